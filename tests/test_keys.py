"""Keys of different types are one key where Python holds them equal."""

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.functions.keys import canonical_key

WHOLE = [0, 1, -1, 7, 10**15 - 1, 10**15, 2 * 10**15, 2**53 - 1, 2**53, 2**53 + 2, -(2**53), 10**18, 2**60, 2**62, 2**63 - 1, -(2**63)]


def keys(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("k", kind)]))
    return [r.k for r in df.select(canonical_key(F.col("k"), kind).alias("k")).collect()]


def test_whole_numbers(spark):
    got = {}
    for kind, of in ((T.LongType(), int), (T.DoubleType(), float), (T.FloatType(), lambda v: float(np.float32(v))), (T.DecimalType(38, 0), Decimal)):
        values = [of(v) for v in WHOLE]
        for v, k in zip(values, keys(spark, values, kind)):
            got.setdefault(k, []).append(v)
    groups = list(got.values())
    assert all(a == b for g in groups for a in g for b in g)
    for i, g in enumerate(groups):
        assert all(g[0] != h[0] for h in groups[:i])


def test_beyond_longs_and_fractions(spark):
    big = [2.0**63, 2.0**64 + 2.0**12, -(2.0**70), 2.0**100 + 2.0**60]
    assert keys(spark, big, T.DoubleType()) == [f"n:{int(v)}" for v in big] == keys(spark, [Decimal(int(v)) for v in big], T.DecimalType(38, 0))
    assert keys(spark, [-0.0, 0.5, 1.5], T.DoubleType()) == ["n:0", "n:0.5", "n:1.5"]
    assert keys(spark, [float(np.float32(0.1))], T.FloatType()) == keys(spark, [float(np.float32(0.1))], T.DoubleType()) != keys(spark, [0.1], T.DoubleType())
    assert keys(spark, [True, False, None], T.BooleanType()) == ["n:1", "n:0", None] and keys(spark, ["1"], T.StringType()) == ["s:1"]
