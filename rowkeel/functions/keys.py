"""Keys of different types made comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HALF = 2**62
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def canonical_key(c: Column, kind: T.DataType) -> Column:
    """Text with a mark of its kind: 1, 1.0 and true are one key, '1' is another; whole doubles are exact up to 2**115. Null stays null.

    A struct (kind, text), as mixed workbook columns have, keeps the kind of each value.
    """
    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit("n:"), c.cast("int").cast("string"))
    if isinstance(kind, _WHOLE):
        return F.concat(F.lit("n:"), c.cast("string"))
    if isinstance(kind, T.DecimalType):
        return F.concat(F.lit("n:"), F.regexp_replace(c.cast("string"), r"\.0+$|(\.\d*?[1-9])0+$", "$1"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = c.cast("double")  # a float is the double of its value
        # Whole numbers as long as a long holds them, then in two parts: dividing by a power of two is exact.
        high = F.rint(wide / _HALF - F.signum(wide) * 0.5)
        parts = high.cast("long").cast("decimal(19,0)") * F.lit(_HALF).cast("decimal(19,0)") + (wide - high * float(_HALF)).cast("long").cast("decimal(19,0)")
        text = F.when(F.abs(wide) < 2.0**63, wide.cast("long").cast("string")).otherwise(parts.cast("decimal(38,0)").cast("string"))
        whole = (wide == F.rint(wide)) & (F.abs(wide) < 2.0**115)
        return F.concat(F.lit("n:"), F.when(whole, text).otherwise(wide.cast("string")))
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("s:"), c)
    if isinstance(kind, T.StructType) and kind.names == ["kind", "text"]:
        return F.concat(c["kind"], F.lit(":"), c["text"])
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit("t:"), c.cast("timestamp").cast("string"))
    raise TypeError(f"no key can be made of {kind.simpleString()}")


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether two key columns can be joined as they are."""
    return a == b and not isinstance(a, T.StructType) or isinstance(a, _WHOLE) and isinstance(b, _WHOLE)
