"""Extensions of the audits on small tables: edge cases and plans."""

import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowkeel import FkRule, TableCatalog
from rowkeel import operators as ops

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


small = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
moments = st.one_of(st.none(), st.integers(-3000, 3000))
keyed = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), moments), max_size=14)


@small
@given(left=keyed, right=keyed, strict=st.booleans(), sliced=st.sampled_from([None, "6 hours", "1 day"]))
def test_latest_before(spark, left, right, strict, sliced):
    a = spark.createDataFrame([(i, k, at(m)) for i, (k, m) in enumerate(left)], "i int, k int, t timestamp")
    b = spark.createDataFrame([(i, k, at(m)) for i, (k, m) in enumerate(right)], "id int, k int, t timestamp")
    got = {r.i: r.prior_id for r in ops.latest_before(a, b, ["k"], left_time="t", right_time="t", tie=["id"], strict=strict, slice_width=sliced).collect()}
    for i, (k, m) in enumerate(left):
        fits = [(n, j) for j, (l, n) in enumerate(right) if None not in (k, m, l, n) and l == k and (n < m or n == m and not strict)]
        assert got[i] == (max(fits)[1] if fits else None)
    assert len(got) == len(left)


def test_latest_before_details(spark):
    a = spark.createDataFrame([(1, at(100), "x"), (1, at(100), "x"), (2, at(5), None)], "k int, t timestamp, _right string")
    b = spark.createDataFrame([(1, at(20), None, 5), (1, at(20), "z", 6), (1, at(100), "late", 7)], "k int, t timestamp, v string, n int")
    got = ops.latest_before(a, b, ["k"], left_time="t", right_time="t", tie=["v"])
    assert got.columns == ["k", "t", "_right", "prior_k", "prior_t", "prior_v", "prior_n"]
    assert [(r.k, r._right, r.prior_v, r.prior_n) for r in got.orderBy("k").collect()] == [(1, "x", "z", 6)] * 2 + [(2, None, None, None)]
    near = ops.latest_before(a, b, ["k"], left_time="t", right_time="t", tie=["v"], within=F.expr("INTERVAL '1' HOUR"))
    assert [r.prior_n for r in near.collect()] == [None] * 3
    assert ops.latest_before(a.where("false"), b, ["k"], left_time="t", right_time="t").count() == 0
    assert ops.latest_before(a, b.where("false"), ["k"], left_time="t", right_time="t", slice_width="1 hour").where("prior_n IS NULL").count() == 3
    with pytest.raises(TypeError):
        ops.latest_before(a, b.withColumn("k", F.col("k").cast("string")), ["k"], left_time="t", right_time="t")
    text = plan(ops.latest_before(a, b, ["k"], left_time="t", right_time="t"))
    assert "Join" not in text and len(re.findall("Exchange hashpartitioning", text)) == 1 and "Python" not in text


spans = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 1)), moments, moments), max_size=8)


@small
@given(points=keyed, spans=spans, width=st.sampled_from(["10 minutes", "1 day"]), slots=st.sampled_from([1, 3, 1000]), salts=st.sampled_from([1, 3]), on=st.booleans())
def test_interval_join(spark, points, spans, width, slots, salts, on):
    p = spark.createDataFrame([(i, k, at(m)) for i, (k, m) in enumerate(points)], "i int, k int, t timestamp")
    s = spark.createDataFrame([(j, k, at(a), at(z)) for j, (k, a, z) in enumerate(spans)], f"j int, {'k' if on else 'other'} int, a timestamp, z timestamp")
    got = rows(ops.interval_join(p, s, time="t", start="a", end="z", on=["k"] if on else [], width=width, max_slots=slots, salts=salts).select("i", "j"))
    assert got == sorted((i, j) for i, (k, m) in enumerate(points) for j, (l, a, z) in enumerate(spans) if None not in (m, a, z) and a <= m < z and (not on or (k is not None and k == l)))


def test_interval_join_plan(spark):
    p = spark.range(1000).select("id", F.timestamp_seconds("id").alias("t"))
    s = spark.range(50).select(F.col("id").alias("j"), F.timestamp_seconds(F.col("id") * 20).alias("a"), F.timestamp_seconds(F.col("id") * 20 + 30).alias("z"))
    met = ops.interval_join(p, s, time="t", start="a", end="z", width="1 minute")
    text = plan(met)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert met.count() == sum(20 * j <= i < 20 * j + 30 for i in range(1000) for j in range(50))
    # A span of a million slots is copied to no more than max_slots + 1.
    far = spark.createDataFrame([(1, DAY, DAY + dt.timedelta(minutes=10**6))], "j int, a timestamp, z timestamp")
    one = spark.createDataFrame([(1, DAY + dt.timedelta(minutes=999_999)), (2, DAY + dt.timedelta(minutes=10**6))], "i int, t timestamp")
    assert rows(ops.interval_join(one, far, time="t", start="a", end="z", width="1 minute", max_slots=8).select("i", "j")) == [(1, 1)]
    with pytest.raises(ValueError):
        ops.interval_join(p, s.withColumn("id", F.lit(1)), time="t", start="a", end="z")


def test_sessions_edges(spark):
    e = spark.createDataFrame([(1, at(0)), (1, at(29)), (1, at(58)), (1, at(88)), (1, at(119)), (1, at(200)), (1, at(200)), (None, at(0)), (2, None)], "u int, ts timestamp")
    got = sorted(((r.u or 0, (r.session_start - DAY).seconds // 60, (r.session_last - DAY).seconds // 60, r.n_events) for r in ops.sessions(e, ["u"], "ts").collect()))
    assert got == [(0, 0, 0, 1), (1, 0, 88, 4), (1, 119, 119, 1), (1, 200, 200, 2)]  # a pause of exactly the gap is within a session
    assert ops.sessions(e.where("false"), ["u"], "ts").count() == 0


def test_sessions_of_a_stream(spark, tmp_path):
    """Late rows within the watermark join sessions into one; later ones are dropped."""
    schema, path = "u int, ts timestamp", str(tmp_path / "in")
    batches = [[(1, at(0)), (1, at(40))], [(1, at(20))], [(1, at(300))], [(1, at(10))], [(1, at(600))]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = ops.sessions(stream, ["u"], "ts", late="1 hour")
    q = found.writeStream.format("memory").queryName("session_rows").outputMode("append").start()
    try:
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
            q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(((r.session_start - DAY).seconds // 60, (r.session_last - DAY).seconds // 60, r.n_events) for r in spark.table("session_rows").collect())
    assert got == [(0, 40, 3), (300, 300, 1)]


@small
@given(values=st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.integers(-9, 9))), max_size=25), fall=st.booleans(), parts=st.sampled_from([1, 3, 7]))
def test_running_totals(spark, values, fall, parts):
    df = spark.createDataFrame([(i, o, v, "c") for i, (o, v) in enumerate(values)], "i int, o int, v int, _part string")
    got = {r.i: (r.run, r.run_whole, r._part) for r in ops.running_totals(df, ["o DESC" if fall else "o", "i"], {"run": F.col("v")}, parts=parts).collect()}
    line = sorted(range(len(values)), key=lambda i: ((values[i][0] is not None) != fall, (-1 if fall else 1) * (values[i][0] or 0), i))
    total, whole = 0, sum(v or 0 for _, v in values)
    for i in line:
        total += values[i][1] or 0
        assert got[i] == (total, whole, "c")
    assert len(got) == len(values)


def test_running_totals_bring_no_rows_together(spark):
    df = spark.range(10_000, numPartitions=4).withColumn("v", F.col("id") % 10)
    out = ops.running_totals(df, ["id DESC"], {"run": F.col("v")})
    text = plan(out)
    # The one single partition is that of the sums, a row a range, and feeds a broadcast.
    assert len(re.findall("Exchange SinglePartition", text)) == 1 and "BroadcastHashJoin" in text
    assert out.agg(F.max("run"), F.min("run_whole")).first()[:] == (45_000, 45_000)


def catalog(spark, **tables):
    return TableCatalog({n: spark.createDataFrame(r, s) for n, (r, s) in tables.items()})


def test_cascade_with_cycles(spark):
    """a -> b -> c -> a is a cycle with a way in from r; d hangs on c and, nearer, on r."""
    t = catalog(
        spark,
        r=([(1,), (2,)], "r int"),
        a=([(10, 1, None), (11, None, 31), (12, 2, None)], "a int, r int, c int"),
        b=([(20, 10), (21, 11), (22, 99)], "b int, a int"),
        c=([(30, 20), (31, 20), (32, None)], "c int, b int"),
        d=([(40, 30, None), (41, 31, 1.0), (42, None, None)], "d int, c string, r double"),
        e=([(1,)], "e int"),
    )
    t.register("d", t.require("d").withColumn("c", F.col("c").cast("int")))
    rules = [FkRule("1", "a", "r", "r", "r"), FkRule("2", "a", "c", "c", "c"), FkRule("3", "b", "a", "a", "a"), FkRule("4", "c", "b", "b", "b"), FkRule("5", "d", "c", "c", "c"), FkRule("6", "d", "r", "r", "r"), FkRule("7", "e", "none", "r", "r")]
    found = {n: rows(df) for n, df in ops.cascade(t, rules, {"r": F.col("r") == 1}).items()}
    assert found == {"r": [(1, 0)], "a": [(10, 1, None, 1), (11, None, 31, 4)], "b": [(20, 10, 2), (21, 11, 5)], "c": [(30, 20, 3), (31, 20, 3)], "d": [(40, 30, None, 4), (41, 31, 1.0, 1)]}
    counts = rows(ops.cascade_counts(t, rules, {"r": F.col("r") == 1}))
    assert ("d", 1, 1) in counts and ("b", 5, 1) in counts and len(counts) == 8
    assert rows(ops.cascade_counts(t, rules, {"r": F.col("r") == 7})) == []
    with pytest.raises(KeyError):
        ops.cascade(t, rules, {"none": F.lit(True)})
    with pytest.raises(ValueError):
        ops.cascade_counts(t, [], {})


edges = st.lists(st.tuples(st.integers(0, 9), st.one_of(st.none(), st.integers(0, 9))), max_size=14)


@settings(small, max_examples=6)
@given(edges=edges)
def test_cascade_of_a_self_reference(spark, edges):
    t = catalog(spark, n=([(i, k, p) for i, (k, p) in enumerate(edges)], "i int, k int, p int"))
    got = {r.i: r.depth for r in ops.cascade(t, [FkRule("s", "n", "p", "n", "k")], {"n": F.col("k") == 0})["n"].collect()}
    depth = {i: 0 for i, (k, _) in enumerate(edges) if k == 0}
    for d in range(12):
        for i, (_, p) in enumerate(edges):
            if p is not None and any(edges[j][0] == p and x <= d for j, x in depth.items()):
                depth[i] = min(depth.get(i, 99), d + 1)
    assert got == depth


bag = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.sampled_from([0.0, 1.5, float("nan")])), st.sampled_from(["", "x", None])), max_size=10)


@small
@given(old=bag, new=bag, buckets=st.sampled_from([1, 2, 64]))
def test_difference(spark, old, new, buckets):
    from collections import Counter

    a, b = (spark.createDataFrame(x, "k int, v double, w string") for x in (old, new))
    got = {r.k: (r.change, r.n_old, r.n_new, r.columns) for r in ops.table_difference(a, b.select("w", "v", "k"), ["k"], buckets=buckets).collect()}
    same = lambda r: (r[0], "nan" if r[1] != r[1] else r[1], r[2])
    was, now, want = Counter(map(same, old)), Counter(map(same, new)), {}
    for k in {r[0] for r in [*was, *now]}:
        x, y = (Counter({r: n for r, n in c.items() if r[0] == k}) for c in (was, now))
        if x != y:
            n, m = sum(x.values()), sum(y.values())
            columns = [c for c, i in (("v", 1), ("w", 2)) if next(iter(x))[i] != next(iter(y))[i]] if n == m == 1 else None
            want[k] = ("added" if not n else "gone" if not m else "changed", n, m, columns)
    assert got == want


def test_difference_reads_only_touched_leaves(spark):
    a = spark.range(5000).withColumn("v", F.col("id") % 7)
    b = a.withColumn("v", F.when(F.col("id") == 77, 100).otherwise(F.col("v")))
    out = ops.table_difference(a, b, ["id"])
    assert rows(out) == [(77, "changed", 1, 1, ["v"])]
    assert "LeftSemi" in plan(out)
    with pytest.raises(ValueError):
        ops.table_difference(a, b.withColumnRenamed("v", "w"), ["id"])
    with pytest.raises(ValueError):
        ops.table_difference(a, b, ["nope"])


def test_sketches_merge(spark):
    rows = [(g, f"u{i % (300 * (g + 1))}", float(i), i % 50) for g in range(3) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, u string, v double, w int")
    fine = ops.sketch(df, ["g", (F.col("w") % 2).alias("half")], distinct=["u", "w", "v"], quantiles=["v"])
    merged = {r.g: r for r in ops.read_sketches(ops.merge_sketches(fine, ["g"]), shares=[0.25, 0.5]).collect()}
    whole = {r.g: r for r in ops.read_sketches(ops.sketch(df, ["g"], distinct=["u", "w", "v"], quantiles=["v"]), shares=[0.25, 0.5]).collect()}
    for g in range(3):
        for got in (merged[g], whole[g]):
            assert got.n_rows == 4000 and abs(got.n_u - 300 * (g + 1)) <= 300 * (g + 1) * ops.distinct_error() and got.n_w == 50
            assert abs(got.n_v - 4000) <= 4000 * ops.distinct_error()
            assert all(abs(q - share * 4000) <= ops.rank_error() * 4000 for q, share in ((got.q25_v, 0.25), (got.q50_v, 0.5)))
    text = plan(ops.sketch(df, ["g"], distinct=["u"]))
    assert "partial_hll_sketch_agg" in text and len(re.findall("Exchange hashpartitioning", text)) == 1


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, float("nan")), (2, "x", 5.0)], "g int, u string, v double")
    held = ops.sketch(df, ["g"], distinct=["u"], quantiles=["v"])
    got = sorted(map(tuple, ops.read_sketches(ops.merge_sketches(held, ["g"])).collect()))
    assert got == [(1, 2, 0, None), (2, 1, 1, 5.0)]
    assert ops.read_sketches(ops.sketch(df.where("false"), ["g"], distinct=["u"], quantiles=["v"])).count() == 0


NESTED = "i int, s struct<a: double, t: array<struct<x: int, y: array<string>>>>, m map<string, struct<p: int>>"


def test_nested_types(spark):
    nan = float("nan")
    rows_ = [
        (1, (nan, [(1, ["a", None]), None, (None, None)]), {"k": (1,), "l": None}),
        (None, (2.0, None), {}),
        (3, None, None),
        (4, (None, []), {"k": (None,)}),
    ]
    df = spark.createDataFrame(rows_, NESTED)
    got = {r.path: (r.n_null, r.n_rows, r.pct_null) for r in ops.nested_null_profile(df, ["i", "s", "m"]).collect()}
    assert got == {
        "i": (1, 4, 25.0),
        "s": (1, 4, 25.0),
        "s.a": (3, 4, 75.0),
        "s.t": (2, 4, 50.0),
        "s.t[]": (1, 3, 33.3),
        "s.t[].x": (2, 3, 66.7),
        "s.t[].y": (2, 3, 66.7),
        "s.t[].y[]": (1, 2, 50.0),
        "m": (1, 4, 25.0),
        "m{}": (1, 3, 33.3),
        "m{}.p": (2, 3, 66.7),
    }
    none = {r.path: (r.n_null, r.n_rows, r.pct_null) for r in ops.nested_null_profile(df.where("false"), ["i", "m"]).collect()}
    assert none == {p: (0, 0, None) for p in ("i", "m", "m{}", "m{}.p")}
    assert len(re.findall("Scan", plan(ops.nested_null_profile(df, ["i", "s", "m"])))) == 1


def test_nested_json(spark):
    texts = ['{"a": 1, "b": {"c": null, "d": "x"}}', '{"a": null, "b": {}}', '{"b": null}', "no json", None, '{"a": 2.5, "b": {"d": 7}, "e": [1, null]}', "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = {r.path: (r.n_null, r.n_rows) for r in ops.nested_null_profile(df.where("coalesce(j, '') not like '[%'"), ["j"], json=("j",)).collect()}
    assert got == {"j": (2, 6), "j.a": (4, 6), "j.b": (3, 6), "j.b.c": (6, 6), "j.b.d": (4, 6), "j.e": (5, 6), "j.e[]": (1, 2)}
    # Objects here and an array there: the whole is one variant.
    assert {r.path: r.n_null for r in ops.nested_null_profile(df, ["j"], json=("j",)).collect()} == {"j": 2}
    assert [(r.path, r.n_null, r.n_rows) for r in ops.nested_null_profile(df.where("false"), ["j"], json=("j",)).collect()] == [("j", 0, 0)]


def test_levels(spark):
    t = catalog(spark, a=([(1, "x"), (2, None), (9, "x"), (None, None)], "k int, src string"), b=([(1.0, 5), (float("nan"), 6)], "f double, n int"), r=([(1,), (2,)], "k int"))
    got = {(r.level, r.table_name, r.source): (r.n_rows, r.n_values, r.n_null, r.n_refs, r.n_orphans, r.pct_orphans) for r in ops.level_profile(t, {"a": "src", "b": "f"}, [FkRule("1", "a", "k", "r", "k")]).collect()}
    assert got == {
        ("source", "a", "x"): (2, 4, 0, 2, 1, 50.0),
        ("source", "a", None): (2, 4, 3, 1, 0, 0.0),
        ("source", "b", "1.0"): (1, 2, 0, 0, 0, None),
        ("source", "b", None): (1, 2, 1, 0, 0, None),
        ("table", "a", None): (4, 8, 3, 3, 1, 33.3),
        ("table", "b", None): (2, 4, 1, 0, 0, None),
        ("all", None, None): (6, 12, 4, 3, 1, 33.3),
    }
    with pytest.raises(KeyError):
        ops.level_profile(t, {"a": "nope"})
    with pytest.raises(ValueError):
        ops.level_profile(t, {})
