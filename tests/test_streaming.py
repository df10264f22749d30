import datetime as dt

from rowkeel.streaming import stream_null_counts, stream_orphans

DAY = dt.datetime(2024, 1, 1)


def _stream(spark, path, rows):
    schema = "ts timestamp, k int, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_null_counts(spark, tmp_path):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    s = _stream(spark, str(tmp_path / "n"), [(at(1), None, 1.0), (at(2), 1, float("nan")), (at(70), 2, None)])
    got = sorted((r.window.start.hour, r.n_rows, r.n_null_k, r.n_null_v) for r in _drain(stream_null_counts(s, "ts"), "null_counts", "complete"))
    assert got == [(0, 2, 1, 1), (1, 1, 0, 1)]


def test_orphans(spark, tmp_path):
    s = _stream(spark, str(tmp_path / "o"), [(DAY, 1, 0.0), (DAY, 9, 0.0), (DAY, 9, 0.0), (DAY, None, 0.0)])
    ref = spark.createDataFrame([(1,), (None,)], "id int")
    assert [r.key for r in _drain(stream_orphans(s, "ts", "k", ref, "id"), "orphans", "append")] == [9]
