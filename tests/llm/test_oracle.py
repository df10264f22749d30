import duckdb
import pytest

from rowkeel.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(got.fetchall())
