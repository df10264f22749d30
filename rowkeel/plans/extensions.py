"""Queries of the extensions: what the reference's audits only name, over the test tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..catalog import TableCatalog
from ..retrieval import chunk_words, rank_documents
from ..rules import FkRule, parse_fk_rules
from ..shared import saved
from ..sources.parquet_dir import load_directory


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prior_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest purchase of the same user before it."""
    events = _table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    found = ops.latest_before(events.select("event_id", "user_id", "ts"), bought, ["user_id"], left_time="ts", right_time="ts", tie=["event_id"], slice_width="7 days")
    return found.select("event_id", "prior_event_id", "prior_value")


def prior_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the customer's latest one of an earlier day: the last by key of that day. At most a year back."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    found = ops.latest_before(orders, orders, ["o_custkey"], left_time="o_orderdate", right_time="o_orderdate", tie=["o_orderkey"], within=F.expr("INTERVAL '365' DAY"))
    return found.select("o_orderkey", "prior_o_orderkey")


def order_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order opens a promotion for its customer of 1 to 36 hours: the events that fall into them."""
    events = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("customer"), "ts")
    begin = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(o_orderkey % 720{}))"
    spans = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.expr(begin.format("")).alias("begins"), F.expr(begin.format(" + 1 + o_orderkey % 36")).alias("ends"))
    return ops.interval_join(events, spans, time="ts", start="begins", end="ends", on=["customer"], width="6 hours").select("event_id", "o_orderkey")


def nation_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions of nations, of an hour to nine days, without a key: how many events each saw, and of what value in cents."""
    events = _table(spark, sf_dir, "events").select("ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    begin = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(n_nationkey), int({}))"
    spans = _table(spark, sf_dir, "nation").select("n_nationkey", F.expr(begin.format("0")).alias("begins"), F.expr(begin.format("1 + n_nationkey % 10 * 24")).alias("ends"))
    met = ops.interval_join(events, spans, time="ts", start="begins", end="ends", width="1 hour", max_slots=16, salts=4)
    return met.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_events"), F.sum("cents").alias("cents"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with pauses of no more than half an hour."""
    events = _table(spark, sf_dir, "events").select("user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"), "event_type")
    return ops.sessions(events, ["user_id"], "ts", gap="30 minutes", aggregates={"cents": F.sum("cents"), "n_types": F.count_distinct("event_type")})


def pareto_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the value of their orders, largest first, with the share of all value that they and those before them make."""
    by = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    found = ops.running_totals(by, ["cents DESC", "o_custkey"], {"running": F.col("cents"), "place": F.lit(1)})
    return found.select("o_custkey", "cents", "place", "running", (F.col("running") / F.col("running_whole")).alias("share"))


CASCADE_RULES = parse_fk_rules(
    """
    T01 nation.n_regionkey -> region.r_regionkey
    T02 customer.c_nationkey -> nation.n_nationkey
    T03 supplier.s_nationkey -> nation.n_nationkey
    T04 orders.o_custkey -> customer.c_custkey
    T05 lineitem.l_orderkey -> orders.o_orderkey
    T06 lineitem.l_partkey -> part.p_partkey
    T07 lineitem.l_suppkey -> supplier.s_suppkey
    T08 events.user_id -> customer.c_custkey
    """
)


def fk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on one region, by table and depth; a line item hangs on its supplier or, one step further, on its order."""
    t = load_directory(spark, sf_dir, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"])
    return ops.cascade_counts(t, CASCADE_RULES, {"region": F.col("r_regionkey") == 2})


def fk_cascade_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a tree that refers to itself (the first order is its own parent), and the line items under one branch."""
    t = load_directory(spark, sf_dir, ["orders", "lineitem"])
    chain = t.require("orders").select("o_orderkey", F.expr("o_orderkey div 3").alias("parent"))
    t = TableCatalog({"chain": chain, "lineitem": t.require("lineitem")})
    rules = parse_fk_rules("Y01 chain.parent -> chain.o_orderkey\nY02 lineitem.l_orderkey -> chain.o_orderkey")
    return ops.cascade_counts(t, rules, {"chain": F.col("o_orderkey") == 1})


def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of orders: some left out of each, some dearer in the second, some twice in it."""
    orders = _table(spark, sf_dir, "orders")
    names = ("o_orderkey", "o_custkey", "cents", "o_orderpriority")
    rows = orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    old = rows.where("o_orderkey % 50 <> 0").select(*names)
    new = rows.where("o_orderkey % 53 <> 0").withColumn("cents", F.when(F.col("o_orderkey") % 37 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    new = new.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 111 != 0, F.col("o_orderpriority"))).select(*names)
    new = new.unionByName(new.where("o_orderkey % 41 = 0"))
    found = ops.table_difference(old, new, ["o_orderkey"])
    return found.select("o_orderkey", "change", "n_old", "n_new", F.array_join("columns", ",").alias("columns"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 200 words, 40 of them shared with the next, of whole texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_words(docs, size=200, overlap=40).select("doc_id", "chunk", "start", "end", "n_words", F.sha2("chunk_text", 256).alias("sha256"))


def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank best for each benchmark question."""
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and values of events by day from sketches by day and type, merged; beside exact figures, whether the estimates keep their bounds."""
    events = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    fine = saved(ops.sketch(events, ["day", "event_type"], distinct=["user_id"], quantiles=["value"]))
    told = ops.read_sketches(ops.merge_sketches(fine, ["day"]), shares=[0.5, 0.95]).withColumnRenamed("n_rows", "n_sketched")
    exact = events.join(told.select("day", "q50_value", "q95_value"), "day").groupBy("day").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("users"), *[F.avg((F.col("value") < F.col(q)).cast("double")).alias(f"below_{q}") for q in ("q50_value", "q95_value")], *[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"upto_{q}") for q in ("q50_value", "q95_value")]
    )
    met = exact.join(told, "day")
    near = lambda q, share: (F.col(f"below_{q}") <= share + ops.rank_error()) & (F.col(f"upto_{q}") >= share - ops.rank_error())
    users = F.abs(F.col("n_user_id") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * ops.distinct_error())
    return met.select("day", "n_rows", "users", (F.col("n_sketched") == F.col("n_rows")).alias("rows_ok"), users.alias("users_ok"), near("q50_value", 0.5).alias("median_ok"), near("q95_value", 0.95).alias("q95_ok"))


def nested_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values by path in the JSON of events: that of props, and of documents made from all columns, some of them no JSON."""
    events = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    who = F.struct(F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user"), F.when(F.col("value") > 50, F.col("event_type")).alias("type"))
    made = F.to_json(F.struct(F.when(F.col("k") % 5 != 0, F.col("k")).alias("k"), who.alias("who"), F.array("event_type", F.when(F.col("k") % 2 == 0, F.lit("even"))).alias("tags")))
    docs = events.select("props", F.when(F.col("event_id") % 100 == 7, F.lit("{no json")).otherwise(made).alias("doc"), F.array(F.col("value"), F.when(F.col("k") > 50, F.lit(1.0))).alias("list"))
    return ops.nested_null_profile(docs, ["props", "doc", "list"], json=("props", "doc"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values and orphan rows by table and source, by table and in all."""
    t = load_directory(spark, sf_dir, ["orders", "lineitem", "customer", "documents", "labels"])
    orders = t.require("orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    t.register("orders", orders)
    t.register("finished", orders.where("o_orderstatus = 'F'"))
    t.register("known", t.require("customer").where("c_nationkey % 5 <> 0"))
    t.register("rated", t.require("documents").select("doc_id", "source").join(t.require("labels"), "doc_id", "left"))
    rules = [FkRule("1", "orders", "o_custkey", "known", "c_custkey"), FkRule("2", "lineitem", "l_orderkey", "finished", "o_orderkey"), FkRule("3", "lineitem", "l_orderkey", "orders", "o_orderkey")]
    return ops.level_profile(t, {"orders": "o_orderstatus", "lineitem": "l_linestatus", "rated": "source"}, rules)


ALL = (prior_purchase, prior_order, order_promotions, nation_promotions, user_sessions, pareto_customers, fk_cascade, fk_cascade_cycle, table_versions, document_chunks, bm25_documents, daily_sketches, nested_nulls, levels)

_CENTS = "round({} * 100)::BIGINT"
SQL = {
    "prior_purchase": "WITH p AS (SELECT user_id, ts, event_id AS k, value AS v FROM events WHERE event_type = 'purchase') "
    "SELECT e.event_id, p.k AS prior_event_id, p.v AS prior_value FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts",
    "prior_order": "WITH p AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY ALL) "
    "SELECT o.o_orderkey, CASE WHEN p.o_orderdate + INTERVAL 365 DAY >= o.o_orderdate THEN p.k END AS prior_o_orderkey FROM orders o ASOF LEFT JOIN p ON o.o_custkey = p.o_custkey AND o.o_orderdate > p.o_orderdate",
    "order_promotions": "SELECT event_id, o_orderkey FROM events JOIN orders ON user_id = o_custkey AND ts >= TIMESTAMP '2024-01-01' + to_hours(o_orderkey % 720) AND ts < TIMESTAMP '2024-01-01' + to_hours(o_orderkey % 720 + 1 + o_orderkey % 36)",
    "nation_promotions": f"SELECT n_nationkey, count(*) AS n_events, sum({_CENTS.format('value')})::BIGINT AS cents FROM events JOIN nation ON ts >= TIMESTAMP '2024-01-01' + to_hours(n_nationkey * 24) AND ts < TIMESTAMP '2024-01-01' + to_hours(n_nationkey * 24 + 1 + n_nationkey % 10 * 24) GROUP BY 1",
    "user_sessions": "WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), "
    "g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) "
    f"SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n_events, sum({_CENTS.format('value')})::BIGINT AS cents, count(DISTINCT event_type) AS n_types FROM g GROUP BY user_id, g",
    "pareto_customers": f"WITH c AS (SELECT o_custkey, sum({_CENTS.format('o_totalprice')})::BIGINT AS cents FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER w AS place, (sum(cents) OVER w)::BIGINT AS running FROM c WINDOW w AS (ORDER BY cents DESC, o_custkey ROWS UNBOUNDED PRECEDING)) "
    "SELECT *, running::DOUBLE / (SELECT sum(cents) FROM c)::DOUBLE AS share FROM r",
    "fk_cascade": "WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)), "
    "o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), e AS (SELECT event_id FROM events WHERE user_id IN (FROM c)), "
    "l AS (SELECT CASE WHEN l_suppkey IN (FROM s) THEN 3 WHEN l_orderkey IN (FROM o) THEN 4 END AS depth FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, {d} AS depth, count(*) AS n_rows FROM {src} HAVING count(*) > 0" for t, d, src in (("region", 0, "region WHERE r_regionkey = 2"), ("nation", 1, "n"), ("customer", 2, "c"), ("supplier", 2, "s"), ("orders", 3, "o"), ("events", 3, "e")))
    + " UNION ALL SELECT 'lineitem' AS table_name, depth, count(*) AS n_rows FROM l WHERE depth IS NOT NULL GROUP BY depth",
    "fk_cascade_cycle": "WITH RECURSIVE r AS (SELECT o_orderkey AS id, 0 AS depth FROM orders WHERE o_orderkey = 1 UNION ALL SELECT o_orderkey, depth + 1 FROM orders JOIN r ON o_orderkey // 3 = id WHERE o_orderkey <> id) "
    "SELECT 'chain' AS table_name, depth, count(*) AS n_rows FROM r GROUP BY depth UNION ALL SELECT 'lineitem', depth + 1, count(*) FROM lineitem JOIN r ON l_orderkey = id GROUP BY depth",
    "table_versions": f"WITH r AS (SELECT o_orderkey, o_orderkey % 50 <> 0 AS a, o_orderkey % 53 <> 0 AS b, o_orderkey % 37 = 0 AS dearer, o_orderkey % 111 = 0 AND o_orderpriority IS NOT NULL AS blank, CASE WHEN o_orderkey % 41 = 0 THEN 2 ELSE 1 END AS n FROM orders) "
    "SELECT o_orderkey, CASE WHEN NOT a THEN 'added' WHEN NOT b THEN 'gone' ELSE 'changed' END AS change, a::BIGINT AS n_old, b::BIGINT * n AS n_new, "
    "CASE WHEN a AND b AND n = 1 THEN concat_ws(',', CASE WHEN dearer THEN 'cents' END, CASE WHEN blank THEN 'o_orderpriority' END) END AS columns FROM r WHERE (a <> b) OR (a AND b AND (dearer OR blank OR n = 2))",
    "document_chunks": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS w, length(regexp_extract(text, '^[\x20\x09-\x0D]+')) AS lead FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, greatest(1, ceil((len(w) - 40) / 160))::INT AS n FROM t WHERE len(w) > 0),
c AS (SELECT *, unnest(range(n))::INT AS chunk FROM n),
x AS (SELECT doc_id, chunk, lead + length(array_to_string(list_slice(w, 1, chunk * 160), '')) AS start, least(200, len(w) - chunk * 160)::INT AS n_words,
             regexp_replace(array_to_string(list_slice(w, chunk * 160 + 1, chunk * 160 + 200), ''), '[\x20\x09-\x0D]+$', '') AS chunk_text FROM c)
SELECT doc_id, chunk, start, start + length(chunk_text) AS "end", n_words, sha256(chunk_text) AS sha256 FROM x
""",
    "bm25_documents": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM documents),
size AS (SELECT doc_id, len(w) AS size FROM d),
whole AS (SELECT count(*) AS n, sum(size) / count(*) AS mean FROM size),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT n FROM whole) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
scored AS (SELECT item_id, doc_id, sum(round(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT mean FROM whole))) * 1e6)::BIGINT)::BIGINT AS score
           FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN size USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored QUALIFY rank <= 10
""",
    "daily_sketches": "SELECT ts::DATE AS day, count(*) AS n_rows, count(DISTINCT user_id) AS users, true AS rows_ok, true AS users_ok, true AS median_ok, true AS q95_ok FROM events GROUP BY 1",
    "nested_nulls": "WITH e AS (SELECT *, (props->>'$.k')::INT AS k, event_id % 100 = 7 AS bad FROM events), "
    "c AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE bad OR k % 5 = 0) AS k, count(*) FILTER (WHERE NOT bad AND k % 2 <> 0) AS tag, count(*) FILTER (WHERE bad OR value <= 50) AS type, "
    "count(*) FILTER (WHERE bad OR user_id % 3 = 0) AS usr, count(*) FILTER (WHERE k <= 50) AS second FROM e), "
    "p AS (" + " UNION ALL ".join(f"SELECT '{p}' AS path, ({a})::BIGINT AS n_null, ({n})::BIGINT AS n_rows FROM c" for p, a, n in (("props", 0, "n"), ("props.k", 0, "n"), ("doc", "bad", "n"), ("doc.k", "k", "n"), ("doc.tags", "bad", "n"), ("doc.tags[]", "tag", "2 * (n - bad)"), ("doc.who", "bad", "n"), ("doc.who.type", "type", "n"), ("doc.who.user", "usr", "n"), ("list", 0, "n"), ("list[]", "second", "2 * n"))) + ") "
    "SELECT *, round_even(n_null / n_rows * 100, 1) AS pct_null FROM p",
    "levels": "WITH o AS (SELECT *, nullif(o_orderstatus, 'P') AS source FROM orders), k AS (SELECT c_custkey FROM customer WHERE c_nationkey % 5 <> 0), f AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), "
    "x AS (SELECT 'orders' AS table_name, source, 6 AS v, (source IS NULL)::INT AS m, 1 AS refs, (o_custkey NOT IN (FROM k))::INT AS lost FROM o "
    "UNION ALL SELECT 'lineitem', l_linestatus, 11, 0, 2, (l_orderkey NOT IN (FROM f))::INT + (l_orderkey NOT IN (SELECT o_orderkey FROM orders))::INT FROM lineitem "
    "UNION ALL SELECT 'rated', source, 4, (doc_id IS NULL)::INT + (source IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT, 0, 0 FROM documents LEFT JOIN labels USING (doc_id)), "
    "g AS (SELECT CASE grouping(table_name, source) WHEN 0 THEN 'source' WHEN 1 THEN 'table' ELSE 'all' END AS level, table_name, source, count(*) AS n_rows, sum(v)::BIGINT AS n_values, sum(m)::BIGINT AS n_null, sum(refs)::BIGINT AS n_refs, sum(lost)::BIGINT AS n_orphans "
    "FROM x GROUP BY GROUPING SETS ((table_name, source), (table_name), ())) "
    "SELECT level, table_name, source, n_rows, n_values, n_null, round_even(n_null / n_values * 100, 1) AS pct_null, n_refs, n_orphans, CASE WHEN n_refs > 0 THEN round_even(n_orphans / n_refs * 100, 1) END AS pct_orphans FROM g",
}
