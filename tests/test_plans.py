"""The plans the audits should get."""

import re

from rowkeel import operators as ops
from rowkeel.plans.registry import CARDINALITY_RULES, FK_RULES, _tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fk_check_shuffles_each_side_once(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ops.fk_check(_tables(spark, sf_dir, "lineitem", "orders"), [FK_RULES[4]]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The join reuses the partitioning of the distinct keys; nulls are dropped and columns pruned in the scan.
    assert len(re.findall("Exchange hashpartitioning", text)) == 2 and "Python" not in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint>", text) and re.search(r"PushedFilters: \[IsNotNull\(l_orderkey\)\]", text)


def test_cardinality_joins_nothing(spark, sf_dir):
    text = plan(ops.cardinality_profile(_tables(spark, sf_dir, "lineitem", "orders"), [CARDINALITY_RULES[4]]))
    assert "Join" not in text and "Cartesian" not in text and len(re.findall("FileScan", text)) == 2


def test_null_profile_scans_once(spark, sf_dir):
    text = plan(ops.null_profile(_tables(spark, sf_dir, "lineitem")))
    assert len(re.findall("FileScan", text)) == 1 and "Exchange hashpartitioning" not in text


def test_long_form_reads_a_reference_once(spark, sf_dir):
    rules = [r for r in FK_RULES if r.ref_table == "customer"]
    text = plan(ops.fk_check_long(_tables(spark, sf_dir, "orders", "events", "customer"), rules))
    assert len(rules) == 2 and len(re.findall(r"FileScan parquet \[c_custkey", text)) == 1
