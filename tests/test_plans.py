"""The plans of queries over tables: how often tables are read, and which joins and exchanges there are."""

import re

import pytest
from pyspark.sql import functions as F

from weft import catalog
from weft.plans.once import drifts, once

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return catalog.run(name, spark, SF).df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def count(text, pattern):
    return len(re.findall(pattern, text))


@pytest.mark.parametrize(("name", "scans"), [("sum_max_min_mean", 1), ("join_nest_count", 2), ("join_two_level", 3), ("nth_per_parent", 3), ("count_root", 2), ("first_last_nth", 3), ("semi", 2), ("anti", 2), ("join_empty", 2)])
def test_tables_are_read_once(spark, name, scans):
    assert count(plan(spark, name), r"FileScan") == scans


def test_aggregates_of_a_flow_are_one_pass(spark):
    text = plan(spark, "nth_per_parent")
    assert count(text, r"\bWindow \[") == 2 and count(text, r"(Left|Right)Outer") == 2  # places, number of rows; the first one
    assert count(plan(spark, "join_nest_count"), r"(Left|Right)Outer") == 1


def test_existence_is_a_semi_or_anti_join(spark):
    for name in ("semi", "filter_plural_any"):
        text = plan(spark, name)
        assert "LeftSemi" in text and "Aggregate" not in text
    text = plan(spark, "anti")
    assert "LeftAnti" in text and "Aggregate" not in text


def test_the_rest_of_a_table_is_not_one_task(spark):
    for name in ("drop", "take_neg"):  # the rows that stay meet one row; only those that go are ordered
        rest = plan(spark, name)
        assert "SinglePartition" not in rest and "GlobalLimit" not in rest and "rangepartitioning" not in rest
    assert "TakeOrderedAndProject" in plan(spark, "drop_neg") and "Exchange" not in plan(spark, "drop_neg").split("TakeOrderedAndProject")[1]


def test_plain_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan(spark, "filter_cmp")


def test_one_inequality_makes_no_pairs(spark):
    text = plan(spark, "join_theta_rank")
    # only single rows are broadcast to all: the ranges and their totals
    assert count(text, "CartesianProduct") == 0 and "Window" in text
    assert all("broadcast" not in x or "Inner" in x or "Cross" in x for x in re.findall(r"BroadcastNestedLoopJoin.*", text))
    assert count(text, r"\(\(?\w+#\d+ >= \w+#\d+") == 0


def test_a_parameter_is_computed_once(spark):
    text = plan(spark, "param_knot")
    assert count(text, r"functions=\[avg\(") == 1 and "MergeJoin" not in text and "HashJoin" not in text and "Window" not in text


def test_what_may_differ_when_computed_again(spark):
    table = spark.read.parquet(f"{SF}/orders.parquet")
    means = table.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.max("o_totalprice").alias("top"), F.sum("o_orderkey").alias("n"))
    assert drifts(means) and drifts(means.where("m > 5").select("top")) and drifts(table.select(F.rand()))
    assert not drifts(table) and not drifts(means.select("o_custkey", "top", "n"))
    assert not drifts(once(means)) and sorted(once(means.select("top")).collect()) == sorted(means.select("top").collect())
