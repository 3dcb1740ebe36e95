"""The plans the operators are meant to have."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import sparkscrub as ss
from sparkscrub.operators import duplicates

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_cell_recipe_is_one_stage(spark):
    text = plan(contract.CELL_RECIPE.apply(table(spark, "lineitem")))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("FileScan") == 1
    kinds = set(re.findall(r"^[ :+\-]*(?:\*\(\d+\) )?([A-Z]\w+)", text, re.MULTILINE))
    assert kinds == {"Project", "ColumnarToRow", "FileScan"}


def test_hot_methods_stay_compilable(spark):
    """The JVM leaves methods above 8000 bytes of code uncompiled."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    customer, orders = table(spark, "customer"), table(spark, "orders")
    frames = {
        "recipe": contract.CELL_RECIPE.apply(table(spark, "lineitem")),
        "mask numbers": ss.mask(ss.mask(customer, "c_acctbal"), "c_nationkey"),
        "email": ss.validate_email(customer, "c_name"),
        "date": ss.validate_date(orders, "o_orderdate"),
        "concatenate": ss.concatenate(orders, ["o_totalprice", "o_custkey", "o_orderkey"], "x"),
    }
    for name, df in frames.items():
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes = [int(stages.apply(i)._3().toString().split("(")[1].split(",")[0]) for i in range(stages.size())]
        assert sizes and max(sizes) < 8000, (name, sizes)


@pytest.mark.parametrize("kind", ["email", "phone", "date", "numeric", "alphanumeric", "url"])
def test_validators_do_not_shuffle(spark, kind):
    text = plan(ss.validate(table(spark, "customer"), "c_name", kind))
    assert "Exchange" not in text and "Python" not in text


def test_columns_are_pruned_and_filters_reach_the_scan(spark):
    df = ss.upper(table(spark, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority")
    text = plan(df.where("o_orderkey < 100"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text
    assert "LessThan(o_orderkey,100)" in text


def test_remove_duplicates_leaves_unique_rows_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "_WORTH_MEASURING", 0)
    orders = table(spark, "orders")
    text = plan(ss.remove_duplicates(orders, "o_orderkey", order_by="o_orderkey"))
    assert "Union" in text and text.count("Exchange hashpartitioning") == 1
    assert "partial_min_by" in text.split("Exchange hashpartitioning")[1]
    text = plan(ss.remove_duplicates(orders, "o_custkey", order_by="o_orderkey"))
    assert "Union" not in text and text.count("Exchange") == 1 and text.count("orders.parquet") == 1


def test_marking_pooled_columns_scans_the_table_once(spark):
    df = table(spark, "orders").withColumns({c: F.col("o_custkey") % 3 for c in "abc"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for cols, scans in ((["o_custkey"], 1), (["o_custkey", "o_orderkey", "a", "b", "c"], 0)):
            marked = ss.mark_duplicates(df, cols)
            # Several columns are marked from the numbered rows, which one scan has written.
            assert plan(marked).count("orders.parquet") == scans
            assert plan(marked).count("SortMergeJoin") <= 2
            assert marked.count() == df.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_lookups_are_broadcast(spark):
    for df in (
        ss.distinct_group(table(spark, "part"), "p_brand"),
        ss.mark_duplicates(table(spark, "part"), "p_brand"),
    ):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_automatic_decimals_are_part_of_the_plan(spark):
    lines = table(spark, "lineitem")
    text = plan(ss.calculated_column(lines, "l_extendedprice", "l_tax", "*", "x"))
    assert "Subquery" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_group_codes_do_not_rank_the_data_in_one_task(spark):
    text = plan(ss.distinct_group(table(spark, "orders"), "o_totalprice"))
    scan_side = text.split("BroadcastExchange")[0]
    assert "Window" not in scan_side and "SinglePartition" not in scan_side
