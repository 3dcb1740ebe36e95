"""Duplicates by measured repetition and in one join, changed cells, mergeable profiles."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.operators import duplicates
from sparkscrub.plans import report


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1k")
    yield
    spark.conf.set(setting, before)


@pytest.mark.parametrize("n_cols", [2, 3, 70])
def test_pooled_marks_in_one_join(spark, no_broadcast, n_cols):
    rng = random.Random(n_cols)
    cols = [f"c{i}" for i in range(n_cols)]
    values = [[rng.choice([None, "hot", str(rng.randint(0, 2000 * n_cols))]) for _ in cols] for _ in range(1500)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id int, " + ", ".join(f"{c} string" for c in cols))
    counts = Counter(v for row in values for v in row)
    marked = ss.mark_duplicates(df, cols)
    assert marked.columns == [*df.columns, *[f"{c}__duplicate" for c in cols]]
    for row in marked.collect():
        for i, c in enumerate(cols):
            assert row[c] == values[row["id"]][i]
            assert row[f"{c}__duplicate"] == (counts[row[c]] > 1)


def test_rows_are_shuffled_once_however_many_columns(spark, no_broadcast):
    texts = [F.concat(F.lit("x" * i), (F.col("id") % 700).cast("string")).alias(f"c{i}") for i in range(6)]
    df = spark.range(2000).select("id", *texts, F.lit("wide").alias("rest"))
    shuffles = []
    for n in (2, 6):
        plan = _plan(ss.mark_duplicates(df, [f"c{i}" for i in range(n)]))
        # Only shuffles of whole rows carry the column that nothing is asked about.
        sorts = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert sorts
        shuffles.append(plan.count("SortMergeJoin"))
    assert shuffles[0] == shuffles[1] <= 2


def _first_rows(rows):
    out = {}
    for key, order, value in rows:
        if key not in out or order < out[key][0]:
            out[key] = (order, value)
    return {(k, o, v) for k, (o, v) in out.items()}


@pytest.mark.parametrize("share", [1.0, 0.97, 0.3, 0.0])
def test_both_plans_keep_the_same_rows(spark, monkeypatch, share):
    rng = random.Random(int(share * 100))
    rows = [(str(i) if rng.random() < share else rng.choice([None, "hot", "b"]), i, f"v{i}") for i in rng.sample(range(3000), 3000)]
    df = spark.createDataFrame(rows, "key string, at int, value string").repartition(7)
    asked = []
    measure = duplicates._share_once
    monkeypatch.setattr(duplicates, "_share_once", lambda *a: asked.append(measure(*a)) or asked[-1])
    for worth in (float("inf"), 0):
        monkeypatch.setattr(duplicates, "_WORTH_MEASURING", worth)
        found = ss.remove_duplicates(df, "key", order_by="at")
        assert {tuple(r) for r in found.collect()} == _first_rows(rows)
        assert ("UnionExec" in _plan(found) or "Union" in _plan(found)) == (worth == 0 and share > 0.9), share
    assert len(asked) == 1 and abs(asked[0] - len({k for k, *_ in rows}) / 3000) < 0.05


def test_a_small_table_is_not_measured(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    assert duplicates._estimated_bytes(df) < duplicates._WORTH_MEASURING
    plan = _plan(ss.remove_duplicates(df, "k", order_by="id"))
    assert "Union" not in plan and plan.count("Exchange") == 1


def test_changed_cells(spark):
    schema = "k string, n int, x double, t string, only_old int"
    old = spark.createDataFrame([("a", 1, 1.5, "p", 0), ("b", 2, float("nan"), None, 0), (None, 3, None, "q", 0), ("gone", 4, 0.0, "z", 0)], schema)
    new = spark.createDataFrame(
        [("new", "9", 0.0, "z"), ("a", "1", 2.5, "P"), ("b", "2", float("nan"), "x"), (None, "4", None, "q")],
        "k string, n string, x double, t string",
    )
    found = {tuple(r) for r in ss.cell_diff(old, new, "k").collect()}
    assert found == {
        ("new", None, "added", None, None),
        ("gone", None, "removed", None, None),
        ("a", "x", "changed", "1.5", "2.5"),
        ("a", "t", "changed", "p", "P"),
        ("b", "t", "changed", None, "x"),
        (None, "n", "changed", "3", "4"),
    }
    totals = {tuple(r) for r in ss.changed_cells(old, new, "k").collect()}
    assert totals == {(None, "added", 1), (None, "removed", 1), ("x", "changed", 1), ("t", "changed", 2), ("n", "changed", 1)}
    assert ss.cell_diff(old, old, "k").count() == 0
    assert ss.cell_diff(old, old.where("false"), ["k", "n"], ["x"]).count() == 4
    assert _plan(ss.cell_diff(old, new, "k")).count("Exchange") == 1


def test_nested_cells_and_shared_keys(spark):
    old = spark.createDataFrame([(1, [1, 2], {"a": 1}), (2, [3], {"b": 2})], "k int, list array<int>, map map<string,int>")
    new = spark.createDataFrame([(1, [1, 2], {"a": 5}), (2, [3, 4], {"b": 2})], "k int, list array<int>, map map<string,int>")
    assert {tuple(r) for r in ss.cell_diff(old, new, "k").collect()} == {
        (1, "map", "changed", '{"a":1}', '{"a":5}'),
        (2, "list", "changed", "[3]", "[3,4]"),
    }
    hot = old.unionAll(old.where("k = 2"))
    for pair in ((hot, new), (new, hot)):
        with pytest.raises(Exception, match="two rows have the same k"):
            ss.cell_diff(*pair, "k").collect()


def test_merged_profiles(spark, tmp_path):
    rows = [(i % 9, i, f"t{i % 50}" if i % 10 else None, float(i % 4), [i % 3]) for i in range(4000)]
    df = spark.createDataFrame(rows, "day int, id long, text string, x double, list array<int>").repartition(6)
    once = {r["column"]: r for r in ss.merged_profile(ss.profile_state(df.drop("day"))).collect()}
    ss.profile_state(df, by="day").write.partitionBy("day").parquet(f"{tmp_path}/states")
    days = spark.read.parquet(f"{tmp_path}/states")
    assert days.count() == 9 * 4 and days.agg(F.max(F.length("sketch"))).first()[0] < 4400
    merged = {r["column"]: r for r in ss.merged_profile(days.where("day < 5"), days.where("day >= 5")).collect()}
    exact = {r["column"]: r for r in ss.profile(df.drop("day")).collect()}
    assert merged.keys() == once.keys() == exact.keys()
    for c, r in merged.items():
        for other in (once[c], exact[c]):
            assert (r["type"], r["has_missing"], r["max_width"]) == (other["type"], other["has_missing"], other["max_width"])
            assert abs(r["distinct_values"] - other["distinct_values"]) <= 0.05 * other["distinct_values"]
        assert (r["rows"], r["missing"]) == (4000, 400 if c == "text" else 0)
    assert "FileScan" in _plan(ss.merged_profile(days)) and report.profile_state(df.where("false"), ["id"]).first()["rows"] == 0
