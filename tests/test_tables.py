"""Duplicates, group codes, slices, reports, recipes: whole-table results, however partitioned."""

import pytest
from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.plans.lookup import Lookup, materialize, release_tables

DUPS = [(1, "a", "b"), (2, "b", "c"), (3, None, None), (4, "d", "d"), (5, "a", "e")]


@pytest.fixture
def dups(spark):
    return spark.createDataFrame(DUPS, "row_id long, x string, y string")


@pytest.fixture(params=["broadcast", "shuffle", "shuffle, hot values spread"])
def join_kind(request, spark):
    """Run a test once per way of joining a lookup table back."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {name: spark.conf.get(name) for name in names}
    if request.param != "broadcast":
        spark.conf.set(names[0], "-1")
    # With so many tasks a value is hot that has a few rows; with one task none is.
    spark.conf.set(names[1], "100" if "hot" in request.param else "1")
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def skewed(spark, parts=8):
    """A third of the rows share a value, a third are null, long texts differ at their ends only."""
    rows = spark.range(3000)
    value = (
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.concat(F.repeat(F.lit("x"), 100), (F.col("id") % 700).cast("string")))
    )
    return rows.select("id", value.alias("v"), (F.col("id") % 10).alias("w")).repartition(parts)


@pytest.mark.parametrize("parts", [1, 16])
def test_mark_duplicates(spark, dups, parts):
    out = ss.mark_duplicates(dups.repartition(parts), "x").orderBy("row_id").collect()
    assert [r.x__duplicate for r in out] == [True, False, False, False, True]
    out = ss.mark_duplicates(dups.repartition(parts), ["x", "y"]).orderBy("row_id").collect()
    assert [r.x__duplicate for r in out] == [True] * 5
    assert [r.y__duplicate for r in out] == [True, False, True, True, False]


def test_mark_duplicates_skew(spark, join_kind):
    df = skewed(spark)
    counts = {r.v: r.n for r in df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = ss.mark_duplicates(df, "v").collect()
    assert len(out) == 3000 and {r.id for r in out} == set(range(3000))
    assert all(r.v__duplicate == (counts[r.v] > 1) for r in out)


def test_pooled_types_are_compared_by_text(spark):
    df = spark.createDataFrame([(1, 1.0, "1"), (2, 2.0, "2.0")], "a int, b double, c string")
    out = ss.mark_duplicates(df, ["a", "b", "c"]).collect()
    assert [(r.a__duplicate, r.b__duplicate, r.c__duplicate) for r in out] == [
        (True, False, True), (False, True, True),
    ]


@pytest.mark.parametrize("parts", [1, 16])
def test_remove_duplicates(spark, dups, parts):
    out = ss.remove_duplicates(dups.repartition(parts), "x", order_by="row_id")
    assert sorted(r.row_id for r in out.collect()) == [1, 2, 3, 4]
    assert out.columns == dups.columns
    last = ss.remove_duplicates(dups.withColumn("back", -F.col("row_id")), "x", order_by="back")
    assert sorted(r.row_id for r in last.collect()) == [2, 3, 4, 5]


def test_remove_duplicates_keeps_groups_without_order(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "b")], "o int, x string")
    assert {r.x for r in ss.remove_duplicates(df, "x", order_by="o").collect()} == {"a", "b"}


def test_remove_duplicates_missing_numbers(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.0), (4, -0.0)], "i int, v double")
    assert sorted(r.i for r in ss.remove_duplicates(df, "v", order_by="i").collect()) == [1, 3]


@pytest.mark.parametrize("parts", [1, 16])
def test_distinct_group(spark, dups, parts):
    out = ss.distinct_group(dups.repartition(parts), "x").orderBy("row_id")
    assert [r.x_distinct_group for r in out.collect()] == [1, 2, 0, 3, 1]
    assert ss.distinct_group(out, "x").columns[-1] == "x_distinct_group_1"


def test_distinct_group_skew(spark, join_kind):
    df = skewed(spark)
    codes = {v: i + 1 for i, v in enumerate(sorted({r.v for r in df.collect()} - {None}))}
    out = ss.distinct_group(df, "v").collect()
    assert len(out) == 3000 and {r.id for r in out} == set(range(3000))
    assert all(r.v_distinct_group == codes.get(r.v, 0) for r in out)
    assert {r.value: r.code for r in ss.distinct_codes(df, "v").collect()} == codes


def test_distinct_group_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,), (-1.5,), (2.0,)], "v double")
    assert [r.v_distinct_group for r in ss.distinct_group(df, "v").collect()] == [0, 2, 0, 1, 2]


@pytest.mark.parametrize("n, slack", [(10, 100_000), (10, 0), (7, 40), (1000, 5), (5000, 0)])
def test_slices(spark, n, slack):
    df = spark.range(2999).withColumn("s", F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")))
    df = df.repartition(7)
    start = max(0, (2999 - n) // 2)
    for order in ("id", "s", ["s", "id"]):
        head = ss.slice_rows(df, "head", n, order_by=order).collect()
        assert [r.id for r in head] == list(range(min(n, 2999)))
        tail = ss.slice_rows(df, "tail", n, order_by=order).collect()
        assert [r.id for r in tail] == list(range(max(0, 2999 - n), 2999))
        middle = ss.slice_rows(df, "middle", n, order_by=order, slack=slack).collect()
        assert [r.id for r in middle] == list(range(start, min(start + n, 2999)))


@pytest.mark.parametrize("slack", [0, 100_000])
def test_slices_with_shared_keys(spark, slack):
    """Shared keys, told apart by the other cells or not at all: the same rows however the table is partitioned."""
    same = spark.range(500).select((F.col("id") * 0).alias("k"))
    pairs = spark.range(500).select(F.floor(F.col("id") / 2).alias("k"))
    halves = spark.range(500).select(F.floor(F.col("id") / 250).alias("k"))
    three = spark.range(2000).select((F.col("id") % 3).alias("k"), "id")
    for df, expected in ((same, [0] * 5), (pairs, [123, 124, 124, 125, 125]), (halves, [0, 0, 0, 1, 1]), (three, [1] * 5)):
        found = [ss.slice_rows(df.repartition(p), "middle", 5, order_by="k", slack=slack).collect() for p in (1, 7)]
        assert [r.k for r in found[0]] == expected
        assert found[0] == found[1]
        for position in ("head", "tail"):
            one, seven = (ss.slice_rows(df.repartition(p), position, 5, order_by="k").collect() for p in (1, 7))
            assert one == seven
    whole = [ss.slice_rows(three, p, 667, order_by="k", slack=slack).collect() for p in ("head", "middle", "tail")]
    keys = sorted(i % 3 for i in range(2000))
    assert [[r.k for r in part] for part in whole] == [keys[:667], keys[666:1333], keys[1333:]]
    assert all(len({r.id for r in part}) == 667 for part in whole)
    assert ss.slice_rows(pairs, "middle", 4, order_by="k", slack=slack).count() == 4


def test_slice_problems(spark):
    with pytest.raises(ValueError):
        ss.slice_rows(spark.range(5), "top", order_by="id")
    with pytest.raises(ValueError):
        ss.slice_rows(spark.range(5), "head", order_by="x")


def test_slice_with_missing_keys(spark):
    df = spark.range(300).select("id", F.when(F.col("id") > 2, F.col("id")).alias("k"))
    middle = ss.slice_rows(df, "middle", 290, order_by=["k", "id"], slack=0).collect()
    assert [r.id for r in middle] == list(range(5, 295))


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.5, True), (2, None, float("nan"), True), (-300, "", 1e-5, True), (2, "abc", None, None)],
        "n int, t string, d double, flag boolean",
    )
    expected = {
        "n": ("int", 3, False, 4), "t": ("string", 4, True, 3), "d": ("double", 3, True, 5),
        "flag": ("boolean", 2, True, 4),
    }
    for approx in (False, True):
        rows = {r["column"]: tuple(r)[1:] for r in ss.profile(df, approx=approx).collect()}
        assert rows == expected


def test_profile_of_nested_columns(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1}), ([1, 2], {"a": 2}), (None, None)], "l array<int>, m map<string,int>")
    for approx in (False, True):
        rows = {r["column"]: (r.distinct_values, r.has_missing, r.max_width) for r in ss.profile(df, approx=approx).collect()}
        assert rows == {"l": (2, True, 5), "m": (3, True, 7)}


def test_own_columns_that_are_called_like_marks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "n", "mine"), (2, "a", "y", "own")], "k int, x string, x__duplicate string, y__reason string")
    with pytest.raises(ValueError, match="already exists"):
        ss.mark_duplicates(df, "x")
    df = df.withColumnRenamed("x", "z").withColumn("y", F.lit("q"))
    marked = ss.mark_duplicates(df, "z")
    assert [(r.x__duplicate, r.y__reason, r.z__duplicate) for r in marked.orderBy("k").collect()] == [
        ("n", "mine", True), ("y", "own", True),
    ]
    with pytest.raises(ValueError, match="already exists"):
        ss.validate_numeric(marked, "y")
    assert "y__reason" in {r["column"] for r in ss.profile(marked).collect()}
    assert "z__duplicate" not in {r["column"] for r in ss.profile(marked).collect()}
    assert ss.diff_summary(df, marked).first().added_columns == ""
    ss.write_table(marked, str(tmp_path / "a.parquet"))
    assert spark.read.parquet(str(tmp_path / "a.parquet")).columns == df.columns
    ss.write_table(marked, str(tmp_path / "b.parquet"), keep_marks=True)
    again = ss.mark_duplicates(spark.read.parquet(str(tmp_path / "b.parquet")), "z")
    assert [r.z__duplicate for r in again.collect()] == [True, True]


def test_marks_survive_duplicate_removal(spark, dups):
    marked = ss.remove_duplicates(ss.mark_duplicates(dups, "x"), "y", order_by="row_id")
    assert {r["column"] for r in ss.issue_report(marked, "row_id").collect()} == {"x"}


def test_written_tables_are_released(spark):
    table = materialize(spark.range(3))
    assert table.count() == 3 and release_tables(spark) >= 1
    with pytest.raises(Exception):
        table.collect()
    assert release_tables(spark) == 0


def test_hot_values_are_fewer_than_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = spark.range(50).select("id", (F.col("id") % 2 * 1000 + 1).alias("rows"), F.lit(True).alias("x"))
        assert len(Lookup(materialize(counts), "id", "rows").hot_keys) < 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_diff_summary(spark, dups):
    after = ss.split_delimiter(ss.remove_duplicates(dups, "x", "row_id"), "y", "|", n_parts=1)
    row = ss.diff_summary(dups, ss.upper(after, "x", flags=True)).first()
    assert tuple(row) == ("y_part1", "y", 5, 4, 1)


def test_issue_report(spark):
    df = spark.createDataFrame([(1, " 1 "), (2, "x"), (3, "x")], "k int, v string")
    df = ss.validate_numeric(ss.mark_duplicates(ss.trim(df, "v", flags=True), "v"), "v")
    top = {tuple(r) for r in ss.issue_report(df, "k").collect()}
    assert top == {
        (1, "v", "modified", None, "1"),
        (2, "v", "invalid", "Invalid Format", "x"),
        (3, "v", "invalid", "Invalid Format", "x"),
    }
    every = {(r.k, r.kind) for r in ss.issue_report(df, "k", all_kinds=True).collect()}
    assert every == {(1, "modified"), (2, "invalid"), (2, "duplicate"), (3, "invalid"), (3, "duplicate")}
    with pytest.raises(ValueError):
        ss.issue_report(df.select("k"), "k")


def test_count_rows(spark):
    assert ss.count_rows(spark.range(12)) == 12


# ---------------------------------------------------------------- recipes

EVERY_KEY = [
    {"key": "op_mask", "column": "a"},
    {"key": "op_mask_email", "column": "a"},
    {"key": "op_mask_words", "column": "a"},
    {"key": "op_trim", "column": "a"},
    {"key": "op_split_delimiter", "column": "a", "delimiter": " "},
    {"key": "op_split_surname", "column": "a"},
    {"key": "op_upper", "column": "a"},
    {"key": "op_lower", "column": "a"},
    {"key": "op_title", "column": "a"},
    {"key": "op_find_replace", "column": "a", "find_text": "a", "replace_text": "b"},
    {"key": "op_remove_specific", "column": "a", "chars_to_remove": "a"},
    {"key": "op_remove_non_numeric", "column": "a"},
    {"key": "op_remove_non_alpha", "column": "a"},
    {"key": "op_concatenate", "cols_to_concat": ["a", "b"], "separator": "-", "new_col_name": "c"},
    {"key": "op_extract_pattern", "column": "a", "pattern": "a", "new_col_name": "c"},
    {"key": "op_fill_missing", "column": "a", "fill_value": "x"},
    {"key": "op_mark_duplicates", "column": "a", "selected_columns": ["a", "b"]},
    {"key": "op_remove_duplicates", "column": "a"},
    {"key": "op_merge_columns", "cols_to_merge": ["a", "b"], "separator": "-", "new_col_name": "c",
     "fill_missing": True},
    {"key": "op_rename_column", "column": "a", "new_col_name": "c"},
    {"key": "op_round_numbers", "column": "b", "decimals": 1},
    {"key": "op_calculate_column_constant", "column": "b", "operation": "+", "constant_value": 1.0},
    {"key": "op_create_calculated_column", "column": "b", "col1_name": "b", "col2_name": "k", "operation": "/",
     "new_col_name": "c"},
    *[{"key": f"op_validate_{kind}", "column": "a"}
      for kind in ("email", "phone", "date", "numeric", "alphanumeric", "url")],
    {"key": "op_distinct_group", "column": "a"},
]


def test_thirty_operations():
    assert len({op["key"] for op in EVERY_KEY}) == 30


@pytest.mark.parametrize("operation", EVERY_KEY, ids=lambda op: op["key"])
def test_every_operation_runs_from_a_recipe(spark, operation):
    df = spark.createDataFrame([(1, "Ann a", 1.25), (2, None, None)], "k int, a string, b double")
    recipe = ss.Recipe.from_json(ss.Recipe([operation]).to_json())
    assert recipe.apply(df, order_by="k", flags=True).count() == 2


def test_recipe_edits():
    recipe = ss.Recipe([{"key": "op_trim", "column": "a"}])
    longer = recipe.append({"key": "op_upper", "column": "a"})
    assert (len(recipe), len(longer), len(longer.clear())) == (1, 2, 0)
    assert longer.without_last() == recipe == ss.Recipe.from_json(recipe.to_json())


@pytest.mark.parametrize(
    "operation",
    [
        {"key": "op_nothing", "column": "a"},
        {"key": "op_trim", "column": "a", "surprise": 1},
        {"key": "op_trim", "column": "a", "type": "row_operation"},
    ],
)
def test_bad_operations_are_refused_early(operation):
    with pytest.raises(ValueError):
        ss.Recipe([operation])


def test_failing_operation_is_named(spark):
    df = spark.createDataFrame([("x",)], "a string")
    recipe = ss.Recipe([{"key": "op_trim", "column": "a"}, {"key": "op_upper", "column": "b"}])
    with pytest.raises(ValueError, match=r"operation 1 \(op_upper\)"):
        recipe.apply(df)
    with pytest.raises(ValueError, match="order_by"):
        ss.Recipe([{"key": "op_remove_duplicates", "column": "a"}]).apply(df)


def test_recipe_carries_validator_options(spark, tmp_path):
    (tmp_path / "blocked.txt").write_text("bad.com\n")
    steps = [
        {"key": "op_validate_email", "column": "e", "suffixes": ["co.uk"], "blocked": str(tmp_path / "blocked.txt"),
         "allowed": ["ok.zz"], "as_text": False},
        {"key": "op_validate_date", "column": "d", "formats": ["yyyy/MM"]},
        {"key": "op_validate_alphanumeric", "column": "a", "allow_digits": True, "skip_header_cells": False},
        {"key": "op_concatenate", "cols_to_concat": ["a", "d"], "new_col_name": "a", "separator": "-", "overwrite": True},
        {"key": "op_mask", "column": "k", "normalize_ints": False},
    ]
    recipe = ss.Recipe.from_json(ss.Recipe(steps).to_json())
    df = spark.createDataFrame(
        [("x@a.co.uk", "2024/01", "a1", "1"), ("x@bad.com", "2024-01", "a", "2"), ("x@ok.zz", None, "?", "3")],
        "e string, d string, a string, k string",
    )
    out = recipe.apply(df).orderBy("e").collect()
    assert [r.e__reason for r in out] == ["Valid Domain", "Blocked Domain", "Allowed Domain"]
    assert [r.d__reason for r in out] == ["Valid", "Invalid Format", "Empty"]
    assert [r.a__reason for r in out] == ["Valid", "Valid", "Invalid Character"]
    for bad in ({"key": "op_validate_email", "column": "e", "rules": 1}, {"key": "op_trim", "column": "a", "formats": []}):
        with pytest.raises(ValueError):
            ss.Recipe([bad])


def test_preview(spark):
    df = spark.range(50).select("id", F.concat(F.lit(" "), F.col("id").cast("string")).alias("t"))
    before, after = ss.preview(df, {"key": "op_trim", "column": "t"}, 3, order_by="id")
    assert [r.t for r in before.collect()] == [" 0", " 1", " 2"]
    assert [(r.t, r.t__modified) for r in after.orderBy("id").collect()] == [("0", True), ("1", True), ("2", True)]
    middle = ss.preview(df, {"key": "op_trim", "column": "t"}, 2, order_by="id", position="middle")[1]
    assert sorted(r.t for r in middle.collect()) == ["24", "25"]


_NEEDY = [
    {"key": "op_split_delimiter", "column": "parts", "delimiter": "-"},
    {"key": "op_validate_numeric", "column": "price"},
    {"key": "op_round_numbers", "column": "price", "decimals": 1, "check": True},
    {"key": "op_create_calculated_column", "column": "low", "col2_name": "high", "operation": "+", "new_col_name": "sum"},
    {"key": "op_split_delimiter", "column": "lines", "delimiter": ";", "check": True, "n_parts": 2},
    {"key": "op_calculate_column_constant", "column": "high", "operation": "*", "constant_value": 2, "check": True},
]


def _needy_table(spark):
    rows = [
        ("a-b-c", "1.25", 1.5, "2.125", "x;y;z"), ("-", None, 2.25, "0.5", None), (None, "n", None, "high", ""),
    ]
    return spark.createDataFrame(rows, "parts string, price string, low double, high string, lines string")


def test_statistics_of_a_recipe_are_taken_at_once(spark, tmp_path, monkeypatch):
    _needy_table(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    one_by_one = df
    for operation in _NEEDY:
        one_by_one = ss.run_operation(one_by_one, operation)
    taken = []
    aggregate = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: taken.append(len(a)) or aggregate(self, *a))
    result = ss.Recipe(_NEEDY).apply(df)
    assert taken == [1 + 2 + 1 + 1 + 2]
    monkeypatch.undo()
    # The number of decimals is known beforehand, so no subquery scans the table again.
    assert result._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert result.schema == one_by_one.schema
    assert sorted(map(str, result.collect())) == sorted(map(str, one_by_one.collect()))


def test_statistics_of_changed_columns_are_taken_later(spark):
    df = _needy_table(spark)
    recipe = [
        {"key": "op_find_replace", "column": "parts", "find_text": "b", "replace_text": "b-b"},
        {"key": "op_concatenate", "cols_to_concat": ["low", "high"], "new_col_name": "both", "separator": ";"},
        {"key": "op_split_delimiter", "column": "lines", "delimiter": ";"},
        {"key": "op_split_delimiter", "column": "parts", "delimiter": "-"},
        {"key": "op_split_delimiter", "column": "both", "delimiter": ";"},
        {"key": "op_round_numbers", "column": "price", "check": True},
        {"key": "op_remove_duplicates", "column": "lines_part1", "order_by": "price"},
        {"key": "op_split_delimiter", "column": "high", "delimiter": "."},
    ]
    one_by_one = df
    for operation in recipe:
        one_by_one = ss.run_operation(one_by_one, operation)
    result = ss.Recipe(recipe).apply(df)
    assert "parts_part4" in result.columns and result.schema == one_by_one.schema
    assert sorted(map(str, result.collect())) == sorted(map(str, one_by_one.collect()))


def test_problems_found_by_the_statistics_name_the_operation(spark):
    df = _needy_table(spark)
    split = {"key": "op_split_delimiter", "column": "parts", "delimiter": "-"}
    with pytest.raises(ValueError, match=r"operation 1 \(op_round_numbers\): column 'lines' holds no numbers"):
        ss.Recipe([split, {"key": "op_round_numbers", "column": "lines", "check": True}]).apply(df)
    with pytest.raises(ValueError, match=r"operation 1 \(op_split_delimiter\): no cell of 'price' has"):
        ss.Recipe([split, {"key": "op_split_delimiter", "column": "price", "delimiter": "#"}]).apply(df)
    with pytest.raises(ValueError, match=r"operation 1 \(op_round_numbers\)"):
        ss.Recipe([split, {"key": "op_round_numbers", "column": "nowhere", "check": True}]).apply(df)
    with pytest.raises(ValueError, match=r"operation 0 \(op_split_delimiter\): .*max_parts"):
        ss.Recipe([{**split, "max_parts": 2}, {"key": "op_round_numbers", "column": "price", "check": True}]).apply(df)
