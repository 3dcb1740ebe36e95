"""Hand-written examples for operators that build, split and compute columns (FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

import sparkscrub as ss


def test_rename(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert ss.rename_column(df, "a", "c").columns == ["c", "b"]
    for old, new in (("x", "y"), ("a", "b"), ("a", "")):
        with pytest.raises(ValueError):
            ss.rename_column(df, old, new)


def test_concatenate(spark):
    df = spark.createDataFrame([(123.0, "x", None)], "a double, b string, c string")
    assert ss.concatenate(df, ["a", "b", "c"], "d", "-").first().d == "123-x-"
    assert ss.concatenate(df, ["c", "b"], "d", "", null_text="?").first().d == "?x"
    with pytest.raises(ValueError):
        ss.concatenate(df, ["a"], "d")
    with pytest.raises(ValueError):
        ss.concatenate(df, ["a", "b"], "c")
    assert ss.concatenate(df, ["a", "b"], "c", "+", overwrite=True).first().c == "123+x"


def test_merge(spark):
    df = spark.createDataFrame([("x", None), (None, 2.0)], "a string, b double")
    rows = ss.merge_columns(df, ["a", "b"], "m", "/").collect()
    assert [tuple(r) for r in rows] == [("x", "", "x/"), ("", "2", "/2")]
    rows = ss.merge_columns(df, ["a", "b"], "m", "/", fill_missing=False).collect()
    assert [tuple(r) for r in rows] == [("x", None, "x/nan"), (None, 2.0, "nan/2")]


def test_split_delimiter(spark):
    df = spark.createDataFrame([(1, "a|b|c", 9), (2, "a", 9), (3, None, 9)], "i int, t string, z int")
    out = ss.split_delimiter(df, "t", "|")
    assert out.columns == ["i", "t_part1", "t_part2", "t_part3", "z"]
    assert [tuple(r)[1:4] for r in out.orderBy("i").collect()] == [("a", "b", "c"), ("a", "", ""), (None,) * 3]
    two = ss.split_delimiter(df, "t", "|", n_parts=2).orderBy("i").first()
    assert (two.t_part1, two.t_part2) == ("a", "b|c")
    with pytest.raises(ValueError):
        ss.split_delimiter(df, "t", "")
    with pytest.raises(ValueError):
        ss.split_delimiter(df, "t", ";")
    with pytest.raises(ValueError):
        ss.split_delimiter(df, "t", "|", max_parts=2)


def test_split_is_literal_and_avoids_taken_names(spark):
    df = spark.createDataFrame([("x..y\\Ez", "1")], "t string, t_part1 string")
    assert tuple(ss.split_delimiter(df, "t", "..").first()) == ("x", "y\\Ez", "1")
    assert ss.split_delimiter(df, "t", "..").columns == ["t_part1_1", "t_part2", "t_part1"]
    assert ss.split_delimiter(df, "t", "\\E").first()[1] == "z"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Ahmet Can Arslan", ("Ahmet Can", "Arslan")),
        ("  Ahmet   Can\tArslan ", ("Ahmet Can", "Arslan")),
        (" Cher ", ("Cher", "")),
        ("", ("", "")),
        ("  ", ("", "")),
        ("NaN", ("", "")),
        (None, ("", "")),
        ("n", ("n", "")),
    ],
)
def test_split_surname(spark, value, expected):
    out = ss.split_surname(spark.createDataFrame([(value, 1)], "n string, z int"), "n")
    assert out.columns == ["n", "n_Surname", "z"]
    assert tuple(out.first())[:2] == expected


@pytest.mark.parametrize(
    "value, pattern, options, expected",
    [
        ("ab007", r"\d+", {}, "7"),
        ("ab007", r"\d+", {"normalize_ints": False}, "007"),
        ("none", r"\d+", {}, ""),
        ("a1", r"(\w)(\d)", {"group": 2}, "1"),
        ("x 1e5", r"\S+$", {}, "100000"),
        ("1_000", r".+", {}, "1000"),
        ("12345678901234567890123", r".+", {}, "12345678901234567741440"),
        ("-5.0", r".*", {}, "-5"),
        ("5.5", r".*", {}, "5.5"),
        ("a b", r"^.+$", {}, "a b"),
        ("one two", r"(?P<first>\w+)\s(?P<second>\w+)", {"group": 2}, "two"),
        ("abab", r"(?P<x>ab)(?P=x)", {}, "ab"),
        ("a[b", r"[[x]", {}, "["),
        ("a]b", r"[]x]", {}, "]"),
        ("a{b", r"a{b", {}, "a{b"),
        ("aaa", r"a{,2}", {}, "aa"),
        ("ÀB", r"(?i)àb", {}, "ÀB"),
        ("x٣", r"\d", {"normalize_ints": False}, "٣"),
        ("end\n", r"d\Z", {}, ""),
        (None, r"\d", {}, None),
    ],
)
def test_extract(spark, value, pattern, options, expected):
    df = spark.createDataFrame([(value, 0)], "t string, z int")
    out = ss.extract_pattern(df, "t", pattern, "x", **options)
    assert out.columns == ["t", "x", "z"]
    assert out.first().x == expected


@pytest.mark.parametrize(
    "pattern, options",
    [("(", {}), (r"(\w)(\d)", {}), (r"\d", {"group": 1}), (r"(a)?(?(1)b|c)", {"group": 1}), (r"(?x) a", {})],
)
def test_extract_refused(spark, pattern, options):
    with pytest.raises(ValueError):
        ss.extract_pattern(spark.createDataFrame([("a",)], "t string"), "t", pattern, "x", **options)


@pytest.mark.parametrize("value, expected", [(0.285, 0.28), (1.005, 1.0), (5.015, 5.01), (0.125, 0.12)])
def test_round(spark, value, expected):
    assert ss.round_numbers(spark.createDataFrame([(value,)], "a double"), "a", 2).first().a == expected


def test_round_text_and_whole(spark):
    df = spark.createDataFrame([("3.14159",), ("abc",), ("a",), ("2",), (None,)], "a string")
    assert [r.a for r in ss.round_numbers(df, "a", 2).collect()] == ["3.14", None, "a", "2.0", None]
    assert [r.a for r in ss.round_numbers(df, "a", 2, as_number=True).collect()] == [3.14, None, None, 2.0, None]
    whole = spark.createDataFrame([(2**62 + 1,)], "a bigint")
    assert ss.round_numbers(whole, "a", 2).first().a == 2**62 + 1
    with pytest.raises(ValueError):
        ss.round_numbers(whole, "a", 11)
    with pytest.raises(ValueError):
        ss.round_numbers(spark.createDataFrame([("x",)], "a string"), "a", check=True)


def test_constant(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "a double")
    assert [r.a for r in ss.calculate_constant(df, "a", "*", 2).collect()] == [3.0, None]
    whole = spark.createDataFrame([(3,)], "a int")
    assert ss.calculate_constant(whole, "a", "/", 2).first().a == 1.5
    with pytest.raises(ValueError):
        ss.calculate_constant(df, "a", "/", 0)
    with pytest.raises(ValueError):
        ss.calculate_constant(df, "a", "%", 2)


@pytest.mark.parametrize(
    "a, b, kind, operation, expected",
    [
        (10.0, 4.0, "double", "/", 2.5),
        (1.0, 0.0, "double", "/", None),
        (0.0, 0.0, "double", "/", None),
        (10, 3, "bigint", "/", 3.3333333333333335),
        (10, 3, "bigint", "*", 30),
        (1, 0, "bigint", "/", None),
        (1.25, 3.0, "double", "*", 3.75),
        (1.0, 3.0, "double", "/", 0.3),
        ("1", "3", "string", "/", 1 / 3),
        ("1.50", "3", "string", "/", 0.5),
        ("x", "3", "string", "+", None),
        (1e308, 10.0, "double", "*", None),
    ],
)
def test_calculated(spark, a, b, kind, operation, expected):
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    assert ss.calculated_column(df, "a", "b", operation, "c").first().c == expected


def test_calculated_options(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.23456, 7.0)], "a double, b double")
    assert [r.c for r in ss.calculated_column(df, "a", "b", "/", "c").collect()] == [0.33333, 0.17637]
    assert [r.c for r in ss.calculated_column(df, "a", "b", "/", "c", decimals=1).collect()] == [0.3, 0.2]
    assert ss.calculated_column(df, "a", "b", "/", "c", decimals=None).first().c == 1 / 3
    with pytest.raises(ValueError):
        ss.calculated_column(df, "a", "b", "/", "a")
    text = spark.createDataFrame([("x", 1.0)], "a string, b double")
    with pytest.raises(ValueError):
        ss.calculated_column(text, "a", "b", "+", "c", check=True)


@pytest.mark.parametrize(
    "text, number",
    [(" 12 ", 12.0), ("1e5", 100000.0), ("1d", None), ("1_000", None), ("0x1A", None), ("1.5f", None),
     ("inf", math.inf), ("nan", None), (".5", 0.5), ("1.", 1.0), ("", None), ("-", None)],
)
def test_number_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "a string")
    assert ss.calculate_constant(df, "a", "+", 0, as_number=True).first().a == number


def test_unique_name(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_1 int")
    assert ss.unique_name(df, "a") == "a_2"
    assert ss.unique_name(df, "b") == "b"


def test_decimals_stay_exact(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal("12345678901234567890.125"), 2), (None, 3)], "a decimal(38,3), b int")
    rounded = ss.round_numbers(df, "a", 2)
    assert rounded.schema["a"].dataType.simpleString() == "decimal(38,3)"
    assert [r.a for r in rounded.collect()] == [Decimal("12345678901234567890.120"), None]
    assert ss.round_numbers(df, "a", 3).first().a == Decimal("12345678901234567890.125")
    more = ss.calculate_constant(df, "a", "+", 0.1)
    assert more.first().a == Decimal("12345678901234567890.225")
    total = ss.calculated_column(df, "a", "b", "-", "c")
    assert [r.c for r in total.collect()] == [Decimal("12345678901234567888.125"), None]
    half = ss.calculated_column(df, "a", "b", "/", "c", decimals=1).first().c
    assert half == Decimal("6172839450617283945.1")
    zero = df.withColumn("b", F.lit(0))
    assert ss.calculated_column(zero, "a", "b", "/", "c").first().c is None
