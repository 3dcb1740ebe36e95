"""Hand-written examples for the operators on one text column (FIXTURES.md)."""

import pytest

import sparkscrub as ss

WIDE = " "


def one(spark, value, op, col="v", kind="string"):
    """The row that ``op`` makes of a single cell."""
    return op(spark.createDataFrame([(value,)], f"`{col}` {kind}")).first()


@pytest.mark.parametrize(
    "value, expected",
    [
        ("12345678", "12****78"),
        ("Ahmet Can", "Ah*****an"),
        ("abcd", "a**d"),
        ("abc", "a*c"),
        ("ab", "ab"),
        ("", ""),
        (None, None),
        ("a", "*"),
        ("05", "5"),
        ("1.", "1"),
        ("-0", "0"),
        (".0", "0"),
        (" 5", "5"),
        ("5\t", "5"),
        (".5", ".5"),
        ("--", "--"),
        ("😀😀😀😀😀", "😀😀*😀😀"),
        ("v", "v"),
    ],
)
def test_mask(spark, value, expected):
    assert one(spark, value, lambda df: ss.mask(df, "v")).v == expected


def test_mask_strict(spark):
    assert one(spark, "a", lambda df: ss.mask(df, "v", strict_compat=True)).v == "aa"
    assert one(spark, "05", lambda df: ss.mask(df, "v", normalize_ints=False)).v == "05"


@pytest.mark.parametrize(
    "value, expected, invalid",
    [
        ("user@domain.com", "us***@domain.com", False),
        ("ab@x.org", "ab***@x.org", False),
        ("😀x@x", "😀x***@x", False),
        ("no-at", "no-at", True),
        ("a@b@c", "a@b@c", True),
        ("@x.org", "@x.org", True),
        ("a@", "a@", True),
        ("a@b\n", "a***@b", False),
        ("v", "v", False),
        (None, None, False),
    ],
)
def test_mask_email(spark, value, expected, invalid):
    row = one(spark, value, lambda df: ss.mask_email(df, "v", flags=True))
    assert (row.v, row.v__invalid) == (expected, invalid)


@pytest.mark.parametrize(
    "value, expected",
    [
        ("John Doe", "Jo** Do*"),
        ("Ahmet  Can Arslan", "Ah*** Ca* Ar****"),
        ("  a\tbc\n", "a bc"),
        ("😀😀😀 x", "😀😀* x"),
        (f"one{WIDE}two", "on* tw*"),
        ("", ""),
        (None, None),
    ],
)
def test_mask_words(spark, value, expected):
    assert one(spark, value, lambda df: ss.mask_words(df, "v")).v == expected


@pytest.mark.parametrize(
    "value, expected, modified",
    [(f"{WIDE} x\t", "x", True), ("x", "x", False), ("​x", "​x", False), (None, None, False)],
)
def test_trim(spark, value, expected, modified):
    row = one(spark, value, lambda df: ss.trim(df, "v", flags=True))
    assert (row.v, row.v__modified) == (expected, modified)


def test_case(spark):
    assert one(spark, "straße", lambda df: ss.upper(df, "v")).v == "STRASSE"
    assert one(spark, "ÉCOLE", lambda df: ss.lower(df, "v")).v == "école"
    row = one(spark, "o'neil mcdonald-smith 3rd", lambda df: ss.title(df, "v"))
    assert row.v == "O'Neil Mcdonald-Smith 3Rd"


@pytest.mark.parametrize(
    "op",
    [
        lambda df: ss.upper(df, "name"),
        lambda df: ss.mask(df, "name"),
        lambda df: ss.mask_words(df, "name"),
        lambda df: ss.remove_specific(df, "name", "aeiou"),
        lambda df: ss.find_replace(df, "name", "n", "x"),
        lambda df: ss.split_surname(df, "name"),
        lambda df: ss.fill_missing(df, "name", "x"),
    ],
)
def test_header_cells_stay(spark, op):
    assert one(spark, "name", op, col="name")[0] == "name"


def test_header_guard_can_be_off(spark):
    assert one(spark, "name", lambda df: ss.upper(df, "name", skip_header_cells=False), col="name")[0] == "NAME"


def test_find_replace(spark):
    row = one(spark, "banana", lambda df: ss.find_replace(df, "v", "a", "o", flags=True))
    assert (row.v, row.v__modified) == ("bonono", True)
    row = one(spark, "xyz", lambda df: ss.find_replace(df, "v", "a", "o", flags=True))
    assert (row.v, row.v__modified) == ("xyz", False)
    assert one(spark, "a.c", lambda df: ss.find_replace(df, "v", ".", "$1")).v == "a$1c"
    with pytest.raises(ValueError):
        one(spark, "x", lambda df: ss.find_replace(df, "v", "", "o"))


def test_removals(spark):
    assert one(spark, "1-2.3", lambda df: ss.remove_specific(df, "v", "-.")).v == "123"
    assert one(spark, "a]b\\c", lambda df: ss.remove_specific(df, "v", "]\\")).v == "abc"
    assert one(spark, "abc", lambda df: ss.remove_specific(df, "v", "")).v == "abc"
    assert one(spark, "a1-.b2", lambda df: ss.remove_non_numeric(df, "v")).v == "1-.2"
    assert one(spark, "Ça va 2x!", lambda df: ss.remove_non_alpha(df, "v")).v == "Ça va x"


@pytest.mark.parametrize("value, expected", [(None, "0"), ("", "0"), ("  ", "0"), (WIDE, "0"), ("x", "x")])
def test_fill_text(spark, value, expected):
    assert one(spark, value, lambda df: ss.fill_missing(df, "v", "0")).v == expected


def test_fill(spark):
    assert one(spark, None, lambda df: ss.fill_missing(df, "v", "5.0")).v == "5"
    assert one(spark, None, lambda df: ss.fill_missing(df, "v", "5.0", normalize_ints=False)).v == "5.0"
    assert one(spark, float("nan"), lambda df: ss.fill_missing(df, "v", "1.5"), kind="double").v == 1.5
    assert one(spark, None, lambda df: ss.fill_missing(df, "v", "7"), kind="int").v == 7
    row = one(spark, None, lambda df: ss.fill_missing(df, "v", "2020-01-02"), kind="date")
    assert row.v.isoformat() == "2020-01-02"
    for kind in ("int", "double", "date"):
        with pytest.raises(ValueError):
            one(spark, None, lambda df: ss.fill_missing(df, "v", "x"), kind=kind)


def test_number_cells_are_text_first(spark):
    assert one(spark, 123456789.0, lambda df: ss.mask(df, "v"), kind="double").v == "12*******.0"
    assert one(spark, float("nan"), lambda df: ss.mask(df, "v"), kind="double").v is None
    assert one(spark, True, lambda df: ss.upper(df, "v"), kind="boolean").v == "TRUE"
    assert one(spark, True, lambda df: ss.trim(df, "v"), kind="boolean").v == "True"
    with pytest.raises(ValueError):
        one(spark, [1], lambda df: ss.trim(df, "v"), kind="array<int>")


def test_missing_column(spark):
    with pytest.raises(ValueError, match="no such column"):
        one(spark, "x", lambda df: ss.trim(df, "w"))


def test_odd_column_names(spark):
    row = one(spark, " x ", lambda df: ss.trim(df, "a.b`c", flags=True), col="a.b``c")
    assert row[0] == "x" and row[1] is True


def test_marks_accumulate(spark):
    def op(df):
        return ss.trim(ss.trim(df, "v", flags=True), "v", flags=True)

    assert one(spark, " x", op).v__modified is True
