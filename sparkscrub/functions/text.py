"""How a cell becomes text: number spelling, white space, blanks and header cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points that count as white space in text cells (first, last).
_WS_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITESPACE = "".join(chr(code) for first, last in _WS_RANGES for code in range(first, last + 1))
# The same set as the inside of a character class.
WS_CLASS = "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in _WS_RANGES)

# Text that reads as a floating-point number: digit groups may be joined by "_". Possessive
# quantifiers ("++") make text that almost fits fail in one pass.
_DIGITS = r"\p{Nd}++(?:_\p{Nd}++)*+"
FLOAT_BARE = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?+)?+|\.{_DIGITS})(?:e[+-]?{_DIGITS})?+"
    r"|inf(?:inity)?|nan)\z"
)
FLOAT_TEXT = FLOAT_BARE.replace("^", f"^[{WS_CLASS}]*+", 1).replace(r"\z", rf"[{WS_CLASS}]*+\z")
# Whole numbers that a double holds exactly.
_SHORT_WHOLE = r"^[+-]?(?:[0-9]{1,15}+(?:\.0*+)?+|\.0++)\z"
_PLAIN_FLOAT = r"(?i)^[+-]?(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:e[+-]?[0-9]++)?+\z"

FLOATING = (T.FloatType, T.DoubleType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NOT_TEXT = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def quoted(name: str) -> str:
    """``name`` as an identifier that survives dots and backticks."""
    return "`" + name.replace("`", "``") + "`"


def col_ref(name: str) -> Column:
    return F.col(quoted(name))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """Null, or NaN in a floating-point column."""
    return (c.isNull() | F.isnan(c)) if isinstance(dtype, FLOATING) else c.isNull()


def no_nan(c: Column, dtype: T.DataType) -> Column:
    return F.nanvl(c, F.lit(None).cast(dtype)) if isinstance(dtype, FLOATING) else c


def apart(c: Column, change) -> Column:
    """``change(c)`` outside the generated row loop, for the rare branch of a hot expression: large
    expressions in that loop make the method too big to be compiled."""
    return F.get(F.transform(F.array(c), change), F.lit(0))


def is_plain(d: Column) -> Column:
    """Doubles that Spark spells the way this module does."""
    size = F.abs(d)
    return ((size >= 1e-3) & (size < 1e7)) | (d == 0)


def float_text(c: Column) -> Column:
    """Shortest spelling of a double: plain from 1e-4 up to 1e16, two-digit exponent outside."""
    return F.when(is_plain(c), c.cast("string")).otherwise(apart(c, _respelled))


def _respelled(c: Column) -> Column:
    raw = c.cast("string")
    size = F.abs(c)
    digits = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"0+\z", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0\z", "")
    power = F.substring_index(raw, "E", -1).try_cast("int")
    steps = F.abs(power).cast("string")
    exponent = F.concat(
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(steps, F.greatest(F.lit(2), F.length(steps)), F.lit("0")),
    )
    return (
        F.when(F.isnan(c), F.lit(None).cast("string"))
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, exponent))
    )


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """The text of a cell; missing cells (null, NaN) stay null."""
    if isinstance(dtype, _NOT_TEXT):
        raise ValueError(f"text operation on a column of type {dtype.simpleString()}")
    if isinstance(dtype, FLOATING):
        return float_text(c)
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c if isinstance(dtype, T.StringType) else c.cast("string")


def short_text(c: Column, dtype: T.DataType) -> Column:
    """:func:`cell_text` without the ``.0`` of whole floating-point cells."""
    if not isinstance(dtype, FLOATING):
        return cell_text(c, dtype)
    d = c.cast("double")
    return (
        F.when((F.rint(d) == d) & (F.abs(d) < float(2**63)), d.cast("bigint").cast("string"))
        .when(is_plain(c), c.cast("string"))
        .otherwise(apart(c, lambda x: F.coalesce(_wide_digits(x.cast("double")), _respelled(x))))
    )


def _wide_digits(d: Column) -> Column:
    """All digits of a whole double below 1e37; null for other doubles."""
    # Two halves that a double and a decimal both hold exactly.
    size, unit = F.abs(d), float(2**62)
    high = F.floor(size / unit)
    low = size - high.cast("double") * unit
    wide = high.cast("decimal(19,0)") * F.lit(str(2**62)).cast("decimal(19,0)") + low.cast("bigint").cast("decimal(19,0)")
    digits = F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), wide.cast("string"))
    return F.when((F.rint(d) == d) & (size < 1e37), digits)


def drop_point_zero(text: Column) -> Column:
    """Text that reads as a whole number is spelled as an integer (``'007'`` -> ``'7'``)."""

    def general(t: Column) -> Column:
        bare = F.translate(strip(t), "_", "")
        return F.coalesce(
            F.when(bare.rlike(_PLAIN_FLOAT), _wide_digits(bare.try_cast("double"))), t
        )

    return (
        F.when(text.rlike(_SHORT_WHOLE), _digits(text))
        .when(text.rlike(FLOAT_TEXT), apart(text, general))
        .otherwise(text)
    )


def drop_point_zero_of_two(text: Column) -> Column:
    """:func:`drop_point_zero` for text of at most two characters."""
    bare = strip(text)
    return F.when(bare.rlike(_SHORT_WHOLE), _digits(bare)).otherwise(text)


def _digits(text: Column) -> Column:
    return text.try_cast("double").try_cast("bigint").cast("string")


def guard_header(c: Column, text: Column, name: str, changed: Column, on: bool = True) -> Column:
    """Cells that repeat the column name (stray header rows) keep their value."""
    return F.when(text == F.lit(name), c).otherwise(changed) if on else changed
