"""Reading numbers, half-even rounding and the four arithmetic operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import FLOATING, WHOLE, apart, cell_text, is_plain

_ASCII_WS = " \t\n\x0b\f\r"
_SPACE = r"[ \t\n\x0B\f\r]*+"
_NUMBER = (
    rf"(?i)^{_SPACE}[+-]?(?:(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:e[+-]?[0-9]++)?+|inf(?:inity)?){_SPACE}\z"
)
_INTEGER = rf"^{_SPACE}[+-]?[0-9]++{_SPACE}\z"


def is_number_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*FLOATING, *WHOLE, T.DecimalType, T.BooleanType))


def to_number(c: Column, dtype: T.DataType) -> Column:
    """A number, or null where the cell is not one. Whole types stay whole, the rest is double."""
    if isinstance(dtype, (*WHOLE, T.BooleanType)):
        return c.cast("bigint")
    if isinstance(dtype, T.FloatType):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.DoubleType):
        return F.nanvl(c, F.lit(None).cast("double"))
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    text = cell_text(c, dtype)
    number = F.btrim(text, F.lit(_ASCII_WS)).try_cast("double")
    # Digits too large for a double are no number; the word "inf" is one.
    fits = (F.abs(number) < float("inf")) | F.contains(F.lower(text), F.lit("n"))
    return F.when(text.rlike(_NUMBER) & fits, number)


def is_whole_text(text: Column) -> Column:
    return text.rlike(_INTEGER)


def is_float_text(text: Column) -> Column:
    return text.rlike(_NUMBER)


def round_half_even(d: Column, decimals: int | Column) -> Column:
    """Scale, round ties to even, scale back — what array libraries do, unlike ``round``/``bround``."""
    if isinstance(decimals, int):
        if decimals == 0:
            return F.rint(d)
        scale = F.lit(float(10**decimals))
    else:
        scale = F.pow(F.lit(10.0), decimals)
    return F.rint(d * scale) / scale


def decimals_shown(c: Column, dtype: T.DataType) -> Column:
    """Characters after the last point in the number's text; 0 for whole numbers and integer text."""
    if isinstance(dtype, (*WHOLE, T.BooleanType)):
        return F.lit(0)
    number = to_number(c, dtype)

    def after_point(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(".")), F.length(F.substring_index(text, ".", -1))).otherwise(0)

    shown = F.when(is_plain(number), after_point(number.cast("string"))).otherwise(
        apart(number, lambda n: after_point(cell_text(n, T.DoubleType())))
    )
    if isinstance(dtype, T.StringType):
        shown = F.when(is_whole_text(c), 0).otherwise(shown)
    return F.when(number.isNotNull(), shown)


ARITHMETIC = {
    "+": F.try_add,
    "-": F.try_subtract,
    "*": F.try_multiply,
    "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
}


def arithmetic(operation: str):
    if operation not in ARITHMETIC:
        raise ValueError(f"unknown arithmetic operation {operation!r}; expected one of + - * /")
    return ARITHMETIC[operation]


def finite(d: Column) -> Column:
    """Infinite and NaN results become null."""
    return F.when(F.abs(d) < float("inf"), d)
