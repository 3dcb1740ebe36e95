"""Operators that rewrite one text column in place. All are stateless projections: they add no
shuffle, fuse into the scan's stage and run unchanged on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings
from ..functions.text import (
    FLOATING,
    col_ref,
    drop_point_zero,
    guard_header,
    is_missing,
    strip,
)
from .common import INVALID, MODIFIED, as_text_column, dtype_of, in_place, mark_column, require


def mask(
    df: DataFrame,
    col: str,
    *,
    normalize_ints: bool = True,
    strict_compat: bool = False,
    flags: bool = False,
    skip_header_cells: bool = True,
) -> DataFrame:
    """Keep the outer two characters (one when the text has four or fewer), stars between."""
    return in_place(
        df, col, lambda t: strings.mask(t, normalize_ints, strict_compat), flags, skip_header_cells
    )


def mask_email(df: DataFrame, col: str, *, flags: bool = False, skip_header_cells: bool = True) -> DataFrame:
    """Keep two characters of the user and the domain; with ``flags`` other cells are invalid."""
    df = as_text_column(df, col)
    text = col_ref(col)
    columns = {col: guard_header(text, text, col, strings.mask_email(text), skip_header_cells)}
    if flags:
        bad = guard_header(F.lit(False), text, col, ~strings.is_maskable_email(text), skip_header_cells)
        label, marked = mark_column(df, col, INVALID, bad)
        columns[label] = marked
    return df.withColumns(columns)


def mask_words(df: DataFrame, col: str, *, flags: bool = False, skip_header_cells: bool = True) -> DataFrame:
    """Keep the first two characters of every word."""
    return in_place(df, col, strings.mask_words, flags, skip_header_cells)


def trim(df: DataFrame, col: str, *, flags: bool = False, skip_header_cells: bool = True) -> DataFrame:
    """Remove Unicode white space at both ends."""
    return in_place(df, col, strip, flags, skip_header_cells)


def upper(df: DataFrame, col: str, *, flags: bool = False, skip_header_cells: bool = True) -> DataFrame:
    return in_place(df, col, F.upper, flags, skip_header_cells)


def lower(df: DataFrame, col: str, *, flags: bool = False, skip_header_cells: bool = True) -> DataFrame:
    return in_place(df, col, F.lower, flags, skip_header_cells)


def title(df: DataFrame, col: str, *, flags: bool = False, skip_header_cells: bool = True) -> DataFrame:
    return in_place(df, col, strings.title, flags, skip_header_cells)


def find_replace(
    df: DataFrame, col: str, find: str, replacement: str = "", *, flags: bool = False, skip_header_cells: bool = True
) -> DataFrame:
    """Replace every literal occurrence of ``find``."""
    return in_place(df, col, lambda t: strings.find_replace(t, find, replacement), flags, skip_header_cells)


def remove_specific(
    df: DataFrame, col: str, characters: str, *, flags: bool = False, skip_header_cells: bool = True
) -> DataFrame:
    """Delete each of the listed characters."""
    return in_place(df, col, lambda t: strings.remove_characters(t, characters), flags, skip_header_cells)


def remove_non_numeric(
    df: DataFrame, col: str, *, flags: bool = False, skip_header_cells: bool = True
) -> DataFrame:
    """Keep ASCII digits, ``.`` and ``-``."""
    return in_place(df, col, strings.keep_numeric, flags, skip_header_cells)


def remove_non_alpha(
    df: DataFrame, col: str, *, flags: bool = False, skip_header_cells: bool = True
) -> DataFrame:
    """Keep letters of any script and white space."""
    return in_place(df, col, strings.keep_letters, flags, skip_header_cells)


def fill_missing(
    df: DataFrame,
    col: str,
    value,
    *,
    normalize_ints: bool = True,
    flags: bool = False,
    skip_header_cells: bool = True,
) -> DataFrame:
    """Fill null, NaN and blank cells. Columns that are not text keep their type."""
    require(df, col)
    dtype, cell = dtype_of(df, col), col_ref(col)
    empty = is_missing(cell, dtype)
    if isinstance(dtype, T.StringType):
        fill = F.lit(str(value))
        fill = drop_point_zero(fill) if normalize_ints else fill
        empty = F.coalesce(strip(cell), F.lit("")) == ""
        empty = F.when(cell == F.lit(col), False).otherwise(empty) if skip_header_cells else empty
    else:
        fill = _typed_fill(df, value, dtype)
    columns = {col: F.when(empty, fill).otherwise(cell)}
    if flags:
        label, marked = mark_column(df, col, MODIFIED, empty)
        columns[label] = marked
    return df.withColumns(columns)


def _typed_fill(df: DataFrame, value, dtype: T.DataType):
    """``value`` as a literal of the column's type, or an error while the plan is built."""
    try:
        if isinstance(dtype, FLOATING):
            return F.lit(float(value)).cast(dtype)
        if isinstance(dtype, T.IntegralType):
            if float(value) != int(float(value)):
                raise ValueError(value)
            return F.lit(int(float(value))).cast(dtype)
    except (TypeError, ValueError):
        raise ValueError(f"{value!r} does not fit a column of type {dtype.simpleString()}") from None
    fits = df.sparkSession.range(1).select(F.lit(str(value)).try_cast(dtype).isNotNull().alias("fits"))
    if not fits.first()["fits"]:
        raise ValueError(f"{value!r} does not fit a column of type {dtype.simpleString()}")
    return F.lit(str(value)).cast(dtype)
