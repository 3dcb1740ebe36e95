"""Operators that rename columns or build new ones from existing ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings
from ..functions.patterns import java_pattern
from ..functions.text import col_ref, drop_point_zero, short_text
from ..plans.lookup import refuse_streams
from .common import as_text_column, dtype_of, place_after, refuse_existing, require, text_of, unique_name


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    refuse_existing(df, new)
    return df.withColumnRenamed(old, new)


def _joined(df: DataFrame, cols: Sequence[str], separator: str, null_text: str) -> Column:
    parts = [F.coalesce(short_text(col_ref(c), dtype_of(df, c)), F.lit(null_text)) for c in cols]
    return F.concat_ws(separator, *parts)


def _check_join(df: DataFrame, cols: Sequence[str], new: str, overwrite: bool) -> None:
    if len(cols) < 2:
        raise ValueError("at least two columns are needed")
    require(df, *cols)
    refuse_existing(df, new, overwrite)


def concatenate(
    df: DataFrame, cols: Sequence[str], new: str, separator: str = "", *, null_text: str = "", overwrite: bool = False
) -> DataFrame:
    """Join the text of ``cols`` in the given order; whole floating-point cells lose their ``.0``."""
    _check_join(df, cols, new, overwrite)
    return df.withColumn(new, _joined(df, cols, separator, null_text))


def merge_columns(
    df: DataFrame,
    cols: Sequence[str],
    new: str,
    separator: str = "",
    *,
    fill_missing: bool = True,
    null_text: str = "nan",
    overwrite: bool = False,
) -> DataFrame:
    """As :func:`concatenate`. ``fill_missing`` joins missing cells as empty text and empties them in
    the source columns too (which become text where they held missing cells of another type);
    without it they are joined as ``null_text``."""
    _check_join(df, cols, new, overwrite)
    merged = _joined(df, cols, separator, "" if fill_missing else null_text)
    if not fill_missing:
        return df.withColumn(new, merged)
    sources = {c: F.coalesce(short_text(col_ref(c), dtype_of(df, c)), F.lit("")) for c in dict.fromkeys(cols)}
    return df.withColumns({**sources, new: merged})


def most_cuts(text: Column, delimiter: str) -> Column:
    """Aggregate: how often the cell with the most delimiters has one."""
    return F.max((F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit("")))) / len(delimiter))


def split_delimiter(
    df: DataFrame,
    col: str,
    delimiter: str,
    *,
    n_parts: int | None = None,
    max_parts: int | None = None,
    check: bool = False,
    cuts: float | None = None,
) -> DataFrame:
    """Replace ``col`` by ``{col}_part1..k``. ``n_parts`` fixes k and keeps the call lazy; otherwise
    one aggregate finds the widest row, and ``max_parts`` makes a wider one an error. Text beyond ``n_parts`` stays in the last part.
    ``check`` raises when no row has the delimiter. Where :func:`most_cuts` of the table is known, ``cuts`` saves the
    aggregate."""
    if not delimiter:
        raise ValueError("the delimiter must not be empty")
    df = as_text_column(df, col)
    text = col_ref(col)
    pattern = strings.literal_regex(delimiter)
    if n_parts is None or check:
        refuse_streams(df, "finding the number of parts")
        widest = int((df.agg(most_cuts(text, delimiter)).first()[0] if cuts is None else cuts) or 0) + 1
        if widest < 2:
            raise ValueError(f"no cell of {col!r} has the delimiter {delimiter!r}")
        if n_parts is None and max_parts is not None and widest > max_parts:
            raise ValueError(f"splitting {col!r} needs {widest} columns; raise max_parts or give n_parts")
        n_parts = n_parts or widest
    names: list[str] = []
    for i in range(n_parts):
        names.append(unique_name(df, f"{col}_part{i + 1}", names))
    # Split once, then read the parts.
    pieces = col_ref(col)
    new = {
        name: F.when(pieces.isNotNull(), F.coalesce(F.get(pieces, F.lit(i)), F.lit("")))
        for i, name in enumerate(names)
    }
    return place_after(df.withColumn(col, F.split(text, pattern, n_parts)), col, new, keep_anchor=False)


def split_surname(df: DataFrame, col: str, *, skip_header_cells: bool = True) -> DataFrame:
    """Move the last word to ``{col}_Surname``; missing and blank cells give two empty texts."""
    df = as_text_column(df, col)
    text, spaced = col_ref(col), "__spaced"
    df = df.withColumn(spaced, strings.single_spaced(text))
    first, last = strings.split_last_word(F.col(spaced))
    if skip_header_cells:
        first = F.when(text == F.lit(col), text).otherwise(first)
        last = F.when(text == F.lit(col), "").otherwise(last)
    surname = unique_name(df, f"{col}_Surname")
    return place_after(df, col, {col: first, surname: last}).drop(spaced)


def extract_pattern(
    df: DataFrame,
    col: str,
    pattern: str,
    new: str,
    *,
    group: int | None = None,
    normalize_ints: bool = True,
    overwrite: bool = False,
) -> DataFrame:
    """First match of a Python-style pattern: group 1, or the whole match if there is no group."""
    require(df, col)
    refuse_existing(df, new, overwrite)
    respelled, groups = java_pattern(pattern)
    if group is None:
        if groups > 1:
            raise ValueError(f"the pattern has {groups} groups; choose one with group=")
        group = min(groups, 1)
    elif not 0 <= group <= groups:
        raise ValueError(f"the pattern has no group {group}")
    df = place_after(df, col, {new: F.regexp_extract(text_of(df, col), respelled, group)})
    # A projection of its own: the match is read several times and found once.
    return df.withColumn(new, drop_point_zero(col_ref(new))) if normalize_ints else df


__all__ = [
    "concatenate", "extract_pattern", "merge_columns", "rename_column", "split_delimiter", "split_surname",
]
