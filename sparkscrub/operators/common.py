"""Plan-time checks, names, column order and cell marks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cell_text, col_ref, guard_header

INVALID, MODIFIED, DUPLICATE, REASON = "__invalid", "__modified", "__duplicate", "__reason"
MARKS = (INVALID, MODIFIED, DUPLICATE, REASON)
_MADE_BY, _MARK_OF = "sparkscrub.mark", "sparkscrub.of"


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(map(repr, missing))}; the table has {df.columns}")


def _folded(df: DataFrame, name: str) -> str:
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    return name if sensitive else name.lower()


def has_column(df: DataFrame, name: str) -> bool:
    return _folded(df, name) in {_folded(df, c) for c in df.columns}


def refuse_existing(df: DataFrame, name: str, overwrite: bool = False) -> None:
    if not name:
        raise ValueError("the new column needs a name")
    if has_column(df, name) and not overwrite:
        raise ValueError(f"column {name!r} already exists")


def unique_name(df: DataFrame, base: str, taken: Iterable[str] = ()) -> str:
    """``base``, or ``base_1``, ``base_2``, ... — the first that no column has."""
    used = {_folded(df, c) for c in [*df.columns, *taken]}
    name, count = base, 0
    while _folded(df, name) in used:
        count += 1
        name = f"{base}_{count}"
    return name


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def text_of(df: DataFrame, name: str) -> Column:
    return cell_text(col_ref(name), dtype_of(df, name))


def place_after(df: DataFrame, anchor: str, new: dict[str, Column], keep_anchor: bool = True) -> DataFrame:
    """``df`` with ``new`` columns right after ``anchor`` (or in its place)."""
    out = []
    for name in df.columns:
        if name == anchor:
            if keep_anchor and anchor not in new:
                out.append(col_ref(name))
            out += [c.alias(n) for n, c in new.items()]
        elif name not in new:
            out.append(col_ref(name))
    return df.select(*out)


def mark_metadata(name: str, mark: str) -> dict:
    """What makes a column a mark of ``name``: its metadata, whatever the column is called."""
    return {_MADE_BY: mark, _MARK_OF: name}


def is_mark(df: DataFrame, label: str) -> bool:
    """Was the column ``label`` made as a mark by this library, and is its column still there?"""
    metadata = df.schema[label].metadata or {}
    return _MADE_BY in metadata and metadata.get(_MARK_OF) in df.columns


def has_mark(df: DataFrame, name: str, mark: str) -> bool:
    """Does ``name`` have this kind of mark? A user's column of the same name is none."""
    label = name + mark
    return label in df.columns and is_mark(df, label) and df.schema[label].metadata[_MADE_BY] == mark


def mark_column(df: DataFrame, name: str, mark: str, found: Column) -> tuple[str, Column]:
    """A mark column that keeps what earlier operations marked. It never replaces a user's column."""
    label = name + mark
    hit = F.coalesce(found, F.lit(False))
    if has_mark(df, name, mark):
        hit = col_ref(label) | hit
    elif has_column(df, label):
        raise ValueError(f"column {label!r} already exists and is no mark; rename it first")
    return label, hit.alias(label, metadata=mark_metadata(name, mark))


def as_text_column(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` as text. Spelling a number is a projection of its own, so that the
    operation after it reads the text several times but spells it once."""
    require(df, name)
    if isinstance(dtype_of(df, name), T.StringType):
        return df
    return df.withColumn(name, text_of(df, name))


def in_place(
    df: DataFrame, name: str, change, flags: bool = False, skip_header_cells: bool = True
) -> DataFrame:
    """Replace column ``name`` by ``change(text)``; with ``flags`` also mark the changed cells."""
    df = as_text_column(df, name)
    text = col_ref(name)
    new = guard_header(text, text, name, change(text), skip_header_cells)
    columns = {name: new}
    if flags:
        label, marked = mark_column(df, name, MODIFIED, ~text.eqNullSafe(new))
        columns[label] = marked
    return df.withColumns(columns)
