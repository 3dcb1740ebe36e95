"""Reports about a table: profile, differences, issues and validation totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHOLE, cell_text, col_ref, is_missing, no_nan
from ..operators.common import DUPLICATE, INVALID, MARKS, MODIFIED, REASON, has_mark, is_mark, require
from .lookup import text_key, value_key


def count_rows(df: DataFrame) -> int:
    """The number of records (not of lines in the files)."""
    return df.count()


def data_columns(df: DataFrame) -> list[str]:
    """The columns that are not marks of another column."""
    return [c for c in df.columns if not is_mark(df, c)]


def profile(df: DataFrame, cols: Sequence[str] | None = None, *, approx: bool = False) -> DataFrame:
    """One row per column: type, distinct values (missing counts as one), missing cells, widest text
    including the column name.

    Exact counts write each row once per column before the shuffle and send each distinct value of each
    column through it, long text and nested values (as JSON) by digest; ``approx=True`` needs no such shuffle.
    """
    cols = list(cols) if cols is not None else data_columns(df)
    require(df, *cols)
    totals, rows = [], []
    for i, name in enumerate(cols):
        dtype, cell = df.schema[name].dataType, col_ref(name)
        if approx:
            counted = F.approx_count_distinct(F.to_json(cell) if isinstance(dtype, _NESTED) else no_nan(cell, dtype))
        else:
            counted = F.count_distinct(_distinct_key(cell, dtype))
        missing = F.coalesce(F.max(is_missing(cell, dtype)), F.lit(False))
        totals += [
            (counted + missing.cast("bigint")).alias(f"d{i}"),
            missing.alias(f"m{i}"),
            F.greatest(F.coalesce(_widest(cell, dtype), F.lit(0)), F.lit(len(name))).alias(f"w{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype.simpleString()).alias("type"),
                F.col(f"d{i}").alias("distinct_values"),
                F.col(f"m{i}").alias("has_missing"),
                F.col(f"w{i}").cast("bigint").alias("max_width"),
            )
        )
    return df.agg(*totals).select(F.inline(F.array(*rows)))


def _widest(cell: Column, dtype: T.DataType) -> Column:
    """Length of the longest cell text. No whole number is longer than the least or the greatest."""
    if isinstance(dtype, WHOLE):
        return F.greatest(*[F.length(end(cell).cast("string")) for end in (F.min, F.max)])
    return F.max(F.length(_shown(cell, dtype)))


_NESTED = (T.ArrayType, T.MapType, T.StructType)


def _shown(cell: Column, dtype: T.DataType) -> Column:
    """The text of any cell: nested values as JSON, bytes as they are."""
    if isinstance(dtype, _NESTED):
        return F.to_json(cell)
    return cell if isinstance(dtype, T.BinaryType) else cell_text(cell, dtype)


def _distinct_key(cell: Column, dtype: T.DataType) -> Column:
    return text_key(F.to_json(cell)) if isinstance(dtype, _NESTED) else value_key(cell, dtype)


def diff_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: added and removed columns, rows before and after (one job)."""
    old, new = data_columns(before), data_columns(after)
    sides = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    total = sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after")
    )
    return total.select(
        F.lit(", ".join(sorted(set(new) - set(old)))).alias("added_columns"),
        F.lit(", ".join(sorted(set(old) - set(new)))).alias("removed_columns"),
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
    )


def cell_diff(
    before: DataFrame, after: DataFrame, key_cols: str | Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """Which cells differ between two versions of a table: ``(key..., column, change, before, after)``.

    A row is known by its ``key_cols``, where missing is a value like others. ``change`` is ``changed``, or ``added`` or
    ``removed`` for a row that is in one version only (once per row, without column). ``cols`` are the data
    columns that both versions have, unless given; cells of one type are compared by value, others by text, and
    two missing cells are equal. The cells are shown as text.

    Both versions go through one shuffle by key. A key that two rows of a version share stops the query; such rows
    are counted before the shuffle, so it is found without collecting them.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    if cols is None:
        cols = [c for c in data_columns(before) if c in data_columns(after) and c not in keys]
    require(before, *keys, *cols)
    require(after, *keys, *cols)
    types = [(before.schema[c].dataType, after.schema[c].dataType) for c in cols]
    by_value = [a == b and not isinstance(a, (T.MapType, T.VariantType)) for a, b in types]

    def side(df: DataFrame, is_after: bool) -> DataFrame:
        cells = [
            (col_ref(c) if same else _shown(col_ref(c), df.schema[c].dataType)).alias(f"c{i}")
            for i, (c, same) in enumerate(zip(cols, by_value, strict=True))
        ]
        names = [_comparable(col_ref(k), df.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)]
        return df.select(*names, F.struct(*cells, F.lit(0).alias("none")).alias("row"), F.lit(is_after).alias("is_after"))

    def rows(is_after: bool) -> Column:
        return F.count_if(F.col("is_after") == is_after)

    def row(is_after: bool) -> Column:
        return F.first(F.when(F.col("is_after") == is_after, F.col("row")), ignorenulls=True)

    named = [f"k{i}" for i in range(len(keys))]
    met = side(before, False).unionAll(side(after, True)).groupBy(*named).agg(
        rows(False).alias("n0"), rows(True).alias("n1"), row(False).alias("r0"), row(True).alias("r1")
    )
    shared = F.raise_error(F.lit(f"two rows have the same {', '.join(keys)}; cell_diff needs a key")).cast("boolean")
    met = met.where(F.when((F.col("n0") > 1) | (F.col("n1") > 1), shared).otherwise(F.lit(True)))

    def change(kind: str, column: str | None, shown: tuple[Column, Column]) -> Column:
        values = F.lit(column).cast("string").alias("column"), F.lit(kind).alias("change")
        return F.struct(*values, shown[0].alias("before"), shown[1].alias("after"))

    nothing = F.lit(None).cast("string")
    found = [
        F.when(F.col("n0") == 0, change("added", None, (nothing, nothing))),
        F.when(F.col("n1") == 0, change("removed", None, (nothing, nothing))),
    ]
    for i, (c, same) in enumerate(zip(cols, by_value, strict=True)):
        old, new = F.col(f"r0.c{i}"), F.col(f"r1.c{i}")
        shown = tuple(_shown(x, types[i][0]).cast("string") if same else x for x in (old, new))
        both = (F.col("n0") > 0) & (F.col("n1") > 0)
        found.append(F.when(both & ~old.eqNullSafe(new), change("changed", c, shown)))
    changes = F.filter(F.array(*found), lambda x: x.isNotNull())
    return met.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.inline(changes))


def _comparable(cell: Column, dtype: T.DataType) -> Column:
    return F.to_json(cell) if isinstance(dtype, T.MapType) else no_nan(cell, dtype)


def changed_cells(before: DataFrame, after: DataFrame, key_cols: str | Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Totals of :func:`cell_diff`: ``column``, ``change``, ``cells`` (rows for ``added`` and ``removed``)."""
    return cell_diff(before, after, key_cols, cols).groupBy("column", "change").agg(F.count(F.lit(1)).alias("cells"))


def profile_state(df: DataFrame, cols: Sequence[str] | None = None, *, by: str | Sequence[str] = ()) -> DataFrame:
    """What :func:`merged_profile` needs of a part of a growing table, to be stored: one row per column, and per value
    of ``by`` (say, the day): ``column, type, rows, missing, max_width, sketch``.

    ``sketch`` (at most 4 KB) holds the distinct values of the part. One pass with partial sums in each task.
    """
    by = [by] if isinstance(by, str) else list(by)
    cols = list(cols) if cols is not None else [c for c in data_columns(df) if c not in by]
    require(df, *by, *cols)
    totals, rows = [F.count(F.lit(1)).alias("__rows")], []
    for i, name in enumerate(cols):
        dtype, cell = df.schema[name].dataType, col_ref(name)
        missing = is_missing(cell, dtype)
        totals += [
            F.hll_sketch_agg(F.when(~missing, F.xxhash64(_distinct_key(cell, dtype)))).alias(f"__s{i}"),
            F.count(F.when(missing, 1)).alias(f"__m{i}"),
            F.greatest(F.coalesce(_widest(cell, dtype), F.lit(0)), F.lit(len(name))).alias(f"__w{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype.simpleString()).alias("type"),
                F.col("__rows").alias("rows"),
                F.col(f"__m{i}").alias("missing"),
                F.col(f"__w{i}").cast("bigint").alias("max_width"),
                F.col(f"__s{i}").alias("sketch"),
            )
        )
    parts = df.groupBy(*map(col_ref, by)).agg(*totals) if by else df.agg(*totals)
    return parts.select(*map(col_ref, by), F.inline(F.array(*rows)))


def merged_profile(*states: DataFrame) -> DataFrame:
    """The profile of all parts together, from their states alone: ``column, type, distinct_values`` (about; missing
    counts as one), ``has_missing, max_width, rows, missing``. A column whose type changed has a row per type."""
    kept = ["column", "type", "rows", "missing", "max_width", "sketch"]
    parts = [state.select(*kept) for state in states]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionAll(part)
    merged = together.groupBy("column", "type").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("values"),
        *[F.sum(c).alias(c) for c in ("rows", "missing")],
        F.max("max_width").alias("max_width"),
    )
    has_missing = F.col("missing") > 0
    return merged.select(
        "column",
        "type",
        (F.col("values") + has_missing.cast("bigint")).alias("distinct_values"),
        has_missing.alias("has_missing"),
        "max_width",
        "rows",
        "missing",
    )


def marked_columns(df: DataFrame, *marks: str) -> list[str]:
    return [c for c in df.columns if any(has_mark(df, c, m) for m in marks or MARKS)]


def issue_report(
    df: DataFrame, key_cols: str | Sequence[str], cols: Sequence[str] | None = None, *, all_kinds: bool = False
) -> DataFrame:
    """One row per marked cell: ``(key..., column, kind, reason, value)``.

    A cell with several marks is reported once, ``invalid`` before ``duplicate`` before
    ``modified``, unless ``all_kinds``. No shuffle.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    cols = list(cols) if cols is not None else marked_columns(df, INVALID, DUPLICATE, MODIFIED)
    require(df, *keys, *cols)
    cells: list[Column] = []
    for name in cols:
        value = cell_text(col_ref(name), df.schema[name].dataType)
        reason = col_ref(name + REASON) if has_mark(df, name, REASON) else F.lit(None).cast("string")
        kinds = []
        for mark, kind in ((INVALID, "invalid"), (DUPLICATE, "duplicate"), (MODIFIED, "modified")):
            if has_mark(df, name, mark):
                issue = F.struct(
                    F.lit(name).alias("column"),
                    F.lit(kind).alias("kind"),
                    (reason if kind == "invalid" else F.lit(None).cast("string")).alias("reason"),
                    value.alias("value"),
                )
                kinds.append(F.when(col_ref(name + mark), issue))
        cells += kinds if all_kinds else [F.coalesce(*kinds)] if kinds else []
    if not cells:
        raise ValueError("the table has no marks; validate, mark duplicates or pass flags=True first")
    found = F.explode(F.filter(F.array(*cells), lambda issue: issue.isNotNull()))
    return df.select(*[col_ref(k) for k in keys], found.alias("__issue")).select(
        *[col_ref(k) for k in keys], "__issue.*"
    )


def validation_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per marked column: valid and total cells, the rate in percent, and the cells marked as
    duplicate or modified (one aggregate). What a column was not checked for is null."""
    cols = list(cols) if cols is not None else marked_columns(df, INVALID, DUPLICATE, MODIFIED)
    require(df, *cols)
    if not cols or not all(any(has_mark(df, c, m) for m in (INVALID, DUPLICATE, MODIFIED)) for c in cols):
        raise ValueError("no column of the table has been validated, or one of those named has no marks")

    def count(name: str, mark: str, marked: bool) -> Column:
        if not has_mark(df, name, mark):
            return F.lit(None).cast("bigint")
        return F.count(F.when(col_ref(name + mark) if marked else ~col_ref(name + mark), 1))

    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            count(c, mark, mark != INVALID).alias(f"{letter}{i}")
            for i, c in enumerate(cols)
            for letter, mark in (("v", INVALID), ("d", DUPLICATE), ("m", MODIFIED))
        ],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"v{i}").alias("valid"),
            F.col("total"),
            F.when(
                F.lit(has_mark(df, c, INVALID)),
                F.coalesce(F.try_divide(F.col(f"v{i}") * 100.0, F.col("total")), F.lit(0.0)),
            ).alias("rate"),
            F.col(f"d{i}").alias("duplicates"),
            F.col(f"m{i}").alias("modified"),
        )
        for i, c in enumerate(cols)
    ]
    return totals.select(F.inline(F.array(*rows)))


def reason_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cells per column and reason; partial counts before the shuffle."""
    cols = list(cols) if cols is not None else marked_columns(df, REASON)
    require(df, *[c + REASON for c in cols])
    pairs = [F.struct(F.lit(c).alias("column"), col_ref(c + REASON).alias("reason")) for c in cols]
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "reason").agg(F.count(F.lit(1)).alias("cells"))
