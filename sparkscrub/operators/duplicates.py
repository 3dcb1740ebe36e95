"""Duplicate cells and duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_ref
from ..plans.lookup import Lookup, cell_keys, materialize, refuse_streams, value_key
from .common import DUPLICATE, dtype_of, mark_column, require

_FOUND = "__is_duplicate"
_ROW, _COLUMN, _KEY, _MASK = "__row_number", "__column_number", "__cell_key", "__mask"
# Truth values in one whole number.
_BITS = 62
# A table that Spark takes to be smaller is not worth a pass that measures how often values repeat.
_WORTH_MEASURING = 1 << 30
# From this share of values that are met once on, their rows are left unshuffled.
_MOSTLY_ONCE = 0.9


def mark_duplicates(
    df: DataFrame, cols: str | Sequence[str], *, hot_rows: int | None = None
) -> DataFrame:
    """Mark (``{col}__duplicate``) every cell whose text occurs twice or more in ``cols`` together.

    Missing cells count as one value. The values that repeat are counted with map-side partial sums, written and
    measured (see :mod:`sparkscrub.plans.lookup`). If they can be broadcast, no row is shuffled. Otherwise the
    cells of all columns meet them in one join of narrow rows, and each row's marks come back to it as one number:
    the rows themselves are shuffled once, however many columns there are.
    """
    cols = [cols] if isinstance(cols, str) else list(dict.fromkeys(cols))
    require(df, *cols)
    refuse_streams(df, "marking duplicates")
    keys = cell_keys({c: (col_ref(c), dtype_of(df, c)) for c in cols})
    lookup = duplicate_values(df, list(keys.values()), hot_rows)
    if len(cols) > 1 and not lookup.small:
        return _marked_at_once(df, keys, lookup)
    for c, key in keys.items():
        df = lookup.attach(df, key, {_FOUND: False})
        label, marked = mark_column(df, c, DUPLICATE, F.col(_FOUND))
        df = df.withColumn(label, marked).drop(_FOUND)
    return df


def _marked_at_once(df: DataFrame, keys: dict[str, Column], lookup: Lookup) -> DataFrame:
    """``df`` with a mark per column of ``keys``, through one join of (row, column, key) and one join back."""
    # Written once, since a row has to keep its number.
    numbered = materialize(df.withColumn(_ROW, F.monotonically_increasing_id()))
    cells = numbered.select(_ROW, F.posexplode(F.array(*keys.values())).alias(_COLUMN, _KEY))
    found = lookup.attach(cells, F.col(_KEY), {_FOUND: False}).where(_FOUND)
    place = F.expr(f"shiftleft(1L, {_COLUMN} % {_BITS})")
    masks = [
        F.bit_or(F.when(F.floor(F.col(_COLUMN) / _BITS) == i, place)).alias(f"{_MASK}{i}")
        for i in range(-(-len(keys) // _BITS))
    ]
    joined = numbered.join(found.groupBy(_ROW).agg(*masks), _ROW, "left").select(
        *[col_ref(c) for c in df.columns], *[f"{_MASK}{i}" for i in range(len(masks))]
    )
    for i, c in enumerate(keys):
        bit = F.col(f"{_MASK}{i // _BITS}").bitwiseAND(F.lit(1 << i % _BITS)) != 0
        label, marked = mark_column(joined, c, DUPLICATE, bit)
        joined = joined.withColumn(label, marked)
    return joined.drop(*[f"{_MASK}{i}" for i in range(len(masks))])


def duplicate_values(df: DataFrame, keys: Sequence[Column], hot_rows: int | None = None) -> Lookup:
    """The keys that occur at least twice in the pooled ``keys``; null is one of them."""
    pool = df.select(keys[0].alias("key") if len(keys) == 1 else F.explode(F.array(*keys)).alias("key"))
    counts = pool.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return Lookup(materialize(counts.withColumn(_FOUND, F.lit(True))), "key", "rows", hot_rows)


def remove_duplicates(
    df: DataFrame, cols: str | Sequence[str], order_by: str | Sequence[str]
) -> DataFrame:
    """Keep, per value of ``cols``, the row that comes first by ``order_by`` (unique, not null).

    Missing is one value. The rows of a value are reduced to one in each task and then shuffled, so a value that
    holds a third of the table sends one row per task. A large table is measured first, by one sketch of its
    hashed values: where nearly all are met once and the others can be broadcast, the marked rows are written once,
    those of values met once pass unshuffled and only the others are reduced.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if not order:
        raise ValueError("order_by is needed to know which row comes first")
    require(df, *cols, *order)
    refuse_streams(df, "keeping the first row per value (use streaming.drop_duplicates)")
    keys = [value_key(col_ref(c), dtype_of(df, c)) for c in cols]
    # Values with the same hash are told apart below; a hash that is met once is a value that is met once.
    hashed = F.xxhash64(*keys)
    if _estimated_bytes(df) >= _WORTH_MEASURING and _share_once(df, hashed) >= _MOSTLY_ONCE:
        lookup = duplicate_values(df, [hashed])
        if lookup.small:
            marked = materialize(lookup.attach(df, hashed, {_FOUND: False}))
            once = marked.where(~F.col(_FOUND)).drop(_FOUND)
            return once.unionAll(_first_rows(marked.where(_FOUND).drop(_FOUND), keys, order))
    return _first_rows(df, keys, order)


def _first_rows(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    row = F.struct(*[col_ref(c) for c in df.columns])
    first = F.min_by(row, F.struct(*[col_ref(c) for c in order])).alias("__row")
    return df.groupBy(*[k.alias(f"__key{i}") for i, k in enumerate(keys)]).agg(first).select("__row.*")


def _estimated_bytes(df: DataFrame) -> int:
    """What Spark's statistics say of the table's size; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _share_once(df: DataFrame, hashed: Column) -> float:
    """About how many distinct values there are per row (one sketch, 1 % off)."""
    found = df.agg(F.approx_count_distinct(hashed, 0.01).alias("values"), F.count(F.lit(1)).alias("rows")).first()
    return found["values"] / max(1, found["rows"])
