"""Head, tail and middle rows of a table by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_ref
from ..operators.common import unique_name
from .lookup import refuse_streams

PREVIEW_ROWS = 1000
# Order keys that a last top-k over keys alone may hold.
_SLACK = 100_000
# Ranges per round, and keys drawn to place their bounds.
_RANGES, _DRAWN = 32, 4000


def slice_rows(
    df: DataFrame,
    position: str,
    n: int = PREVIEW_ROWS,
    *,
    order_by: str | Sequence[str],
    slack: int = _SLACK,
) -> DataFrame:
    """``n`` rows at the ``head``, ``middle`` or ``tail`` of ``df`` ordered by ``order_by``.

    Rows that share their order key are ordered by a hash of all their cells (maps aside), so the slice does not
    depend on how the table is partitioned. Head and tail are top-k plans. The middle is found by narrowing the
    key range (see :func:`_middle_keys`), so neither a full sort nor a single task sees all rows; only where rows
    outside of it share the key of one of its end rows is it looked for once more with the hash.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    refuse_streams(df, "a slice by position")
    missing = [c for c in order if c not in df.columns]
    if missing or not order:
        raise ValueError(f"cannot order by {missing or order}")
    if position not in ("head", "middle", "tail"):
        raise ValueError("position must be 'head', 'middle' or 'tail'")
    names, tie = df.columns, unique_name(df, "__tie")
    hashed = df.withColumn(tie, _content(df))
    ascending = [col_ref(c).asc_nulls_first() for c in [*order, tie]]
    if position == "head":
        return hashed.orderBy(*ascending).limit(n).select(*map(col_ref, names))
    if position == "tail":
        last = hashed.orderBy(*[col_ref(c).desc_nulls_last() for c in [*order, tie]]).limit(n)
        return last.orderBy(*ascending).select(*map(col_ref, names))
    ends = _middle_keys(df, order, n, slack)
    if ends is None:
        return df.limit(0)
    low, high, n_low, n_high = ends
    if n_low is None:
        return df.where(_between(df, order, low, high)).orderBy(*ascending[:-1]).limit(n)
    order = [*order, tie]
    low, high, n_low, n_high = _middle_keys(hashed, order, n, slack)
    if n_low is None:
        return hashed.where(_between(hashed, order, low, high)).orderBy(*ascending).limit(n).select(*map(col_ref, names))
    # Rows that share the hash too are alike: any of them will do.
    key = _key(order)
    at_low, at_high = (hashed.where((key == _literal(hashed, order, end)) & _between(hashed, order, end, end)) for end in (low, high))
    rows = at_low.limit(n_low)
    if low != high:
        inside = (key > _literal(hashed, order, low)) & (key < _literal(hashed, order, high))
        rows = rows.unionAll(hashed.where(inside & _between(hashed, order, low, high))).unionAll(at_high.limit(n_high))
    return rows.orderBy(*ascending).limit(n).select(*map(col_ref, names))


def _content(df: DataFrame) -> Column:
    """A hash of all cells of a row; those that cannot be hashed (maps) are left out."""
    return F.xxhash64(F.lit(0), *[col_ref(f.name) for f in df.schema if not _has_map(f.dataType)])


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype)
    return isinstance(dtype, (T.MapType, T.VariantType))


def _middle_keys(df: DataFrame, order: list[str], n: int, slack: int) -> tuple | None:
    """First and last key of the slice, and how many rows of either are in it where some are not (else None).

    None for an empty slice. Only order columns are read.

    Each round cuts the candidate keys into ranges at keys drawn from them, counts every range with map-side
    sums, and keeps the ranges that touch the slice, until ``2 * n + slack`` keys are left to sort.
    """
    keys = df.select(_key(order).alias("key"))
    total = keys.count()
    length = min(n, total)
    if length <= 0:
        return None
    first_rank = start = (total - length) // 2
    near, held = keys, total
    low = high = ends = None
    while held > 2 * n + slack:
        bounds = _bounds(near, held)
        counts = _range_sizes(near, df, order, bounds)
        seen, kept = 0, []
        for at in range(len(bounds) + 1):
            size = counts.get(at, 0)
            if seen + size > start and seen < start + length:
                kept.append((at, size, seen))
            seen += size
        first, last = kept[0][0], kept[-1][0]
        # Range ``at`` holds the keys from bound ``at - 1`` (included) to bound ``at`` (excluded).
        low = bounds[first - 1] if first > 0 else low
        high = bounds[last] if last < len(bounds) else high
        now = sum(size for _, size, _ in kept)
        if now == held:
            ends = _ends_of_many(near, df, order, start, length, held)
            if ends is None:
                raise ValueError(f"the keys {order} of {held} rows cannot be told apart by a draw; raise slack")
            break
        start, held = start - kept[0][2], now
        near = keys.where(_inside(df, order, low, high))
    if ends is None:
        found = near.orderBy("key").offset(start).limit(length)
        ends = tuple(map(tuple, found.agg(F.min("key"), F.max("key")).first()))
    low, high = ends
    at_low, at_high = (F.col("key") == _literal(df, order, end) for end in ends)
    before = F.col("key") < _literal(df, order, low)
    counts = keys.where(F.col("key") <= _literal(df, order, high)).agg(
        F.count_if(before), F.count_if(at_low), F.count_if(at_high), F.count(F.lit(1))
    )
    n_before, n_low, n_high, n_all = counts.first()
    if n_all - n_before == length:
        return low, high, None, None
    if low == high:
        return low, high, length, length
    used = n_low - (first_rank - n_before)
    return low, high, used, length - used - (n_all - n_before - n_low - n_high)


def _ends_of_many(
    near: DataFrame, df: DataFrame, order: list[str], start: int, length: int, held: int
) -> tuple | None:
    """First and last key of the slice where it begins within the least key's rows and ends within the largest's."""
    low, high = map(tuple, near.agg(F.min("key"), F.max("key")).first())
    if low == high:
        return low, high
    at = [F.count_if(F.col("key") == _literal(df, order, end)) for end in (low, high)]
    n_low, n_high = near.agg(*at).first()
    return (low, high) if start < n_low and start + length > held - n_high else None


def _key(order: list[str]) -> Column:
    return F.struct(*[col_ref(c).alias(f"k{i}") for i, c in enumerate(order)])


def _literal(df: DataFrame, order: list[str], row) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(f"k{i}") for i, (v, c) in enumerate(zip(row, order))])


def _bounds(near: DataFrame, held: int) -> list[tuple]:
    """Up to ``_RANGES`` - 1 distinct keys that cut a draw of the candidates into equal parts."""
    drawn = sorted(
        (tuple(r["key"]) for r in near.sample(min(1.0, _DRAWN / held), seed=17).collect()),
        key=lambda key: tuple((v is not None, v) for v in key),
    )
    step = max(1, len(drawn) // _RANGES)
    return list(dict.fromkeys(drawn[step::step]))[: _RANGES - 1]


def _range_sizes(near: DataFrame, df: DataFrame, order: list[str], bounds: list[tuple]) -> dict[int, int]:
    """Keys per range: one row per range and task is shuffled."""
    at = F.lit(0)
    for bound in bounds:
        at = at + (F.col("key") >= _literal(df, order, bound)).cast("int")
    return {r[0]: r[1] for r in near.groupBy(at.alias("at")).count().collect()}


def _inside(df: DataFrame, order: list[str], low, high) -> Column:
    """Keys from ``low`` (included) to ``high`` (excluded); None is open."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("key") >= _literal(df, order, low))
    if high is not None:
        inside = inside & (F.col("key") < _literal(df, order, high))
    return inside


def _between(df: DataFrame, order: list[str], low, high) -> Column:
    """Order keys from ``low`` to ``high``. The first column's own range can reach the scan."""
    key = _key(order)
    inside = (key >= _literal(df, order, low)) & (key <= _literal(df, order, high))
    first = col_ref(order[0])
    if low[0] is None or high[0] is None:
        return inside
    kind = df.schema[order[0]].dataType
    return first.between(F.lit(low[0]).cast(kind), F.lit(high[0]).cast(kind)) & inside
