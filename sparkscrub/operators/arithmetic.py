"""Rounding and arithmetic on number columns, and on text columns that hold numbers."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import (
    arithmetic,
    decimals_shown,
    finite,
    is_number_type,
    round_half_even,
    to_number,
)
from ..functions.text import WHOLE, cell_text, col_ref
from ..plans.lookup import refuse_streams
from .common import dtype_of, refuse_existing, require


def number_counts(df: DataFrame, *cols: str) -> dict[str, Column]:
    """Aggregates that :func:`require_numbers` reads: rows, and cells of each column that hold a number."""
    counts = [F.count(to_number(col_ref(c), dtype_of(df, c))) for c in cols]
    return {"rows": F.count(F.lit(1)), **{f"n{i}": n for i, n in enumerate(counts)}}


def require_numbers(counts: Mapping[str, int], *cols: str) -> None:
    """Raise when a column with rows has no number at all."""
    for i, c in enumerate(cols):
        if counts["rows"] and not counts[f"n{i}"]:
            raise ValueError(f"column {c!r} holds no numbers")


def _check_numeric(df: DataFrame, *cols: str) -> None:
    """:func:`require_numbers` by one aggregate for all columns."""
    refuse_streams(df, "checking that a column is numeric")
    found = df.agg(*[n.alias(name) for name, n in number_counts(df, *cols).items()]).first()
    require_numbers(found.asDict(), *cols)


def places_shown(df: DataFrame, *cols: str) -> Column:
    """Aggregate: the most decimals that a cell of ``cols`` shows."""
    shown = [decimals_shown(col_ref(c), dtype_of(df, c)) for c in cols]
    return F.coalesce(F.max(F.greatest(*shown)), F.lit(0))


def measures_places(t1: T.DataType, t2: T.DataType) -> bool:
    """Whether ``decimals="auto"`` has to look at the cells: whole numbers and decimals show theirs by type."""
    exact = (*WHOLE, T.DecimalType)
    return not (isinstance(t1, exact) and isinstance(t2, exact))


def _stored(df: DataFrame, col: str, number: Column, as_number: bool, skip_header_cells: bool) -> Column:
    """The result in the column's own kind: text columns get number text and keep header cells."""
    dtype, cell = dtype_of(df, col), col_ref(col)
    if as_number or is_number_type(dtype):
        return number
    spelled = cell_text(number, T.DoubleType())
    return F.when(cell == F.lit(col), cell).otherwise(spelled) if skip_header_cells else spelled


def _as_decimal(value: float) -> Decimal:
    """The shortest decimal that reads as ``value``."""
    return Decimal(repr(value)) if isinstance(value, float) else Decimal(value)


def _exact(a: Column, operation: str, b: Column) -> Column:
    """Decimal arithmetic; null for a division by zero and where the result does not fit."""
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[operation](a, b)


def round_numbers(
    df: DataFrame,
    col: str,
    decimals: int = 2,
    *,
    as_number: bool = False,
    check: bool = False,
    skip_header_cells: bool = True,
) -> DataFrame:
    """Round half-even on the scaled double; decimals exactly, keeping their type. Whole types are
    unchanged, cells that are no number become null. A text column stays text unless ``as_number``."""
    require(df, col)
    if not 0 <= decimals <= 10:
        raise ValueError("decimals must be between 0 and 10")
    if check:
        _check_numeric(df, col)
    dtype = dtype_of(df, col)
    if isinstance(dtype, WHOLE):
        return df
    if isinstance(dtype, T.DecimalType):
        return df.withColumn(col, F.bround(col_ref(col), decimals).cast(dtype)) if decimals < dtype.scale else df
    rounded = round_half_even(to_number(col_ref(col), dtype).cast("double"), decimals)
    return df.withColumn(col, _stored(df, col, rounded, as_number, skip_header_cells))


def calculate_constant(
    df: DataFrame,
    col: str,
    operation: str,
    value: float,
    *,
    as_number: bool = False,
    check: bool = False,
    skip_header_cells: bool = True,
) -> DataFrame:
    """``col operation value`` in place: a double, or for decimals a decimal (null where it does not fit)."""
    require(df, col)
    combine = arithmetic(operation)
    if operation == "/" and float(value) == 0:
        raise ValueError(f"division of {col!r} by zero")
    if check:
        _check_numeric(df, col)
    dtype = dtype_of(df, col)
    if isinstance(dtype, T.DecimalType):
        return df.withColumn(col, _exact(col_ref(col), operation, F.lit(_as_decimal(value))))
    number = to_number(col_ref(col), dtype).cast("double")
    return df.withColumn(
        col, _stored(df, col, combine(number, F.lit(float(value))), as_number, skip_header_cells)
    )


def calculated_column(
    df: DataFrame,
    col1: str,
    col2: str,
    operation: str,
    new: str,
    *,
    decimals: int | str | None = "auto",
    check: bool = False,
) -> DataFrame:
    """``new = col1 operation col2``, rounded to the most decimals either input shows.

    ``decimals="auto"`` finds that number with one aggregate inside the same plan; a number skips
    the aggregate; ``None`` does not round. Division by zero gives null. Decimals, also with whole numbers,
    are combined exactly and show the larger of the two scales.
    """
    require(df, col1, col2)
    refuse_existing(df, new)
    combine = arithmetic(operation)
    if check:
        _check_numeric(df, col1, col2)
    t1, t2 = dtype_of(df, col1), dtype_of(df, col2)
    if not measures_places(t1, t2) and not (isinstance(t1, WHOLE) and isinstance(t2, WHOLE)):
        result = _exact(col_ref(col1), operation, col_ref(col2))
        if decimals == "auto":
            decimals = max(getattr(t, "scale", 0) for t in (t1, t2))
        return df.withColumn(new, result if decimals is None else F.bround(result, int(decimals)))
    a, b = to_number(col_ref(col1), t1), to_number(col_ref(col2), t2)
    result = combine(a, b)
    if isinstance(t1, WHOLE) and isinstance(t2, WHOLE):
        # Whole inputs show no decimals, so there is nothing to round to.
        return df.withColumn(new, finite(result) if operation == "/" else result)
    result = finite(result.cast("double"))
    if decimals == "auto":
        refuse_streams(df, "finding the number of decimals")
        places = df.select(places_shown(df, col1, col2)).scalar()
        result = F.when(places > 0, round_half_even(result, places)).otherwise(result)
    elif decimals is not None:
        result = round_half_even(result, int(decimals))
    return df.withColumn(new, result)
