"""Group codes: every distinct value gets its rank among the sorted distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_ref, no_nan
from ..plans.lookup import Lookup, materialize, refuse_streams, value_key
from .common import dtype_of, require, unique_name


def _ranked(df: DataFrame, col: str) -> DataFrame:
    """Written table ``value, rows, code``; missing, if there is any, is a value with code 0.

    The distinct values are range-sorted over many tasks; a value's code is its place in its own
    partition plus the sizes of the partitions before it. Missing sorts last and moves no code.
    """
    value = no_nan(col_ref(col), dtype_of(df, col))
    counted = df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    # Written before partitions are counted: a second sort could cut the ranges elsewhere.
    placed = materialize(
        counted.orderBy(F.col("value").asc_nulls_last()).select(
            "value",
            "rows",
            F.shiftrightunsigned(F.monotonically_increasing_id(), 33).alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place"),
        )
    )
    # One row per task of the sort, however many values there are: a window over them is small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    code = F.when(F.col("value").isNull(), 0).otherwise(F.col("start") + F.col("place") + 1)
    return placed.join(F.broadcast(starts), "part").select("value", "rows", code.alias("code"))


def distinct_codes(df: DataFrame, col: str) -> DataFrame:
    """The mapping ``(value, code)``; its row count is the number of distinct values."""
    require(df, col)
    refuse_streams(df, "group codes")
    return _ranked(df, col).where("value IS NOT NULL").select("value", "code")


def distinct_group(df: DataFrame, col: str, *, hot_rows: int | None = None) -> DataFrame:
    """Add ``{col}_distinct_group``: 1-based rank of the value, 0 for missing cells."""
    require(df, col)
    refuse_streams(df, "group codes")
    new = unique_name(df, f"{col}_distinct_group")
    dtype = dtype_of(df, col)
    ranked = _ranked(df, col)
    table = ranked.select(
        value_key(F.col("value"), dtype).alias("key"), F.col("code").alias(new), "rows"
    )
    return Lookup(table, "key", "rows", hot_rows).attach(df, value_key(col_ref(col), dtype), {new: 0})
