"""Recipes and duplicate removal (by arrival or by an order) on streams.

Every cell operator, the validators and the fixed-width column operators are projections and run
on a stream as they are; operators that need the whole table refuse one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_ref, quoted
from ..operators.common import dtype_of, require, unique_name
from ..plans.lookup import value_key
from ..plans.recipe import Recipe
from ..sources.tables import MISSING_TOKENS, csv_reader, typed_cells, without_tokens


def read_stream(
    spark: SparkSession,
    path: str,
    format: str,
    schema: T.StructType | str,
    *,
    pattern: str | None = None,
    missing_tokens: Sequence[str] = MISSING_TOKENS,
    multi_line: bool = True,
    on_bad: str = "raise",
) -> DataFrame:
    """New files under ``path`` as a stream; ``pattern`` selects file names.

    CSV cells are read as :func:`sparkscrub.sources.tables.read_table` reads them: the same missing tokens
    and number spellings, line breaks inside quotes (one task per file unless ``multi_line`` is off), and an error
    for a cell that does not fit ``schema``, which names all columns of the files in their order.
    """
    reader = spark.readStream.format(format)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if format != "csv":
        return reader.schema(schema).load(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])
    text = csv_reader(reader, multi_line).option("enforceSchema", False).schema(as_text).load(path)
    return typed_cells(without_tokens(text, missing_tokens), wanted, on_bad)


def apply_recipe(stream: DataFrame, recipe: Recipe, *, flags: bool = False) -> DataFrame:
    """Replay ``recipe`` on every batch; whole-table operations raise."""
    if not stream.isStreaming:
        raise ValueError("not a stream; use Recipe.apply")
    return recipe.apply(stream, flags=flags)


def drop_duplicates(
    stream: DataFrame, cols: str | Sequence[str], *, event_time: str, within: str
) -> DataFrame:
    """Keep the first row to arrive per value of ``cols``; state is dropped after ``within``.

    The rows come out with the columns and types they came in with. All rows of a value meet in one task
    (:func:`first_by_order` reduces them before).
    """
    columns = stream.columns
    cols = [cols] if isinstance(cols, str) else list(cols)
    require(stream, event_time, *cols)
    stream, instant = _with_instant(stream, event_time)
    first = stream.withWatermark(quoted(instant), within).dropDuplicatesWithinWatermark(cols)
    return first.select(*map(col_ref, columns))


_MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def first_by_order(
    stream: DataFrame,
    cols: str | Sequence[str],
    order_by: str | Sequence[str],
    *,
    event_time: str,
    within: str,
) -> DataFrame:
    """Keep, per value of ``cols``, the row that comes first by ``order_by`` (unique, not null), whenever it arrives.

    Rows of a value less than ``within`` apart in event time belong together. Their first row comes out once, in
    append mode, when the watermark (``within`` behind the newest row) has passed the last of them by ``within``;
    then their state is dropped. So while a value's rows are never further apart, this is
    :func:`sparkscrub.operators.duplicates.remove_duplicates` of the rows that are not late. Missing is one value.
    A row without an event time belongs nowhere and stops the query. The rows of a value are reduced to one for
    each run of them in every task before they are shuffled, so a hot value sends few rows: the setting
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is turned on for it in the
    stream's session unless it has been set there. The rows come out with the columns and types they came in with.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if not cols or not order:
        raise ValueError("columns and order_by are needed")
    require(stream, event_time, *cols, *order)
    spark = stream.sparkSession
    if _MERGE_SESSIONS not in spark.conf.getAll:
        spark.conf.set(_MERGE_SESSIONS, "true")
    row = F.struct(*[col_ref(c) for c in stream.columns])
    keys = [value_key(col_ref(c), dtype_of(stream, c)).alias(f"__key{i}") for i, c in enumerate(cols)]
    order_key = F.struct(*[col_ref(c) for c in order])
    stream, instant = _with_instant(stream, event_time)
    placed = F.coalesce(col_ref(instant), F.raise_error(F.lit(f"a row has no {event_time}")).cast("timestamp"))
    narrow = stream.select(placed.alias("__at"), *keys, row.alias("__row"), order_key.alias("__order"))
    run = F.session_window("__at", within).alias("__run")
    found = narrow.withWatermark("__at", within).groupBy(run, *[f"__key{i}" for i in range(len(cols))])
    return found.agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def _with_instant(stream: DataFrame, event_time: str) -> tuple[DataFrame, str]:
    """``stream`` with a column that watermarks can use, and its name."""
    if not isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
        return stream, event_time
    # Watermarks need an instant; a local time is read in the session's time zone.
    instant = unique_name(stream, "__instant")
    return stream.withColumn(instant, col_ref(event_time).cast("timestamp")), instant
