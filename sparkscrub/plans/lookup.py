"""Joining a value table back to the data it was computed from.

The value table (duplicated values, group codes, ...) is written once, measured, and only then is
the join chosen: a broadcast when its measured size is under the session's broadcast limit,
otherwise a shuffle join in which rows of common values are spread by a salt over many tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHOLE, cell_text, no_nan, quoted

# Values longer than this many bytes are compared by their SHA-256 digest.
_DIGEST_FROM = 64
# Rows of a hot value, and missing cells, are spread over this many tasks.
_SALTS = 256
_BROADCAST_LIMIT = 10 * 1024 * 1024
_LINK, _SALT = "__lookup_key", "__lookup_salt"
# Tables written by each application and not yet released.
_written: dict[str, list[str]] = {}


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = folder or context.getCheckpointDir()
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def use_own_folder(spark: SparkSession) -> None:
    """Give a local session that names no folder one of its own; other sessions are left alone."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and context.getCheckpointDir() is None and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder, so that losing executors loses nothing.

    The table stays until :func:`release_tables`.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application. DataFrames that read them must not run afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def text_key(text: Column) -> Column:
    """A comparison key of bounded length: short text itself, long text by digest; null stays null."""
    return F.when(F.octet_length(text) <= _DIGEST_FROM, F.concat(F.lit("="), text)).otherwise(
        F.concat(F.lit("#"), F.sha2(text, 256))
    )


def value_key(c: Column, dtype: T.DataType) -> Column:
    """Comparison key by value: numbers and dates as they are, text bounded, missing null."""
    return text_key(c) if isinstance(dtype, T.StringType) else no_nan(c, dtype)


def cell_keys(columns: dict[str, tuple[Column, T.DataType]]) -> dict[str, Column]:
    """Comparison keys by cell text, shared by all ``columns``; missing is null.

    Whole numbers, and dates and truth values of one type, are equal when their texts are.
    """
    kinds = {type(dtype) for _, dtype in columns.values()}
    if kinds <= set(WHOLE):
        return {name: c.cast("bigint") for name, (c, _) in columns.items()}
    if len(kinds) == 1 and kinds <= {T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType}:
        return {name: c for name, (c, _) in columns.items()}
    return {name: text_key(cell_text(c, dtype)) for name, (c, dtype) in columns.items()}


def broadcast_limit(spark: SparkSession) -> int:
    """The session's broadcast limit in bytes; 0 when broadcasting is off."""
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", str(_BROADCAST_LIMIT)).strip().lower()
    units = {"b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}
    digits = setting.rstrip("bkmg")
    return max(0, int(digits) * units.get(setting[len(digits) :] or "b", 1))


def row_bytes(df: DataFrame, columns: list[str]) -> Column:
    """Rough in-memory bytes of one row of ``columns``."""
    size = F.lit(32)
    for name in columns:
        if isinstance(df.schema[name].dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(name), F.lit(0)) + 16
        else:
            size = size + 16
    return size


class Lookup:
    """A written table ``key, payload..., rows``: at most one row per key, ``rows`` = rows with it.
    The row of the null key, if there is one, stands for missing cells.

    A value is hot when it has more rows than an average task would get, so there are fewer hot values than
    tasks; ``hot_rows`` replaces that number.
    """

    def __init__(self, table: DataFrame, key: str, rows: str, hot_rows: int | None = None):
        self.key, self.table = key, table
        spark = table.sparkSession
        self.payload = [c for c in table.columns if c not in (key, rows)]
        is_null = F.col(key).isNull()
        size = table.agg(
            F.sum(row_bytes(table, [key, *self.payload])).alias("bytes"),
            F.sum(rows).alias("rows"),
            F.max(F.when(is_null, F.struct(*self.payload))).alias("of_null"),
        ).first()
        self.bytes, total, self.of_null = size["bytes"] or 0, size["rows"] or 0, size["of_null"]
        self.small = self.bytes <= broadcast_limit(spark)
        self.hot_keys = []
        if not self.small:
            parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
            cut = total // parts if hot_rows is None else hot_rows
            hot = table.where((F.col(rows) > cut) & ~is_null)
            self.hot_keys = [row[0] for row in hot.select(key).collect()]

    def attach(self, df: DataFrame, key: Column, unknown: dict[str, object]) -> DataFrame:
        """``df`` plus the payload of its rows' keys; ``unknown`` is for keys the table does not have.

        One scan of ``df``. In the shuffle join a row of a hot value or a missing cell gets a salt from its
        content and partition, a hot value of the table is there once per salt, and all else has salt 0.
        """
        keyed = df.withColumn(_LINK, key)
        other = self.table.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias(_LINK), *self.payload)
        if self.small:
            joined = keyed.join(F.broadcast(other), _LINK, "left")
        else:
            link = F.col(_LINK)
            common = link.isin(self.hot_keys) if self.hot_keys else F.lit(False)
            content = [F.col(quoted(f.name)) for f in df.schema if "map<" not in f.dataType.simpleString()]
            spread = F.pmod(F.xxhash64(*content, F.spark_partition_id()), F.lit(_SALTS)).cast("int")
            keyed = keyed.withColumn(_SALT, F.when(link.isNull() | common, spread).otherwise(0))
            salts = F.when(common, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
            other = other.withColumn(_SALT, F.explode(salts))
            joined = keyed.join(other, [_LINK, _SALT], "left")
        out = [joined[quoted(c)] for c in df.columns]
        for p in self.payload:
            null_value = F.lit(unknown[p] if self.of_null is None else self.of_null[p])
            found = F.coalesce(joined[p], F.lit(unknown[p]))
            out.append(F.when(joined[_LINK].isNull(), null_value).otherwise(found).alias(p))
        return joined.select(*out)


def attach_known(df: DataFrame, key: Column, counted: DataFrame, name: str, marks: list[str]) -> DataFrame:
    """``df`` plus the truth columns ``marks`` of ``counted`` (``name, rows, marks``: one row per key
    of ``df``). Only keys with a mark are kept for the join."""
    worth = F.lit(False)
    for mark in marks:
        worth = worth | F.col(mark)
    # Keys that are common in the data are kept too: they tell the join what to spread.
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    share = counted.agg(F.sum("rows")).first()[0] or 0
    table = materialize(counted.where(worth | (F.col("rows") > max(1, share // parts))).select(name, "rows", *marks))
    return Lookup(table, name, "rows").attach(df, key, dict.fromkeys(marks, False))


def refuse_streams(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs the whole table and does not run on a stream")
