"""Shared parts of the corpus operators: scratch tables, distributed ranks, connected components, texts as bytes.

Intermediate tables are Parquet in the folder named by ``spark.checkpoint.dir``, which every executor
and the driver can read, so a lost executor costs a rerun of its tasks and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lookup import use_own_folder, work_folder

# ASCII white space, the word separators of every operator here.
SPACE = "\\x20\\x09-\\x0D"


class Scratch:
    """Tables written to the shared folder, each under a name of its own; ``drop`` frees one early."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        use_own_folder(spark)
        self.folder = f"{work_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._made: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` computed once; later reads come from the written files."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        self._made[name] = path
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._made.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Delete every table of this object; nothing that reads them may run afterwards."""
        self.drop(*self._made)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def doc_bucket(doc_id: Column, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words: word starts are counted, without building the words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def uniform(*columns: Column) -> Column:
    """A number strictly between 0 and 1 fixed by the columns' values: 52 bits of their hash."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double") + 0.5) / float(2**52)


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str, scratch: Scratch) -> DataFrame:
    """``df`` plus ``rank``: the row's place (from 0) in its group by ``order``, gapless, ties in any order.

    A group of any size spreads over many tasks: rows are range-partitioned by group and order, and a
    row's rank is its place in the partition plus the group's rows in earlier partitions. The table of
    counts has at most one row per partition and one per group.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in [*groups, *order]]
    n = partitions(spark)
    spread = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mono = F.monotonically_increasing_id()
    placed = scratch.save(
        spread.select("*", F.shiftright(mono, 33).alias("__part"), mono.bitwiseAND(2**33 - 1).alias("__at")),
        f"ranked_{rank}",
    )
    counts = (
        placed.groupBy("__part", *groups)
        .agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
        .select("*", F.struct(*groups).alias("__group"))
    )
    # One row per partition and group: few, as partitions are ranges of groups.
    before = F.sum("__rows").over(
        Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        F.col("__part").alias("__p"),
        F.col("__group").alias("__g"),
        (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    on = (F.col("__part") == F.col("__p")) & F.struct(*groups).eqNullSafe(F.col("__g"))
    joined = placed.join(offsets, on)
    return joined.select(*df.columns, (F.col("__at") + F.col("__shift")).alias(rank))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b`` longs): rows ``node``, ``root`` = smallest node reachable.

    Alternating star contraction: every round points each node's larger neighbours, then its smaller
    ones, at its smallest neighbour, until the edges are stars. Only sums reach the driver. A table with one
    row per node is broadcast while the counted edges bound its size; beyond that it is written first, so
    that Spark can split the join of a node with many neighbours.
    """

    def counted(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def per_node(df: DataFrame, part: str) -> DataFrame:
        return F.broadcast(df) if 64 * last[0] <= SMALL_BYTES else scratch.save(df, f"{name}_{part}{done}")

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.save(e, f"{name}_edges0")
    last, done = counted(e), 0
    while last[0]:
        files = 1 + last[0] // 200_000  # a file for each so many edges
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = per_node(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.where("a <> b").distinct().coalesce(files), f"{name}_large{done}")
        lower = per_node(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        stars = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = stars.unionAll(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        done += 1
        e = scratch.save(stars.coalesce(files), f"{name}_edges{done}")
        now = counted(e)
        scratch.drop(f"{name}_edges{done - 1}", f"{name}_large{done - 1}")
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: Above this many bytes a written table is joined by shuffle instead of broadcast.
SMALL_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a written table) as the broadcast side of a join if its measured size allows, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a row for later decisions: its id and its text; nulls are values like others."""
    return F.struct(
        F.coalesce(doc_id.cast("string"), F.lit("null")).alias("id"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
    )


def without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose :func:`row_key` is not in the column ``key`` of ``gone`` (a written table)."""
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"),
        row_key(F.col(doc_id), F.col(text)).alias("__key"),
    )
    return rows.join(small(gone, 80), F.col("__key") == F.col("key"), "left_anti").select("__row.*")


def giving_back(work: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """``work`` for ``mapInArrow``; after it the worker, which lives on, hands the memory that it has freed back. Work
    that does not itself need what :func:`kept` holds (``keeps``) lets go of it first."""

    def run(batches: Iterator) -> Iterator:
        if not keeps:
            forget()
        yield from work(batches)
        hand_back()

    return run


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, once per worker process for its tasks of one kind: one such thing at a time, until :func:`forget`."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what :func:`kept` holds and hands its memory back."""
    if _KEPT:
        _KEPT.clear()
        hand_back()


#: Bytes of a batch of texts on its way to a worker: the executor's JVM holds up to twice as much outside its heap,
#: the worker as much again, each for every task.
TEXT_BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes to Python workers in batches of ``TEXT_BATCH_BYTES`` (a longer row alone), or of
    what the session allows if that is less; the session's own setting holds again afterwards."""
    before = spark.conf.get(_BATCH_BYTES)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > TEXT_BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, f"{TEXT_BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def small_table(spark: SparkSession, rows: Iterable[tuple], schema) -> DataFrame:
    """A table of the driver's few ``rows``, by an Arrow schema. It is part of the plan: a plain list would be
    unpickled on the executors by a Python daemon and workers that only do that, and stay."""
    import pyarrow as pa

    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema))


def added_up(sums: DataFrame, size: int, kind: str, driver_bytes: int = 32 << 20) -> np.ndarray:
    """The sum of the arrays (``size`` numbers of ``kind``) in the binary column ``sums``, one row per task or so.

    Few tasks add them up first, so that what reaches the driver does not depend on the number of rows.
    """

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size, kind)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py(), kind)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    few = max(1, min(16, driver_bytes // (8 * size)))
    found = sums.repartition(few).mapInArrow(add, "sums binary").collect()
    return np.sum([np.frombuffer(row[0], kind) for row in found] or [np.zeros(size, kind)], axis=0)


def hand_back() -> None:
    """Gives memory that this process has freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct ``values``, which are sorted in place: ``np.unique`` holds 50 bytes for each in a hash table."""
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def in_runs(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to ``limit`` at most; a larger item stands alone."""
    start, total, at = 0, 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > limit:
            yield start, at
            start, total = at, 0
        total += size
        at += 1
    if at > start:
        yield start, at


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow text column and its offsets, without copying; null is empty."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if column.null_count:
        sizes = np.diff(offsets)
        valid = np.asarray(column.is_valid())
        if sizes[~valid].any():
            data = data[np.repeat(valid, sizes)]
            sizes = np.where(valid, sizes, 0)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
    return data, offsets


def union_find(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each item's component, for ``pairs`` of indices below ``n``."""
    root = np.arange(n)
    if len(pairs) == 0:
        return root
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
