"""Joining per-document lookups (n-grams, words) with a corpus-wide table, a block of documents at a time.

Joining every occurrence of every document would shuffle the corpus many times over. Instead documents
belong to blocks of about equal text; each block lists the distinct keys it needs once, the lists are
joined with the table like any other rows, and the block's small table then meets its documents in one
shuffle of the texts. Blocks are many and bounded in bytes, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, distinct, giving_back, in_runs, partitions, utf8

#: Bytes of text of an average block.
BLOCK_BYTES = 16 << 20
#: Bytes of texts worked on, or squeezed into one row of the shuffle, at once.
_TEXT_BYTES = 1 << 20
#: Keys that a task holds before it writes its lists.
_HELD_KEYS = 2_000_000
#: Blocks have a partition each up to this number, beyond which they share partitions evenly.
_MOST_PARTS = 50_000


def with_blocks(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` (``text``, ...) plus ``block`` and ``deal`` (a partition number); the number of partitions.

    A block is a run of neighbouring rows of one file, known by the rows' places in it, so any task that reads a row
    finds the same block for it, and equal rows belong to as many blocks as their places do. Rows that are not read
    from files are written first. Long texts belong to blocks of their own, so that no block holds many of them.
    """
    place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    try:
        at = docs.select("*", *place)
    except AnalysisException:
        docs = scratch.save(docs, "docs")
        at = docs.select("*", *place)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    is_long = size > block_bytes // 32
    total, n_long, n_rows = docs.agg(
        F.coalesce(F.sum(size), F.lit(0)),
        F.coalesce(F.sum(F.when(is_long, size)), F.lit(0)),
        F.count(F.when(~is_long, 1)),
    ).first()
    long_blocks = -(-n_long // block_bytes)
    rows = max(1, block_bytes * n_rows // max(1, total - n_long))
    n_blocks = long_blocks + -(-(total - n_long) // block_bytes)
    n = min(max(partitions(docs.sparkSession), n_blocks), max(partitions(docs.sparkSession), _MOST_PARTS))
    chunk = F.floor(F.col("__row") / rows)
    long_at = F.pmod(F.xxhash64("text"), F.lit(max(1, long_blocks)))
    block = F.when(is_long, F.xxhash64(F.lit("long"), long_at)).otherwise(F.xxhash64("__file", chunk))
    deal = F.pmod(F.when(is_long, long_at).otherwise(F.xxhash64("__file") % n + chunk), F.lit(n)).cast("int")
    return at.select(*[f"`{c}`" for c in docs.columns], block.alias("block"), deal.alias("deal")), n


@cache
def zstd() -> tuple[Callable, Callable]:
    """Squeezes and loosens bytes; made once, as that takes longer than a short run of numbers."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _pack(values: np.ndarray) -> bytes:
    steps = values.copy()
    np.subtract(values[1:], values[:-1], out=steps[1:])
    return zstd()[0](steps)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstd()[1](data), kind), dtype=kind)


def needed_keys(
    blocked: DataFrame, parts: int, keys: Callable[[np.ndarray, np.ndarray], np.ndarray], scratch: Scratch, name: str
) -> DataFrame:
    """Distinct rows ``block``, ``deal``, ``key`` (written): the keys that ``keys(bytes, offsets)`` finds in a block's
    texts (an array that may be sorted in place). ``blocked`` and ``parts`` are those of :func:`with_blocks`."""

    def collect(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def out():
            packed = [_pack(distinct(np.concatenate(found))) for found in held.values()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block for block, _ in held], pa.int64()),
                    pa.array([deal for _, deal in held], pa.int32()),
                    pa.array(packed, pa.binary()),
                ],
                names=["block", "deal", "keys"],
            )

        for batch in batches:
            for a, b, block in _runs(np.asarray(batch.column("block"))):
                data, offsets = utf8(batch.column("text").slice(a, b - a))
                at = block, batch.column("deal")[a].as_py()
                for i, j in in_runs(np.diff(offsets).tolist(), _TEXT_BYTES):
                    found = distinct(keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                    held.setdefault(at, []).append(found)
                    size += len(found)
                    if size > _HELD_KEYS:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, found, size = None, [], 0

        def out():
            keys = np.concatenate(found)
            found.clear()
            keys = distinct(keys)
            for k in range(0, len(keys), 1 << 18):
                part = keys[k : k + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), now[0])), pa.array(np.full(len(part), now[1], np.int32)), pa.array(part)],
                    names=["block", "deal", "key"],
                )

        for batch in batches:
            for *at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if now is not None and at != now:
                    yield from out()
                    found, size = [], 0
                now = at
                found.append(_unpack(packed.as_py(), np.int64))
                size += len(found[-1])
                if size > 2 * _HELD_KEYS:
                    keys = np.concatenate(found)
                    found.clear()
                    found.append(distinct(keys))
                    del keys
                    size = len(found[0])
        if found:
            yield from out()

    lists = blocked.mapInArrow(giving_back(collect), "block long, deal int, keys binary")
    lists = lists.repartitionById(parts, F.col("deal")).sortWithinPartitions("block")
    return scratch.save(lists.mapInArrow(giving_back(merge), "block long, deal int, key long"), name)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """First and last place, and value, of each run of equal ``values``."""
    edges = np.flatnonzero(np.diff(values, prepend=~values[:1])).tolist()
    for a, b in zip(edges, [*edges[1:], len(values)], strict=True):
        yield a, b, int(values[a])


def with_tables(
    blocked: DataFrame,
    parts: int,
    table: DataFrame,
    work: Callable[[np.ndarray, dict[str, np.ndarray], Iterator], Iterator],
    schema: str,
) -> DataFrame:
    """``work(keys, values, batches)`` per block: its sorted keys, their values, and its documents in batches.

    ``table`` has ``block``, ``deal``, ``key`` and float or long values, at most one row per block and key. A block's table
    comes first in its partition and its documents stream past it. Documents are shuffled as compressed runs of
    rows of one block, which take far less room than single rows.
    """
    kinds = {c: kind for c, kind in table.dtypes if c not in ("block", "deal", "key")}

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            key = np.asarray(batch.column("key"))
            rows: list[list] = [[], [], [], []]
            for a, b, block in _runs(np.asarray(batch.column("block"))):
                columns = [np.asarray(batch.column(c))[a:b] for c in kinds]
                rows[0].append(block)
                rows[3].append(batch.column("deal")[a].as_py())
                rows[1].append(_pack(key[a:b]))
                rows[2].append(squeeze(b"".join(np.ascontiguousarray(c, "f4" if kinds[n] == "float" else "i8").tobytes() for n, c in zip(kinds, columns, strict=True))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[0], pa.int64()),
                    pa.array(rows[3], pa.int32()),
                    pa.array(rows[1], pa.binary()),
                    pa.array(rows[2], pa.binary()),
                ],
                names=["block", "deal", "keys", "values"],
            )

    packed = table.repartitionById(parts, F.col("deal")).sortWithinPartitions("block", "key")
    packed = packed.mapInArrow(giving_back(pack), "block long, deal int, keys binary, values binary")
    return meet(blocked, parts, packed, kinds, work, schema)


def meet(
    blocked: DataFrame,
    parts: int,
    packed: DataFrame,
    kinds: dict[str, str],
    work: Callable[[np.ndarray, dict[str, np.ndarray], Iterator], Iterator],
    schema: str,
) -> DataFrame:
    """:func:`with_tables` for tables packed already: ``block``, ``deal``, ``keys`` (sorted), ``values`` (columns of
    ``kinds``, one after another). A block may have several such rows, also with keys in common."""
    names = [c for c in blocked.columns if c not in ("block", "deal")]

    def squeeze(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = batch.select(names)
            for a, b, block in _runs(np.asarray(batch.column("block"))):
                part = rows.slice(a, b - a)
                for i, j in in_runs(np.diff(utf8(part.column("text"))[1]).tolist(), _TEXT_BYTES):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part.slice(i, j - i))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block], pa.int64()),
                            batch.column("deal").slice(a, 1),
                            pa.array([compress(sink.getvalue())], pa.binary()),
                        ],
                        names=["block", "deal", "values"],
                    )

    documents = blocked.mapInArrow(giving_back(squeeze), "block long, deal int, values binary").select(
        "block", "deal", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("keys"), "values"
    )
    tables = packed.select("block", "deal", F.lit(0).alias("kind"), "keys", "values")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        loose = zstandard.ZstdDecompressor().decompress
        state: dict = {"ahead": None}
        source = iter(batches)

        def parts() -> Iterator:
            """Runs of rows of one block and kind."""
            for batch in source:
                if batch.num_rows == 0:
                    continue
                kinds = np.asarray(batch.column("kind"))
                for a, b, block in _runs(np.asarray(batch.column("block"))):
                    for i, j, kind in _runs(kinds[a:b]):
                        yield (block, kind), batch.slice(a + i, j - i)

        stream = parts()
        state["ahead"] = next(stream, None)

        def take(mark: tuple[int, int]) -> Iterator:
            while state["ahead"] is not None and state["ahead"][0] == mark:
                part = state["ahead"][1]
                state["ahead"] = next(stream, None)
                yield part

        def rows(mark: tuple[int, int]) -> Iterator:
            for part in take(mark):
                for squeezed in part.column("values"):
                    yield from pa.ipc.open_stream(loose(squeezed.as_py())).read_all().to_batches()

        while state["ahead"] is not None:
            block = state["ahead"][0][0]
            keys, columns = [], {c: [] for c in kinds}
            for part in take((block, 0)):
                for k, v in zip(part.column("keys"), part.column("values"), strict=True):
                    keys.append(_unpack(k.as_py(), np.int64))
                    raw, at = loose(v.as_py()), 0
                    for c in kinds:
                        kind = np.dtype("f4" if kinds[c] == "float" else "i8")
                        columns[c].append(np.frombuffer(raw, kind, len(keys[-1]), at))
                        at += kind.itemsize * len(keys[-1])
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            order = np.argsort(key, kind="stable")
            order = order[np.diff(key[order], prepend=~key[order[:1]]) != 0]
            found = {c: (np.concatenate(v) if v else np.zeros(0))[order] for c, v in columns.items()}
            yield from work(key[order], found, rows((block, 1)))
            for _ in take((block, 1)):  # whatever was not read
                pass

    both = tables.unionAll(documents).repartitionById(parts, F.col("deal")).sortWithinPartitions("block", "kind")
    return both.mapInArrow(giving_back(run), schema)
