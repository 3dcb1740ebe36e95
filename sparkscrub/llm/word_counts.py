"""Counts of word hashes over a whole corpus, and what each block of documents needs of them.

One pass lists the distinct hashes of every block with their counts. The lists are cut into equal ranges of
hashes; a task adds up one range of all lists, and later tells each block the sums of the hashes that it has. So
hashes travel as sorted, packed runs, and no single one becomes a row of a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _pack, _runs, _unpack, meet, zstd
from .common import Scratch, giving_back

#: Hashes that a task holds before it puts equal ones together.
_HELD_KEYS = 1_000_000
#: Blocks for which there is one range of hashes, so that words of which none occurs twice fit into a task, too.
_BLOCKS = 2


class Places:
    """Finds hashes among ``known`` ones, which are sorted and distinct, through a table of leading bits."""

    def __init__(self, known: np.ndarray):
        self.known = np.append(known, np.iinfo(np.int64).max)
        bits = max(1, len(known).bit_length())
        self.shift, self.half = 64 - bits, 1 << (bits - 1)
        per_lead = np.bincount((known >> self.shift) + self.half, minlength=2 * self.half)
        self.first = np.cumsum(per_lead) - per_lead
        self.even = per_lead.max() <= 64  # else they are no hashes

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """The place of every key in ``known``; the number of known hashes stands for one that is not there."""
        n = len(self.known) - 1
        if self.even:
            at = self.first.take((key >> self.shift) + self.half)
            rows = np.flatnonzero(self.known.take(at) < key)
            while len(rows):
                at[rows] += 1
                rows = rows[self.known.take(at.take(rows)) < key.take(rows)]
        else:
            at = np.searchsorted(self.known[:n], key)
        at[self.known.take(at) != key] = n
        return at


def added(key: np.ndarray, n: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their ``n`` and their ``shape``, which equal keys share."""
    order = np.argsort(key)
    key = key.take(order)
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    sums = np.add.reduceat(n.take(order), first) if len(first) else n
    return key.take(first), sums, shape.take(order.take(first))


class _Sums:
    """Counts of a growing number of lists, equal keys put together now and then."""

    def __init__(self):
        self.held, self.size, self.limit = [], 0, _HELD_KEYS

    def add(self, *lists: np.ndarray) -> None:
        self.held.append(lists)
        self.size += len(lists[0])
        if self.size > self.limit:
            self.held = [self.all()]
            self.size = len(self.held[0][0])
            self.limit = 2 * self.size + _HELD_KEYS

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return added(*(np.concatenate(x) for x in zip(*self.held, strict=True)))


def _squeezed(values: np.ndarray) -> bytes:
    return zstd()[0](values.tobytes())


def _loose(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstd()[1](data), kind)


def _in_ranges(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """First and last place, and number, of each of ``ranges`` equal ranges of hashes that sorted ``keys`` meet."""
    return _runs(((keys >> 32) + (1 << 31)) * ranges >> 32) if len(keys) else iter(())


def n_ranges(docs: DataFrame, parts: int) -> int:
    """Ranges of hashes for documents of ``parts`` blocks."""
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, parts // _BLOCKS)


def list_words(
    blocked: DataFrame, words: Callable[..., Iterator], counts: str, ranges: int, scratch: Scratch
) -> DataFrame:
    """Rows ``range``, ``block``, ``deal``, ``keys``, ``n``, ``shapes`` (written): sorted lists of the hashes in a block's
    texts, one or more for each range, with how often they occur in rows that ``counts`` holds for.

    ``words`` gives for an Arrow text column, part by part, its first and last text and per word hash, text and shape.
    ``blocked`` is that of :func:`~.blocks.with_blocks`.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple[int, int], _Sums] = {}

        def out():
            rows: list[list] = [[], [], [], [], [], []]
            for (block, deal), sums in held.items():
                key, n, shape = sums.all()
                for a, b, k in _in_ranges(key, ranges):
                    row = k, block, deal, _pack(key[a:b]), _squeezed(n[a:b]), _squeezed(shape[a:b])
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            kinds = pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            columns = [pa.array(c, kind) for c, kind in zip(rows, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["range", "block", "deal", "keys", "n", "shapes"])

        for batch in batches:
            counted = np.asarray(batch.column("counted")).astype(np.int64)
            for a, b, block in _runs(np.asarray(batch.column("block"))):
                at = block, batch.column("deal")[a].as_py()
                for i, _, key, text, shape in words(batch.column("text").slice(a, b - a)):
                    n = counted.take(text + (a + i))
                    held.setdefault(at, _Sums()).add(*added(key, n, shape.astype(np.int8)))
                    if sum(s.size for s in held.values()) > 2 * _HELD_KEYS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    rows = blocked.select("text", "block", "deal", F.expr(counts).alias("counted"))
    schema = "range int, block long, deal int, keys binary, n binary, shapes binary"
    return scratch.save(rows.mapInArrow(giving_back(run), schema), "lists")


def add_up(lists: DataFrame, ranges: int, scratch: Scratch) -> DataFrame:
    """Rows ``range``, ``key``, ``shape``, ``n`` (written): the sums of all lists, of the hashes that occur at all."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, _Sums] = {}
        for batch in batches:
            for k, keys, n, shapes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.setdefault(k, _Sums()).add(_unpack(keys, np.int64), _loose(n, np.int64), _loose(shapes, np.int8))
        for k, sums in held.items():
            key, n, shape = sums.all()
            for a in range(0, len(key), 1 << 18):
                some = a + np.flatnonzero(n[a : a + (1 << 18)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), k, np.int32)),
                        pa.array(key.take(some)),
                        pa.array(shape.take(some).astype(np.int32)),
                        pa.array(n.take(some)),
                    ],
                    names=["range", "key", "shape", "n"],
                )

    rows = lists.select("range", "keys", "n", "shapes").repartitionById(ranges, F.col("range"))
    return scratch.save(rows.mapInArrow(giving_back(run), "range int, key long, shape int, n long"), "counts")


def with_counts(
    blocked: DataFrame,
    parts: int,
    lists: DataFrame,
    counts: DataFrame,
    ranges: int,
    work: Callable[[np.ndarray, dict[str, np.ndarray], Iterator], Iterator],
    schema: str,
) -> DataFrame:
    """``work(keys, {"n": counts}, batches)`` per block, as :func:`~.blocks.with_tables` does, with the hashes of the
    block's ``lists`` that have ``counts`` (of :func:`add_up`). A task holds the counts of one range at a time, and the
    lists stream past them."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            number, key, n = (np.asarray(batch.column(c)) for c in ("range", "key", "n"))
            runs = list(_runs(number)) if len(number) else []
            columns = [
                pa.array([k for _, _, k in runs], pa.int32()),
                pa.array([_pack(key[a:b]) for a, b, _ in runs], pa.binary()),
                pa.array([_squeezed(n[a:b]) for a, b, _ in runs], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "keys", "values"])

    def answer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, told, places, n = None, [], None, None
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for k, block, deal, keys, values in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if k != now:
                    now, told, places = k, [], None
                keys = _unpack(keys, np.int64)
                if block is None:
                    told.append((keys, _loose(values, np.int64)))
                    continue
                if places is None:
                    key, n = (np.concatenate([np.zeros(0, np.int64), *(t[i] for t in told)]) for i in range(2))
                    order = np.argsort(key)
                    places, n, told = Places(key[order]), n[order], []
                at = places(keys)
                found = np.flatnonzero(at < len(n))
                if len(found):
                    row = block, deal, _pack(keys[found]), _squeezed(n.take(at.take(found)))
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary()
            columns = [pa.array(c, kind) for c, kind in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "deal", "keys", "values"])

    none = F.lit(None).cast
    told = counts.select("range", "key", "n").mapInArrow(giving_back(cut), "range int, keys binary, values binary")
    told = told.select("range", none("long").alias("block"), none("int").alias("deal"), "keys", "values")
    asked = lists.select("range", "block", "deal", "keys", none("binary").alias("values"))
    both = told.unionAll(asked).repartitionById(ranges, F.col("range"))
    both = both.sortWithinPartitions("range", F.col("block").asc_nulls_first())
    packed = both.mapInArrow(giving_back(answer), "block long, deal int, keys binary, values binary")
    return meet(blocked, parts, packed, {"n": "bigint"}, work, schema)
