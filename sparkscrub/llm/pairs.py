"""Exact pair checks inside groups of any size, and streams of whole groups out of sorted partitions.

A group above a chunk's size is cut into chunks, and every pair of chunks is a task's work of its own, so no
task holds a whole large group and only links, never all pairs, are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back


def chunk_pairs(members: DataFrame, item: str, chunks: Column) -> DataFrame:
    """``members`` once per pair of chunks it belongs to: ``__chunk`` (own), ``__c1`` <= ``__c2``."""
    own = F.pmod(F.xxhash64(item), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))).alias("__other")
    paired = members.select("*", own.alias("__chunk"), other)
    low, high = F.least("__chunk", "__other"), F.greatest("__chunk", "__other")
    return paired.select(*members.columns, "__chunk", low.alias("__c1"), high.alias("__c2"))


def whole_groups(batches: Iterator, keys: list[str]) -> Iterator[tuple[object, list[tuple[int, int]]]]:
    """Arrow tables that hold whole groups, with the groups' row ranges, from batches sorted by ``keys``."""
    import pyarrow as pa

    kept = []

    def ranges(table) -> list[tuple[int, int]]:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for key in keys:
            column = np.asarray(table.column(key))
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        return list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        kept.append(batch)
        first, last = kept[0], batch
        if all(first.column(k)[0] == last.column(k)[batch.num_rows - 1] for k in keys):
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        found = ranges(table)
        yield table, found[:-1]
        rest = table.slice(found[-1][0])
        kept = rest.combine_chunks().to_batches()
        if len(kept) == 1:  # a copy, so that the rows already done can be freed
            kept = [pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in kept[0].columns], schema=kept[0].schema)]
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield table, ranges(table)


def map_groups(
    df: DataFrame, keys: list[str], work: Callable[[object, int, int], list[np.ndarray]], schema: str
) -> DataFrame:
    """``work(table, start, stop)`` for every group of ``keys``: columns of ``schema`` as arrays, or an empty list."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table, groups in whole_groups(batches, keys):
            found = [x for a, b in groups if b - a > 1 and (x := work(table, a, b))]
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(giving_back(run), schema)


def in_pairs(chunk: np.ndarray, c1: int, c2: int) -> tuple[np.ndarray, np.ndarray]:
    """Members to compare: within one chunk all with all, of two chunks the first's with the second's."""
    if c1 == c2:
        at = np.arange(len(chunk))
        return at, at
    return np.flatnonzero(chunk == c1), np.flatnonzero(chunk == c2)
