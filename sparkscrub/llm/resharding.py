"""Resharding by minimum-cost flow: new shards of given capacities out of old ones, moving the fewest bytes.

The rows of an old shard are summed into blocks by size class. A flow from blocks to new shards,
where staying costs nothing and moving costs the row's bytes, is solved on the driver over that small
network (its size depends on the shards, not on the rows). A block order by size makes the moved part
of an old shard its smallest rows, so a row's place in that order says where it goes, and its slot there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, ranked, small


def min_cost_flow(n: int, edges: list[tuple[int, int, int, float]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0) of a maximum flow of least cost (shortest paths)."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for a, b, capacity, price in edges:
        graph[a].append(len(to))
        to.append(b), room.append(capacity), cost.append(price)
        graph[b].append(len(to))
        to.append(a), room.append(0), cost.append(-price)
    potential = [0.0] * n
    while True:
        far, back = [float("inf")] * n, [-1] * n
        far[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                if room[e] > 0:
                    step = d + max(0.0, cost[e] + potential[a] - potential[to[e]])
                    if step < far[to[e]] - 1e-9:
                        far[to[e]], back[to[e]] = step, e
                        heapq.heappush(heap, (step, to[e]))
        if back[sink] < 0:
            return [room[2 * i + 1] for i in range(len(edges))]
        most = max(d for d in far if d < float("inf"))
        potential = [p + min(d, most) for p, d in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(back[at])
            at = to[back[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


@dataclass(frozen=True)
class Move:
    """Rows ``first`` (included) to ``last`` (excluded) of an old shard go to ``new``, from ``slot`` on."""

    old: int
    new: int
    first: int
    last: int
    slot: int


def plan_moves(blocks: list[tuple[int, int, int, int]], n_new: int) -> list[Move]:
    """Moves for blocks (old shard, size class, rows, bytes) into ``n_new`` shards of equal row counts.

    Counts differ by one at most; which shards get the extra row is part of the flow.
    """
    blocks = sorted(blocks)
    total = sum(b[2] for b in blocks)
    each, extra = divmod(total, n_new)
    k = len(blocks)
    transit, spare, source, sink = k + n_new, k + n_new + 1, k + n_new + 2, k + n_new + 3
    edges: list[tuple[int, int, int, float]] = []
    stays: list[tuple[int, int]] = []
    for i, (old, _, rows, held) in enumerate(blocks):
        edges.append((source, i, rows, 0.0))
        if old < n_new:
            stays.append((len(edges), old))
            edges.append((i, k + old, rows, 0.0))
        edges.append((i, transit, rows, held / rows))
    arrive = len(edges)
    edges += [(transit, k + j, total, 0.0) for j in range(n_new)]
    edges += [(k + j, sink, each, 0.0) for j in range(n_new)]
    edges += [(k + j, spare, 1, 0.0) for j in range(n_new)]
    edges.append((spare, sink, extra, 0.0))
    flow = min_cost_flow(k + n_new + 4, edges, source, sink)
    kept = dict.fromkeys(range(n_new), 0)
    for e, old in stays:
        kept[old] += flow[e]
    rows_of: dict[int, int] = {}
    for old, _, rows, _ in blocks:
        rows_of[old] = rows_of.get(old, 0) + rows
    wants = [[j, flow[arrive + j]] for j in range(n_new) if flow[arrive + j]]
    slot = dict(kept)
    moves = []
    for old, rows in sorted(rows_of.items()):
        leaving, at = rows - kept.get(old, 0), 0
        while at < leaving:
            j, room = wants[-1]
            part = min(room, leaving - at)
            moves.append(Move(old, j, at, at + part, slot[j]))
            slot[j] += part
            at += part
            wants[-1][1] -= part
            if not wants[-1][1]:
                wants.pop()
        if at < rows:
            moves.append(Move(old, old, at, rows, 0))
    return moves


def reshard(
    docs: DataFrame,
    old: Column,
    n_new: int = 24,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_rows: bool = False,
) -> tuple[DataFrame, list[Move]]:
    """Rows of ``docs`` placed in shards 0 to ``n_new`` - 1 whose row counts differ by one at most.

    ``old`` is the shard (0, 1, ...) that holds the row now; null counts as shard 0. Returns the placed rows
    (``doc_id``, ``size``: bytes of the text plus 8, ``text_crc32``, ``old``, ``shard``, ``slot``, and with
    ``keep_rows`` the input row as the struct ``__row``) and the moves. A null text has 8 bytes and the checksum
    of the empty text. Equal rows are placed one by one; rows of equal size keep no order among themselves
    beyond id and checksum. Null ids are allowed. With no rows there are no moves.

    One sort of the rows and one join with the table of moves (at most one per old and new shard).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    value = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row")] if keep_rows else []),
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(value).cast("long") + 8).alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.coalesce(old.cast("int"), F.lit(0)).alias("old"),
    )
    rows = ranked(base, ["old"], ["size", "doc_id", "text_crc32"], "place", scratch)
    blocks = base.groupBy("old", F.floor(2 * F.log2("size")).cast("int").alias("class"))
    blocks = blocks.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()
    moves = plan_moves([tuple(b) for b in blocks], n_new)
    found = spark.createDataFrame(
        [(m.old, m.new, m.first, m.last, m.slot) for m in moves],
        "to_old int, shard int, first long, last long, first_slot long",
    )
    on = (F.col("old") == F.col("to_old")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))
    placed = rows.join(F.broadcast(found), on)
    slot = (F.col("first_slot") + F.col("place") - F.col("first")).alias("slot")
    return placed.select(*base.columns, "shard", slot), moves


def changed_shards(moves: list[Move], n_new: int) -> list[int]:
    """Shards whose files have to be written again: rows leave them or come to them."""
    touched = {m.new for m in moves if m.old != m.new} | {m.old for m in moves if m.old != m.new}
    held = {m.new for m in moves}
    return sorted((touched | (set(range(n_new)) - held)) & set(range(n_new)))


def rewrite(placed: DataFrame, moves: list[Move], n_new: int, path: str, max_records: int = 1_000_000) -> list[int]:
    """Write the files of the affected shards (folders ``shard=N`` under ``path``) and return those shards.

    ``placed`` is from :func:`reshard` with ``keep_rows``; columns ``shard`` and ``slot`` of the input are
    replaced. Other shards keep their files. Rows of one shard spread over as many tasks as it has slot ranges
    of ``max_records``, so no task holds a whole shard.
    """
    shards = changed_shards(moves, n_new)
    rows = placed.where(F.col("shard").isin(shards))
    at = F.floor(F.col("slot") / max_records)
    own = [F.col(f"__row.`{c}`") for c in placed.schema["__row"].dataType.names if c not in ("shard", "slot")]
    rows = rows.repartition("shard", at).select(*own, "shard", "slot")
    rows.sortWithinPartitions("shard", "slot").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).option("maxRecordsPerFile", max_records).partitionBy("shard").parquet(path)
    return shards


#: Bytes of text that a task writes.
_TASK_BYTES = 128 << 20


def reshard_files(
    docs: DataFrame,
    old: Column,
    path: str,
    n_new: int = 24,
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame, list[Move]]:
    """Plan as :func:`reshard` does, and write the files of the affected shards (folders ``shard=N`` under ``path``).

    Returns the rows of the affected shards, read from their files with ``shard`` and ``slot``; the rows of the
    other shards, which keep their files (``doc_id``, ``size``, ``text_crc32``, ``old``, ``shard``, ``slot``); and the
    moves. Nulls, ids, repeated rows and empty tables as there; columns of the input called ``shard`` or ``slot``
    are replaced. Rows that are not read from files are written first.

    Only ids, sizes and checksums are sorted to find the rows' places. The first row of every move is the bound by
    which each whole row then finds its shard where it is read, so the texts are shuffled once. In a shard rows lie
    by a hash, which spreads long texts evenly over the tasks; a row's slot is its place in that order, the
    sum of the counts of the files before and its place in its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__line")
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        docs = scratch.save(docs, "docs")
        rows = docs.select("*", *place)
    value = F.coalesce(F.col(text), F.lit(""))
    plan = {
        "old": F.coalesce(old.cast("int"), F.lit(0)),
        "size": F.octet_length(value).cast("long") + 8,
        "doc_id": F.col(doc_id),
        "text_crc32": F.crc32(value.cast("binary")),
        "__file": F.col("__file"),
        "__line": F.col("__line"),
    }
    by = [c for c in plan if c != "old"]
    narrow = ranked(rows.select(*[c.alias(k) for k, c in plan.items()]), ["old"], by, "place", scratch)
    blocks = narrow.groupBy("old", F.floor(2 * F.log2("size")).cast("int").alias("class"))
    blocks = blocks.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()
    moves = plan_moves([tuple(b) for b in blocks], n_new)
    shards = changed_shards(moves, n_new)
    found = spark.createDataFrame(
        [(m.old, m.new, m.first, m.last, m.slot) for m in moves],
        "__from int, __to int, first long, last long, first_slot long",
    )
    found = F.broadcast(found)  # a row per move: at most one per old and new shard
    same = F.col("old") == F.col("__from")
    inside = same & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))
    rest = narrow.join(found.where(~F.col("__to").isin(shards)), inside)
    slot = (F.col("first_slot") + F.col("place") - F.col("first")).alias("slot")
    rest = rest.select("doc_id", "size", "text_crc32", "old", F.col("__to").alias("shard"), slot)

    bounds = narrow.join(found, same & (F.col("place") == F.col("first")))
    bounds = bounds.select("__from", "__to", "first", F.struct(*by).alias("__low"))
    above = F.lead("__low").over(Window.partitionBy("__from").orderBy("first"))
    bounds = scratch.save(bounds.withColumn("__high", above).drop("first"), "bounds")
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    key = F.struct(*[plan[c].alias(c) for c in by])
    wide = rows.select(
        *[F.col(f"`{c}`") for c in own],
        plan["old"].alias("__old"),
        key.alias("__key"),
        F.xxhash64("__file", "__line").alias("__place"),
    )
    on = (F.col("__old") == F.col("__from")) & (F.col("__key") >= F.col("__low"))
    on &= F.col("__high").isNull() | (F.col("__key") < F.col("__high"))
    wide = wide.join(F.broadcast(bounds.where(F.col("__to").isin(shards))), on)
    wide = wide.select(*[F.col(f"`{c}`") for c in own], "__place", "__key.__file", "__key.__line", F.col("__to").alias("shard"))
    n = max(partitions(spark), -(-sum(b["bytes"] for b in blocks) // _TASK_BYTES))
    order = ["shard", "__place", "__file", "__line"]
    wide = wide.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__place", "__file", "__line")
    mono = F.monotonically_increasing_id()
    wide = wide.withColumn("__part", F.shiftright(mono, 33)).withColumn("__nth", mono.bitwiseAND(2**33 - 1))
    wide.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)

    files = spark.read.schema(wide.schema).parquet(path).where(F.col("shard").isin(shards))
    counts = files.groupBy("shard", "__part").agg(F.min("__nth").alias("__least"), F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        F.col("shard").alias("__shard"),
        F.col("__part").alias("__of"),
        (F.coalesce(before, F.lit(0)) - F.col("__least")).alias("__shift"),
    )
    starts = small(scratch.save(starts, "starts"), 32)
    files = files.join(starts, (F.col("shard") == F.col("__shard")) & (F.col("__part") == F.col("__of")))
    slot = (F.col("__nth") + F.col("__shift")).alias("slot")
    return files.select(*[F.col(f"`{c}`") for c in own], "shard", slot), rest, moves
