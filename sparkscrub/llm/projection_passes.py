"""Embedding near-duplicates by sorted projection passes.

A pass draws random hyperplanes, writes on which side of each a vector lies as one number and sorts the
vectors of a label by it, most significant plane first. Close vectors share long prefixes and come to lie
close together, so each is compared with a bounded window of its successors. Pairs that are verified by
their exact cosine are united across passes; inside each component all pairs are then compared, which
gives every vector's number of links.

Vectors of a label are centred on their mean for the keys. From the bits that a vector's key shares with the end
of its window follows how likely a pair at the least cosine is missed there. Vectors for which that stays
too likely over all passes go through further passes with a wider window, and what then remains of a label is
compared with each other in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, partitions, small, union_find
from .pairs import chunk_pairs, in_pairs, map_groups

_PLANES, _CHUNK, _BLOCK = 64, 1024, 256
#: Chance of missing a pair above which a vector goes on, the second window in windows, rows of a chunk compared in full.
_MISS, _WIDER, _CLOSE_CHUNK = 0.01, 16, 4096


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths, in double precision."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sums(batches: Iterator) -> Iterator:
    """Per label and length the sum of the unit vectors and their number, a batch at a time."""
    import pyarrow as pa

    for batch in batches:
        labels, dims = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for dim in np.unique(dims):
            chosen = dims == dim
            x = _unit(_matrix(batch.column(2).filter(pa.array(chosen))))
            names, at = np.unique(labels[chosen], return_inverse=True)
            order = np.argsort(at, kind="stable")
            total = np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(len(names))), axis=0)
            for name, n, row in zip(names, np.bincount(at), total, strict=True):
                where = np.arange(len(row), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), name)),
                        pa.array(np.full(len(row), dim, np.int32)),
                        pa.array(where),
                        pa.array(row),
                        pa.array(np.full(len(row), n, np.int64)),
                    ],
                    names=["label", "dim", "at", "total", "n"],
                )


def _means(points: DataFrame) -> DataFrame:
    """``__label``, ``__dim``, ``mean`` of the unit vectors."""
    sums = points.select("label", "dim", "embedding").mapInArrow(
        _sums, "label long, dim int, at int, total double, n long"
    )
    each = sums.groupBy("label", "dim", "at").agg((F.sum("total") / F.sum("n")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "m")))
    means = each.groupBy(F.col("label").alias("__label"), F.col("dim").alias("__dim")).agg(ordered.alias("mean"))
    return means.select("__label", "__dim", F.col("mean.m").alias("mean"))


def _keys(passes: int, seed: list[int], least: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _unit(_matrix(part.column("embedding"))) - _matrix(part.column("mean"))
                # Log of the share of planes that do not part a pair at the least cosine, seen from the mean.
                apart = np.clip((1 - least) / np.maximum((x * x).sum(axis=1), 1e-300), 0, 2)
                same = pa.array(np.log(np.maximum(1 - np.arccos(1 - apart) / np.pi, 1e-300)))
                part = part.drop_columns(["mean"])
                planes = np.random.default_rng([*seed, int(dim)]).standard_normal((int(dim), passes * _PLANES))
                for k in range(passes):
                    sides = x @ planes[:, k * _PLANES : (k + 1) * _PLANES] > 0
                    key = np.packbits(sides, axis=1).view(">i8")[:, 0].astype(np.int64)
                    count = pa.array(np.full(len(x), k, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [count, pa.array(key), same, *part.columns], names=["pass", "key", "same", *part.schema.names]
                    )

    return run


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that the keys have in common."""
    differ = (a ^ b).view(np.uint64)
    return np.where(differ == 0, _PLANES, _PLANES - 1 - np.floor(np.log2(np.maximum(differ, 1).astype(np.longdouble))).astype(np.float64))


def _windows(least: float, window: int):
    """Verified pairs of rows at most ``window`` apart in their pass and label, as star edges.

    Rows with no ``b`` are those (``a``) whose pairs at the least cosine this pass may part from their window,
    with the log of the chance of that in ``miss``; a row without one has a chance of one half or less. Windows end at
    partition edges, and rows next to an edge are taken as missed.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept, groups = None, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            old = 0 if kept is None else kept.num_rows
            table = batch if kept is None else pa.concat_batches([kept, batch])
            kept = table.slice(max(0, table.num_rows - window))
            group = np.stack([np.asarray(table.column(c)) for c in ("pass", "label", "dim")], axis=1)
            rep = np.asarray(table.column("rep"))
            groups.append([np.asarray(batch.column(c)) for c in ("pass", "label", "dim", "key", "same", "rep")])
            change = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            found = []
            for a, b in zip([0, *change], [*change, len(rep)], strict=True):
                if b - a < 2 or b <= old:
                    continue
                x = _unit(_matrix(table.slice(a, b - a).column("embedding")))
                for k in range(0, len(x), _BLOCK):
                    near = x[k : k + _BLOCK] @ x[k : k + _BLOCK + window].T >= least
                    i, j = np.nonzero(near)
                    use = (j > i) & (j - i <= window)
                    found.append(np.stack([i[use], j[use]], axis=1) + a + k)
            if found:
                pairs = np.concatenate(found)
                root = union_find(len(rep), pairs)
                moved = np.flatnonzero(root != np.arange(len(rep)))
                nothing = pa.array(np.zeros(len(moved)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[moved]), pa.array(rep[root[moved]]), nothing], names=["a", "b", "miss"]
                )
        if not groups:
            return
        *group, key, same, rep = [np.concatenate(c) for c in zip(*groups, strict=True)]
        change = (np.stack([c[1:] != c[:-1] for c in group]).any(axis=0)).nonzero()[0] + 1
        edges = np.array([0, *change, len(rep)])
        number = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        at = np.arange(len(rep))
        bits = np.zeros(len(rep))
        for end in (at - window - 1, at + window + 1):
            out = (end < edges[number]) | (end >= edges[number + 1])
            bits = np.maximum(bits, np.where(out, 0, _shared_bits(key, key[np.clip(end, 0, len(rep) - 1)]) + 1))
        hit = np.exp(bits * same)
        # The first and the last group of a partition may go on in its neighbours.
        hit[(at <= window) & (number == 0) | (at >= len(rep) - 1 - window) & (number == len(edges) - 2)] = 0
        weak = np.flatnonzero(hit < 0.5)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep[weak]), pa.nulls(len(weak), pa.int64()), pa.array(np.log1p(-hit[weak]))], names=["a", "b", "miss"]
        )

    return run


def _close(least: float):
    """Star edges of the rows of one label that are close enough, all pairs of the compared chunks."""

    def work(table, a: int, b: int) -> list[np.ndarray]:
        part = table.slice(a, b - a)
        rep = np.asarray(part.column("rep"))
        x = _unit(_matrix(part.column("embedding").combine_chunks()))
        one, two = in_pairs(
            np.asarray(part.column("__chunk")), part.column("__c1")[0].as_py(), part.column("__c2")[0].as_py()
        )
        root = np.arange(len(rep))
        for k in range(0, len(one), _BLOCK):
            i, j = np.nonzero(x[one[k : k + _BLOCK]] @ x[two].T >= least)
            pairs = np.stack([one[k + i], two[j]], axis=1)
            # What was united so far stays a star, so no block needs the pairs of those before.
            root = union_find(len(rep), np.concatenate([np.stack([np.arange(len(rep)), root], axis=1), pairs]))
        moved = np.flatnonzero(root != np.arange(len(rep)))
        return [rep[moved], rep[root[moved]]] if len(moved) else []

    return work


def _link_counts(least: float):
    """Per member of a group the vectors it is linked with in the compared chunks, copies included."""

    def work(table, a: int, b: int) -> list[np.ndarray]:
        part = table.slice(a, b - a)
        rep, copies = np.asarray(part.column("rep")), np.asarray(part.column("copies"))
        x = _unit(_matrix(part.column("embedding").combine_chunks()))
        one, two = in_pairs(
            np.asarray(part.column("__chunk")), part.column("__c1")[0].as_py(), part.column("__c2")[0].as_py()
        )
        links = np.zeros(len(rep), np.int64)
        for k in range(0, len(one), _BLOCK):
            rows = one[k : k + _BLOCK]
            near = (x[rows] @ x[two].T >= least) & (rows[:, None] != two[None, :])
            links[rows] += near @ copies[two]
            if one is not two:
                links[two] += copies[rows] @ near
        some = np.flatnonzero(links)
        return [rep[some], links[some]] if len(some) else []

    return work


def near_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    passes: int = 24,
    window: int = 64,
    seed: int = 11,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Links between vectors of equal label with a cosine of ``least`` or more, in double precision.

    Columns: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable,
    itself included), ``kept`` (``vec_id = component_id``). Vectors that are null, empty or zero, or hold null or
    non-finite components, and those with a null label or id, link with nothing; vectors of different length
    neither. A null id has no component and is kept. Equal vectors are one class: their links are
    counted, never listed. Rows may repeat, each counts.

    Two components can only be missed as one where no pass brings any of their links into a window, which for a
    pair at the least cosine is estimated to happen with a probability below ``_MISS``. Within a component every
    link is counted.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()
    usable = usable & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    base = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).cast("array<double>").alias("embedding"),
        F.col(label).alias("label"),
    )
    base = base.select(
        "vec_id",
        F.when(usable, F.col("label").cast("string")).alias("group"),
        "embedding",
        F.when(usable, F.xxhash64(F.lit(1), F.col("label"), "embedding")).alias("h1"),
        F.when(usable, F.xxhash64(F.lit(2), "embedding", F.col("label"))).alias("h2"),
        F.when(usable, F.xxhash64(F.col("label"))).alias("label"),
    )
    good = base.where("h1 is not null")
    classes = good.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.first("label").alias("label"),
        F.first(F.size("embedding")).alias("dim"),
        F.first("embedding").alias("embedding"),
    )
    classes = scratch.save(classes, "classes")

    points = classes.select("label", "dim", "rep", "embedding")
    order = ["pass", "label", "dim", "key", "rep"]
    schema = "pass int, key long, same double, label long, dim int, rep long, embedding array<double>"
    rest, edges, made = points, None, []
    for turn, wide in enumerate((window, _WIDER * window)):
        means = small(scratch.save(_means(rest), f"means{turn}"), 1024)
        on = (F.col("label") == F.col("__label")) & (F.col("dim") == F.col("__dim"))
        keyed = rest.join(means, on).select("label", "dim", "rep", "embedding", "mean")
        keyed = keyed.mapInArrow(_keys(passes, [seed, turn], least), schema)
        ordered = keyed.repartitionByRange(max(passes, partitions(spark)), *order).sortWithinPartitions(*order)
        seen = ordered.mapInArrow(_windows(least, wide), "a long, b long, miss double")
        seen = scratch.save(seen, f"seen{turn}")
        made += [f"means{turn}", f"seen{turn}"]
        new = seen.where("b is not null").select("a", "b")
        edges = new if edges is None else edges.unionAll(new)
        weak = seen.where("b is null").groupBy(F.col("a").alias("rep"))
        log_miss = F.sum("miss") + (passes - F.count(F.lit(1))) * float(np.log(0.5))
        weak = weak.agg(log_miss.alias("miss")).where(F.col("miss") > float(np.log(_MISS))).select("rep")
        rest = scratch.save(rest.join(weak, "rep").select(*points.columns), f"rest{turn}")
        made.append(f"rest{turn}")
    held = rest.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("held"))
    left = rest.join(held, ["label", "dim"]).withColumn("chunks", F.ceil(F.col("held") / _CLOSE_CHUNK))
    cut = chunk_pairs(left, "rep", F.col("chunks"))
    edges = edges.unionAll(map_groups(cut, ["label", "dim", "__c1", "__c2"], _close(least), "a long, b long"))
    edges = scratch.save(edges, "edges")
    scratch.drop(*made)
    found = scratch.save(components(edges, scratch, "passes"), "components")
    scratch.drop("edges")

    roots = found.select(F.col("root").alias("node"), "root").distinct()
    member = found.unionAll(roots).select(F.col("node").alias("rep"), "root")
    held = member.groupBy("root").agg(F.count(F.lit(1)).alias("held"))
    member = member.join(held, "root").join(classes.select("rep", "copies", "embedding"), "rep")
    cut = chunk_pairs(member, "rep", F.ceil(F.col("held") / _CHUNK))
    counted = map_groups(cut, ["root", "__c1", "__c2"], _link_counts(least), "rep long, links long")
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("h1", "h2", "rep", "copies")
    known = known.join(links, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(
        "h1",
        "h2",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"),
    )
    known = scratch.save(known, "known")
    scratch.drop("classes", "components")
    out = base.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
