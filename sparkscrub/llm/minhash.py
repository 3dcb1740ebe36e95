"""Near-duplicates by an inverted join over MinHash signature coordinates.

Texts with equal shingle sets are one class. Each class posts under its pairs (coordinate, minimum); pairs
held by one class only are its rarest. Two classes that agree on at least ``matches`` of ``coordinates`` pairs
share one of the ``coordinates - matches + 1`` rarest pairs of either (prefix), so only those are joined,
the frequent lists are skipped, and a class with more unshared pairs than the prefix has needs no join.
Within a list collisions are counted on the whole signatures. What passes is grouped, and inside each
group all pairs are checked on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, giving_back, in_runs, small, text_batches, union_find, utf8
from .pairs import chunk_pairs, in_pairs, map_groups
from .shingles import mix64, shingle_sets

#: Members of a chunk, shingles of a chunk, bytes of texts worked on at once, shared shingles per product.
_CHUNK, _CHUNK_SHINGLES, _TEXT_BYTES, _COLUMNS = 1024, 2_000_000, 1 << 20, 4096


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def _sets(batch, at: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Shingle sets of the batch's texts in column ``at``, a bounded number of bytes at a time."""
    data, offsets = utf8(batch.column(at))
    for a, b in in_runs(np.diff(offsets).tolist(), _TEXT_BYTES):
        yield a, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _signatures(docs: DataFrame, coordinates: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, two set hashes and the signature (empty set: null) per row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        factors = _factors(coordinates)
        for batch in batches:
            n, one, two, minima = [], [], [], []
            for _, sets in _sets(batch, 1):
                for s in sets:
                    n.append(len(s))
                    one.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix64(s ^ np.uint64(_factors(1)[0])).sum(dtype=np.uint64).view(np.int64)))
                    if len(s):
                        low = np.full(coordinates, 2**64 - 1, np.uint64)
                        for k in range(0, len(s), 4096):
                            np.minimum(low, (s[k : k + 4096] * factors[:, None]).min(axis=1), out=low)
                        minima.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32))
            valid = np.array(n, np.int64) > 0
            ends = np.concatenate(([0], np.cumsum(valid * coordinates))).astype(np.int32)
            values = np.concatenate(minima) if minima else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(values), mask=pa.array(~valid) if len(valid) else None
            )
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, lists], names=["doc_id", "n_shingles", "f1", "f2", "signature"])

    schema = "doc_id long, n_shingles long, f1 long, f2 long, signature array<int>"
    return docs.mapInArrow(giving_back(run), schema)


def _same_signature(coordinates: int, matches: int, percent: int):
    """Star edges of the members of one list whose signatures agree often enough."""

    def work(table, a: int, b: int) -> list[np.ndarray]:
        part = table.slice(a, b - a)
        rep, size = np.asarray(part.column("rep")), np.asarray(part.column("n_shingles"))
        lists = part.column("signature").combine_chunks()
        values = np.asarray(lists.flatten()).reshape(len(rep), coordinates)
        one, two = in_pairs(
            np.asarray(part.column("__chunk")), part.column("__c1")[0].as_py(), part.column("__c2")[0].as_py()
        )
        found = []
        for k in range(0, len(one), 64):
            rows = one[k : k + 64]
            same = (values[rows][:, None, :] == values[two][None, :, :]).sum(axis=2) >= matches
            low, high = np.minimum.outer(size[rows], size[two]), np.maximum.outer(size[rows], size[two])
            i, j = np.nonzero(same & (100 * low >= percent * high))
            pairs = np.stack([rows[i], two[j]], axis=1)
            found.append(pairs[pairs[:, 0] != pairs[:, 1]])
        return _stars(rep, np.concatenate(found)) if found else []

    return work


def _stars(ids: np.ndarray, pairs: np.ndarray) -> list[np.ndarray]:
    if len(pairs) == 0:
        return []
    root = union_find(len(ids), pairs)
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return [ids[moved], ids[root[moved]]]


def _same_sets(percent: int):
    """Star edges of the members of one group whose shingle sets are similar enough, checked on the full sets."""

    def work(table, a: int, b: int) -> list[np.ndarray]:
        part = table.slice(a, b - a)
        rep = np.asarray(part.column("rep"))
        data, offsets = utf8(part.column("shingles").combine_chunks())
        values, sizes = data.view(np.uint64), np.diff(offsets) // 8
        owner = np.repeat(np.arange(len(rep)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1  # shingles of one member cannot meet
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        one, two = in_pairs(
            np.asarray(part.column("__chunk")), part.column("__c1")[0].as_py(), part.column("__c2")[0].as_py()
        )
        meet = np.zeros((len(one), len(two)), np.float32)
        width = int(column.max()) + 1 if len(column) else 0
        for k in range(0, width, _COLUMNS):
            inside = slice(*np.searchsorted(column, [k, k + _COLUMNS]))
            held = np.zeros((len(rep), min(_COLUMNS, width - k)), np.float32)
            held[owner[inside], column[inside] - k] = 1
            meet += held[one] @ held[two].T
        found = []
        for k in range(0, len(one), 256):
            inter = meet[k : k + 256].astype(np.int64)
            union = sizes[one[k : k + 256]][:, None] + sizes[two][None, :] - inter
            i, j = np.nonzero(100 * inter >= percent * union)
            pairs = np.stack([one[k + i], two[j]], axis=1)
            found.append(pairs[pairs[:, 0] != pairs[:, 1]])
        return _stars(rep, np.concatenate(found)) if found else []

    return work


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    coordinates: int = 64,
    matches: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Components of documents linked by 100 * intersection >= ``percent`` * union of their 5-word shingle sets.

    Columns: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable, itself included), ``kept``
    (``doc_id = component_id``). A text with fewer than five words is one shingle; without words or text it is
    empty and linked with nothing. Rows with a null id are linked with nothing, have no component and are kept.
    Rows may repeat; each is returned. A pair at exactly the least similarity agrees on fewer than ``matches``
    coordinates with a probability below 1e-4; links found are exact.

    Shingles are told apart by 64-bit hashes. Large lists and groups are cut into chunk pairs; the links
    written are a spanning star per chunk pair, never all pairs. The result reads tables of ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    ids = F.col(doc_id).cast("long").alias("doc_id")
    texts = docs.select(ids, F.col(text).alias("text"))
    with text_batches(docs.sparkSession):
        signed = scratch.save(_signatures(texts, coordinates), "signatures")
    key = ["n_shingles", "f1", "f2"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key)
    classes = scratch.save(
        classes.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature")),
        "classes",
    )

    posts = classes.select("rep", F.posexplode("signature").alias("at", "value"))
    posts = posts.select("rep", (F.col("at").cast("long") * 2**32 + (F.col("value").cast("long") + 2**31)).alias("key"))
    shared = scratch.save(posts.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shared")
    prefix = coordinates - matches + 1
    lists = posts.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("p"))
    room = prefix - (coordinates - F.size("p"))
    rare = lists.where(room > 0).select("rep", F.explode(F.slice("p", F.lit(1), room)).alias("p"))
    rare = scratch.save(rare.select("rep", "p.key"), "prefixes")
    held = rare.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = rare.join(held, "key").join(classes.select("rep", "n_shingles", "signature"), "rep")
    cut = chunk_pairs(members, "rep", F.ceil(F.col("held") / _CHUNK))
    near = map_groups(cut, ["key", "__c1", "__c2"], _same_signature(coordinates, matches, percent), "a long, b long")
    with text_batches(docs.sparkSession):
        groups = scratch.save(components(near, scratch, "near"), "groups")
    scratch.drop("shared", "prefixes")

    roots = groups.select(F.col("root").alias("node"), "root").distinct()
    member = scratch.save(groups.unionAll(roots).select(F.col("node").alias("rep"), "root"), "members")
    sized = member.join(classes.select("rep", "n_shingles"), "rep")
    per_group = sized.groupBy("root").agg(F.count(F.lit(1)).alias("held"), F.sum("n_shingles").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("held") / _CHUNK), F.ceil(F.col("shingles") / _CHUNK_SHINGLES))
    member = scratch.save(member.join(per_group, "root").select("rep", "root", chunks.alias("chunks")), "chunked")
    wanted = texts.where("doc_id is not null").join(
        small(member, 64).withColumnRenamed("rep", "doc_id"), "doc_id"
    )

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [s.tobytes() for _, part in _sets(batch, 1) for s in part]
            arrays = [batch.column(i) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(found, pa.binary())], names=["rep", "root", "chunks", "shingles"]
            )

    full = wanted.select("doc_id", "text", "root", "chunks").mapInArrow(
        giving_back(sets), "rep long, root long, chunks long, shingles binary"
    )
    cut = chunk_pairs(full, "rep", F.col("chunks"))
    linked = map_groups(cut, ["root", "__c1", "__c2"], _same_sets(percent), "a long, b long")
    with text_batches(docs.sparkSession):
        linked = scratch.save(components(linked, scratch, "linked"), "linked")

    # Only classes with copies or links need to be looked up; other documents are their own component.
    known = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or root is not null")
    known = known.select(*key, F.coalesce("root", "rep").alias("component_id"), F.lit(True).alias("__known"))
    known = scratch.save(known, "known")
    narrow = scratch.save(signed.drop("signature"), "narrow")
    scratch.drop("signatures", "classes", "groups", "members", "chunked", "linked")
    found = narrow.join(small(known, 64), key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but the first (smallest id) document of each component.

    Of rows that repeat an id and text one stays. Rows with a null id stay.
    """
    scratch, work = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    found = near_duplicates(docs, doc_id=doc_id, text=text, scratch=work, **options)
    found = scratch.save(found.select("doc_id", "kept"), "found")
    work.release()
    gone = scratch.save(found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeated = scratch.save(repeated.select(F.col("doc_id").alias("__again")), "repeated")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row")
    rows = docs.select(row, F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    rows = rows.join(small(gone, 32), F.col("__id") == F.col("__gone"), "left_anti")
    if repeated.isEmpty():
        return rows.select("__row.*")
    again = small(repeated, 32)
    once = rows.join(again, F.col("__id") == F.col("__again"), "left_anti").select("__row")
    twice = rows.join(again, F.col("__id") == F.col("__again"), "left_semi")
    twice = twice.groupBy("__id", F.sha2(F.coalesce("__text", F.lit("")), 256)).agg(F.first("__row").alias("__row"))
    return once.unionAll(twice.select("__row")).select("__row.*")
