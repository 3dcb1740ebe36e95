import itertools
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sparkscrub.llm.entry import op3_reshard
from sparkscrub.llm.resharding import changed_shards, min_cost_flow, plan_moves, reshard, reshard_files, rewrite


def _least_moved(rows: dict[int, list[int]], n_new: int) -> int:
    """Fewest bytes that leave their shard, over all choices of the shards with an extra row."""
    each, extra = divmod(sum(map(len, rows.values())), n_new)
    best = None
    for larger in itertools.combinations(range(n_new), extra):
        moved = 0
        for old, sizes in rows.items():
            room = each + (old in larger) if old < n_new else 0
            moved += sum(sorted(sizes)[: max(0, len(sizes) - room)])
        best = moved if best is None else min(best, moved)
    return best


def test_moves_the_fewest_bytes():
    for seed in range(40):
        rng = random.Random(seed)
        n_new = rng.randint(1, 6)
        rows = {i: [rng.randint(8, 60) for _ in range(rng.randint(1, 12))] for i in range(rng.randint(1, 7))}
        # Blocks of one size each, so that the block costs are exact.
        blocks = defaultdict(int)
        for old, sizes in rows.items():
            for s in sizes:
                blocks[old, s] += 1
        moves = plan_moves([(old, s, n, n * s) for (old, s), n in blocks.items()], n_new)
        counts, moved = defaultdict(int), 0
        for m in moves:
            counts[m.new] += m.last - m.first
            if m.old != m.new:
                moved += sum(sorted(rows[m.old])[m.first : m.last])
        total = sum(map(len, rows.values()))
        held = [counts[j] for j in range(n_new)]
        assert sum(held) == total and max(held) - min(held) <= 1
        assert moved == _least_moved(rows, n_new)


def test_flow_prefers_cheap_paths():
    edges = [(0, 1, 4, 1.0), (0, 2, 4, 3.0), (1, 3, 3, 0.0), (2, 3, 4, 0.0), (1, 2, 4, 0.5)]
    assert min_cost_flow(4, edges, 0, 3) == [4, 3, 3, 4, 1]


def _check(rows, n_new):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[j]) for j in range(n_new)]
    assert max(counts) - min(counts) <= 1
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_query(spark, documents):
    rows = op3_reshard(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 8
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        assert r["law"] == "rows" and r["grown_shard"] is None
    _check(rows, 24)
    old = defaultdict(list)
    for r in rows:
        old[r["old_shard"]].append(r["size"])
    moved = sum(r["size"] for r in rows if r["shard"] != r["old_shard"])
    each = -(-len(rows) // 24)
    least = sum(sum(sorted(s)[: max(0, len(s) - each)]) for s in old.values())
    assert moved >= least and moved <= least + 24 * max(map(max, old.values()))


def test_rewrites_only_what_changed(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    placed, moves = reshard(odd, F.lit(0), 3, keep_rows=True)
    assert rewrite(placed, moves, 3, path) == [0, 1, 2]
    files = spark.read.parquet(path)
    assert files.count() == odd.count()
    _check(files.collect(), 3)
    stay = reshard(files.select("doc_id", "text", F.col("shard").alias("was")), F.col("was"), 3)[1]
    assert changed_shards(stay, 3) == []


def test_files_hold_the_planned_rows(spark, odd, none, tmp_path):
    """Repeated rows, nulls and clashing names: every row is in one file, each move has its rows, slots are gapless."""
    docs = odd.unionAll(odd).unionAll(odd).withColumn("slot", F.lit(-1))
    old = F.coalesce(F.col("doc_id") % 3, F.lit(1)) * 2  # shard 1 and 3 are new, 2 and 4 are old
    files, rest, moves = reshard_files(docs, old, str(tmp_path / "many"), 4)
    own = [c for c in odd.columns if c not in ("shard", "slot")]
    rows = files.collect()
    value = F.coalesce(F.col("text"), F.lit(""))
    kept = ["doc_id", "size", "text_crc32", "old", "shard", "slot"]
    read = files.select(
        "doc_id", (F.octet_length(value) + 8).alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"),
        old.alias("old"), "shard", "slot",
    ).collect() + rest.select(*kept).collect()
    _check(read, 4)
    if not rest.count():
        assert sorted(map(str, files.select(*own).collect())) == sorted(map(str, docs.select(*own).collect()))
    assert len(rows) + rest.count() == docs.count()
    went = defaultdict(int)
    for r in read:
        went[r["old"], r["shard"]] += 1
    planned = defaultdict(int)
    for m in moves:
        planned[m.old, m.new] += m.last - m.first
    assert went == planned
    files, rest, moves = reshard_files(none, F.lit(0), str(tmp_path / "none"), 4)
    assert (files.count(), rest.count(), moves) == (0, 0, [])


def test_other_shards_keep_their_files(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), (F.col("id") % 4).alias("was"))
    moved = F.when(F.col("doc_id") == 0, 1).otherwise(F.col("was"))  # shard 1 has one too many, shard 0 one too few
    files, rest, moves = reshard_files(docs, moved, str(tmp_path / "some"), 4)
    assert changed_shards(moves, 4) == [0, 1]
    assert {r["shard"] for r in files.collect()} == {0, 1} and {r["shard"] for r in rest.collect()} == {2, 3}
    _check(files.select("shard", "slot").unionAll(rest.select("shard", "slot")).collect(), 4)


def test_odd_and_empty(odd, none):
    rows = reshard(odd, F.col("doc_id") % 5, 4)[0].collect()
    assert len(rows) == odd.count()
    _check(rows, 4)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(8, 0)}
    placed, moves = reshard(none, F.lit(0), 4)
    assert placed.count() == 0 and moves == []
