import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkscrub.llm import prefix_trie
from sparkscrub.llm.entry import QUERIES, SQL

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """Rows (conv_id, turn, role, text) as rebuilt conversations; no two rows of a conversation have one turn."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0))] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    return {
        (
            convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), children.get(path, 0), leaves[path],
            saved[path], hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest(),
        )
        for path, convs in members.items()
    }


def rows_of(df):
    assert df.columns == COLUMNS
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = rows_of(QUERIES["op13_prefix_trie"](spark, SF))
    assert found == brute(rebuilt(rows))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    answer = con.sql(SQL["op13_prefix_trie"])
    assert answer.columns == COLUMNS
    assert set(answer.fetchall()) == found


def made(spark, rows, parts=5):
    schema = "conv_id long, turn long, role string, text string, conv string, key string, n int"
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema).repartition(parts)


@pytest.mark.parametrize("seed, block_turns", [(0, 1), (1, 2), (2, 3), (3, 8)])
def test_random_conversations(spark, seed, block_turns):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 70), 10**12, 2**62]:
        if rng.random() < 0.15:
            continue
        first = rng.choice([0, 1, None])
        for t in range(rng.choice([1, 2, 3, 9, 12, 30])):
            turn = None if t == 0 and first is None else t + (first or 0)
            text = rng.choice(["a", "ß日", "", None, "some longer text"]) if rng.random() < 0.4 else "same"
            rows.append((c, turn, rng.choice(["user", "user", None, ""]), text))
    rows.append((None, 1, "user", "of no conversation"))
    assert rows_of(prefix_trie.rebuilt_trie(made(spark, rows), block_turns)) == brute(rebuilt(rows))


def test_one_long_and_many_equal_conversations(spark):
    """A third of all turns in one conversation, which is cut into parts, and a third in copies of another."""
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(400)]
    rows += [(1000 + 5 * i, t, "user", f"copied {t}") for i in range(40) for t in range(10)]
    rows += [(10_000 + 5 * i, t, "user", f"{t} of {i // 3}") for i in range(40) for t in range(10)]
    expected = brute(rebuilt(rows))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for broadcast in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
            assert rows_of(prefix_trie.rebuilt_trie(made(spark, rows))) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ids_of_one_node_in_many_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_RUN_IDS", 7)
    scratch = prefix_trie.Scratch(spark)
    members = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("key"), F.col("id").alias("conv"))
    found = {r["key"]: r["ends_sha256"] for r in prefix_trie._joined_ids(scratch.save(members, "m"), scratch).collect()}
    by_key = defaultdict(list)
    for i in range(500):
        by_key["hot" if i % 3 else f"k{i % 30}"].append(i)
    assert found == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in by_key.items()}


def test_odd_tables(spark):
    assert rows_of(prefix_trie.rebuilt_trie(made(spark, []))) == set()
    assert rows_of(prefix_trie.rebuilt_trie(made(spark, [(None, 0, "a", "b")]))) == set()
    # The rebuilt conversation 7 has no turns: crc32("7") % 9 is above 0 and conversation 5 is absent.
    assert zlib.crc32(b"7") % 9 > 0
    assert rows_of(prefix_trie.rebuilt_trie(made(spark, [(7, 0, "a", "b")]))) == brute({7: []})
    # Repeated rows are turns of their own; texts may be long.
    rows = [(0, 3, "a", "x" * 300_000)] * 12
    found = rows_of(prefix_trie.rebuilt_trie(made(spark, rows)))
    assert found == brute({0: [("a", "x" * 300_000)] * 12})
