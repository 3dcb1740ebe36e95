import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
import sparkscrub.llm.minhash as minhash
from sparkscrub.llm.entry import op9_minhash_join
from sparkscrub.llm.minhash import deduplicated, near_duplicates
from sparkscrub.llm.shingles import shingle_sets


def _shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def _brute(rows, percent=85):
    """(id, shingles, component, kept) per row of (id, text), comparing all pairs."""
    sets = [_shingles(t) for _, t in rows]
    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    linked = defaultdict(set)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holds[x] if j > i}:
            inter = len(s & sets[j])
            if 100 * inter >= percent * (len(s) + len(sets[j]) - inter):
                if rows[i][0] is not None and rows[j][0] is not None:
                    linked[i].add(j), linked[j].add(i)
    found = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        component = None if doc_id is None else min(rows[j][0] for j in seen)
        found.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(found, key=str)


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_query_against_all_pairs(spark, documents):
    found = _found(op9_minhash_join(spark, "/root/testdata/sf0.001"))
    assert found == _brute(_rows(documents))
    assert any(not r[3] for r in found)


def test_pipeline_stage_against_all_pairs(spark, documents):
    near_dedup = dict(corpus_pipeline.STAGES)["near_dedup"]
    expected = {r[0] for r in _brute(_rows(documents), 80) if r[3]}
    assert expected < {r[0] for r in _brute(_rows(documents), 85) if r[3]}
    out = near_dedup(spark, documents, "/root/testdata/sf0.001")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(expected)


def test_shingle_sets_match_words():
    texts = ["", " ", "a", "A", "a b c d", "a b c d e", "A  B\tc\nd e\x0bf\x0c", "é É ß", "a b c d e a b c d e", " lead"]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    sets = shingle_sets(np.frombuffer(data, np.uint8), offsets)
    assert [len(s) for s in sets] == [len(_shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(_shingles(a) & _shingles(b)), (a, b)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_group_of_near_copies(spark, monkeypatch, chunk):
    """A hundred edited copies of one text, exact copies, and texts that share half of it."""
    monkeypatch.setattr(minhash, "_CHUNK", chunk)
    monkeypatch.setattr(minhash, "_CHUNK_SHINGLES", 600 if chunk == 4 else 2_000_000)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        if i < 100:
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        elif i < 120:
            words = base[:60] + [f"other{rng.randrange(10**6)}" for _ in range(60)]
        elif i >= 140:
            words = [f"own{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert _found(near_duplicates(df)) == _brute(rows)


def test_odd_rows(odd):
    assert _found(near_duplicates(odd)) == _brute(_rows(odd))
    kept = deduplicated(odd)
    assert kept.columns == odd.columns
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert found == sorted(
        [(False, i) for i in (1, 3, 4, 5, 6, 7, 8, 9, 10)] + [(True, 0), (True, 0)]
    )


def test_empty(none):
    assert near_duplicates(none).count() == 0
    assert deduplicated(none).count() == 0


def test_one_of_each_group_stays(documents):
    found = near_duplicates(documents)
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert {r["doc_id"] for r in deduplicated(documents).collect()} == kept
    assert kept == {r["component_id"] for r in found.collect()}
