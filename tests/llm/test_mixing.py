import re
from collections import defaultdict

import pytest

from sparkscrub.llm.entry import op2_mix_sources
from sparkscrub.llm.mixing import cycling_weights, mix, mixed_documents, shared_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes):
    """By bisection on the level to which every source's share of the total is filled."""
    weights = cycling_weights(sizes)
    total = 1.5 * sum(sizes.values())
    low, high = 0.0, total
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * weights[s], 2 * sizes[s]) for s in sizes) < total:
            low = level
        else:
            high = level
    return {s: min(high * weights[s], 2 * sizes[s]) for s in sizes}


def test_weights_follow_code_points_and_null_is_last():
    assert cycling_weights([None, "b", "B", "a"]) == {"B": 3, "a": 1, "b": 2, None: 3}


def test_targets_without_words():
    assert shared_targets({"a": 0, None: 0}, {"a": 3, None: 1}, 0, 2) == {"a": 0, None: 0}


def test_query_against_brute_force(spark, documents):
    rows = op2_mix_sources(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r for r in documents.collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        doc = texts[r["doc_id"]]
        assert r["size"] == len(WORD.findall(doc["text"]))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[doc["source"]] += r["size"]
        taken[doc["source"]] += r["taken"]
        largest[doc["source"]] = max(largest[doc["source"]], r["size"])
    assert len(rows) == len(texts)
    targets = _targets(sizes)
    for r in rows:
        source = texts[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(targets[source])
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= largest[source] / 2 + 1
    again = op2_mix_sources(spark, "/root/testdata/sf0.001").collect()
    assert sorted(again) == sorted(rows)


def test_larger_documents_are_likelier(documents):
    rows = mix(documents, share=0.3, weights=lambda names: dict.fromkeys(names, 1.0)).collect()
    rows = [r for r in rows if r["size"] > 0]
    rows.sort(key=lambda r: r["size"])
    half = len(rows) // 2
    assert sum(r["copies"] for r in rows[half:]) > sum(r["copies"] for r in rows[:half])


def test_odd_rows(odd):
    rows = mix(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = r["__row"]["text"]
        assert r["size"] == (len(WORD.findall(text)) if text else 0)
        assert r["taken"] == r["copies"] * r["size"] and (r["size"] or not r["copies"])
    same = {r["copies"] for r in rows if r["__row"]["doc_id"] == 1}
    assert len(same) == 1
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in rows)


def test_empty(none):
    assert mix(none).count() == 0
    assert mixed_documents(none).count() == 0


def test_small_tables_need_no_python_on_the_executors(spark, documents, monkeypatch):
    """A plain list of rows starts a Python daemon and workers on each executor, which stay."""

    def plain(*_, **__):
        raise AssertionError("rows are unpickled by Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", plain)
    found = mix(documents)
    assert found.count() == documents.count()
    assert mix(documents.limit(0)).count() == 0
