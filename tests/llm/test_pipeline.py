import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from sparkscrub.llm import blocks, kneser_ney, quality_rules
from sparkscrub.llm.common import TEXT_BATCH_BYTES, Scratch, components, distinct, in_runs, ranked, union_find
from sparkscrub.llm.entry import QUERIES, tokenizer_path
from sparkscrub.llm.minhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [n.split("_")[0] for n in QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


def test_stages_take_effect(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, columns = Scratch(spark), docs.columns
    kept = {
        "quality_classifier": lambda d: kneser_ney.classify(d, labels).where("kept"),
        "quality_rules": lambda d: quality_rules.judged(d, labels).where("kept"),
        "near_dedup": lambda d: near_duplicates(d, **corpus_pipeline.NEAR).where("kept"),
    }
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = scratch.save(stage(spark, docs, SF), name)
        assert out.columns == columns
        if name in kept:
            expected = {r["doc_id"] for r in kept[name](docs).collect()}
            assert {r["doc_id"] for r in out.collect()} == expected
            assert out.count() == len(expected) <= docs.count()
        before = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in out.collect()} <= before
        docs = out
    taken = Counter(r["doc_id"] for r in docs.collect())
    assert max(taken.values()) == 2
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokens = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in pieces) == tokens
    assert {r["doc_id"] for r in pieces} == set(taken)


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, odd, none, name, stage):
    for docs in (odd, none):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() >= 0
    assert stage(spark, none, SF).count() == 0


def test_ranks(spark):
    rows = [(i % 7 if i % 11 else None, i % 13, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, i long").repartition(5)
    found = defaultdict(list)
    for r in ranked(df, ["g"], ["o"], "rank", Scratch(spark)).collect():
        found[r["g"]].append((r["rank"], r["o"]))
    assert sum(map(len, found.values())) == 500
    for group in found.values():
        group.sort()
        assert [r for r, _ in group] == list(range(len(group)))
        assert [o for _, o in group] == sorted(o for _, o in group)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (200, 200)] + [(300, 301 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    found = {r["node"]: r["root"] for r in components(df, Scratch(spark), "t").collect()}
    expected = {i: 1 for i in range(2, 61)} | {101: 100, 103: 100} | {301 + i: 300 for i in range(50)}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark), "t").count() == 0


def test_small_helpers():
    import numpy as np

    assert list(in_runs([3, 3, 3, 20, 1, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(in_runs([], 6)) == []
    assert union_find(6, np.array([[4, 5], [1, 4], [2, 3]])).tolist() == [0, 1, 2, 2, 1, 1]


_DISTINCT = """
import re, sys
import numpy as np
from sparkscrub.llm import shingles

def highest():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

windows = np.random.default_rng(1).integers(0, 2**40, 2_000_000).astype(np.uint64)
shingles.word_hashes = lambda data, offsets: (windows, np.zeros(len(windows), np.int64), None)
shingles.mix64 = lambda x: windows
open("/proc/self/clear_refs", "w").write("5")
before = highest()
shingles.shingle_sets(np.zeros(1, np.uint8), np.array([0, 1]), width=1)
print(highest() - before)
"""


def test_distinct_numbers_need_no_hash_table():
    """Two million numbers took 113 MB besides themselves."""
    found = subprocess.run([sys.executable, "-c", _DISTINCT], capture_output=True, text=True, check=True).stdout
    assert float(found) < 80


def test_distinct():
    random = np.random.default_rng(1)
    for kind in (np.int64, np.uint64):
        for n in (0, 1, 2, 5000):
            values = random.integers(0, 1000, n).astype(kind) * kind(2**52)
            expected = np.unique(values)
            assert expected.tolist() == distinct(values).tolist()
            assert expected.tolist() == blocks._unpack(blocks._pack(expected), kind).tolist()


def test_texts_reach_workers_of_all_stages_in_small_batches(spark, documents, labels, monkeypatch):
    """In batches of 10,000 rows an executor held some 20 MB of texts several times for each task."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, save = spark.conf.get(setting), {}, Scratch.save

    def saved(self, df, name):
        seen[name] = spark.conf.get(setting)
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", saved)
    corpus_pipeline.quality_classifier(spark, documents, SF)
    corpus_pipeline.near_dedup(spark, documents, SF)
    small = {"counts5", "pairs", "signatures", "near_edges0", "linked_edges0"}
    assert {seen[name] for name in small} == {f"{TEXT_BATCH_BYTES}b"}
    assert spark.conf.get(setting) == before
