import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import sparkscrub.llm.blocks as blocks
from sparkscrub.llm.common import Scratch
from sparkscrub.llm.entry import op10_kneser_ney
from sparkscrub.llm.kneser_ney import ORDER, _discounts, classify, count_grams, kept_documents, perplexities


def _grams(text):
    data = [255] * (ORDER - 1) + list((text or "").encode()) + [254]
    return [tuple(data[i : i + ORDER]) for i in range(len(data) - ORDER + 1)]


class _Model:
    """The textbook recursion over dictionaries."""

    def __init__(self, texts):
        counts = Counter(g for t in texts for g in _grams(t))
        self.levels = {}
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                counts = Counter(g[1:] for g in counts)
            kinds = Counter(counts.values())
            off = _discounts([kinds[k] for k in (1, 2, 3, 4)])
            total, back = defaultdict(int), defaultdict(float)
            for g, n in counts.items():
                total[g[:-1]] += n
                back[g[:-1]] += off[min(n, 3) - 1]
            self.levels[order] = (counts, off, total, back)

    def p(self, gram):
        below = 1 / 257 if len(gram) == 1 else self.p(gram[1:])
        counts, off, total, back = self.levels[len(gram)]
        context = gram[:-1]
        if context not in total:
            return below
        n = counts.get(gram, 0)
        share = (n - off[min(n, 3) - 1]) / total[context] if n else 0
        return share + back[context] / total[context] * below

    def perplexity(self, text):
        grams = _grams(text)
        return math.exp(-sum(math.log(self.p(g)) for g in grams) / len(grams))


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "", "a cat and a dog", "日本語 é", "the the the the", None]


def test_grams_are_counted(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    found = {r["gram"]: r["n"] for r in count_grams(df).collect()}
    expected = Counter(int.from_bytes(bytes(g), "big") for t in TEXTS for g in _grams(t))
    assert found == expected


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_perplexity_against_the_recursion(spark, documents, monkeypatch, block_bytes):
    trained = [r["text"] for r in documents.orderBy("doc_id").limit(12).collect()]
    model = _Model(trained)
    scored = [*TEXTS, *trained[:2], "!!! $$$ %%%", "the"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(scored)], "doc_id long, text string, tag string")
    monkeypatch.setattr(blocks.with_blocks, "__defaults__", (block_bytes,))
    df = spark.createDataFrame([(t,) for t in trained], "text string")
    found = perplexities(rows.repartition(3), df, Scratch(spark)).collect()
    assert len(found) == len(scored)
    for r in found:
        text = scored[r["doc_id"]]
        assert r["tag"] == "x" and r["n_bytes"] == len((text or "").encode())
        assert r["perplexity"] == pytest.approx(model.perplexity(text), rel=1e-4)


def test_probabilities_add_up(documents):
    model = _Model([r["text"] for r in documents.limit(5).collect()])
    for context in ((255,) * 4, tuple(b"the "), tuple(b"zzzz")):
        assert sum(model.p((*context, s)) for s in [*range(256), 256]) == pytest.approx(1, abs=1e-9)


def test_query_keeps_good_and_rejects_poor(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op10_kneser_ney(spark, folder).collect()}
    assert len(rows) == 1000
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    poor = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.95 * len(good)
    assert sum(poor) <= 0.2 * len(poor)


def test_thresholds_are_quantiles(spark, documents, labels):
    rows = classify(documents, labels, quantile=0.9, margin=1.5, least=3).collect()
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    held = documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    held = {r["doc_id"] for r in held.collect()} & good
    groups = defaultdict(list)
    for r in rows:
        if r["doc_id"] in held:
            groups[r["lang"], int(math.log2(r["n_bytes"]) / 2)].append(r["perplexity"])
            groups[r["lang"], None].append(r["perplexity"])
            groups[None].append(r["perplexity"])
    for r in rows:
        options = [groups[r["lang"], int(math.log2(r["n_bytes"]) / 2)], groups[r["lang"], None]]
        values = sorted(next((g for g in options if len(g) >= 3), groups[None]))
        assert r["threshold"] == 1.5 * values[math.ceil(0.9 * len(values)) - 1]
        assert r["kept"] == (r["perplexity"] <= r["threshold"])


def test_threshold_is_the_quantile_itself(documents, labels):
    rows = classify(documents, labels, least=3).collect()
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    held = documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    held = {r["doc_id"] for r in held.collect()} & good
    seen = {r["perplexity"] for r in rows if r["doc_id"] in held}
    assert rows and all(r["threshold"] in seen for r in rows)


def test_odd_rows(odd, none, labels, no_labels):
    for known in (labels, no_labels):
        found = classify(odd, known).collect()
        assert len(found) == odd.count()
        for r in found:
            assert r["kept"] or r["n_bytes"] == 0 or r["perplexity"] > r["threshold"]
            assert not (r["kept"] and r["n_bytes"] == 0)
        rows = kept_documents(odd, known)
        assert rows.columns == odd.columns and rows.count() == sum(r["kept"] for r in found)
        assert classify(none, known).count() == 0
    assert sum(r["kept"] for r in classify(odd, no_labels).collect()) == sum(bool(r["text"]) for r in odd.collect())
