import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscrub.llm import langid
from sparkscrub.llm.entry import op1_language_id


def _parse(text, reference):
    """Greedy longest phrases of ``text`` that occur in ``reference``; a letter that does not is a phrase."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in reference:
            end += 1
        if text[at] not in reference:
            end = at + 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("block", [7, 512])
def test_phrases_against_search(monkeypatch, block):
    monkeypatch.setattr(langid, "_BLOCK", block)
    rng = random.Random(block)
    texts = {k: "".join(rng.choice(letters) for _ in range(300)) for k, letters in (("x", "ab "), ("y", "abcd "))}
    model = langid.Model(texts)
    samples = ["", "a", "zzz", "abab cd dcba", *["".join(rng.choice("abcdz ") for _ in range(rng.randrange(1, 60))) for _ in range(40)]]
    found, offsets, letters = langid._letters(samples, model.classes())
    counts = model.phrases(found, offsets)
    for i, sample in enumerate(samples):
        clean = " ".join(sample.split())
        assert offsets[i + 1] - offsets[i] in (len(clean), len(clean) + 1)  # one separator may end it
        clean = clean + " " * (offsets[i + 1] - offsets[i] - len(clean))
        assert letters[i] == sum(c.isalpha() for c in sample)
        for k, name in enumerate(model.languages):
            blocks = [clean[j : j + block] for j in range(0, len(clean), block)]
            assert counts[k, i] == sum(_parse(b, texts[name]) for b in blocks), (sample, name)


def test_query_accuracy(spark, documents):
    rows = op1_language_id(spark, "/root/testdata/sf0.001").collect()
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_labels_of_the_held_out_fold_do_not_matter(documents):
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    changed = documents.withColumn("lang", F.when(bucket == 0, "zz").otherwise(F.col("lang")))
    found = langid.predict(documents, langid.train(documents)).collect()
    assert sorted(langid.predict(documents, langid.train(changed)).collect()) == sorted(found)


def test_any_part_of_a_long_text_is_learned_from(spark):
    """The letters of xx come only after 10,000 letters that both languages share."""
    rows = [(i, "yy" if i % 2 else "xx", "ab " * 3_333 + ("cd " if i % 2 else "ef ") * 3_333) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs, train_chars=20_000)
    assert {chr(c) for c in model.codes} == set("abcdef")
    found = langid.predict(spark.createDataFrame([(1, "cd cd"), (2, "ef ef")], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in found.collect()} == {1: "yy", 2: "xx"}


def test_every_language_has_a_least_share(documents):
    model = langid.train(documents, all_chars=2)
    learned = documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert model.languages == sorted(r[0] for r in learned.select("lang").distinct().collect() if r[0])
    assert min(model.bits) > np.log2(200)


def test_odd_rows(odd, documents):
    model = langid.train(documents)
    rows = langid.predict(odd, model).collect()
    texts = odd.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r, (doc_id, text) in zip(
        sorted(rows, key=lambda r: str(r["doc_id"])), sorted(texts, key=lambda r: str(r["doc_id"])), strict=True
    ):
        assert r["doc_id"] == doc_id
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for doc_id in (3, 4, 5, 7):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"]) == ("und", 0.0)
    assert by_id[9]["lang_pred"] != "und"


def test_nothing_to_learn_from(odd, none):
    model = langid.train(none)
    assert {r["lang_pred"] for r in langid.predict(odd, model).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
    one = langid.train(odd.where("lang = 'en'"))
    assert one.languages == ["en"]
    assert {r["score"] for r in langid.predict(odd, one).collect()} == {0.0, 1.0}


def test_automaton_accepts_exactly_the_substrings():
    text = [0, 1, 0, 0, 1, 1, 0, 1, 0]
    step = langid.suffix_automaton(np.array(text), 2)
    accepted, todo = set(), [((), 0)]
    while todo:
        path, state = todo.pop()
        accepted.add(path)
        todo += [((*path, c), int(step[state, c])) for c in (0, 1) if step[state, c] >= 0]
    assert accepted == {tuple(text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)}
