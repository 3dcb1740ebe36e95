import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkscrub.llm import quality_rules
from sparkscrub.llm.entry import op7_quality_rules
from sparkscrub.llm.quality_rules import binomial_tail, judged, kept_documents, text_features

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(lines))


def _features(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, __text string")
    rows = text_features(df).orderBy("i").select(*COUNTS).collect()
    return [tuple(r) for r in rows]


def test_counts_on_odd_texts(spark, odd, documents):
    texts = [r["text"] for r in odd.collect()] + [r["text"] for r in documents.collect()]
    texts += ["a b c d e a b c d e", "a a a a a a a", "a b c d e f", "x\n\n x\nx\nx ", "\x0b\x0c\r\n", "a b #$ <|>", "\n"]
    assert _features(spark, texts) == [_counts(t) for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "\n", "#", "\t"]), max_size=60).map(" ".join), max_size=12))
def test_counts_on_random_texts(spark, texts):
    assert _features(spark, texts) == [_counts(t) for t in texts]


def test_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 30, 200, 1500, 20_000) for k in sorted({0, 1, n // 200, n // 110, n // 100}) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long")
    for p in (0.01, 0.004):
        rows = df.select("k", "n", binomial_tail(F.col("k"), F.col("n"), p).alias("tail")).collect()
        for r in rows:
            if r["k"] <= r["n"] * p:
                logs = [
                    math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1)
                    + i * math.log(p) + (r["n"] - i) * math.log1p(-p)
                    for i in range(r["k"] + 1)
                ]
                assert r["tail"] == pytest.approx(math.fsum(map(math.exp, logs)), rel=1e-6)
            else:
                assert r["tail"] == 1


def _cutoffs(rows, labels, limit=0.05, delta=0.05, price=4.0):
    """Cutoffs by stratum and rule, testing every cutoff from the loosest on with exact sums."""
    strata = {r["stratum"] for r in rows if r["doc_id"] in labels and not r["base_failed"]}
    found = {}
    for s in strata:
        held = [(r, labels[r["doc_id"]]) for r in rows if r["stratum"] == s and r["doc_id"] in labels and not r["base_failed"]]
        n, poor = sum(y == 1 for _, y in held), sum(y != 1 for _, y in held)
        for rule, (top, bottom, steps, last) in quality_rules.RULES.items():
            bins = [(min(last, math.floor(r[top] * steps / max(r[bottom], 1))), y) for r, y in held]
            p, best = Fraction(limit / len(quality_rules.RULES)), None
            for b in range(last, 0, -1):
                k = sum(y == 1 and x >= b for x, y in bins)
                tail = float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
                if k > n * p or tail * len(strata) * len(quality_rules.RULES) > delta:
                    break
                gain = sum(y != 1 and x >= b for x, y in bins) / max(poor, 1) - price * k / max(n, 1)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, b)
            if best:
                found[s, rule] = best[1]
    return found


def test_cutoffs_against_brute_force(spark):
    rows, labels = [], {}
    for i in range(1600):
        poor = i % 8 == 0
        words = [f"w{(i * 7 + j) % 1000}" for j in range(20)]
        if poor and i % 16 == 0:
            words = [w + "$$" for w in words]
        elif poor:
            words = [w.upper() + "SHOUT" for w in words]
        elif i % 400 == 1:
            words[:4] = ["#", "#", "#", "#"]
        rows.append((i, " ".join(words), "en" if i % 4 else None))
        labels[i] = int(not poor)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    found = judged(docs, table, limit=0.2).collect()
    cutoffs = _cutoffs(found, labels, limit=0.2)
    assert cutoffs
    for r in found:
        over = any(
            min(last, math.floor(r[top] * steps / max(r[bottom], 1))) >= cutoffs.get((r["stratum"], rule), 10**9)
            for rule, (top, bottom, steps, last) in quality_rules.RULES.items()
        )
        assert r["kept"] == (not r["base_failed"] and not over)
    good = [r for r in found if labels[r["doc_id"]]]
    assert sum(not r["kept"] for r in good) <= 0.2 * len(good)
    caught = [r for r in found if not labels[r["doc_id"]]]
    assert sum(not r["kept"] for r in caught) > 0.8 * len(caught)


def test_query(spark, documents):
    rows = op7_quality_rules(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        counts = _counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS[:5]) == counts[:5]
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_odd_rows(spark, odd, none, no_labels, labels):
    for known in (no_labels, labels):
        found = judged(odd, known).collect()
        assert len(found) == odd.count()
        rows = kept_documents(odd, known)
        assert rows.columns == odd.columns
        assert rows.count() == sum(r["kept"] for r in found) > 0
        assert judged(none, known).count() == 0
        assert kept_documents(none, known).count() == 0


def test_no_python_on_the_executors(spark, documents, labels):
    plan = judged(documents, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_labels_of_null_repeated_and_unknown_ids(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten " + str(i), "en") for i in range(30)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(None, 1), (1, 1), (1, 0), (2, None), (999, 1)], "doc_id long, quality int")
    by_id = defaultdict(int)
    for r in judged(docs, known).collect():
        by_id[r["kept"]] += 1
    assert by_id == {True: 30}
