"""Log-likelihood of whole documents under a gated recurrent model, with the unigram base beside it.

Word counts of the training documents are aggregated over the whole corpus and meet each block of documents
as its small table. The recurrent model predicts the frequent words, the end, and for every other word the
ending it has; such a word then takes its share of the smoothed counts of the words with that ending, so
the probabilities of all words add up to one. Training goes through the training documents once, in rounds:
every task of a round starts from the same weights, learns from its own documents, and the weights are
averaged by tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent
from .blocks import with_blocks
from .common import Scratch, added_up, doc_bucket, giving_back, in_runs, utf8
from .shingles import word_hashes
from .word_counts import Places, add_up, list_words, n_ranges, with_counts

_TEXT_BYTES = 1 << 20
#: Tokens of one pass of the optimiser inside a task; texts scored side by side, in bytes.
_PASS_TOKENS, _SCORE_BYTES = 1_000_000, 16 << 20
_SMOOTH = 0.1
#: Endings: a to z, full stop, comma, exclamation mark, digit, beyond ASCII, any other.
_SHAPES = 32
_SHAPE = np.full(256, 31, np.int64)
_SHAPE[97:123] = np.arange(26)
_SHAPE[[46, 44, 33]] = [26, 27, 28]
_SHAPE[48:58] = 29
_SHAPE[128:] = 30


def _words(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last text, and per word hash, text (from 0) and ending, a bounded number of bytes at a time."""
    data, offsets = utf8(column)
    for a, b in in_runs(np.diff(offsets).tolist(), _TEXT_BYTES):
        hashes, text, last = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, hashes.view(np.int64), text, _SHAPE[last]


class _Tokens:
    """Tokens of texts: the end, an ending, or a frequent word."""

    def __init__(self, keys: np.ndarray, layout: recurrent.Layout):
        order = np.argsort(keys, kind="stable")
        self.places = Places(keys[order])
        self.numbers = np.append(layout.single + order, -1)

    def frequent(self, key: np.ndarray) -> np.ndarray:
        """The token of every frequent word, -1 for others."""
        return self.numbers.take(self.places(key))

    @staticmethod
    def stream(n: int, frequent: np.ndarray, text: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of ``n`` texts one after another, each with its end, and their offsets; of the words given are the
        tokens that they have if they are ``frequent``, their texts and endings."""
        size = np.bincount(text, minlength=n)
        offsets = np.concatenate(([0], np.cumsum(size + 1)))
        out = np.full(offsets[-1], recurrent.END, np.int64)
        out[np.arange(len(text)) + text] = np.where(frequent < 0, 1 + shape, frequent)
        return out, offsets


def _train_round(docs: DataFrame, weights: recurrent.Weights, keys: np.ndarray, rate: float) -> recurrent.Weights:
    shared = docs.sparkSession.sparkContext.broadcast((weights, keys))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, keys = shared.value
        tokens = _Tokens(keys, now.layout)
        held, size, total = [], 0, 0

        def learn(w):
            return recurrent.train(w, np.concatenate(held), rate=rate)

        for batch in batches:
            for a, b, key, text, shape in _words(batch.column(0)):
                held.append(tokens.stream(b - a, tokens.frequent(key), text, shape)[0])
                size += len(held[-1])
                if size >= _PASS_TOKENS:
                    now, total = learn(now), total + size
                    held, size = [], 0
        if held:
            now, total = learn(now), total + size
        if total:
            flat = np.append(now.flat().astype(np.float64), 1.0) * total
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["sums"])

    # One row per task, which a few tasks add up.
    n = len(weights.flat())
    sums = added_up(docs.select("text").mapInArrow(giving_back(run), "sums binary"), n + 1, "float64")
    return weights.unflat(sums[:n] / sums[n]) if sums[n] else weights


def score_documents(
    docs: DataFrame,
    folds: int = 10,
    vocabulary: int = 1024,
    hidden: int = 16,
    rounds: int = 3,
    rate: float = 0.01,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` per row.

    Learns from the rows outside of fold 0 of their id. ``score`` is the model's log10 probability of the whole
    text, ``base_score`` that of the smoothed word counts. Null texts are empty: one token, the end. Null ids
    are in fold 0; rows may repeat. If nothing can be learned from, every token counts as unseen.

    Words are told apart by 64-bit hashes. What reaches the driver are the ``vocabulary`` most frequent words,
    sums per ending, and the model's weights.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        (doc_bucket(F.col(doc_id), folds) == 0).alias("held_out"),
    )
    training = rows.where("not held_out")
    blocked, parts = with_blocks(rows, scratch)
    ranges = n_ranges(docs, parts)
    lists = list_words(blocked, _words, "not held_out", ranges, scratch)
    words = add_up(lists, ranges, scratch)
    per_shape = words.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    n_texts = training.count()
    n_all = sum(r["n"] for r in per_shape) + n_texts
    kinds = sum(r["kinds"] for r in per_shape) + (n_texts > 0)
    under = np.log10(n_all + _SMOOTH * (kinds + 1))
    top = words.orderBy(F.desc("n"), "key").limit(vocabulary).collect()
    keys = np.array([r["key"] for r in top], np.int64)
    rest = np.full(_SHAPES, _SMOOTH)  # the words of each ending that are not frequent, and one unseen
    for r in per_shape:
        rest[r["shape"]] += r["n"] + _SMOOTH * r["kinds"]
    for r in top:
        rest[r["shape"]] -= r["n"] + _SMOOTH
    rest = np.maximum(rest, _SMOOTH)
    layout = recurrent.Layout(_SHAPES, len(top))
    mass = np.concatenate(([n_texts + _SMOOTH], rest, [r["n"] + _SMOOTH for r in top]))
    weights = recurrent.Weights.start(layout, hidden, np.log(mass / mass.sum()))
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(rounds))
    for k in range(rounds):
        weights = _train_round(training.where(turn == k), weights, keys, rate)

    shared = docs.sparkSession.sparkContext.broadcast((weights, keys, rest))
    kept = ["doc_id", "held_out"]

    def work(known: np.ndarray, values: dict[str, np.ndarray], batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights, keys, rest = shared.value
        tokens, places = _Tokens(keys, weights.layout), Places(known)
        # Per known word, and last for a word without a count.
        numbers, log_count = np.append(tokens.frequent(known), -1), np.log10(np.append(values["n"], 0) + _SMOOTH)
        log_rest = np.log10(rest)

        def out(parts: list):
            columns = [pa.concat_arrays([p[0][i] for p in parts]) for i in range(len(kept))]
            stream = np.concatenate([p[1] for p in parts])
            sizes = np.concatenate([np.diff(p[2]) for p in parts])
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            score = recurrent.score(weights, stream, offsets) / np.log(10)
            score += np.concatenate([p[3] for p in parts])
            return pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(sizes),
                    pa.array(np.concatenate([p[4] for p in parts])),
                    pa.array(np.full(len(sizes), n_all, np.int64)),
                    pa.array(np.concatenate([p[5] for p in parts])),
                    pa.array(score),
                ],
                names=[*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        held, size = [], 0
        for batch in batches:
            for a, b, key, text, shape in _words(batch.column("text")):
                n = b - a
                at = places(key)
                frequent, logs = numbers.take(at), log_count.take(at)
                stream, offsets = tokens.stream(n, frequent, text, shape)
                base = np.bincount(text, weights=logs - under, minlength=n) + np.log10(n_texts + _SMOOTH) - under
                rare = np.where(frequent < 0, logs - log_rest.take(shape), 0)
                share = np.bincount(text, weights=rare, minlength=n)
                n_known = np.bincount(text, minlength=n) - np.bincount(text[at == len(known)], minlength=n) + (n_texts > 0)
                columns = [batch.column(k).slice(a, n) for k in kept]
                held.append((columns, stream, offsets, share, n_known, base))
                size += len(stream) * 7
                if size >= _SCORE_BYTES:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return with_counts(blocked, parts, lists, words, ranges, work, schema)
