"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with block-max inverted indexes.

Examples are rows of a bounded sample; all of their terms are the vocabulary. A term weighs its logarithmic
frequency in the text times its inverse document frequency times its chi-square with the label (at least 1),
both counted over all labelled rows. The index holds a posting list per term, cut into runs by blocks of
examples, with the largest weight of each run. A query takes the blocks in the order of the most they could
score and stops where no block can reach its k-th best example, so the neighbours are exact. Neighbours vote by
their cosine, each weighing as many rows as it stands for; votes are calibrated by leaving examples out of their
own vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_bucket, giving_back, small

_TERM = re.compile(r"[^\W\d_]+")
_BLOCK = 128
#: Blocks a query takes before it looks at its bound again; each turn takes four times as many.
_FIRST_BLOCKS = 4
#: Cosines are compared to this many decimals, so that equal examples tie; and how far rounding may lift a sum.
_DECIMALS, _SLACK = 12, 1e-9
#: Texts searched for at once, the most terms that are laid out as rows then, and the share of examples that have
#: such a term. A sum over so many terms in single precision is off by less than half of _WIDE.
_MANY, _ROWS, _FEW, _WIDE = 64, 512, 16, 1e-4


def term_counts(text: str) -> Counter:
    """Runs of letters of the lower-cased text and how often each occurs."""
    return Counter(_TERM.findall(text.lower()))


def chi_square(n: np.ndarray, toxic: np.ndarray, n_rows: int, n_toxic: int) -> np.ndarray:
    """Pearson's statistic of a term's presence and the label, for terms in ``n`` rows, ``toxic`` of them toxic."""
    n, toxic = np.asarray(n, float), np.asarray(toxic, float)
    apart = toxic * n_rows - n * n_toxic
    spread = n * (n_rows - n) * float(n_toxic) * (n_rows - n_toxic)
    return n_rows * apart * apart / np.maximum(spread, 1e-300) * (spread > 0)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start`` .. ``start + length - 1`` of every range, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class BlockMaxIndex:
    """Posting lists over sparse unit vectors, in runs of one term and one block with the run's largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.size = len(vectors)
        # Examples with the same strongest term share blocks, which keeps the largest weights tight.
        strongest = [(int(t[w.argmax()]), float(w.max())) if len(t) else (-1, 0.0) for t, w in vectors]
        self.order = np.array(sorted(range(self.size), key=lambda i: (strongest[i], i)), np.int64)
        lengths = [len(vectors[i][0]) for i in self.order]
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        by_term = np.argsort(term, kind="stable")
        at = np.repeat(np.arange(self.size), lengths)[by_term]
        term, self.weight, self.at = term[by_term], weight[by_term], at.astype(np.int32)
        self.n_blocks = -(-self.size // _BLOCK)
        key = term * max(1, self.n_blocks) + at // _BLOCK
        self.run = np.flatnonzero(np.diff(key, prepend=-1))
        self.run_size = np.diff(self.run, append=len(key))
        self.run_block = (at // _BLOCK)[self.run]
        self.run_most = np.maximum.reduceat(self.weight, self.run) if len(key) else np.zeros(0)
        self.first = np.searchsorted(term[self.run], np.arange(n_terms + 1))

    def nearest(
        self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and example numbers of the ``k`` nearest with a positive cosine, the nearest first.

        ``skip`` names an example that is left out. Ties go to the example first in the index.
        """
        lengths = self.first[terms + 1] - self.first[terms]
        runs, lift = _ranges(self.first[terms], lengths), np.repeat(weights, lengths)
        block = self.run_block[runs]
        bound = np.bincount(block, lift * self.run_most[runs], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        best, who = np.zeros(0), np.zeros(0, np.int64)
        turn, step = 0, _FIRST_BLOCKS
        while turn < self.n_blocks:
            floor = best[k - 1] - _SLACK if len(best) >= k else 0.0
            now = order[turn : turn + step]
            now = now[bound[now] > max(floor, 0.0)]
            if len(now) == 0:
                break
            taken = np.zeros(self.n_blocks, bool)
            taken[now] = True
            some = taken[block]
            posts = _ranges(self.run[runs[some]], self.run_size[runs[some]])
            value = np.repeat(lift[some], self.run_size[runs[some]]) * self.weight[posts]
            found = np.round(np.bincount(self.at[posts], value, minlength=self.size), _DECIMALS)
            name = np.flatnonzero(found > 0)
            if skip is not None:
                name = name[self.order[name] != skip]
            if len(name) > k:  # ties with the k-th stay in
                name = name[found[name] >= np.partition(found[name], -k)[-k]]
            best, who = np.concatenate([best, found[name]]), np.concatenate([who, name])
            top = np.lexsort((who, -best))[:k]
            best, who = best[top], who[top]
            turn, step = turn + step, step * 4
        return best, self.order[who] if self.size else who


    def __getstate__(self):
        return {name: value for name, value in self.__dict__.items() if name != "_laid_out"}

    @cached_property
    def _laid_out(self) -> tuple:
        """Rows of common terms, each term's row (-1: none), and the postings by example. Not sent with the index."""
        n_terms = len(self.first) - 1
        start = np.append(self.run, len(self.weight))[self.first]
        held = np.diff(start)
        common = np.argsort(-held, kind="stable")[:_ROWS]
        common = np.sort(common[held[common] * _FEW > self.size])
        row_of = np.full(n_terms, -1)
        row_of[common] = np.arange(len(common))
        rows = np.zeros((len(common), self.size), np.float32)
        posts = _ranges(start[common], held[common])
        rows[np.repeat(np.arange(len(common)), held[common]), self.at[posts]] = self.weight[posts]
        by_example = np.argsort(self.at, kind="stable")
        term = np.repeat(np.arange(n_terms, dtype=np.int32), held)[by_example]
        first = np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=self.size))])
        return rows, row_of, term, self.weight[by_example], first, np.arange(self.size) // _BLOCK, np.zeros(n_terms)

    def nearest_of_many(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator:
        """:meth:`nearest` of each vector, with the same results.

        The share of common terms in all cosines is one product in single precision, so that a block's bound
        needs the largest weights of the other terms only and is close. Examples within its error of the k-th best
        are scored again, from all their terms, in the order in which :meth:`nearest` adds.
        """
        if not self.size:
            yield from ((np.zeros(0), np.zeros(0, np.int64)) for _ in vectors)
            return
        rows, row_of, *_ = self._laid_out
        for at in range(0, len(vectors), _MANY):
            some = vectors[at : at + _MANY]
            weights = np.zeros((len(some), len(rows)), np.float32)
            others = []
            for i, (terms, w) in enumerate(some):
                row = row_of[terms]
                is_common = row >= 0
                weights[i, row[is_common]] = w[is_common]
                others.append((terms[~is_common], w[~is_common]))
            shares = weights @ rows
            for (terms, w), other, share in zip(some, others, shares, strict=True):
                yield self._nearest_beside(terms, w, self._candidates(*other, share, k), k)

    def _candidates(self, terms: np.ndarray, weights: np.ndarray, share: np.ndarray, k: int) -> np.ndarray:
        """Places (ascending) of all examples that may be among the ``k`` nearest, given the ``share`` of common terms."""
        block_of = self._laid_out[5]
        lengths = self.first[terms + 1] - self.first[terms]
        runs, lift = _ranges(self.first[terms], lengths), np.repeat(weights, lengths)
        block = self.run_block[runs]
        bound = np.bincount(block, lift * self.run_most[runs], minlength=self.n_blocks)
        bound = bound + np.maximum.reduceat(share, np.arange(0, self.size, _BLOCK))
        order = np.argsort(-bound, kind="stable")
        best, who, floor = np.zeros(0), np.zeros(0, np.int64), 0.0
        turn, step = 0, _FIRST_BLOCKS
        while turn < self.n_blocks:
            now = order[turn : turn + step]
            now = now[bound[now] > floor]
            if len(now) == 0:
                break
            taken = np.zeros(self.n_blocks, bool)
            taken[now] = True
            some = np.flatnonzero(taken[block])
            size = self.run_size[runs[some]]
            posts = _ranges(self.run[runs[some]], size)
            value = np.repeat(lift[some], size) * self.weight[posts]
            found = np.bincount(self.at[posts], value, minlength=self.size) + share
            name = np.flatnonzero((found > floor) & taken[block_of])
            best, who = np.concatenate([best, found[name]]), np.concatenate([who, name])
            if len(best) >= k:
                floor = max(0.0, float(np.partition(best, -k)[-k]) - _WIDE)
            turn, step = turn + step, step * 4
        return np.sort(who[best > floor])

    def _nearest_beside(self, terms: np.ndarray, weights: np.ndarray, places: np.ndarray, k: int) -> tuple:
        """The ``k`` nearest of the examples at ``places``."""
        _, _, term, weight, first, _, lifts = self._laid_out
        size = first[places + 1] - first[places]
        posts = _ranges(first[places], size)
        lifts[terms] = weights
        value = lifts[term[posts]] * weight[posts]
        lifts[terms] = 0
        found = np.round(np.bincount(np.repeat(np.arange(len(places)), size), value, minlength=len(places)), _DECIMALS)
        top = np.lexsort((places, -found))[:k]
        top = top[found[top] > 0]
        return found[top], self.order[places[top]]


def _isotonic(vote: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (vote, score) of the best nondecreasing score of a vote (pool adjacent violators)."""
    order = np.argsort(vote, kind="stable")
    pools: list[list[float]] = []  # weight, weight of label 1, first vote
    for v, y, w in zip(vote[order], label[order], weight[order], strict=True):
        if pools and pools[-1][2] == v:
            pools[-1][0] += w
            pools[-1][1] += w * y
        else:
            pools.append([w, w * y, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w2, y2, _ = pools.pop()
            pools[-1][0] += w2
            pools[-1][1] += y2
    return np.array([p[2] for p in pools]), np.array([p[1] / p[0] for p in pools])


class Model:
    """Vocabulary with weights, the index of examples, what each stands for, and the calibration of votes.

    ``examples`` are (id, label, counts per term); ``rates`` the shares of rows of label 0 and 1 that became
    examples; ``rest`` the score of a text without a known term.
    """

    def __init__(
        self, terms: list[str], weights: np.ndarray, examples: list, rates: tuple[float, float], rest: float, k: int
    ):
        self.number, self.weights, self.k, self.rest = {t: i for i, t in enumerate(terms)}, weights, k, rest
        self.ids = [e[0] for e in examples]
        self.label = np.array([e[1] for e in examples], np.int64)
        self.stands_for = np.where(self.label == 1, 1 / max(rates[1], 1e-9), 1 / max(rates[0], 1e-9))
        vectors = [self.vector(e[2]) for e in examples]
        self.index = BlockMaxIndex(vectors, len(terms))
        votes = [self._vote(*self.index.nearest(*v, k, skip=i)) for i, v in enumerate(vectors)]
        known = np.array([v is not None for v in votes], bool)
        self.steps = None
        if known.any():
            vote = np.array([v for v in votes if v is not None])
            self.steps = _isotonic(vote, self.label[known], self.stands_for[known])

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (ascending) and unit weights of the known terms of a text."""
        number = self.number
        terms = np.fromiter((number.get(t, -1) for t in counts), np.int64, len(counts))
        times = np.fromiter(counts.values(), float, len(counts))
        order = np.argsort(terms)[np.count_nonzero(terms < 0) :]
        terms = terms[order]
        weights = (1 + np.log(times[order])) * self.weights[terms]
        return terms, weights / max(math.sqrt(float((weights * weights).sum())), 1e-300)

    def _vote(self, cosine: np.ndarray, who: np.ndarray) -> float | None:
        """Share of label 1 among the neighbours; None without any."""
        if len(who) == 0:
            return None
        # The nearer, the more: an example at distance 0 weighs a hundred times one at distance 1.
        weight = self.stands_for[who] / (0.01 + 1 - np.minimum(cosine, 1))
        return float((weight * self.label[who]).sum() / weight.sum())

    def score(self, texts: list[str]) -> Iterator[tuple[float, list[tuple]]]:
        """Score of each whole text, and the three nearest examples (id, cosine, label) behind it."""
        vectors = [self.vector(term_counts(text)) for text in texts]
        for cosine, who in self.index.nearest_of_many(vectors, self.k):
            vote = self._vote(cosine, who)
            if vote is None or self.steps is None:
                yield self.rest, []
                continue
            at = max(int(np.searchsorted(self.steps[0], vote, side="right")) - 1, 0)
            near = zip(cosine[:3].tolist(), who[:3].tolist(), strict=True)
            evidence = [(self.ids[i], c, int(self.label[i])) for c, i in near]
            yield min(1.0, max(0.0, float(self.steps[1][at]))), evidence


def train(
    docs: DataFrame,
    labels: DataFrame,
    is_training: Column,
    examples: int = 4096,
    example_bytes: int = 16 << 20,
    k: int = 15,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """A model from the labelled rows for which ``is_training`` holds.

    Document frequencies and the statistics of terms are over all of these rows and whole texts. About ``examples``
    rows (half of each label), with about ``example_bytes`` of text, drawn by a hash of id and text, become
    examples; texts above a sixteenth of these bytes are not drawn. Every term of an example is in the vocabulary.
    Rows without a label or id are left out; of several labels of an id the highest holds. Rows and labels that
    repeat count as often as the rows do. Columns other than those named are not looked at, so that their names
    do not matter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id"))
    known = scratch.save(known.agg(F.max(F.col(label).cast("int")).alias("y")), "labels")
    rows = docs.where(is_training).select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = rows.join(small(known, 32), F.col("doc_id") == F.col("__id"))
    rows = rows.select("doc_id", "text", (F.col("y") == 1).cast("int").alias("y"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            seen: list[Counter] = [Counter(), Counter()]
            n, bare = [0, 0], [0, 0]
            for value, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = set(_TERM.findall(value.as_py().lower()))
                n[y] += 1
                bare[y] += not found
                seen[y].update(found)
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*terms, None, ""], pa.string()),  # totals: rows, rows without a term
                    pa.array([seen[0][t] + seen[1][t] for t in terms] + [sum(n), sum(bare)], pa.int64()),
                    pa.array([seen[1][t] for t in terms] + [n[1], bare[1]], pa.int64()),
                ],
                names=["term", "n", "toxic"],
            )

    counted = rows.mapInArrow(giving_back(count), "term string, n long, toxic long").groupBy("term")
    counted = scratch.save(counted.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "terms")
    totals = {r["term"]: (r["n"], r["toxic"]) for r in counted.where("term is null or term = ''").collect()}
    (n_rows, n_toxic), (n_bare, toxic_bare) = totals.get(None, (0, 0)), totals.get("", (0, 0))
    rest = (toxic_bare + n_toxic / max(1, n_rows)) / (n_bare + 1)

    size = F.octet_length("text")
    fits = (size > 0) & (size <= example_bytes // 16)
    held = {r["y"]: r for r in rows.where(fits).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()}
    rate = [
        min(1.0, examples / 2 / held[y]["n"], example_bytes / 2 / held[y]["b"]) if y in held else 1.0 for y in (0, 1)
    ]
    cut = F.when(F.col("y") == 1, int(rate[1] * 1_000_000)).otherwise(int(rate[0] * 1_000_000))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < cut
    sample = scratch.save(rows.where(fits & drawn), "sample")

    def terms_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = {t for value in batch.column(0).to_pylist() for t in _TERM.findall(value.lower())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["term"])

    names = sample.select("text").mapInArrow(terms_of, "term string").distinct()
    used = sorted(tuple(r) for r in counted.join(names, "term").select("term", "n", "toxic").collect())
    n, toxic = np.array([r[1] for r in used], float), np.array([r[2] for r in used], float)
    weights = (np.log((n_rows + 1) / (n + 1)) + 1) * np.maximum(1.0, chi_square(n, toxic, n_rows, n_toxic))
    found = sorted(
        ((r["doc_id"], r["y"], term_counts(r["text"])) for r in sample.collect()),
        key=lambda e: (str(e[0]), e[1], sorted(e[2].items())),
    )
    return Model([r[0] for r in used], weights, found, (rate[0], rate[1]), rest, k)


def score(
    docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``evidence`` (nearest examples) for every row, from its whole text.

    Texts without a term of the examples, empty and null ones among them, get the share of toxic rows among
    the labelled rows without a term, and no evidence. Ids may be null or repeat; equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            found = []
            for at in range(0, len(batch), _MANY):
                found += model.score([v.as_py() or "" for v in batch.column(1).slice(at, _MANY)])
            scores, evidence = np.array([f[0] for f in found], float), [f[1] for f in found]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(e) for e in evidence]))), pa.int32())
            flat = [x for e in evidence for x in e]
            item = pa.StructArray.from_arrays(
                [
                    pa.array([x[0] for x in flat], batch.column(0).type),
                    pa.array([x[1] for x in flat], pa.float64()),
                    pa.array([x[2] for x in flat], pa.int32()),
                ],
                names=["doc_id", "cosine", "label"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, item),
                ],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    id_type = kind.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        giving_back(run),
        f"doc_id {id_type}, score double, predicted int, "
        f"evidence array<struct<doc_id: {id_type}, cosine: double, label: int>>",
    )


def outside_fold(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return doc_bucket(doc_id, folds) != fold
