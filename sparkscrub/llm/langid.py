"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily into the longest
phrases that occur in that text; a language it is close to needs few of them. The phrases times the
bits that point into the language's text, per character, estimate the cross entropy; least wins.

The automaton's transitions are a table, and where a phrase ends the table already leads on to the first
state of the next phrase and counts it, so that blocks of many texts are parsed side by side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, in_runs, utf8

UNKNOWN = "und"
#: Characters of a block; phrases end at its edge. Characters worked on at once.
_BLOCK, _AT_ONCE = 512, 1 << 20
_POINTS = 0x110000


def _separated(text: str) -> str:
    """Lower case, every run of other characters than letters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: np.ndarray, letters: int) -> np.ndarray:
    """Transitions (states x letters, -1: none) of the suffix automaton of ``text`` (letter numbers); state 0 starts."""
    step = np.full((2 * max(1, len(text)) + 1, letters), -1, np.int32)
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(link)
        link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and step[p, c] == -1:
            step[p, c] = cur
            p = link[p]
        if p != -1:
            q = int(step[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q]), length.append(length[p] + 1)
                step[clone] = step[q]
                while p != -1 and step[p, c] == q:
                    step[p, c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step[: len(link)]


@cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS)


class Model:
    """Parsing tables per language over one alphabet: a space, the most frequent letters, and classes of the others.

    A letter that is not among the most frequent counts as its script: code point / 256 modulo ``scripts``.
    """

    def __init__(self, texts: dict[str, str], alphabet: int = 96, scripts: int = 16):
        self.languages = sorted(texts)
        counts = Counter("".join(texts.values()))
        del counts[" "]
        letters = sorted(sorted(counts), key=lambda c: -counts[c])[:alphabet]
        self.scripts, self.width = scripts, len(letters) + 1 + scripts
        self.codes = np.array([ord(c) for c in letters], np.uint32)
        self.tables, self.bits = [], []
        classes = self.classes()
        for language in self.languages:
            text = texts[language]
            numbers = classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
            step = suffix_automaton(numbers, self.width).astype(np.int64)
            # Where nothing goes on, the phrase (unless it is empty) ends and the next begins with this letter;
            # a letter that the language never has is a phrase of its own and leads back to the start.
            again = np.maximum(step[0], 0)[None, :]
            ended = (np.arange(len(step)) > 0).astype(np.int64)[:, None] + (step[0] < 0)[None, :]
            table = np.where(step >= 0, step * self.width * 4, again * self.width * 4 + ended)
            self.tables.append(table.astype(np.int32).ravel())
            self.bits.append(np.log2(max(2, len(text))))

    def classes(self) -> np.ndarray:
        """Letter number of every code point; 0: no letter."""
        table = np.where(_alphabetic(), len(self.codes) + 1 + (np.arange(_POINTS) >> 8) % self.scripts, 0)
        table = table.astype(np.uint16)
        table[self.codes] = np.arange(1, len(self.codes) + 1)
        return table

    def phrases(self, letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases per language and text; ``letters`` are the texts' numbers one after another."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // _BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[owner] + nth * _BLOCK
        size = np.minimum(_BLOCK, offsets[owner + 1] - start)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        active = np.searchsorted(-size, -np.arange(1, _BLOCK + 1), side="right")  # blocks longer than each place
        out = np.zeros((len(self.tables), len(sizes)), np.int64)
        states = [np.zeros(len(start), np.int32) for _ in self.tables]
        ends = [np.zeros(len(start), np.int32) for _ in self.tables]
        for at in range(_BLOCK):
            n = active[at]
            if n == 0:
                break
            letter = letters[start[:n] + at]
            for table, state, end in zip(self.tables, states, ends, strict=True):
                found = table.take(state[:n] + letter)
                end[:n] += found & 3
                state[:n] = found >> 2
        for k, (end, state) in enumerate(zip(ends, states, strict=True)):
            # The phrase that the block's edge ends counts too.
            out[k] = np.bincount(owner, weights=end + (state > 0), minlength=len(sizes)).astype(np.int64)
        return out


def _letters(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter numbers of the texts with runs of separators joined and trimmed, offsets, and letters per text."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)
    found = classes[codes]
    keep = found > 0
    if len(keep):
        first = np.zeros(len(keep) + 1, bool)
        first[ends] = True
        keep[1:] |= (found[:-1] > 0) & ~first[1 : len(keep)]  # the first separator after a letter
    held = np.concatenate(([0], np.cumsum(keep)))
    n_letters = np.concatenate(([0], np.cumsum(found > 0)))
    return found[keep].astype(np.int32), held[ends], np.diff(n_letters[ends])


def train(
    docs: DataFrame,
    train_chars: int = 40_000,
    all_chars: int = 400_000,
    row_chars: int = 2_000,
    least_chars: int = 400,
    folds: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Model:
    """A model from a bounded sample of the rows with a language outside of fold 0 of their id.

    Rows are drawn by a hash of id and text, about 1.5 times as many as ``train_chars`` characters per
    language, and at least eight long rows, need, each giving up to ``row_chars`` from a place in it that the hash draws too; with many languages
    ``all_chars`` is shared among them, but none has a share below ``least_chars``. Null languages and texts are
    left out. The sample, bounded by these parameters and the number of languages, reaches the driver.
    """
    rows = docs.where(doc_bucket(F.col(doc_id), folds) != 0).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    size = F.least(F.length(text), F.lit(row_chars))
    known = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).agg(F.sum(size)).collect()}
    each = min(train_chars, max(least_chars, all_chars // max(1, len(known))))
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), F.lit(1_000_000))
    places = F.greatest(F.length(text) - row_chars + 1, F.lit(1))
    begin = 1 + F.pmod(F.xxhash64(F.lit("place"), F.col(doc_id).cast("string"), F.col(text)), places).cast("int")
    spark = docs.sparkSession
    # Enough rows for a small share too that a language without any is next to impossible.
    wanted = 1.5e6 * max(each, 8 * row_chars)
    share = [(k, min(1_000_000, int(wanted / max(1, n)) + 1)) for k, n in known.items()]
    shares = spark.createDataFrame(share, "__lang string, __share int")
    drawn = rows.join(F.broadcast(shares), F.col(lang) == F.col("__lang")).select(
        F.col(lang).alias("lang"), draw.alias("draw"), F.substring(text, begin, F.lit(row_chars)).alias("text"), "__share"
    )
    sample = drawn.where("draw < __share").select("lang", "draw", "text").collect()
    texts: dict[str, str] = {}
    for language, _, value in sorted(sample):
        have = texts.get(language, "")
        if len(have) < each and (value := _separated(value)):
            texts[language] = (have + " " + value).strip()[:each]
    return Model(texts)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for every row, from the whole text alone.

    ``score`` is how much more the second best language needs, as its share of both (0.5: a tie, broken by
    the language's name); 1 where only one language is known. ``lang_pred`` is ``und`` and the score 0 for null
    texts, texts without a letter, and where no language is known. Ids may be null or repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, classes = shared.value, None
        for batch in batches:
            classes = model.classes() if classes is None else classes
            texts = batch.column(1)
            names, scores = [], []
            for a, b in in_runs(np.diff(utf8(texts)[1]).tolist(), _AT_ONCE):
                found, offsets, n_letters = _letters([v or "" for v in texts.slice(a, b - a).to_pylist()], classes)
                if not model.languages:
                    names += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                need = model.phrases(found, offsets) * np.array(model.bits)[:, None]
                order = np.argsort(need, axis=0, kind="stable")
                least = np.take_along_axis(need, order, axis=0)
                second = least[1] if len(least) > 1 else np.full(b - a, np.inf)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.where(np.isinf(second), 1.0, second / (least[0] + second))
                has = n_letters > 0
                names += [model.languages[k] if h else UNKNOWN for k, h in zip(order[0].tolist(), has, strict=True)]
                scores += np.where(has, score, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
