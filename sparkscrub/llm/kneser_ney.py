"""Quality classifier: an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

The counts of every order are tables keyed by n-gram; continuation counts, discounts and back-off weights are
aggregates and joins of them. The n-grams that documents need are joined with those tables order by order, and
every document's perplexity is the mean over its bytes. Documents are rejected above a high quantile of what
trusted documents that were not learned from have in the same language and size class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import needed_keys, with_blocks, with_tables
from .common import Scratch, doc_bucket, giving_back, in_runs, row_key, small, text_batches, utf8, without

ORDER = 5
#: Bytes that no UTF-8 text has: before the start, after the end.
_START, _END = 0xFF, 0xFE
_SYMBOLS = 257  # 256 byte values and the end
_TEXT_BYTES = 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDER``-grams ending at each byte and at the end of each text, as numbers, and the texts' offsets in them."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    pad = ORDER - 1
    begin = offsets[:-1] + np.arange(n) * ORDER  # each text is followed by its end and preceded by its starts
    padded = np.full(len(data) + n * ORDER, _START, np.int64)
    inside = np.ones(len(padded), bool)
    for k in range(pad):
        inside[begin + k] = False
    ends = begin + pad + size
    padded[ends] = _END
    text = inside.copy()
    text[ends] = False
    padded[text] = data
    windows = np.zeros(len(padded) - pad if n else 0, np.int64)
    for k in range(ORDER if n else 0):
        windows = (windows << 8) | padded[k : len(padded) - pad + k]
    return windows[inside[pad:]], offsets + np.arange(n + 1)


def count_grams(texts: DataFrame) -> DataFrame:
    """Rows ``gram``, ``n``: how often each ``ORDER``-gram occurs in the column ``text``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in in_runs(np.diff(offsets).tolist(), _TEXT_BYTES):
                found, _ = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                key, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["gram", "n"])

    counted = texts.select("text").mapInArrow(giving_back(run), "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


class Counts:
    """Per order the n-grams' discounted shares and their contexts' back-off weights, as written tables."""

    def __init__(self, top: DataFrame, scratch: Scratch):
        self.share: dict[int, DataFrame] = {}
        self.back: dict[int, DataFrame] = {}
        counts = scratch.save(top, "counts5")
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                # Lower orders count in how many contexts an n-gram was seen.
                tail = F.col("gram").bitwiseAND((1 << (8 * order)) - 1)
                counts = counts.groupBy(tail.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
                counts = scratch.save(counts, f"counts{order}")
            kinds = counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
            off = _discounts([v or 0 for v in kinds])
            discount = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
            context = F.shiftright("gram", 8)
            per_context = counts.groupBy(context.alias("context")).agg(
                F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("back")
            )
            per_context = scratch.save(per_context, f"contexts{order}")
            shares = counts.withColumn("context", context).join(per_context, "context")
            shares = shares.select("gram", ((F.col("n") - discount) / F.col("total")).alias("share"))
            self.share[order] = scratch.save(shares, f"shares{order}")
            self.back[order] = per_context.select("context", "back")

    def log_probabilities(self, wanted: DataFrame, scratch: Scratch) -> DataFrame:
        """``key`` and ``logp`` (natural) for the distinct ``ORDER``-grams ``key`` of ``wanted``."""
        needed = {ORDER: wanted.select(F.col("key").alias("gram"))}
        for order in range(ORDER - 1, 0, -1):
            tail = F.col("gram").bitwiseAND((1 << (8 * order)) - 1)
            needed[order] = scratch.save(needed[order + 1].select(tail.alias("gram")).distinct(), f"needed{order}")
        lower = None
        for order in range(1, ORDER + 1):
            rows = needed[order].select(
                "gram",
                F.shiftright("gram", 8).alias("context"),
                F.col("gram").bitwiseAND((1 << (8 * (order - 1))) - 1).alias("tail"),
            )
            rows = rows.join(self.share[order], "gram", "left").join(self.back[order], "context", "left")
            if lower is None:
                rows = rows.withColumn("below", F.lit(1.0 / _SYMBOLS))
            else:
                rows = rows.join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("below")), "tail")
            p = F.coalesce("share", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("below")
            lower = scratch.save(rows.select("gram", p.alias("p")), f"p{order}")
        return lower.select(F.col("gram").alias("key"), F.log("p").cast("float").alias("logp"))


def _discounts(kinds: list[int]) -> tuple[float, float, float]:
    """Discounts for n-grams seen once, twice and more often, from how many were seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = kinds
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), most) for d, most in zip(found, (0.95, 1.9, 2.9), strict=True))


def perplexities(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ...) with ``n_bytes`` and ``perplexity`` (per byte) instead of the text.

    The model is trained on the column ``text`` of ``trusted``. A null text is empty; an empty text has the
    perplexity of its end alone.
    """
    model = Counts(count_grams(trusted), scratch)
    blocked, parts = with_blocks(docs, scratch)
    pairs = needed_keys(blocked, parts, lambda data, offsets: grams(data, offsets)[0], scratch, "pairs")
    table = model.log_probabilities(scratch.save(pairs.select("key").distinct(), "distinct"), scratch)
    kept = [c for c in docs.columns if c != "text"]

    def work(keys: np.ndarray, values: dict[str, np.ndarray], batches: Iterator) -> Iterator:
        import pyarrow as pa

        logp = values["logp"]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = []
            for a, b in in_runs(np.diff(offsets).tolist(), _TEXT_BYTES):
                need, ends = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total = np.concatenate(([0.0], np.cumsum(logp[np.searchsorted(keys, need)], dtype=np.float64)))
                found.append(np.exp(-np.diff(total[ends]) / np.diff(ends)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.diff(offsets)), pa.array(np.concatenate(found))],
                names=[*kept, "n_bytes", "perplexity"],
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_bytes long, perplexity double"
    return with_tables(blocked, parts, pairs.join(table, "key").select("block", "deal", "key", "logp"), work, schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = 0.995,
    margin: float = 1.0,
    least: int = 100,
    folds: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    scratch: Scratch | None = None,
) -> DataFrame:
    """``doc_id``, ``lang``, ``key`` (identity: id and text), ``n_bytes``, ``perplexity``, ``threshold``, ``kept`` per row.

    Trusted documents are those with quality 1 (the lowest label of an id holds). The model learns from those
    outside of fold 0 of their id; the threshold is ``margin`` times the ``quantile`` of the others' perplexity in
    the same language (null is a language) and size class (powers of 4 bytes), or in the language, whichever
    first has ``least`` documents, else over all; without any, all texts pass. Null and empty texts are rejected. Ids may be
    null (then never trusted) and rows may repeat. The result reads tables of ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id"))
    good = scratch.save(good.agg(F.min("quality").alias("q")).where("q = 1").select("__id"), "good")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.col(lang).cast("string").alias("lang"),
        row_key(F.col(doc_id), F.col(text)).alias("key"),
    )
    trusted = rows.where(F.col("text").isNotNull() & (doc_bucket(F.col("doc_id"), folds) != 0))
    trusted = trusted.join(small(good, 32), F.col("doc_id") == F.col("__id"), "left_semi")
    work = Scratch(docs.sparkSession)
    with text_batches(docs.sparkSession):
        found = scratch.save(perplexities(rows, trusted, work), "found")
    work.release()
    size_class = F.floor(F.log2(F.greatest("n_bytes", F.lit(1))) / 2).cast("int")
    found = found.withColumn("class", size_class)
    held = found.where((doc_bucket(F.col("doc_id"), folds) == 0) & (F.col("n_bytes") > 0))
    held = held.join(good, F.col("doc_id") == F.col("__id"), "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    enough = F.count(F.lit(1)) >= least

    def cuts(*by: str) -> DataFrame:
        table = held.groupBy(*by).agg(cut.alias("cut"), enough.alias("enough")).where("enough")
        return scratch.save(table.drop("enough"), "cuts_" + "_".join(by))

    by_class, by_lang = cuts("lang", "class"), cuts("lang")
    fallback = F.lit(held.agg(cut).first()[0]).cast("double")
    by_class = small(by_class.toDF("__l1", "__c1", "__cut1"), 64)
    by_lang = small(by_lang.toDF("__l2", "__cut2"), 64)
    joined = found.join(
        by_class, F.col("lang").eqNullSafe(F.col("__l1")) & (F.col("class") == F.col("__c1")), "left"
    ).join(by_lang, F.col("lang").eqNullSafe(F.col("__l2")), "left")
    threshold = (margin * F.coalesce("__cut1", "__cut2", fallback)).alias("threshold")
    out = joined.select("doc_id", "lang", "key", "n_bytes", "perplexity", threshold)
    passed = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.withColumn("kept", passed & (F.col("n_bytes") > 0))


def kept_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with their own columns."""
    scratch = Scratch(docs.sparkSession)
    found = classify(docs, labels, doc_id=doc_id, text=text, scratch=scratch, **options)
    gone = Scratch(docs.sparkSession).save(found.where("not kept").select("key").distinct(), "gone")
    scratch.release()
    return without(docs, gone, doc_id, text)
