"""Quality rules whose cutoffs are risk controlled, in DataFrame functions only.

Labelled documents are the holdout. For every rule (a ratio that is high in poor text), stratum and cutoff of
a fixed grid, the exact binomial tail says how likely so few good documents would be rejected if the true rate
of false rejection were above the limit. Cutoffs are tested from the loosest on and testing stops at the
first that fails (fixed sequence), and the error is shared among rules and strata (Bonferroni), so with
confidence ``1 - delta`` no certified cutoff rejects more than its limit of the good documents of its
stratum. Among the certified cutoffs the one that best separates the holdout is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, row_key, small, without, words

_WORD = f"[^{SPACE}]"
#: Rule: (numerator, denominator, grid steps per unit, last step). A ratio of last step / steps and above is one bin.
RULES = {
    "symbols": ("n_symbols", "word_chars", 50, 50),
    "dup_lines": ("n_dup_lines", "n_lines", 50, 50),
    "repeats": ("n_repeat_words", "n_words", 50, 50),
    "capitals": ("n_capitals", "word_chars", 50, 50),
    "word_length": ("word_chars", "n_words", 2, 100),
}


def text_features(df: DataFrame, text: str = "__text") -> DataFrame:
    """``df`` plus the counts that the rules use, over the whole text; null counts as empty.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_capitals``, ``n_lines`` and ``n_dup_lines`` (lines with a word),
    ``n_repeat_words`` (words inside 5-word windows that occur twice or more). Windows are told apart
    by 64-bit hashes; sorting them is left out where none occurs twice.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(value, "\n"), lambda line: line.rlike(_WORD))
    df = df.withColumns({"__words": words(F.col(text)), "__lines": with_word})
    hashes = F.transform("__words", lambda w, i: F.xxhash64(F.slice("__words", i + 1, 5)))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.regexp_replace(value, f"[{SPACE}]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(value, "[^#*$%&|<>]+", "")).cast("long"),
            "n_capitals": (F.length(value) - F.length(F.regexp_replace(value, r"\p{Lu}+", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__hashes": F.when(
                F.size("__words") > 5, F.slice(hashes, F.lit(1), F.greatest(F.size("__words") - 4, F.lit(0)))
            ),
        }
    ).drop("__words", "__lines")
    repeats = F.size("__hashes") > F.size(F.array_distinct("__hashes"))
    by_hash = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(repeats, by_hash)).drop("__hashes")

    def same(i: Column, j: Column) -> Column:
        return F.get("__sorted", i)["h"] == F.get("__sorted", j)["h"]

    twice = F.filter(
        "__sorted",
        lambda s, k: F.coalesce(same(k, k + 1), F.lit(False)) | F.coalesce(same(k, k - 1), F.lit(False)),
    )
    starts = F.array_sort(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + p + 5 - F.greatest(acc["end"], p)).alias("n"), (p + 5).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__sorted")


def _bins() -> Column:
    """Array of (rule, bin): the grid step of each rule's ratio, an empty denominator counting as step 0."""
    found = []
    for rule, (top, bottom, steps, last) in RULES.items():
        step = F.floor(F.col(top) * steps / F.greatest(F.col(bottom), F.lit(1)))
        found.append(F.struct(F.lit(rule).alias("rule"), F.least(step, F.lit(last)).cast("int").alias("bin")))
    return F.array(*found)


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!: exact up to 20, then Stirling's series (error below 1e-9)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), k <= n * p: the terms from k downwards until they vanish; 1 above that."""
    log_term = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    )
    reach = F.least(k, (40 * F.sqrt(n * p) + 100).cast("long"))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), reach),
        F.struct(F.exp(log_term).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def certified_cutoffs(
    features: DataFrame, labels: DataFrame, scratch: Scratch, limit: float = 0.05, delta: float = 0.05, price: float = 4.0
) -> DataFrame:
    """Rows ``stratum``, ``cutoffs`` (map from rule to the smallest rejected bin) from labelled documents.

    ``features`` has ``doc_id``, ``stratum``, ``base_failed`` and the counts; ``labels`` has ``doc_id`` and
    ``quality`` (1 good; with several labels the lowest holds; null ids and labels are left out). Documents
    that fail the base rule are no part of the holdout. Each rule may reject ``limit`` / rules of the good
    documents. ``price`` is what a good document rejected costs against a poor one. Strata too small to
    certify anything get no cutoff.
    """
    known = labels.where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = features.where("not base_failed").select("doc_id", "stratum", F.explode(_bins()).alias("b"))
    counts = (
        held.join(known, "doc_id")
        .groupBy("stratum", "b.rule", "b.bin")
        .agg(
            F.sum((F.col("quality") == 1).cast("long")).alias("good"),
            F.sum((F.col("quality") != 1).cast("long")).alias("poor"),
        )
    )
    counts = scratch.save(counts, "counts")
    # Every cutoff of the grid is tested, those between two filled bins too, so the sequence is fixed.
    grid = F.array(
        *[F.struct(F.lit(rule).alias("rule"), F.lit(last).alias("last")) for rule, (_, _, _, last) in RULES.items()]
    )
    strata = counts.select("stratum").distinct()
    cells = strata.select("stratum", F.explode(grid).alias("g")).select(
        "stratum", "g.rule", F.explode(F.sequence(F.lit(1), F.col("g.last"))).alias("bin")
    )
    zero = F.lit(0).cast("long")
    every = (
        cells.select("stratum", "rule", "bin", zero.alias("good"), zero.alias("poor"))
        .unionAll(counts.select("stratum", "rule", "bin", "good", "poor"))
        .groupBy("stratum", "rule", "bin")
        .agg(F.sum("good").alias("good"), F.sum("poor").alias("poor"))
    )
    group = Window.partitionBy("stratum", "rule")
    loose = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    each, tests = limit / len(RULES), len(RULES)
    tested = (
        every.select(
            "*",
            F.sum("good").over(loose).alias("k"),
            F.sum("poor").over(loose).alias("caught"),
            F.sum("good").over(group).alias("n"),
            F.sum("poor").over(group).alias("n_poor"),
        )
        .where("bin >= 1")
    )
    tail = binomial_tail(F.col("k"), F.col("n"), each) * (strata.count() * tests)
    passed = tested.withColumn("tail", tail).withColumn("worst", F.max("tail").over(loose)).where(F.col("worst") <= delta)
    gain = F.col("caught") / F.greatest("n_poor", F.lit(1)) - price * F.col("k") / F.greatest("n", F.lit(1))
    best = passed.groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), "bin")).alias("best"))
    used = best.where("best.gain > 0")
    entries = F.collect_list(F.struct("rule", F.col("best.bin").alias("bin")))
    return used.groupBy("stratum").agg(F.map_from_entries(F.array_sort(entries)).alias("cutoffs"))


#: More strata than this are joined by shuffle instead of broadcast.
_BROADCAST_STRATA = 10_000


def judged(
    docs: DataFrame,
    labels: DataFrame,
    limit: float = 0.05,
    delta: float = 0.05,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Counts of :func:`text_features` with ``doc_id``, ``stratum``, ``base_failed``, ``kept`` and ``key`` per row of ``docs``.

    A document fails the base rule with fewer than 10 words or more than 20 % repeated words; others are
    rejected when one rule's ratio reaches its stratum's certified cutoff. ``key`` is the row's identity (id and
    text). Null texts are empty, null ids are kept and have no label, a null stratum is a stratum of its
    own. Repeated rows are judged alike. Without labels only the base rule rejects. The result reads tables of
    ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        F.col(text).alias("__text"),
        row_key(F.col(doc_id), F.col(text)).alias("key"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = scratch.save(text_features(base).drop("__text").withColumn("base_failed", failed), "features")
    labels = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    cutoffs = scratch.save(certified_cutoffs(found, labels, scratch, limit, delta), "cutoffs")
    table = small(cutoffs.withColumnRenamed("stratum", "__stratum"), 2_000)
    joined = found.join(table, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    over = F.exists(_bins(), lambda b: b["bin"] >= F.try_element_at(F.col("cutoffs"), b["rule"]))
    kept = ~F.col("base_failed") & ~F.coalesce(over, F.lit(False))
    return joined.withColumn("kept", kept).drop("__stratum", "cutoffs")


def kept_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with their own columns."""
    scratch = Scratch(docs.sparkSession)
    found = judged(docs, labels, doc_id=doc_id, text=text, scratch=scratch, **options)
    gone = Scratch(docs.sparkSession).save(found.where("not kept").select("key").distinct(), "gone")
    scratch.release()
    return without(docs, gone, doc_id, text)
