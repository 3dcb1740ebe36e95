"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A source whose target is at least its size gives whole
copies of all its documents first; the rest of the target is a sample without replacement. In it a
document's inclusion probability grows with its size class, documents are ranked by the odds of a random
number divided by the odds of inclusion, and the sample is the head of that ranking that holds the
target number of words. The random numbers are hashes of the document, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, n_words, small_table, uniform

# The ranking is cut by four passes over 2**13 ranges each: 52 bits of the ranking number.
_STEP, _BITS = 13, 52


def cycling_weights(sources: Iterable[str | None], cycle: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights by the sources' code point order, null last, repeating ``cycle``."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(ordered)}


def shared_targets(
    sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float
) -> dict[str | None, float]:
    """``total`` shared by weight; no target above ``most`` times its source's size, the excess reshared by weight."""
    open_, left, targets = {s for s in sizes if weights[s] > 0}, float(total), dict.fromkeys(sizes, 0.0)
    while open_:
        weight = math.fsum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight >= most * sizes[s]}
        if not full:
            return targets | {s: left * weights[s] / weight for s in open_}
        targets |= {s: most * sizes[s] for s in full}
        left -= math.fsum(most * sizes[s] for s in full)
        open_ -= full
    return targets


def _scale(classes: list[tuple[int, int]], want: float) -> float:
    """``c`` with sum of words * min(1, c * 2**class) = ``want``; classes: (size class, its words)."""
    certain = 0
    for cls, held in sorted(classes, reverse=True):
        open_ = sum(w * 2.0**k for k, w in classes if k <= cls)
        c = (want - certain) / open_ if open_ else 0.0
        if c * 2.0**cls < 1:
            return max(c, 0.0)
        certain += held
    return math.inf


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    weights: Callable[[Iterable[str | None]], dict[str | None, float]] = cycling_weights,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """How many copies of each document the mix takes.

    Columns: ``__row`` (the input row as a struct, so no name clashes), ``size``, ``source_size``,
    ``target`` (its source's), ``copies`` and ``taken`` (words taken, repeats counted). ``size`` defaults to
    the words of the text; null and empty texts have size 0 and none of their words can be taken. A null
    source is a source. Rows equal in id and text are ranked alike and taken or left together; rows with
    ties in the ranking too. Each source's taken words differ from its target by half of the rows at the
    cut at most. Null ids are allowed. An empty table gives an empty result.

    Per-source totals by size class (64 at most) and one range of the ranking at a time reach the
    driver: their number depends on the sources, not on the documents.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = n_words(F.col(text)) if size is None else size.cast("long")
    base = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"),
        F.col(source).cast("string").alias("source"),
        size.alias("size"),
        uniform(F.lit(seed), F.col(doc_id).cast("string"), F.xxhash64(F.col(text))).alias("u"),
    )
    narrow = scratch.save(base.drop("__row"), "sizes")
    size_class = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    by_class = narrow.groupBy("source", size_class.alias("class")).agg(F.sum("size").alias("words")).collect()
    sizes: dict[str | None, int] = {}
    classes: dict[str | None, list[tuple[int, int]]] = {}
    for name, cls, held in by_class:
        sizes[name] = sizes.get(name, 0) + held
        classes.setdefault(name, []).append((cls, held))
    targets = shared_targets(sizes, weights(sizes), share * sum(sizes.values()), most)
    plan = []
    for name, target in targets.items():
        whole = int(target // sizes[name]) if sizes[name] else 0
        rest = target - whole * sizes[name]
        plan.append((name, sizes[name], target, whole, rest, _scale(classes[name], rest) if rest > 0 else 0.0))
    numbers = {"source_size": pa.int64(), "target": pa.float64(), "whole": pa.int32(), "rest": pa.float64(), "scale": pa.float64()}
    per_source = small_table(spark, plan, pa.schema({"source": pa.string()} | numbers))

    # The ranking number q = odds(u) / odds(inclusion), as q / (1 + q) on a 52-bit scale; certain: 0.
    inclusion = F.least(F.lit(1.0), F.col("scale") * F.pow(F.lit(2.0), size_class))
    odds = F.col("u") / (1 - F.col("u")) * (1 - inclusion) / inclusion
    place = F.when(inclusion >= 1, 0).when(inclusion <= 0, 2**_BITS - 1)
    place = place.otherwise(F.least(F.floor(odds / (1 + odds) * 2.0**_BITS), F.lit(2**_BITS - 1))).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(per_source.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source")))
        return joined.withColumn("place", place)

    ranks = scratch.save(placed(narrow).select("source", "size", "place").where("rest > 0 and size > 0"), "ranks")
    cuts = _cuts(ranks, {p[0]: p[4] for p in plan if p[4] > 0})
    scratch.release()
    found = small_table(spark, cuts.items(), pa.schema({"cut_source": pa.string(), "cut": pa.int64()}))
    out = placed(base).join(F.broadcast(found), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    chosen = F.coalesce((F.col("place") <= F.col("cut")) & (F.col("size") > 0), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + chosen.cast("int")).otherwise(0).alias("copies")
    taken = (F.col("size") * copies).cast("long").alias("taken")
    return out.select("__row", "size", "source_size", "target", copies, taken)


def _cuts(ranks: DataFrame, wanted: dict[str | None, float]) -> dict[str | None, int]:
    """Per source the last place to take, so that the words up to it come nearest to those wanted.

    Each pass sums the words in 2**13 ranges of places per source and goes on inside the range that the
    wanted number falls into, until ranges are single places.
    """
    import pyarrow as pa

    spark = ranks.sparkSession
    low = dict.fromkeys(wanted, 0)
    held = dict.fromkeys(wanted, 0)
    cut: dict[str | None, int] = {}
    for shift in range(_BITS - _STEP, -1, -_STEP):
        if not low:
            break
        start = small_table(spark, low.items(), pa.schema({"low_source": pa.string(), "low": pa.int64()}))
        bins = (
            ranks.join(F.broadcast(start), F.col("source").eqNullSafe(F.col("low_source")))
            .where(F.shiftright(F.col("place") - F.col("low"), shift).between(0, 2**_STEP - 1))
            .groupBy("source", F.shiftright(F.col("place") - F.col("low"), shift).alias("bin"))
            .agg(F.sum("size").alias("words"), F.min("place").alias("first"), F.max("place").alias("last"))
        )
        by_source: dict[str | None, list] = {}
        for name, at, total, first, last in bins.collect():
            by_source.setdefault(name, []).append((at, total, first, last))
        for name in list(low):
            for at, total, first, last in sorted(by_source.get(name, [])):
                if held[name] + total < wanted[name]:
                    held[name] += total
                    cut[name] = last
                    continue
                if first == last or shift == 0:  # one place: take it if that comes nearer
                    if held[name] + total - wanted[name] <= wanted[name] - held[name]:
                        cut[name] = last
                    del low[name]
                else:
                    low[name] += at << shift
                break
            else:
                del low[name]  # all of it is wanted
    return {name: place for name, place in cut.items()}


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each input row as often as it is taken. Rows of size 0 are not taken."""
    mixed = mix(docs, **options).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("__row", F.col("copies"))).alias("__row")).select("__row.*")
