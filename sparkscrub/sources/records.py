"""CSV records with line breaks in quotes, cut by as many tasks as the files have blocks.

Whether a line break ends a record depends on the quotes before it, from the start of the file. An even number
leaves the quotes closed, so the parity of the quotes of each block is enough: one pass counts them, the parities
before each block follow from these few numbers, and a second pass joins the lines of a record in every
block on its own. Records that go over the end of a block come out in fragments, which are joined last.

That is exact where quotes stand where they belong: around whole cells, doubled inside. If every record found is
such a record, any reader ends the first record, and hence all others, at the same places. A file for which this
does not hold is left to Spark's reader, with one task per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lookup import materialize

# What a row of a block is: a whole record, the end of one begun earlier, the beginning of one, lines inside of one.
_WHOLE, _HEAD, _TAIL, _INSIDE = 0, 1, 2, 3
_UNKNOWN = -1
_ATTEMPTS = 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` (without the carriage return of a Windows line end), ``file``, ``start`` of the block, ``block`` (its hash)."""
    value = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    where = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        value.alias("value"), where[0].alias("file"), where[1].alias("start"), F.xxhash64(*where).alias("block")
    )


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, '"', ""))


class QuoteCounts:
    """What one pass finds out about the blocks of the files: a few numbers per block (128 MB by default)."""

    def __init__(self, spark: SparkSession, path: str):
        odd = F.coalesce(_quotes(F.col("value")) % 2 == 1, F.lit(False))
        blocks = _lines(spark, path).groupBy("file", "start", "block")
        found = blocks.agg(
            F.bit_xor(odd.cast("int")).alias("parity"),
            F.bool_or(odd).alias("open"),
            F.bool_or(F.contains("value", F.lit("\r"))).alias("returns"),
            F.bool_or(F.contains("value", F.lit('"'))).alias("quotes"),
        ).collect()
        #: Do carriage returns stand inside of lines? They end lines for some readers.
        self.stray_returns = any(row["returns"] for row in found)
        quotes = any(row["quotes"] for row in found)
        #: May line breaks stand in quotes? Then a line has an odd number of quotes, or carriage returns hide it.
        self.any_open = any(row["open"] for row in found) or self.stray_returns and quotes
        #: By block: do quotes opened before it go on in it?
        self.opens: dict[int, int] = {}
        #: By block: the block in which the record that is open at its start began (its own start if none is).
        self.begun: dict[int, int] = {}
        file, parity, begun = None, 0, 0
        for row in sorted(found, key=lambda row: (row["file"], row["start"])):
            parity = parity if row["file"] == file else 0
            file = row["file"]
            self.opens[row["block"]] = parity
            self.begun[row["block"]] = begun if parity else row["start"]
            # A block with an odd line ends the record it begins with; what is open at its end began in it.
            if row["open"] or not parity:
                begun = row["start"]
            parity ^= row["parity"]


def _cut(lines: DataFrame, opens) -> DataFrame:
    """Rows ``record``, ``file``, ``begun``, ``start``, ``kind``, ``first`` (begins with the first line of its file).

    ``begun`` tells where the block starts in which the record begins.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = opens.value
        state = {"block": None, "inside": 0, "kind": _WHOLE, "first": False, "held": []}

        def out(records, kinds, firsts, batch, at: int):
            n, start = len(records), batch.column("start")[at].as_py()
            begun = np.where(np.isin(kinds, (_HEAD, _INSIDE)), state.get("begun", start), start)
            return pa.RecordBatch.from_arrays(
                [
                    records.cast(pa.string()),
                    pa.array([batch.column("file")[at].as_py()] * n, pa.string()),
                    pa.array(begun, pa.int64()),
                    pa.array([start] * n, pa.int64()),
                    pa.array(kinds, pa.int32()),
                    pa.array(firsts, pa.bool_()),
                ],
                names=["record", "file", "begun", "start", "kind", "first"],
            )

        def joined(parts: list, ends: list[int]):
            values = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
            lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)
            return pc.binary_join(lists, "\n")

        def rest():
            """The lines that the end of the block leaves without an end of their record."""
            if state["held"]:
                batch, at = state["where"]
                kind = _INSIDE if state["kind"] == _HEAD else _TAIL
                record = joined(state["held"], [sum(map(len, state["held"]))])
                yield out(record, [kind], [state["first"] and kind == _TAIL], batch, at)

        for batch in batches:
            block = np.asarray(batch.column("block"))
            edges = np.flatnonzero(np.diff(block, prepend=~block[:1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
                values = batch.column("value").slice(a, b - a)
                if block[a] != state["block"]:
                    yield from rest()
                    found, start = known.get(int(block[a])), batch.column("start")[a].as_py()
                    if found is None:
                        yield out(pa.array([""]), [_UNKNOWN], [False], batch, a)
                    inside, begun = found or (0, start)
                    state = {"block": block[a], "inside": inside, "kind": _HEAD if inside else _WHOLE, "first": start == 0, "held": []}
                    state["begun"] = begun
                state["where"] = batch, a
                odd = np.asarray(pc.count_substring(values, '"')) & 1
                after = (state["inside"] + np.cumsum(odd)) & 1
                ends = np.flatnonzero(after == 0) + 1
                state["inside"] = int(after[-1])
                if len(ends) == 0:
                    state["held"].append(values)
                    continue
                before = sum(map(len, state["held"]))
                records = joined([*state["held"], values.slice(0, int(ends[-1]))], (ends + before).tolist())
                kinds, firsts = np.full(len(ends), _WHOLE, np.int32), np.zeros(len(ends), bool)
                kinds[0] = state["kind"]
                if state["first"]:
                    # Blank lines before the names are no records.
                    named = np.flatnonzero(np.asarray(pc.binary_length(records)) > 0)
                    if len(named):
                        firsts[named[0]], state["first"] = True, False
                state["kind"] = _WHOLE
                left = values.slice(int(ends[-1]))
                state["held"] = [left] if len(left) else []
                yield out(records, kinds, firsts, batch, a)
        yield from rest()

    return lines.mapInArrow(run, "record string, file string, begun long, start long, kind int, first boolean")


def _stitched(cut: DataFrame) -> DataFrame:
    """Records that go over the ends of blocks: their fragments, at most two per block, name the block they begin in,
    so that every record is joined on its own."""
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    fragments = cut.where(F.col("kind") > _WHOLE).groupBy("file", "begun")
    joined = fragments.agg(parts.alias("parts"), F.bool_or("first").alias("first"))
    return joined.select(F.concat_ws("\n", F.col("parts.record")).alias("record"), "file", "first")


def _is_strict(record: Column) -> Column:
    """Do quotes stand around whole cells only, doubled inside of them?"""
    pieces = F.split(record, '"', -1)
    last = F.size(pieces) - 1

    def misplaced(piece: Column, i: Column) -> Column:
        # Pieces with an even number are outside of quotes, or empty between two quotes that stand for one.
        begins = (i == 0) | piece.startswith(",")
        ends = (i == last) | piece.endswith(",")
        return (i % 2 == 0) & (piece != "") & ~(begins & ends)

    wrong = F.exists(F.transform(pieces, misplaced), lambda found: found)
    return F.when(F.contains(record, F.lit('"')), (last % 2 == 0) & ~wrong).otherwise(F.lit(True))


def quoted_records(spark: SparkSession, path: str, counts: QuoteCounts) -> DataFrame | None:
    """Rows ``record``, ``file``, ``first``: the records of CSV files, written to the shared folder once.

    None if the files' quotes do not allow it. Blank lines are no records; a Windows line end inside quotes is a
    line break. Should the files be cut into other blocks than when the quotes were counted (executors came
    or went), both passes are made again.
    """
    for attempt in range(_ATTEMPTS):
        if attempt:
            counts = QuoteCounts(spark, path)
        if counts.stray_returns:
            return None
        # Three numbers per block.
        opens = spark.sparkContext.broadcast({block: (counts.opens[block], counts.begun[block]) for block in counts.opens})
        cut = materialize(_cut(_lines(spark, path), opens))
        whole = cut.where(F.col("kind") == _WHOLE).select("record", "file", "first")
        records = whole.unionAll(_stitched(cut)).where("record <> ''")
        unknown = cut.agg(F.coalesce(F.bool_or(F.col("kind") == _UNKNOWN), F.lit(False))).first()[0]
        if unknown:
            continue
        strict = records.agg(F.coalesce(F.bool_and(_is_strict(F.col("record"))), F.lit(True))).first()[0]
        return records if strict else None
    return None
