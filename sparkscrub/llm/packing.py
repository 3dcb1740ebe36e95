"""Best-fit packing of token pieces into fixed-length sequences through a configuration linear program.

A configuration is a multiset of piece lengths that fits into one sequence. The program asks for the
fewest configurations that use up the histogram of lengths. It is solved by multiplicative weights: every
length has a weight, a knapsack dynamic program finds the configurations of greatest weight, these are
used for a share of what is left of their lengths, and lengths that were served lose weight. Steps
are whole numbers of sequences, so rounding is only needed for what is left, which is packed best fit,
longest first. All of this depends on the histogram (at most one entry per length), not on the rows;
rows take their places by their rank among the pieces of the same length.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, giving_back, hand_back, kept, ranked, text_batches

Config = tuple[tuple[int, int], ...]


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total value for each capacity with any number of each length, and the length to take (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            found = best[c - lengths[:k]] + value[:k]
            i = int(found.argmax())
            if found[i] > best[c] + 1e-12:
                best[c], take[c] = found[i], lengths[i]
    return best, take


def solve_configurations(
    histogram: dict[int, int], capacity: int, rounds: int = 48, share: float = 0.3, rate: float = 1.0
) -> list[tuple[Config, int]]:
    """Configurations and how many sequences use each; together they use up ``histogram`` exactly.

    ``rounds`` bounds the knapsack programs, ``share`` is the part of a length's rest that one step may
    use, ``rate`` the strength of the weights. At most ``rounds`` configurations per length come out,
    besides those of the final best fit, whatever the counts are. Rounding keeps the steps of as many rounds
    as give the fewest sequences once the rest is packed best fit.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan: list[tuple[Config, int]] = []
    if left[capacity]:
        plan.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    total = np.maximum(left, 1)
    weight = np.ones(capacity + 1)
    slack = 0
    ends = [(len(plan), left.copy())]
    for _ in range(rounds):
        lengths = np.flatnonzero(left)
        if len(lengths) == 0 or slack > capacity // 64:
            break
        _, take = _knapsack(lengths, lengths / capacity * weight[lengths], capacity)
        served, used = np.zeros(capacity + 1), 0
        for first in lengths[::-1].tolist():
            config, room = {first: 1}, capacity - first
            while room > 0:
                # Where the best filling leaves room unused, the table repeats the next smaller capacity.
                item = int(take[room])
                if item == 0:
                    room -= 1
                    continue
                config[item] = config.get(item, 0) + 1
                room -= item
            fill = sum(length * n for length, n in config.items())
            if capacity - fill > slack:
                continue
            times = min(int(left[length]) // n for length, n in config.items())
            times = min(times, max(1, int(left[first] * share)))
            if times <= 0:
                continue
            for length, n in config.items():
                left[length] -= n * times
                served[length] += n * times
            used += times
            plan.append((tuple(sorted(config.items(), reverse=True)), times))
        weight *= np.exp(-rate * served / total)
        ends.append((len(plan), left.copy()))
        if used < max(1, left.sum() // 200):
            slack = max(1, 2 * slack)
    ends = ends[:: max(1, len(ends) // 12)] + ends[-1:]
    best = None
    for steps, rest in ends:
        found = plan[:steps] + _best_fit(rest, capacity)
        if best is None or sum(t for _, t in found) <= sum(t for _, t in best):
            best = found
    return best


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Best fit, longest first, for runs of equal pieces and runs of equal sequences."""
    runs: dict[int, list[tuple[Config, int]]] = {}  # free room: sequences in use
    rooms: list[int] = []

    def put(room: int, config: Config, times: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((config, times))

    for length in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[length])
        while rest:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(rest, capacity // length)
                times = rest // each
                put(capacity - each * length, ((length, each),), times)
                rest -= each * times
                continue
            room = rooms[at]
            config, times = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[at]
            each = min(rest, room // length)
            now = min(times, rest // each)
            if now < times:
                put(room, config, times - now)
            put(room - each * length, (*config, (length, each)), now)
            rest -= each * now
    return [run for room in runs.values() for run in room]


def placement(plan: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """Arrays by (length, first rank): where the pieces of a length from that rank on are placed."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in plan:
        offset = 0
        for length, each in config:
            first = used.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            used[length] = first + each * times
            offset += length * each
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


#: How a known vocabulary file cuts words into pieces, and the same for words of simple characters: visible ASCII ones
#: and lower-case letters up to U+024F, which no normaliser changes and all versions of Unicode take for letters.
_CUT = [
    {
        "type": "Split",
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_LETTER = r"a-z\u00df-\u00f6\u00f8-\u024f"
_SIMPLE = re.compile(f"[!-@\\[-~{_LETTER}]+")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^0-9{_LETTER}]+")


class _Words:
    """Token ids of words as little-endian bytes, remembered up to a bound.

    The vocabulary file drops white space, so no token spans two words and the ids of a text are those of its
    words one after the other. Words that its normaliser would not change go to a copy without one,
    which is several times faster; A to Z are lowered here unless the text may hold a special token. Words of simple
    characters are cut here if the file does so by ``_CUT``, and their pieces given to its model.
    """

    def __init__(self, path: str, remember: int):
        from tokenizers import Tokenizer, models

        self.whole = whole = Tokenizer.from_file(path)
        shell = Tokenizer(models.BPE())  # what stands before the model, without its vocabulary: that is large as JSON
        shell.normalizer, shell.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        definition = json.loads(shell.to_str())
        kinds = [n["type"] for n in (definition["normalizer"] or {}).get("normalizers", [])]
        self.lowers = kinds == ["NFC", "Replace", "Lowercase"]
        self.added = [token.content for token in whole.get_added_tokens_decoder().values()]
        self.plain = whole
        if self.lowers:
            self.plain = Tokenizer(whole.model)
            self.plain.pre_tokenizer = whole.pre_tokenizer
            if whole.truncation:
                self.plain.enable_truncation(**whole.truncation)
            if whole.padding:
                self.plain.enable_padding(**whole.padding)
        self.remember, self.known = remember, {}
        cut = (definition["pre_tokenizer"] or {}).get("pretokenizers")
        special = all("<|" in content for content in self.added)
        self.cuts = self.lowers and special and cut == _CUT and isinstance(whole.model, models.BPE)
        last = max(whole.get_vocab().values(), default=-1)
        self.bytes_of = [i.to_bytes(4, "little") for i in range(last + 1)] if self.cuts else []
        self.tokenize = self.plain.model.tokenize
        # The character that stands for each byte: visible ones for themselves, the others from 256 on.
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(256, 512))
        self.shown = "".join(chr(b if b in shown else next(hidden)) for b in range(256))

    def _encode_simple(self, text: str) -> bytes:
        tokenize, bytes_of = self.tokenize, self.bytes_of
        if not text.isascii():
            pieces = [codecs.charmap_decode(p.encode(), "strict", self.shown)[0] for p in _PIECE.findall(text)]
        else:
            pieces = [text] if text.isalpha() else _PIECE.findall(text)
        return b"".join([bytes_of[token.id] for piece in pieces for token in tokenize(piece)])

    def _encode_new(self, words: list[bytes]) -> None:
        plain, whole = [], []
        for word in words:
            text = word.decode()
            if self.cuts and "<|" not in text and _SIMPLE.fullmatch(text) and text == text.lower():
                self.known[word] = self._encode_simple(text)
                continue
            stays = text.isprintable() and text == text.lower() and unicodedata.is_normalized("NFC", text)
            stays = stays and not any(content in text for content in self.added)  # only the whole one knows them
            (plain if stays else whole).append((word, text))
        for tokenizer, part in ((self.plain, plain), (self.whole, whole)):
            for k in range(0, len(part), 4096):
                some = part[k : k + 4096]
                encoded = tokenizer.encode_batch_fast([text for _, text in some], add_special_tokens=False)
                self.known.update((w, np.array(e.ids, "<u4").tobytes()) for (w, _), e in zip(some, encoded, strict=True))

    def encode(self, text: str) -> bytes:
        data = text.encode()
        if self.lowers and b"<|" not in data:
            data = data.lower()
        words = data.split()
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            new = {w for w, ids in zip(words, found, strict=True) if ids is None}
            if len(known) + len(new) > self.remember:
                known.clear()
                new = set(words)
            self._encode_new(list(new))
            found = list(map(known.get, words))
        return b"".join(found)


def _words(path: str, remember: int) -> _Words:
    """One per worker process, so that its tasks share what it remembers; later stages' tasks drop it."""

    def make() -> _Words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = _Words(path, remember)
        hand_back()  # of what was read to make it
        return words

    return kept(("words", path, remember), make)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    remember: int = 800_000,
) -> DataFrame:
    """Pieces of each document: its ids and the end id, cut every ``capacity`` ids.

    ``tokenizer`` is the path of a vocabulary file whose tokens do not span white space, present on
    every machine; ``remember`` bounds the words a worker keeps. Columns: ``doc_id``, ``piece``, ``start``,
    ``length``, ``ids_crc32``. A null text is empty (one piece, the end id); a null id stays null.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    end, names = np.array([end_id], "<u4").tobytes(), schema.names

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = _words(tokenizer, remember)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = words.encode(value.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4)
                    length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                names=names,
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(giving_back(cut, keeps=True), schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    remember: int = 800_000,
) -> DataFrame:
    """Every document's pieces placed in sequences of at most ``capacity`` tokens, as few as possible.

    Columns of :func:`token_pieces` plus ``sequence_id`` and ``offset``. Only documents above
    ``capacity`` tokens are cut. Null and empty texts are one piece each; repeated rows are packed each on its own;
    pieces of equal length are interchangeable. An empty table gives an empty result.

    The histogram of lengths reaches the driver (one row per length, ``capacity`` at most); the plan that is
    broadcast has a bound of its own (see :func:`solve_configurations`). ``remember`` bounds the words whose ids a
    worker keeps (about 200 bytes each).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with text_batches(spark):
        pieces = scratch.save(token_pieces(docs, tokenizer, capacity, end_id, doc_id, text, remember), "pieces")
    histogram = {row[0]: row[1] for row in pieces.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(placement(solve_configurations(histogram, capacity)))
    placed = ranked(pieces, ["length"], ["doc_id", "piece"], "__rank", scratch)
    schema = T.StructType(
        [
            *pieces.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    names = pieces.columns

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = plan.value
        key = (table["length"] << 48) + table["first"]
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("__rank"))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            past = rank - table["first"][at]
            sequence = table["sequence"][at] + past // table["each"][at]
            offset = table["offset"][at] + past % table["each"][at] * length
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return placed.mapInArrow(giving_back(place), schema)
