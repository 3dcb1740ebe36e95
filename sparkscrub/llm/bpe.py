"""Byte-level BPE of a whole corpus through a table of its distinct words.

A text is cut into words by the vocabulary file's own rule, and a word's ids do not depend on its neighbours. So
every distinct word is encoded once, for the whole corpus, and the ids are joined back by position:

1. Documents belong to blocks of neighbouring rows. Each block lists its distinct words by word bucket.
2. A bucket sees every list of its words, encodes each word when it is met first, and answers each block.
3. A block's answers meet its texts in one shuffle; each word's position takes the ids of its word.

Lists, answers and texts travel as compressed runs, one row for many words or documents. Decoding gathers the
piece of each id from the vocabulary, whose size bounds that table whatever the corpus.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, with_blocks
from .common import Scratch, giving_back, in_runs, partitions, utf8

#: Bytes of text worked on, or squeezed into one row of the shuffle, at once.
_RUN_BYTES = 2 << 20
#: Words that a task holds before it writes its lists, or that a bucket remembers, at most.
_HELD_WORDS, _KNOWN_WORDS = 300_000, 1_000_000
#: Characters below this are told apart by a pattern, texts with others by the vocabulary's own rule.
_PLAIN = 0x2500


@cache
def _byte_of() -> dict[str, int]:
    """The character that stands for each byte: visible ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Words, ids and pieces of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        whole = Tokenizer.from_file(path)
        definition = json.loads(whole.to_str())
        rule = definition["pre_tokenizer"] or {}
        if rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex"):
            raise ValueError(f"{path} does not cut texts into byte-level words")
        if definition["normalizer"] is not None or definition["model"]["type"] != "BPE":
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        self.special = {}
        for token in definition["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"{path} has special tokens that depend on their neighbours")
            self.special[token["content"]] = token["id"]
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self._rule = whole.pre_tokenizer
        self._pattern = self._as_pattern()
        bare = definition | {"added_tokens": [], "pre_tokenizer": rule | {"use_regex": False}, "post_processor": None}
        bare |= {"truncation": None, "padding": None}
        self._bare = Tokenizer.from_str(json.dumps(bare))
        self._vocab = whole.get_vocab(with_added_tokens=True)

    def _as_pattern(self) -> re.Pattern:
        """The vocabulary's rule for texts of plain characters, whose kinds are asked of the rule itself."""

        def one(text: str) -> bool:
            return len(self._rule.pre_tokenize_str(text)) == 1

        kinds: dict[str, list[str]] = {"letter": [], "number": [], "space": []}
        for c in map(chr, range(_PLAIN)):
            if one("a" + c):
                kinds["letter"].append(c)
            elif one("1" + c):
                kinds["number"].append(c)
            elif not one("!" + c):
                kinds["space"].append(c)
        letter, number, space = ("".join(map(re.escape, kinds[k])) for k in ("letter", "number", "space"))
        # The order of the alternatives is the file format's: endings, letters, numbers, others, white space.
        return re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+"
        )

    def _words(self, text: str) -> list[str]:
        if text.isascii() or max(text) < chr(_PLAIN):
            return self._pattern.findall(text)
        return [text[a:b] for _, (a, b) in self._rule.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Words of the text up to each special token and that token's id; None at the end."""
        if self._special is None or not any(token in text for token in self.special):
            yield self._words(text), None
            return
        cut = self._special.split(text)
        for i in range(0, len(cut), 2):
            yield self._words(cut[i]) if cut[i] else [], self.special[cut[i + 1]] if i + 1 < len(cut) else None

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words as little-endian bytes."""
        found = []
        for k in range(0, len(words), 4096):
            encoded = self._bare.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)
            found += [np.array(e.ids, "<u4").tobytes() for e in encoded]
        return found

    def pieces(self) -> dict[int, bytes]:
        """The bytes that each id stands for; a token with other characters stands for its own text."""
        byte_of = _byte_of()
        return {
            i: bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
            for token, i in self._vocab.items()
        }


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


def _squeeze(parts: list[bytes]) -> bytes:
    import zstandard

    sizes = np.array(list(map(len, parts)), "<u4").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(sizes + b"".join(parts))


def _loose(data: bytes, n: int) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = (4 * n + np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends)]


def encode(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """Rows ``doc_id``, ``ids``: the ids of every whole text as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a byte-level BPE file, present on every machine; ids are those of its library without
    added special tokens, while special tokens spelled in a text are found as the library finds them. A null
    text is empty and has no ids; a null id stays null; repeated rows are encoded each on its own; an empty table
    gives an empty result. Only the two named columns are read, so others may have any name.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocked, n_parts = with_blocks(rows, scratch, BLOCK_BYTES)
    # Lists shrink as buckets grow in number, so both grow with the root of the corpus.
    n_buckets = max(4 * partitions(spark), math.isqrt(n_parts) * 8)

    def lists(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = vocabulary(tokenizer)
        held: dict[tuple[int, int], set[str]] = {}

        def out():
            for (block, deal), found in held.items():
                dealt: dict[int, list[bytes]] = {}
                for word in sorted(word.encode() for word in found):
                    dealt.setdefault(zlib.crc32(word) % n_buckets, []).append(word)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(dealt), pa.int32()),
                        pa.array([block] * len(dealt), pa.int64()),
                        pa.array([deal] * len(dealt), pa.int32()),
                        pa.array([len(some) for some in dealt.values()], pa.int32()),
                        pa.array([_squeeze(some) for some in dealt.values()], pa.binary()),
                    ],
                    names=["bucket", "block", "deal", "n", "words"],
                )
            held.clear()

        for batch in batches:
            block, deal = batch.column("block").to_pylist(), batch.column("deal").to_pylist()
            for i, value in enumerate(batch.column("text")):
                known = held.setdefault((block[i], deal[i]), set())
                for part, _ in words.parts(value.as_py() or ""):
                    known.update(part)
                if i % 64 == 0 and sum(map(len, held.values())) > _HELD_WORDS:
                    yield from out()
        yield from out()

    def answers(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = vocabulary(tokenizer)
        bucket, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket or len(known) > _KNOWN_WORDS:
                    bucket, known = row["bucket"], {}
                some = _loose(row["words"], row["n"])
                new = [word for word in some if word not in known]
                known.update(zip(new, words.encode_words([word.decode() for word in new]), strict=True))
                found = _squeeze([*some, *map(known.__getitem__, some)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()),
                        pa.array([row["deal"]], pa.int32()),
                        pa.array([row["n"]], pa.int32()),
                        pa.array([found], pa.binary()),
                    ],
                    names=["block", "deal", "n", "data"],
                )

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            block = np.asarray(batch.column("block"))
            edges = np.flatnonzero(np.diff(block, prepend=~block[:1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
                part = batch.slice(a, b - a)
                rows = part.select(["doc_id", "text"])
                for i, j in in_runs(np.diff(utf8(part.column("text"))[1]).tolist(), _RUN_BYTES):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema) as stream:
                        stream.write_batch(rows.slice(i, j - i))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("block").slice(i, 1),
                            part.column("deal").slice(i, 1),
                            pa.array([-1], pa.int32()),
                            pa.array([compress(sink.getvalue())], pa.binary()),
                        ],
                        names=["block", "deal", "n", "data"],
                    )

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        words = vocabulary(tokenizer)
        special = {i: np.array([i], "<u4").tobytes() for i in words.special.values()}
        block, known = None, {}

        def ids(text: str) -> bytes:
            out = []
            for part, token in words.parts(text):
                out += map(known.__getitem__, part)
                if token is not None:
                    out.append(special[token])
            return b"".join(out)

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, known = row["block"], {}
                if row["n"] >= 0:
                    found = _loose(row["data"], 2 * row["n"])
                    known.update(zip((w.decode() for w in found[: row["n"]]), found[row["n"] :], strict=True))
                    continue
                run = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["data"])).read_all()
                for some in run.to_batches():
                    encoded = pa.array([ids(value.as_py() or "") for value in some.column("text")], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), encoded], names=["doc_id", "ids"])

    wanted = blocked.select("text", "block", "deal").mapInArrow(
        giving_back(lists), "bucket int, block long, deal int, n int, words binary"
    )
    wanted = wanted.repartition("bucket").sortWithinPartitions("bucket")
    run_of = "block long, deal int, n int, data binary"
    met = wanted.mapInArrow(giving_back(answers), run_of).unionAll(blocked.mapInArrow(giving_back(texts), run_of))
    # A block's words come before its texts, whose runs have n = -1.
    met = met.repartitionById(n_parts, F.col("deal")).sortWithinPartitions("block", F.col("n").desc())
    return met.mapInArrow(giving_back(place), T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` plus ``decoded``: the text of ``ids``, special tokens as they are spelled.

    Bytes that are no UTF-8 become the replacement character, ids outside the vocabulary are left out and null
    ids give an empty text, as the library does it. A column that is called ``decoded`` already is replaced.
    """
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField("decoded", T.StringType())])

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = _pieces(tokenizer)
        for batch in batches:
            sizes = np.diff(utf8(batch.column(ids))[1]).tolist()
            for i, j in in_runs(sizes, _RUN_BYTES):
                part = batch.slice(i, j - i)
                texts = []
                for value in part.column(ids):
                    found = np.frombuffer(value.as_py() or b"", "<u4")
                    found = np.minimum(found, len(pieces) - 1)  # the last piece is that of all unknown ids
                    texts.append(b"".join(pieces[found]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "decoded"]
                )

    return encoded.select(*[f"`{c}`" for c in kept]).mapInArrow(giving_back(join), schema)


@cache
def _pieces(path: str) -> np.ndarray:
    """Bytes by id, with an empty piece after the last id."""
    known = vocabulary(path).pieces()
    table = np.full(max(known, default=-1) + 2, b"", object)
    for i, piece in known.items():
        table[i] = piece
    return table
