import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkscrub.llm import bpe
from sparkscrub.llm.entry import QUERIES, byte_tokenizer_path, tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = byte_tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def found(df):
    return {
        (r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"])
        for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()
    }


def test_query_equals_the_library(spark, library):
    rows = {r["doc_id"]: r for r in QUERIES["op11_byte_bpe"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids, decoded = expected(library, text)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_and_empty_tables(spark, library, odd, none):
    rows = odd.select("doc_id", "text").collect()
    assert found(odd) == {(r["doc_id"], tuple(e[0]), e[1]) for r in rows for e in [expected(library, r["text"])]}
    assert bpe.encode(odd, PATH).count() == len(rows)
    assert bpe.encode(odd, PATH).where("ids IS NULL").count() == 0
    assert found(none) == set()


def test_any_text_in_many_blocks(spark, library, monkeypatch, tmp_path):
    rng = random.Random(5)
    marks = [*" \t\n\r\x0b\x85\xa0\x1c aZéß'sStllre03²¼٣!?._日😀​\x00̀Ⅷ　", "<|endoftext|>", " the", "'s"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 4096)
    read = spark.read.parquet(f"{tmp_path}/docs")
    assert found(read) == {(i, tuple(e[0]), e[1]) for i, t in enumerate(texts) for e in [expected(library, t)]}
    blocked, parts = bpe.with_blocks(read, None, 4096)
    assert blocked.select("block").distinct().count() > 16
    assert parts > 16 and blocked.agg(F.max("deal")).first()[0] < parts


def test_hot_text_is_spread(spark, monkeypatch):
    """A third of all rows are one text: blocks follow the places of rows, so no block holds more than its share."""
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 16_384)
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text of a few words").otherwise(F.col("id").cast("string")).alias("text")
    )
    scratch = bpe.Scratch(spark)
    sizes = bpe.with_blocks(df, scratch, 16_384)[0].groupBy("block").count().collect()
    assert max(r["count"] for r in sizes) <= 16_384 // 16
    assert bpe.encode(df, PATH).count() == 6000


def test_decoding_alone(spark, library):
    lists = [[], [50256], [464, 50256, 3290], [222], [300, 70_000, 301], None]
    rows = [(i, None if ids is None else bytearray(np.array(ids, "<u4").tobytes()), "mine") for i, ids in enumerate(lists)]
    out = bpe.decode(spark.createDataFrame(rows, "doc_id int, ids binary, decoded string"), PATH)
    assert out.columns == ["doc_id", "ids", "decoded"]
    texts = {r["doc_id"]: r["decoded"] for r in out.collect()}
    assert texts == {i: library.decode(ids or [], skip_special_tokens=False) for i, ids in enumerate(lists)}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(tokenizer_path())
