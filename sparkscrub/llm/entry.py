"""The corpus queries: each applies its operator with production parameters to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kneser_ney, langid, quality_rules, toxicity
from .common import Scratch, doc_bucket
from .lm_scoring import score_documents
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .prefix_trie import rebuilt_trie
from .projection_passes import near_vectors
from .resharding import reshard_files
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_mix_sources(spark, sf_dir):
    """Sources weigh 3, 1, 2, share 150 % of all words and stop at twice their size."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("__row.doc_id", "size", "source_size", "target", "taken", "copies")


@query()
def op3_reshard(spark, sf_dir):
    """From 16 old shards by source, the hot one among them, to 24 with equal row counts; affected files rewritten.

    Rows of affected shards are read from the files written for them.
    """
    docs = table(spark, sf_dir, "documents")
    old = F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")) % 16
    files, rest, _ = reshard_files(docs, old, f"{Scratch(spark).folder}/shards", n_new=24)
    value = F.coalesce(F.col("text"), F.lit(""))
    rewritten = files.select(
        "doc_id",
        (F.octet_length(value).cast("long") + 8).alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        old.cast("int").alias("old"),
        "shard",
        "slot",
    )
    return rewritten.unionByName(rest).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op4_pack(spark, sf_dir):
    """Sequences of 4096 tokens from the word vocabulary."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op7_quality_rules(spark, sf_dir):
    """Strata are languages; at most 5 % of a stratum's good documents are rejected, with 95 % confidence."""
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


@query()
def op5_projection_passes(spark, sf_dir):
    """Vectors of one label with a cosine of 0.98 or more, by 24 passes with windows of 64."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op9_minhash_join(spark, sf_dir):
    """Documents whose sets of 5-word shingles have a similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op1_language_id(spark, sf_dir):
    """Learned from folds 1 to 4 of the document id, predicted for every text."""
    documents = table(spark, sf_dir, "documents")
    found = langid.predict(documents, langid.train(documents))
    held_out = (doc_bucket(F.col("doc_id"), 5) == 0).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


@query()
def op8_toxicity(spark, sf_dir):
    """Learned from the labelled documents outside of fold 2 of 4, scored for every text."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), toxicity.outside_fold(F.col("doc_id")))
    found = toxicity.score(documents, model)
    return found.withColumn("held_out", ~toxicity.outside_fold(F.col("doc_id")))


@query()
def op10_kneser_ney(spark, sf_dir):
    """Rejected above the 99.5 % quantile of held-out trusted documents of the language and size class."""
    found = kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept")


@query()
def op6_recurrent_scores(spark, sf_dir):
    """Learned from folds 1 to 9 of the document id, scored for every text."""
    return score_documents(table(spark, sf_dir, "documents"))


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op11_byte_bpe(spark, sf_dir):
    """Every whole text to ids of the byte-level vocabulary and back, each distinct word encoded once."""
    path = byte_tokenizer_path()
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op12_whitening(spark, sf_dir):
    """The 32 leading components of all usable vectors, each scaled to unit variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


# The shared start of a conversation is as long as the checksum of its number says, which SQL works out bit by bit.
_TRIE_SQL = """
WITH crc AS (
  SELECT list(list_reduce(range(8)::UBIGINT[], lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT)
                                                              ELSE x // 2 END, i::UBIGINT) ORDER BY i) AS steps
  FROM range(256) AS r(i)),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base,
         xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::UBIGINT),
                         lambda x, d: xor(x // 256, steps[(xor(x, d) % 256)::INT + 1]), 4294967295::UBIGINT),
             4294967295::UBIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns), crc),
rebuilt AS (
  SELECT convs.c, 0 AS part, pos, role, txt FROM convs JOIN turns ON turns.c = base AND pos < h
  UNION ALL SELECT convs.c, 1, pos, role, txt FROM convs JOIN turns ON turns.c = convs.c AND pos >= h),
placed AS (SELECT c, role, txt, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM rebuilt),
paths AS (
  SELECT c, depth, strlen(txt) AS bytes, list({'r': role, 't': txt}) OVER (PARTITION BY c ORDER BY depth) AS path FROM placed
  UNION ALL SELECT c, 0, 0, [] FROM convs),
lengths AS (SELECT c, max(depth) AS len FROM paths GROUP BY c),
nodes AS (
  SELECT depth, path, min(c) AS conv, count(*) AS n, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = depth), '')) AS ends
  FROM paths JOIN lengths USING (c) GROUP BY depth, path),
passed AS (SELECT c, paths.depth, nodes.conv FROM paths JOIN nodes USING (depth, path)),
kids AS (
  SELECT p.conv, p.depth, count(*) AS n_children FROM nodes AS u JOIN passed AS p ON p.c = u.conv AND p.depth = u.depth - 1
  GROUP BY ALL),
subtree AS (
  SELECT v.conv, v.depth, sum((u.n - 1) * u.bytes) AS saved, count(*) FILTER (WHERE k.conv IS NULL) AS leaves
  FROM nodes AS u JOIN passed AS v ON v.c = u.conv AND v.depth <= u.depth
  LEFT JOIN kids AS k ON k.conv = u.conv AND k.depth = u.depth GROUP BY ALL)
SELECT n.conv AS conv_id, n.depth, p.conv AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes AS n JOIN subtree AS s ON s.conv = n.conv AND s.depth = n.depth
LEFT JOIN kids AS k ON k.conv = n.conv AND k.depth = n.depth
LEFT JOIN passed AS p ON p.c = n.conv AND p.depth = n.depth - 1"""


@query(_TRIE_SQL)
def op13_prefix_trie(spark, sf_dir):
    """Every shared prefix of the rebuilt conversations, by blocks of eight turns."""
    return rebuilt_trie(table(spark, sf_dir, "conversations"))
