"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, whose written
rows are the next stage's ``docs``. All but the last return the columns of ``documents``; columns of any name pass.
In every stage a null text is empty, and an empty one is rejected by the first; rows without id are judged by their
text; repeated rows are judged alike, and one of them stays in the third; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkscrub.llm import kneser_ney, quality_rules
from sparkscrub.llm.common import Scratch
from sparkscrub.llm.entry import table, tokenizer_path
from sparkscrub.llm.minhash import deduplicated
from sparkscrub.llm.mixing import mixed_documents
from sparkscrub.llm.packing import pack


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model of trusted text finds no less likely than trusted ones."""
    return kneser_ney.kept_documents(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs of their language."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


#: A pair at exactly 0.8 agrees on fewer than 38 of 64 coordinates with a probability of 4e-05.
NEAR = {"percent": 80, "coordinates": 64, "matches": 38}
#: Words whose ids a packing worker keeps: fewer than alone, as its machine has worked for other stages before.
REMEMBER = 200_000


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked by five-word shingle sets with a similarity of 0.8 or more; of equal
    or linked ones the smallest id."""
    return deduplicated(docs, **NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 4096 tokens."""
    return pack(docs, tokenizer_path(), remember=REMEMBER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("packing", packed),
]

#: The model, the signatures, the draws and the packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written before the next reads it."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
