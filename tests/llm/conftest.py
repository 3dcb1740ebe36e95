import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

ODD_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for their own columns.
        T.StructField("size", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("component_id", T.StringType()),
    ]
)

_LINE = "the quick brown fox jumps over the lazy dog and runs away from it"
ODD_TEXTS = [
    (1, _LINE, "en", "a"),
    (1, _LINE, "en", "a"),  # a repeated row
    (2, _LINE, "en", None),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n ", "de", "c"),
    (None, _LINE, None, "a"),
    (None, None, None, None),
    (6, "word", "en", "b"),
    (7, "!!! ??? 123", "en", "b"),
    (8, "long " * 60_000, "en", "a"),
    (9, "x" * 200_000, "en", "a"),
    (10, "naïve Straße — 日本語 😀 \x00 end", "de", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, s, 0 if t is None else len(t), "s", "k", "h", "c", "p", "b", "m") for i, t, lang, s in ODD_TEXTS]
    return spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
