import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators might use themselves
    T.StructField("_text", T.StringType()), T.StructField("_sha", T.StringType()),
    T.StructField("_keep", T.LongType()), T.StructField("id", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("k", T.LongType()), T.StructField("_kept", T.LongType()), T.StructField("_scored", T.LongType()),
])

WORDS = [f"w{i}x" for i in range(400)]


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    base = WORDS[:60]
    near = [*base[:30], "other", *base[31:]]
    texts = [
        (1, "Plain text, here."), (2, None), (3, ""), (4, " \t\n "), (5, "Plain  text,\there."),
        (6, " ".join(base)), (7, " ".join(near)), (8, "  " + "\n".join(base)), (9, "two words"),
        (10, "TWO words"), (11, " ".join(WORDS[100:400] * 40)), (12, "é漢😀́\x85 \x1c don't 's <|endoftext|>"),
        (None, "Plain text, here."), (None, None), (6, " ".join(base)), (13, "Released under the MIT License."),
        (14, "x" * 5000), (15, " ".join(WORDS[:3])),
    ]
    return [(i, t, None, None, None, "a", None, 7, "z", 3, 5, 9, 1) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The documents of the smallest tables as (id, text) with null as empty."""
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def query(spark, sf):
    from fleetlens.llm.catalog import QUERIES

    return lambda name: QUERIES[name](spark, sf)
