import pytest

LONG = " ".join(f"word{i % 997} and" for i in range(30_000))

#: Nulls in every column, empty and very long texts, copies, ties and repeated rows, and columns with clashing names.
ODD = [
    (1, "The same text, twice over, with enough words to count.", "a"),
    (2, "the SAME text, twice over, with enough words to count.", "b"),
    (2, "the SAME text, twice over, with enough words to count.", "b"),
    (3, "", "a"), (4, None, None), (None, "", "a"), (None, None, None), (None, "a text without an id", "c"),
    (5, LONG, "a"), (6, LONG.upper(), "a"), (7, "É é ß İ ﬁ   \x1c 日本語 \U0001f600", "ü"), (8, " \t\n", "b"),
    (9, "a text without an id", None),
]
CLASHES = ("_id", "_key", "_sha", "_possible", "row", "fp", "score", "label", "shard", "slot", "copies", "number", "measures", "k0", "_source", "_size", "key", "size", "rate", "copy")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").coalesce(2)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    """Documents as the brute-force versions read them: (doc_id, text, source)."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    return [tuple(r) for r in rows]
