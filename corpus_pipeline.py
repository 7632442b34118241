"""From documents to token digests: a pipeline of corpus operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import byte_bpe, exact_dedup, mixing, near_copies
from siftline.llm import toxicity as toxic
from siftline.llm.common import staged, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxic.kept_rows(docs, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more, found by SimHash
    links and, for similarities at which fingerprints are too far apart, by bands; verified on whole texts."""
    return near_copies.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, zero to three times."""
    return mixing.taken_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return byte_bpe.digests(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("byte_bpe", encode)]

#: Stages learn, hash and tokenise beyond what SQL expresses; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
