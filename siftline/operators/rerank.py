"""Reranking by weighted word overlap, and extractive answers built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import text as T

# Bonus for a shared identifier, least relevance of a sentence.
IDENTIFIER_BONUS, MIN_RELEVANCE = 0.35, 0.02


def idf_overlap(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, chunk_id, overlap): Jaccard of distinct tokens weighted by their rarity among a query's candidates.

    queries: (query_id, text); candidates: (query_id, chunk_id, text). idf = ln(1 + n / (1 + df)) over the candidates
    of the query; query tokens that no candidate has weigh ln(1 + n). Shared tokens of letters and digits, four
    characters or more, add IDENTIFIER_BONUS each; the sum stops at 1. Written as |union| = |query| + |candidate| -
    |both|, so that only shared tokens are joined.
    """
    ask = queries.select("query_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("token"))
    have = candidates.select("query_id", "chunk_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("token"))
    n = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    df = have.groupBy("query_id", "token").agg(F.count("*").alias("df")).join(n, "query_id")
    idf = df.select("query_id", "token", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))
    asked = ask.join(idf, ["query_id", "token"], "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    weight_q = asked.groupBy("query_id").agg(F.sum("idf").alias("q"))
    have = have.join(idf, ["query_id", "token"]).join(asked.select("query_id", "token", F.lit(True).alias("asked")), ["query_id", "token"], "left")
    mixed = F.col("token").rlike("[a-z]") & F.col("token").rlike("[0-9]") & (F.length("token") >= 4)
    shared = F.col("asked").isNotNull()
    sums = have.groupBy("query_id", "chunk_id").agg(
        F.sum("idf").alias("d"), F.coalesce(F.sum(F.when(shared, F.col("idf"))), F.lit(0.0)).alias("both"),
        F.count(F.when(shared & mixed, 1)).alias("ids"),
    )
    union = F.col("q") + F.col("d") - F.col("both")
    score = F.when(union > 1e-12, F.col("both") / union).otherwise(0.0) + IDENTIFIER_BONUS * F.col("ids")
    return sums.join(weight_q, "query_id").select("query_id", "chunk_id", F.round(F.least(F.lit(1.0), score), 6).alias("overlap"))


def extractive(queries: DataFrame, docs: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, unit, sentence, overlap, position): the sentences of each query's documents that fit it best, verbatim.

    docs: (query_id, chunk_id, text).
    """
    units = docs.select("query_id", F.col("chunk_id").alias("doc"), F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence"))
    units = units.withColumn("unit", F.concat_ws(":", F.col("doc").cast("string"), F.col("at").cast("string")))
    found = idf_overlap(queries, units.select("query_id", F.col("unit").alias("chunk_id"), F.col("sentence").alias("text")))
    found = found.where(F.col("overlap") >= MIN_RELEVANCE).withColumnRenamed("chunk_id", "unit")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("overlap"), "unit"))
    found = found.withColumn("position", rank.cast("long")).where(F.col("position") <= top)
    return found.join(units.select("query_id", "unit", "sentence"), ["query_id", "unit"]).select("query_id", "unit", "sentence", "overlap", "position")
