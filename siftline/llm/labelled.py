"""Bounded samples of labelled rows, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import lowest_hashes, staged


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label, weight): at most ``per_class`` rows of each label, picked by a hash of the id, none held out.

    A row weighs as many labelled ids as it stands for, so weighted sums keep the true shares of the labels, however
    many of each were picked. Ids with several labels count as their largest. The ids, 2 * per_class at most, are
    broadcast, so the texts are filtered where they are read; of several texts of one id the least is taken.
    """
    known = labels.where(~held_out & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    known = staged(known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label")), "labels")
    rows = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value in (0, 1):
        stands_for = max(1.0, rows.get(value, 0) / per_class)
        side = lowest_hashes(known.where(F.col("label") == value), per_class).withColumn("weight", F.lit(stands_for))
        picked = side if picked is None else picked.unionByName(side)
    picked = picked.withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text"))
