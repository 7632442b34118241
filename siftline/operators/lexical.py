"""The inverted index and BM25 over batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import text as T

K1, B = 1.5, 0.75
BODY, TITLE = 1, 2  # what a token counts
BUCKETS, POSTINGS = 16, "doc_id long, term string, tf long, length long, bucket int"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, id_col: str, text_col: str, title_col: str | None = None) -> DataFrame:
    """(doc_id, term, tf), partitioned by document.

    Texts are dealt by document once; words are then counted, stemmed (each distinct word of a document once, after stop
    words went) and summed by term where they are, and so are the lengths of documents.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), *([F.col(title_col).alias("title")] if title_col else [])]
    dealt, out = docs.select(*columns).repartition("doc_id"), None
    for column, weight in [("body", BODY)] + ([("title", TITLE)] if title_col else []):
        words = dealt.select("doc_id", F.explode(T.raw_tokens(F.col(column))).alias("word")).where(~T.is_stopword(F.col("word")))
        words = words.groupBy("doc_id", "word").agg((F.count("*") * weight).alias("n"))
        out = words if out is None else out.unionByName(words)
    return out.select("doc_id", T.stem(F.col("word")).alias("term"), "n").groupBy("doc_id", "term").agg(F.sum("n").alias("tf"))


@dataclass(frozen=True)
class LexicalIndex:
    """postings (doc_id, term, tf, length), df (term, df), corpus (n, avg_len; one row)."""

    postings: DataFrame
    df: DataFrame
    corpus: DataFrame
    buckets: int | None = None  # of stored postings

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> LexicalIndex:
        tf = postings(docs, id_col, text_col, title_col).persist()  # read by all parts of the index; spills to disk
        lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        total = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
        corpus = docs.agg(F.count("*").alias("n")).crossJoin(total)  # one row each
        corpus = corpus.select("n", F.greatest(F.try_divide(F.col("tokens"), F.col("n")), F.lit(1.0)).alias("avg_len"))
        return cls(tf.join(lengths, "doc_id"), df, corpus)

    def write(self, path: str, buckets: int = BUCKETS) -> None:
        """Postings by hash of the term, so that a query reads the files of its terms alone."""
        postings = self.postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
        postings.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.df.write.mode("overwrite").parquet(f"{path}/df")
        self.corpus.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def read(cls, spark, path: str) -> LexicalIndex:
        corpus = spark.read.parquet(f"{path}/corpus")
        buckets = corpus.first().buckets
        return cls(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/df"), corpus.drop("buckets"), buckets)

    def scores(self, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) of all documents that share a term with a query. queries: (query_id, text)."""
        terms = queries.select("query_id", F.explode(F.array_distinct(T.analysed(F.col("text")))).alias("term"))
        terms = terms.join(self.df, "term").crossJoin(F.broadcast(self.corpus))  # the corpus is one row
        hits = self.postings if allowed is None else self.postings.join(allowed, "doc_id", "left_semi")
        on = ["term"]
        if self.buckets:  # stored postings: only the buckets of the terms asked for are read
            terms, on = terms.withColumn("bucket", bucket_of(F.col("term"), self.buckets)), ["bucket", "term"]
            hits = hits.where(F.col("bucket").isin([r.bucket for r in terms.select("bucket").distinct().collect()]))
        scored = hits.join(terms, on)
        return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(bm25()), 6).alias("score"))


def bm25() -> Column:
    """Share of one term, from columns tf, length, df, n, avg_len."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    below = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_len"))
    return F.when(below > 0, idf * F.col("tf") * (K1 + 1) / below).otherwise(F.lit(0.0))


def ranked(scores: DataFrame, k: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds rank from 1 for each query: score descending, then id; the first ``k`` alone, if given."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col)))
    out = scores.withColumn("rank", rank.cast("long"))
    return out.where(F.col("rank") <= k) if k is not None else out
