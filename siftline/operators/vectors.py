"""Vector collections: normalising, cosine, exact nearest neighbours for batches of queries."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.sources import folders

EPSILON = 1e-12
MAX_QUERIES, BLOCK_BYTES, SLICE = 20_000, 8 << 20, 512  # in one block, whose matrix goes to every task; at a time in a task


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector at length one, in double; vectors shorter than EPSILON stay as they are."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n < EPSILON, x.cast("double")).otherwise(x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def _packed(block: pd.DataFrame) -> pd.DataFrame:
    matrix = np.stack([np.asarray(v, np.float64) for v in block.embedding])
    return pd.DataFrame({"block": [block.block.iloc[0]], "ids": [block.query_id.to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]})


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of blocks of queries by hash of their ids, of some MAX_QUERIES and BLOCK_BYTES at most. Tasks pack each
    block into bytes; the driver holds one at a time."""
    queries = folders.staged(queries.select("query_id", "embedding"), "knn-queries")
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("d")).first()
    blocks = -(-size.n // max(1, min(MAX_QUERIES, BLOCK_BYTES // (8 * max(1, size.d)))))
    if not blocks:
        return
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    packed = folders.staged(dealt.groupBy("block").applyInPandas(_packed, "block int, ids binary, matrix binary"), "knn-blocks")
    for block in range(blocks):
        if (row := packed.where(F.col("block") == block).first()) is not None:
            ids = np.frombuffer(row.ids, np.int64)
            yield ids, np.frombuffer(row.matrix, np.float64).reshape(len(ids), -1)


def knn(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): cosine of every query with every vector, the best ``k`` a query.

    vectors: (vec_id, embedding); queries: (query_id, embedding), of any number: each block of them makes a pass
    over the vectors. Each task multiplies blocks of vectors with the query matrix and hands on its best k a query;
    scores are rounded to 6 places before ranking and ties go to the smaller id.
    """
    blocks = _query_blocks(queries)
    first, second = next(blocks, (np.zeros(0, np.int64), np.zeros((0, 1)))), next(blocks, None)
    if second is None:
        return _best(_nearest(vectors, *first, k, least), k)
    vectors = folders.staged(vectors.select("vec_id", "embedding"), "knn-vectors")  # not made again for each block
    folder = f"{folders.shared(vectors.sparkSession)}/knn-{uuid.uuid4().hex}"
    for n, (ids, matrix) in enumerate(itertools.chain([first, second], blocks)):  # each is written and let go before the next is read
        _best(_nearest(vectors, ids, matrix, k, least), k).write.parquet(f"{folder}/block={n}")
    return vectors.sparkSession.read.parquet(folder).drop("block")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _nearest(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, least: float | None) -> DataFrame:
    """(query_id, vec_id, score): of each block of vectors the best ``k`` for each query: of ``ids``, as rows of ``matrix``."""

    def unit(m: np.ndarray) -> np.ndarray:
        lengths = np.sqrt((m * m).sum(1, keepdims=True))
        return np.where(lengths < EPSILON, m, m / np.maximum(lengths, EPSILON))

    wanted = unit(matrix)

    def nearest(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            if not len(block) or not len(ids):
                continue
            dimension = len(block.embedding.iloc[0])
            if dimension != wanted.shape[1]:
                raise ValueError(f"dimension {dimension} where queries have {wanted.shape[1]}")
            rows = max(1, BLOCK_BYTES // (8 * dimension))
            for start in range(0, len(block), rows):
                yield from best_of(block.iloc[start : start + rows])

    def best_of(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found = unit(np.stack([np.asarray(v, np.float64) for v in block.embedding]))
        own = block.vec_id.to_numpy()
        for at in range(0, len(wanted), SLICE):  # scores of SLICE queries at a time, whatever their number
            scores = np.round(wanted[at : at + SLICE] @ found.T, 6)
            floor = np.partition(scores, -k, axis=1)[:, -k] if k < len(own) else np.full(len(scores), -np.inf)
            floor = floor if least is None else np.maximum(floor, least)
            q, v = np.nonzero(scores >= floor[:, None])  # the best k and what ties with the last of them
            best = scores[q, v]
            order = np.lexsort((own[v], -best, q))
            q, v, best = q[order], v[order], best[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            some = place < k
            yield pd.DataFrame({"query_id": ids[at + q[some]], "vec_id": own[v[some]], "score": best[some]})

    return vectors.select("vec_id", "embedding").mapInPandas(nearest, "query_id long, vec_id long, score double")
