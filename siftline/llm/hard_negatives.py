"""Hard-negative mining by branch and bound over ball trees.

An anchor's positives are its best rows of the same label; for each of them the best rows of other labels are wanted whose
score lies in a window below the positive's. Rows are dealt into trees of TREE rows at most, which are built once and
written as a table of one row a tree. A node keeps centre and radius of its rows, which bound every inner product q.x
under it: q.c - |q| r <= q.x <= q.c + |q| r. A question leaves a node whose bounds lie outside its window, or whose upper
bound lies strictly beneath the score of its current kth result (equal scores may still win by the smaller id), or
that holds no label it may take. Many questions walk down a tree together: a node costs one product of its centre with
those that are left, a leaf one product of matrices. A task carries its results from tree to tree, so later trees are
pruned by what earlier ones gave, and hands on k rows a question.

Before that, one tree in SAMPLE is searched alone. Its kth scores bound the final ones from below, so tasks drop
what lies beneath them: what all tasks together hand on is some k * SAMPLE rows a question, not k for each task.

Scores are integers. They are taken in 64-bit floats where these are exact for the numbers at hand, else in 64-bit
integers, else in Python's, cut to the range of a long.

Scale. Every anchor meets every row, as the task asks; anchors go in blocks of about BLOCK, each of them one pass over the
trees with the block's vectors broadcast (BLOCK * dimension numbers, whatever the input), and a block's results are
written before the next begins. The driver holds one block. Trees shuffle once, dealt by a hash of the id, so a label
that a third of the rows carry is spread over all tasks.

Defined cases. Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Of rows
that repeat an id the one with the smallest label, then vector, takes part. Vectors of another dimension than an anchor's
have no score with it; vectors of no dimension score 0. An anchor without positives, or a positive without negatives, gives
no row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import arrow_batches, staged, table
from siftline.llm.memory import give_back

TREE, LEAF, SAMPLE, BLOCK = 2_048, 64, 16, 8_192
#: Wider than the rounding of a float's product of centre and question.
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Window:
    """Negatives score from low to high hundredths of their positive's score."""

    low: int = 80
    high: int = 100


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    largest = a.shape[1] * float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max())
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST, np.iinfo(np.int64).max).astype(np.int64)


@dataclass
class Tree:
    """Rows in the order of the leaves; nodes as arrays, children of a node side by side."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    begin: np.ndarray  # first row of each node
    end: np.ndarray
    child: np.ndarray  # the first of its two children, 0 for a leaf
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray  # smallest and largest label under it
    high: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        """Halves rows along the line between two that are far apart, until ``leaf`` are left."""
        points, order = vectors.astype(np.float64), np.arange(len(ids))
        begin, end, child = [0], [len(ids)], [0]
        at = 0
        while at < len(begin):
            a, b = begin[at], end[at]
            if b - a > leaf:
                rows = points[order[a:b]]
                far = rows[((rows - rows[0]) ** 2).sum(1).argmax()]
                other = rows[((rows - far) ** 2).sum(1).argmax()]
                half = (b - a) // 2
                side = np.argsort(rows @ (other - far), kind="stable")
                order[a:b] = order[a:b][side]
                child[at] = len(begin)
                begin += [a, a + half]
                end += [a + half, b]
                child += [0, 0]
            at += 1
        points, labels = points[order], labels[order]
        centre = np.array([points[a:b].mean(0) for a, b in zip(begin, end)])
        radius = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(begin, end, centre)])
        low, high = (np.array([f(labels[a:b]) for a, b in zip(begin, end)]) for f in (np.min, np.max))
        return cls(ids[order], labels, vectors[order], np.array(begin), np.array(end), np.array(child), centre, radius, low, high)

    def to_bytes(self) -> bytes:
        out, largest = io.BytesIO(), np.abs(self.vectors.astype(np.float64)).max(initial=0)
        small = next(t for t in (np.int16, np.int32, np.int64) if largest < np.iinfo(t).max or t is np.int64)
        np.savez(out, **vars(self) | {"vectors": self.vectors.astype(small)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
            return cls(**arrays)


@dataclass
class Questions:
    """What is asked of the trees: ``of`` points at the vector; scores wanted lie from low to high and reach floor.

    Rows of the label ``label`` alone may answer if ``same``, of all others if not; the row ``own`` never.
    """

    vectors: np.ndarray
    of: np.ndarray
    own: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    same: bool


class Search:
    """The best k answers to each question over the trees seen so far."""

    def __init__(self, asked: Questions, k: int):
        self.q, self.k = asked, k
        n = len(asked.of)
        self.scores, self.ids = np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max)
        self.norm = np.sqrt((asked.vectors.astype(np.float64) ** 2).sum(1)) if len(asked.vectors) else np.zeros(0)
        self.points = asked.vectors.astype(np.float64)

    def least(self, at: np.ndarray) -> np.ndarray:
        """What a score must reach to be among the answers."""
        return np.maximum(self.scores[at, -1], np.maximum(self.q.floor[at], self.q.low[at]))

    def over(self, tree: Tree) -> None:
        if not len(self.q.of) or not len(tree.ids) or tree.vectors.shape[1] != self.q.vectors.shape[1]:
            return
        stack = [(0, np.arange(len(self.q.of)))]
        while stack:
            node, at = stack.pop()
            label = self.q.label[at]
            if self.q.same:
                at = at[(tree.low[node] <= label) & (label <= tree.high[node])]
            else:
                at = at[(tree.low[node] != label) | (label != tree.high[node])]
            vectors, back = np.unique(self.q.of[at], return_inverse=True)
            middle, reach = self.points[vectors] @ tree.centre[node], self.norm[vectors] * tree.radius[node]
            slack = 1 + SLACK * (np.abs(middle) + self.norm[vectors] * (tree.radius[node] + np.linalg.norm(tree.centre[node])))
            upper, lower = (middle + reach + slack)[back], (middle - reach - slack)[back]
            at = at[(upper >= self.least(at)) & (lower <= self.q.high[at])]
            if not len(at):
                continue
            if first := tree.child[node]:
                ahead = [self.points[np.unique(self.q.of[at])].sum(0) @ tree.centre[c] for c in (first, first + 1)]
                nearer = first if ahead[0] >= ahead[1] else first + 1
                stack += [(2 * first + 1 - nearer, at), (nearer, at)]  # the nearer child comes first
            else:
                self._leaf(tree, tree.begin[node], tree.end[node], at)

    def _leaf(self, tree: Tree, begin: int, end: int, at: np.ndarray) -> None:
        q = self.q
        vectors, back = np.unique(q.of[at], return_inverse=True)
        scores = products(q.vectors[vectors], tree.vectors[begin:end])[back]
        ids, labels = tree.ids[begin:end], tree.labels[begin:end]
        fits = (labels == q.label[at, None]) == q.same
        fits &= (ids != q.own[at, None]) & (scores >= self.least(at)[:, None]) & (scores <= q.high[at, None])
        some = fits.any(1)
        if not some.any():
            return
        at, scores, fits = at[some], scores[some], fits[some]
        # of a leaf's rows those that fit, then the best k of them and of what there was
        scores = np.hstack([self.scores[at], np.where(fits, scores, LEAST)])
        found = np.hstack([self.ids[at], np.where(fits, ids, np.iinfo(np.int64).max)])
        best = np.lexsort((found, ~scores), axis=1)[:, : self.k]  # ~score falls as score rises, without overflow
        self.scores[at], self.ids[at] = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)

    def answers(self) -> pd.DataFrame:
        at, nth = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return pd.DataFrame({"question": at.astype(np.int64), "id": self.ids[at, nth], "score": self.scores[at, nth]})


def rows_of(embeddings: DataFrame, label: Column | None = None, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, one for each id; components as floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col(label_col) if label is None else label
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def trees_of(rows: DataFrame, size: int = TREE) -> DataFrame:
    """(tree, dimension, data) of the rows as they are dealt; of each dimension a tree holds at most ``size`` rows."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[int, list] = {}

        def done(dimension: int, held: list) -> pd.DataFrame:
            ids, labels, vectors = zip(*held)
            matrix = np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(ids), dimension)
            data = Tree.build(np.array(ids, np.int64), np.array(labels, np.int64), matrix).to_bytes()
            return pd.DataFrame({"tree": [min(ids)], "dimension": [dimension], "data": [data]})

        for batch in batches:
            for row in zip(batch.vec_id, batch.label, batch.vector):
                held = open_.setdefault(len(row[2]), [])
                held.append(row)
                if len(held) == size:
                    yield done(len(row[2]), open_.pop(len(row[2])))
        for dimension, held in sorted(open_.items()):
            yield done(dimension, held)

    return rows.mapInPandas(grow, "tree long, dimension int, data binary")


def answered(trees: DataFrame, asked: Questions, k: int) -> DataFrame:
    """(question, id, score, rank): the best k answers of all trees to each question."""
    sent = trees.sparkSession.sparkContext.broadcast(asked)  # one block

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Search(sent.value, k)
        for batch in batches:
            for data in batch.data:
                found.over(Tree.from_bytes(data))
        yield found.answers()
        give_back()

    rows = trees.mapInPandas(search, "question long, id long, score long")
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def best(trees: DataFrame, asked: Questions, k: int, sample: int = SAMPLE) -> DataFrame:
    """The same, after a search of one tree in ``sample`` has set floors."""
    with arrow_batches(trees.sparkSession, 16):
        some = answered(trees.where(F.pmod(F.xxhash64("tree"), F.lit(sample)) == 0), asked, k)
        floors = some.where(F.col("rank") == k).select("question", "score").toPandas()  # a row a question of the block
        asked.floor[floors.question.to_numpy()] = floors.score.to_numpy()
        return staged(answered(trees, asked, k), "answers")


NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, window: Window = Window(), block: int = BLOCK, tree: int = TREE) -> DataFrame:
    """The best negatives in the window below each of an anchor's best positives. rows: as ``rows_of`` gives them."""
    spark = rows.sparkSession
    rows = staged(rows, "vectors")
    trees = staged(trees_of(rows, tree), "trees")
    anchors = rows.where(anchor)
    blocks = -(-anchors.count() // block)
    out = spark.createDataFrame([], NEGATIVES)
    for at in range(blocks):  # each a pass over the trees, of which the driver keeps nothing
        held = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == at).toPandas()
        for dimension, some in held.groupby(held.vector.map(len)):
            own = trees.where(F.col("dimension") == dimension)
            out = out.unionByName(_of_block(own, some.reset_index(drop=True), dimension, positives, negatives, window))
    return out


def _of_block(trees: DataFrame, held: pd.DataFrame, dimension: int, positives: int, negatives: int, window: Window) -> DataFrame:
    n, ids, labels = len(held), held.vec_id.to_numpy(np.int64), held.label.to_numpy(np.int64)
    vectors = np.array([np.asarray(v, np.int64) for v in held.vector], np.int64).reshape(n, dimension)
    wide = np.full(n, np.iinfo(np.int64).max)
    asked = Questions(vectors, np.arange(n), ids, labels, np.full(n, LEAST), wide, np.full(n, LEAST), True)
    near = best(trees, asked, positives).orderBy("question", "rank").toPandas()  # ``positives`` rows an anchor of the block
    of, score = near.question.to_numpy(np.int64), near.score.to_numpy(np.int64)
    low, high = (-(-window.low * score.astype(object) // 100)), window.high * score.astype(object) // 100
    ahead = np.array(low <= high, bool)  # below a negative score the window is empty
    near, of, low, high = near[ahead], of[ahead], low[ahead].astype(np.int64), high[ahead].astype(np.int64)
    asked = Questions(vectors, of, ids[of], labels[of], low, high, np.full(len(of), LEAST), False)
    found = best(trees, asked, negatives)
    pairs = pd.DataFrame({"question": np.arange(len(of)), "anchor_id": ids[of], "positive_id": near.id.to_numpy(np.int64), "positive_score": near.score.to_numpy(np.int64)})
    schema = "question long, anchor_id long, positive_id long, positive_score long"
    pairs = F.broadcast(trees.sparkSession.createDataFrame(pairs, schema))  # ``positives`` rows an anchor of the block
    out = found.join(pairs, "question")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows_of(table(spark, sf_dir, "embeddings"), moved), F.col("vec_id") % 100 == 0)


#: Scores are sums of products of integers, exact in SQL as well.
ORACLE = """
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         [floor(CAST(x AS DOUBLE) * 256) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
