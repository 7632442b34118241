import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import hard_negatives as H


def by_hand(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """All against all, in Python's integers. rows: (id, label, components)."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept = {}
    for i, label, v in rows:
        kept[i] = min(kept.get(i, (label, [math.floor(256 * x) for x in v])), (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in kept.items():
        if not is_anchor(a):
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a and len(w) == len(v)]
        scores.sort()
        for score, p, _ in [s for s in scores if s[2] == label][:positives]:
            found = [s for s in scores if s[2] != label and low * -score <= 100 * -s[0] <= high * -score][:negatives]
            out += [(a, p, r, i, -score, -s) for r, (s, i, _) in enumerate(found, 1)]
    return sorted(out)


def test_embeddings_against_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = db.sql(H.ORACLE)
    assert rel.columns == H.op13_hard_negatives(spark, sf).columns
    assert sorted(map(tuple, H.op13_hard_negatives(spark, sf).collect())) == sorted(rel.fetchall())


def test_embeddings_against_all_pairs(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, H.op13_hard_negatives(spark, sf).collect())) == by_hand(rows, lambda i: i % 100 == 0)


def made(kind):
    rng = random.Random(kind)
    if kind == "clusters":  # many close rows, many equal scores
        centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
        return [(i, rng.randrange(4), [c + rng.gauss(0, 0.02) for c in rng.choice(centres)]) for i in range(700)]
    if kind == "ties":
        return [(i, i % 3, [1.0, float(i % 2)]) for i in range(300)]
    if kind == "one hot label":
        return [(i, 0 if i % 3 else i % 50, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(600)]
    if kind == "large":  # beyond exact floats, and beyond longs' products but for their sums
        return [(i, i % 3, [rng.choice((1.0, -1.0)) * 10.0 ** rng.randrange(6) for _ in range(3)]) for i in range(200)]
    v = lambda *x: list(x)
    return [
        (0, 1, v(1.0, 0.0)), (1, 1, v(0.9, 0.0)), (2, 2, v(0.8, 0.1)), (3, None, v(1.0, 0.0)), (None, 1, v(1.0, 0.0)), (4, 1, None),
        (5, 2, v(1.0, None)), (6, 2, v(float("nan"), 1.0)), (7, 2, v(float("inf"), 1.0)), (8, 2, v(0.9,)), (9, 2, []), (10, 1, []), (20, 2, []), (11, 2, v(0.85, 0.0)),
        (11, 2, v(0.85, 0.0)), (12, 2, v(-1.0, 0.0)), (30, 3, v(0.1, 0.1)), (40, 4, v(-0.5, 0.2)), (41, 4, v(0.5, -0.2)), (42, 1, v(0.7, 0.0)),
    ]


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("kind", ["clusters", "ties", "one hot label", "large", "odd"])
def test_kinds_of_rows(spark, kind):
    rows = made(kind)
    df = H.rows_of(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = H.mined(df, F.col("vec_id") % 10 == 0, block=20, tree=100)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, lambda i: i % 10 == 0)
    got = H.mined(df, F.col("vec_id") % 50 == 0, positives=2, negatives=3, window=H.Window(20, 90), tree=37)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, lambda i: i % 50 == 0, 2, 3, 20, 90)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mined(H.rows_of(empty), F.col("vec_id") % 100 == 0).collect() == []
    rows = made("odd")
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("row", "vector", "tree", "data", "question", "id", "score", "rank")])
    assert sorted(map(tuple, H.mined(H.rows_of(df), F.col("vec_id") % 10 == 0).collect())) == by_hand(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 256, (20, 16))
    vectors = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(0, 5, (2000, 16))).astype(np.int64)
    tree = H.Tree.build(np.arange(2000), np.zeros(2000, np.int64), vectors)
    for node in range(len(tree.begin)):
        rows = tree.vectors[tree.begin[node] : tree.end[node]].astype(float)
        assert (np.linalg.norm(rows - tree.centre[node], axis=1) <= tree.radius[node] * (1 + 1e-9) + 1e-9).all()
    seen = []
    n = 50
    asked = H.Questions(vectors[:n], np.arange(n), np.arange(n), np.zeros(n, np.int64), np.full(n, H.LEAST), np.full(n, np.iinfo(np.int64).max), np.full(n, H.LEAST), True)
    search = H.Search(asked, 5)
    leaf = search._leaf
    search._leaf = lambda tree, a, b, at: (seen.append((b - a) * len(at)), leaf(tree, a, b, at))
    search.over(H.Tree.from_bytes(tree.to_bytes()))
    assert sum(seen) < 0.5 * n * 2000  # most of the tree isn't scored


def test_scores_are_exact():
    a, b = np.array([[2**40, -3]]), np.array([[2**22, 5]])
    assert H.products(a, b)[0, 0] == 2**62 - 15
    assert H.products(np.array([[2**40]]), np.array([[2**40]]))[0, 0] == 2**63 - 1
