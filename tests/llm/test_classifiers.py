import zlib

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import pu_quality as Q
from siftline.llm import toxicity as T

BIG = "/root/testdata/sf0.01"


def labels_of(spark, sf, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def auc(scores, truth):
    good, bad = scores[truth == 1], scores[truth == 0]
    return float(np.mean([(g > bad).mean() + 0.5 * (g == bad).mean() for g in good]))


def check_shape(rows, n, folds, held):
    assert len(rows) == n
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)


def test_toxicity_on_held_out_rows(spark):
    rows = T.op2_toxicity(spark, BIG).collect()
    check_shape(rows, 1000, 4, 2)
    truth = labels_of(spark, BIG, "toxic")
    clean = [r for r in rows if truth.get(r.doc_id) == 0]
    toxic = [r for r in rows if truth.get(r.doc_id) == 1 and r.held_out]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)


def test_verdicts_do_not_hang_on_the_size_of_the_sample(spark):
    """One tenth of the texts are toxic; a sample that holds as many of either label must not call half of them so."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = labels.where("toxic is not null").select("doc_id", "toxic")

    def shares(per_class):
        rows = T.scored(docs, T.fit(docs, labels, per_class)).join(truth, "doc_id").where(T.fold("doc_id", 4) == 2)
        return {r.toxic: r.share for r in rows.groupBy("toxic").agg(F.avg((F.col("score") >= T.THRESHOLD).cast("int")).alias("share")).collect()}

    all_rows, few = shares(8_000), shares(300)
    assert all_rows[1] > 0.92 and all_rows[0] < 0.01
    assert few[1] > 0.9 and few[0] < 0.03


def test_texts_without_a_sign_get_the_true_share(spark):
    rows = [(i, f"plain words number {i}" if i % 10 else f"plain words and vilething number {i}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (1000, ""), (1001, " ".join(["plain"] * 50_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    for per_class in (8_000, 25):
        model = T.fit(docs, labels, per_class)
        assert model.terms
        scores = {r.doc_id: r.score for r in T.scored(docs, model).collect()}
        assert scores[None] == scores[1000] == scores[1001] < 0.1
        assert all((scores[i] >= 0.3) == (i % 10 == 0) for i, _ in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(T.fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, flipped)
    assert a.terms == b.terms and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_label_model_weighs_voters():
    rng = np.random.default_rng(5)
    truth = rng.random(3000) < 0.2
    votes = np.stack([rng.random(3000) < np.where(truth, hit, miss) for hit, miss in ((0.8, 0.01), (0.7, 0.02), (0.6, 0.01))], 1)
    votes = np.column_stack([votes, votes[:, 0], ~votes.any(1)]).astype(np.uint8)  # the fourth repeats the first
    anchors = np.array([[0.02, 0.02, 0.02, 0.02, 0.95], [0.5, 0.5, 0.5, 0.5, 0.1]])
    posterior, say = T.label_model(votes, anchors, 0.2)
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert say[0] < 0.7 and say[3] < 0.7 and say[1] > say[0]


def test_toxicity_odd_rows(spark, odd, clashing, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(odd, none)
    assert len({round(r.score, 9) for r in T.scored(odd, model).collect()}) == 1
    assert T.scored(empty, model).collect() == []
    some = spark.createDataFrame([(1, None, 1), (2, 1, 1), (3, 1, 0), (5, 1, 0), (5, 1, None), (6, 0, 7)], "doc_id long, quality int, toxic int")
    kept = T.kept_rows(clashing, clashing, some)
    assert kept.columns == clashing.columns and kept.count() <= clashing.count()


def test_quality_on_held_out_rows(spark):
    rows = Q.op5_quality_classifier(spark, BIG).collect()
    check_shape(rows, 1000, 5, 0)
    truth = labels_of(spark, BIG, "quality")
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    scores, y = np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held])
    assert auc(scores, y) > 0.95 and np.mean([r.predicted for r in held if truth[r.doc_id] == 1]) > 0.95


def test_class_prior_and_risk():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (6000, 3)), rng.normal(2.5, 1, (6000, 3))
    mixed = np.vstack([good[2000:4100], bad[:900]])  # 70 % good
    edges = Q.intervals(mixed)
    prior = Q.class_prior(good[:2000], mixed, edges)
    assert 0.6 < prior < 0.75
    model = Q.fit_pu(good[:2000], mixed, prior, edges)
    assert (model.scores(good[4100:]) > 0.5).mean() > 0.9 and (model.scores(bad[1000:]) < 0.5).mean() > 0.9


def test_quality_odd_rows(spark, odd, clashing, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.scored(odd, Q.fit(odd, none)).collect()} == {0.5}
    assert Q.scored(empty, Q.fit(empty, none)).collect() == []
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (7, None, 0), (8, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.scored(clashing, Q.fit(clashing, some)).count() == clashing.count()
