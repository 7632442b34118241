import math

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import filters, ranking, rerank, vectors
from siftline.operators.lexical import LexicalIndex, ranked


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_tokens_and_stems(spark):
    terms = one(spark, T.analysed, "The Payments were failing: TX82931, stopped boxes; cities as usual! Classes")
    assert terms == ["payment", "fail", "tx82931", "stop", "box", "city", "usual", "class"]
    assert one(spark, T.analysed, None) == [] and one(spark, T.analysed, "") == []


def test_sentences_and_slices(spark):
    assert one(spark, T.sentences, "One. Two!\nthree  four? five") == ["One.", "Two!", "three  four?", "five"]
    assert one(spark, lambda c: T.hard_split(c, 2), "a b c d e") == ["a b", "c d", "e"]
    assert one(spark, lambda c: T.hms(c.cast("double")), "3725.9") == "01:02:05"
    assert one(spark, T.paragraphs, " a  b\n c\n\n \n d ") == ["a b\nc", "d"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "payment failed"), (2, "payment payment ok"), (3, "nothing here")], "doc_id long, text string")
    index = LexicalIndex.build(docs)
    got = {r.doc_id: r.score for r in index.scores(spark.createDataFrame([(7, "payments")], "query_id long, text string")).collect()}
    idf, avg = math.log(1 + 1.5 / 2.5), (2 + 3 + 2) / 3
    by_hand = lambda tf, n: round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg)), 6)
    assert got == {1: by_hand(1, 2), 2: by_hand(2, 3)}
    absent = spark.createDataFrame([(8, "imran")], "query_id long, text string")
    assert index.scores(absent).collect() == []


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    query = spark.createDataFrame([(1, "beta gamma")], "query_id long, text string")
    index = LexicalIndex.build(docs)
    index.write(f"file://{tmp_path}/i", buckets=4)
    back = LexicalIndex.read(spark, f"file://{tmp_path}/i")
    assert sorted(ranked(back.scores(query)).collect()) == sorted(ranked(index.scores(query)).collect())


def test_nearest_neighbours(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.9, 0.1, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    got = vectors.knn(rows, asked, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 4] and got[0].score == 1.0
    with pytest.raises(Exception, match="dimension"):
        vectors.knn(rows, spark.createDataFrame([(9, [1.0])], "query_id long, embedding array<double>"), 3).collect()


def candidates(spark):
    return spark.createDataFrame([(1, "lexical", 10, 1, 4.0), (1, "lexical", 11, 2, 2.0), (1, "dense", 12, 1, 0.9), (1, "dense", 10, 2, 0.5), (1, "exact_id", 13, 1, 1.0)], "query_id long, retriever string, chunk_id long, rank long, score double")


def test_gate_comes_before_normalising(spark):
    rows = ranking.fused(candidates(spark)).withColumns({"rerank": F.lit(None).cast("double"), "metadata_match": F.lit(0.5), "source_reliability": F.lit(0.7), "freshness": F.lit(0.5)})
    got = {r.chunk_id: r for r in ranking.scored(rows).collect()}
    assert set(got) == {10, 11, 13}  # cosine alone is no evidence
    assert got[10].lexical_norm == 1.0 and got[13].place == 1 and got[13].final >= 1.0
    assert abs(sum(ranking.rebalanced().values()) - 1.0) < 1e-9 and ranking.budget("odd") == (200, 40)


def test_flat_signals(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 0.0), (3, None)], "query_id long, s double")
    assert sorted(r.n for r in rows.select("query_id", ranking.normalised("s").alias("n")).where("query_id < 3").collect()) == [0.0, 1.0, 1.0]
    assert rows.where("query_id = 3").select(ranking.normalised("s").alias("n")).first().n is None


def test_filter_dialect(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, None, ["y"]), (3, "b", None)], "id long, s string, tags array<string>")
    ids = lambda c, **k: [r.id for r in rows.where(filters.compiled(c, **k)).collect()]
    assert ids({"s": ["a", "b"]}) == [1, 3] and ids({"s": {"eq": "a"}}) == [1] and ids({"tags": {"any": ["y", "z"]}}, array_columns=("tags",)) == [2]
    for bad in ({"s": []}, {"s": {"eq": 1, "in": [2]}}, {"s": {"like": 1}}):
        with pytest.raises(ValueError):
            filters.compiled(bad)


def test_permissions(spark):
    rows = spark.createDataFrame([("s1", [], []), ("s2", ["admin"], []), ("s1", [], ["admin"]), ("s3", None, None)], "source string, sr array<string>, cr array<string>")
    ok = lambda **k: [r.ok for r in rows.select(filters.permitted(F.col("source"), F.col("sr"), F.col("cr"), "analyst", **k).alias("ok")).collect()]
    assert ok() == [True, False, False, True] and ok(denied=("s1",)) == [False, False, False, True] and ok(access=("s2",)) == [False, True, False, False]


def test_overlap_by_hand(spark):
    asked = spark.createDataFrame([(1, "tx82931 failed why")], "query_id long, text string")
    rows = spark.createDataFrame([(1, 1, "tx82931 failed"), (1, 2, "other words")], "query_id long, chunk_id long, text string")
    got = {r.chunk_id: r.overlap for r in rerank.idf_overlap(asked, rows).collect()}
    idf = math.log(1 + 2 / 2)
    assert got == {1: round(min(1.0, 2 * idf / (2 * idf + 1.0) + 0.35), 6), 2: 0.0}


def test_more_queries_than_a_block_holds(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(23)], "vec_id long, embedding array<double>")
    asked = rows.withColumnRenamed("vec_id", "query_id").repartition(3)
    found = lambda: sorted(map(tuple, vectors.knn(rows, asked, 4).collect()))
    want = found()
    monkeypatch.setattr(vectors, "MAX_QUERIES", 5)
    assert found() == want and len(want) == 23 * 4


def test_blocks_of_queries_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 10 * 8 * 4)
    rows = spark.createDataFrame([(i, [1.0, float(i), 2.0, 0.5]) for i in range(100)], "query_id long, embedding array<double>")
    blocks = list(vectors._query_blocks(rows))
    assert len(blocks) > 5 and max(m.nbytes for _, m in blocks) < 30 * 8 * 4
    assert sorted((int(i), v) for ids, m in blocks for i, v in zip(ids, m[:, 1])) == [(i, float(i)) for i in range(100)]


def test_dense_text_search_against_brute_force(spark, sf):
    import numpy as np

    from siftline.functions import embed
    from siftline.plans import retrieval

    docs = [(r.doc_id, np.array(embed.embed(r.text))) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    asked = {r.item_id: np.array(embed.embed(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {}
    for r in retrieval.dense_text_search(spark, sf).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, v in list(asked.items())[:10]:
        best = sorted((-round(float(v @ d), 6), i) for i, d in docs)[:10]
        assert [i for _, i in sorted(found[q])] == [i for _, i in best]
