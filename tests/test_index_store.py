import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftline.operators import index_store as S
from siftline.operators.lexical import LexicalIndex, ranked

WORDS = ["alpha", "beta", "gamma", "delta", "running", "runs", "boxes", "the", "of", "x1", "über", "日本"]


def some_docs(rng, ids):
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for i in ids]


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    monkeypatch.setattr(S, "POSTINGS", 60)
    monkeypatch.setattr(S, "SAMPLE", 3)


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def assert_same_as_a_rebuild(spark, index, docs):
    fresh = LexicalIndex.build(spark.createDataFrame(docs or [(0, "")], "doc_id long, text string").where("true" if docs else "false"))
    assert as_rows(index.postings().select("doc_id", "term", "tf", "length")) == as_rows(fresh.postings.select("doc_id", "term", "tf", "length"))
    assert as_rows(index.df()) == as_rows(fresh.df)
    corpus = fresh.corpus.first()
    n, avg = index.totals()
    assert n == corpus.n == len(docs) and math.isclose(avg, corpus.avg_len)
    asked = spark.createDataFrame([(1, "alpha of the boxes"), (2, "running über x1 x1"), (3, "nothing known"), (4, "")], "query_id long, text string")
    for k in (1, 3, 100):
        assert as_rows(index.search(asked, k)) == as_rows(ranked(fresh.scores(asked), k).select("query_id", "doc_id", "score", "rank"))
    some = spark.createDataFrame([(i,) for i, _ in docs if i % 3 == 0] + [(10**9,)], "doc_id long")
    assert as_rows(index.search(asked, 4, some)) == as_rows(ranked(fresh.scores(asked, some), 4).select("query_id", "doc_id", "score", "rank"))


def test_upkeep_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    index = S.TextIndex(spark, f"file://{tmp_path}/ix")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    held = dict(some_docs(rng, range(40)))
    index.write(frame(list(held.items())))
    assert_same_as_a_rebuild(spark, index, sorted(held.items()))
    changed = dict(some_docs(rng, [3, 5, 8, 39, 50, 51]))  # some replace, some are new
    index.write(frame(list(changed.items())))
    held |= changed
    index.delete(spark.createDataFrame([(1,), (2,), (5,), (777,)], "doc_id long"))
    for i in (1, 2, 5):
        del held[i]
    assert_same_as_a_rebuild(spark, index, sorted(held.items()))
    again = dict(some_docs(rng, [2, 3]))  # one that was deleted comes back
    index.write(frame(list(again.items())))
    held |= again
    before = index.store.manifest()
    assert len(before.segments) >= 3 and before.tombstones
    index.merge()
    after = index.store.manifest()
    assert len(after.segments) == 1 and not after.tombstones and after.version == before.version + 1
    assert_same_as_a_rebuild(spark, index, sorted(held.items()))
    index.delete(frame(list(held.items())).select("doc_id"))
    assert index.totals() == (0, 1.0) and index.df().count() == 0 and index.postings().count() == 0


def test_of_two_writers_one_is_told(spark, tmp_path):
    index = S.TextIndex(spark, f"file://{tmp_path}/ix")
    index.write(spark.createDataFrame([(1, "alpha")], "doc_id long, text string"))
    base = index.store.manifest()
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(S.ConcurrentCommit):
        index.store.commit({}, None, {"n": 5}, base)
    assert index.totals()[0] == 0
    other = S.TextIndex(spark, f"file://{tmp_path}/ix", {"analyser": 2})
    assert other.store.path != index.store.path and other.totals() == (0, 1.0) and other.search(spark.createDataFrame([(1, "alpha")], "query_id long, text string"), 3).count() == 0


def test_odd_documents(spark, tmp_path, ):
    rows = [(None, "alpha"), (1, None), (2, ""), (3, "of the"), (4, "alpha " * 5000), (5, "alpha"), (5, "alpha beta")]
    index = S.TextIndex(spark, f"file://{tmp_path}/ix")
    index.write(spark.createDataFrame(rows, "doc_id long, text string"))
    assert index.totals()[0] == 5
    found = as_rows(index.search(spark.createDataFrame([("q", "alpha")], "query_id string, text string"), 10))
    assert [r[1] for r in found] == [5, 4] or [r[1] for r in found] == [4, 5]
    empty = S.TextIndex(spark, f"file://{tmp_path}/none")
    empty.write(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.totals() == (0, 1.0)


def test_bounds_spare_most_pairs(spark, sf, tmp_path, monkeypatch):
    """Same rows as scoring every document that shares a word, with a part of the pairs scored to the end."""
    monkeypatch.setattr(S, "POSTINGS", 4_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    full = LexicalIndex.build(docs)
    index = S.TextIndex(spark, f"file://{tmp_path}/ix")
    index.write(docs)
    scores = full.scores(asked)
    found, pairs = index.counted(asked, 10)
    close = lambda rows: [(q, d, round(s, 5), r) for q, d, s, r in rows]
    assert close(as_rows(found)) == close(as_rows(ranked(scores, 10).select("query_id", "doc_id", "score", "rank")))
    assert pairs * 10 < scores.count()


def test_questions_of_the_same_terms_are_searched_once(spark, tmp_path):
    index = S.TextIndex(spark, f"file://{tmp_path}/same")
    index.write(spark.createDataFrame([(i, f"order {i} of priority {i % 3}") for i in range(60)], "doc_id long, text string"))
    ask = lambda n: spark.createDataFrame([(q, f"why did {q + 900} of priority 2 fail") for q in range(n)], "query_id long, text string")
    found, pairs = index.counted(ask(300), 5)
    rows = found.collect()
    assert pairs == index.counted(ask(1), 5)[1] and len(rows) == 1500 and {r.query_id for r in rows} == set(range(300))
    assert {(r.rank, r.doc_id) for r in rows} == {(r.rank, r.doc_id) for r in index.search(ask(1), 5).collect()}


def test_what_no_manifest_names_goes(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = S.TextIndex(spark, f"file://{tmp_path}/kept")
    index.write(docs((1, "one order"), (2, "two orders"), (3, "three")))
    index.delete(docs((3, "")).select("doc_id"))
    index.merge()
    index.store.expire()
    found = index.search(spark.createDataFrame([(7, "order three")], "query_id long, text string"), 5)
    assert [(r.doc_id, r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    at = tmp_path / "kept" / index.store.version
    assert len(list((at / "segments").iterdir())) == 1 and not list((at / "tombstones").iterdir())
    assert not list(at.glob("work/*/tf")) and not list(at.glob("work/*/found-*")) and not list(at.glob("work/*/words"))
