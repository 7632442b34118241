import zlib

import pytest
from pyspark.sql import functions as F

from siftline.llm import sharding as S


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000, 4097])
def test_permutation_and_its_inverse(spark, n):
    rows = spark.range(n).select("id", S.permuted(F.col("id"), n).alias("p")).withColumn("back", S.unpermuted(F.col("p"), n)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def check(found, n):
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == n
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(S.SHARDS)]
    assert max(sizes) - min(sizes) <= 1


def test_documents(spark, sf, docs):
    found = S.op4_sharding(spark, sf).collect()
    check(found, len(docs))
    texts = {i: t or "" for i, t, _ in docs}
    for r in found:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    again = S.op4_sharding(spark, sf).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in found}


def test_odd_rows_and_clashing_names(clashing, empty):
    found = S.sharded(clashing, ["doc_id", "text"])
    assert found.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    check(found.collect(), clashing.count())
    assert S.sharded(empty, ["doc_id"]).collect() == []


def test_shards_as_folders(spark, odd, tmp_path):
    S.write_shards(S.sharded(odd, ["doc_id", "text"], shards=3), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == odd.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_a_hot_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 20)
    rows = spark.createDataFrame([(None, "")] * 300 + [(i, "x") for i in range(50)], "doc_id long, text string").repartition(4)
    found = S.sharded(rows, ["doc_id", "text"]).collect()
    check(found, 350)
    salted = S.spread(rows, ["doc_id", "text"])
    assert salted.where("doc_id IS NULL").select("_salt").distinct().count() > 50 and salted.where("doc_id IS NOT NULL AND _salt <> 0").count() == 0
    again = S.sharded(rows, ["doc_id", "text"]).collect()
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in again) == sorted((r.doc_id or -1, r.shard, r.slot) for r in found)
