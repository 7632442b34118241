import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.operators import order_stats
from siftline.streaming import ingest, jobs

T0 = datetime(2026, 1, 1)


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    jobs.use_rocksdb(spark)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def run(spark, tmp_path, rows, ttl_ms=jobs.TTL_MS):
    schema = "job_id string, event_id long, updated_at timestamp, status string"
    spark.createDataFrame([(j, i, T0 + timedelta(minutes=m), s) for j, i, m, s in rows], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    ingest.run_once(jobs.changes_of(stream, ttl_ms), f"file://{tmp_path}/cp", lambda b, n: b.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={n}"))
    return {(r.job_id, r.event_id): r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}


def test_changes_are_refused_and_state_outlives_a_restart(spark, tmp_path, rocksdb):
    got = run(spark, tmp_path, [("a", 2, 2, "processing"), ("a", 1, 1, "queued"), ("a", 3, 3, "queued"), ("b", 1, 1, "ready"), ("b", 2, 2, "failed"), ("c", 1, 1, "dancing")])
    assert got["a", 1].accepted and got["a", 2].accepted and got["a", 2].from_status == "queued"
    assert got["a", 3].reason == "backwards" and got["b", 2].reason == "finished" and got["c", 1].reason == "unknown status"
    got = run(spark, tmp_path, [("a", 4, 0, "indexed"), ("a", 5, 9, "processing"), ("a", 6, 10, "ready"), ("a", 7, 11, "ready"), ("c", 2, 5, "queued")])
    assert got["a", 4].reason == "late" and got["a", 5].reason == "repeated" and got["a", 7].reason == "finished"
    assert got["a", 6].accepted and list(got["a", 6].stages_completed) == ["queued", "processing", "ready"] and got["c", 2].accepted


def test_a_job_that_hears_nothing_expires(spark, tmp_path, rocksdb):
    run(spark, tmp_path, [("a", 1, 1, "queued"), ("b", 1, 1, "ready")], ttl_ms=1)
    time.sleep(0.2)
    got = run(spark, tmp_path, [("z", 1, 1, "queued")], ttl_ms=1)
    assert got["a", None].status == "failed" and got["a", None].reason == "expired" and ("b", None) not in got
    got = run(spark, tmp_path, [("a", 2, 5, "processing")], ttl_ms=10**9)
    assert got["a", 2].reason == "finished"


def middle(values):
    v = sorted(values)
    n = len(v)
    return n, v[(n + 1) // 2 - 1], v[n // 2], (v[(n + 1) // 2 - 1] + v[n // 2]) / 2


def test_medians_of_any_groups(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.choice([1, 2, 2, 2, 3]))) for _ in range(500)] + [("odd", rng.uniform(-5, 5)) for _ in range(101)] + [("even", rng.uniform(-5, 5)) for _ in range(40)] + [("one", 7.0), (None, 1.0), (None, 4.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    for ranges in (1, 7, 64):
        got = {r.k: (r.n, r.lower, r.upper, r.middle) for r in order_stats.medians(df, ["k"], "v", ranges).collect()}
        assert got == {k: middle(v) for k, v in want.items()}
    every = order_stats.medians(df, [], "v", 9).collect()
    assert [(r.n, r.lower, r.upper, r.middle) for r in every] == [middle([v for _, v in rows if v is not None])]
    top = order_stats.at_ranks(df, ["k"], "v", {"least": F.lit(1), "most": F.col("n"), "none": F.col("n") + 1}).collect()
    assert {r.k: (r.least, r.most, r.none) for r in top} == {k: (min(v), max(v), None) for k, v in want.items()}
    assert order_stats.medians(df.where("false"), ["k"], "v").collect() == []
