"""Streams over the event and document tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftline.plans.base import Registry, table
from siftline.sources import folders
from siftline.streaming import ingest, jobs

query = Registry()


def _folder(spark: SparkSession) -> str:
    """A new folder that the whole cluster shares."""
    return f"{folders.shared(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir: str, name: str):
    """A table as a stream, whether it is one file or a folder of them."""
    like = table(spark, sf_dir, name)
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet")
    return reader.option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parque[t]")


@query("SELECT sha256(text) AS content_hash FROM documents GROUP BY 1")
def stream_ingest_dedupe(spark, sf_dir):
    folder = _folder(spark)
    ingest.run_available(_stream(spark, sf_dir, "documents"), f"{folder}/checkpoint", ingest.deduplicated_into(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").select("content_hash")


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, list_sort(list(DISTINCT event_type)) AS stages_completed, max(ts) AS updated_at FROM events GROUP BY ALL")
def stream_job_state(spark, sf_dir):
    """Each batch writes a version of its own, so that a batch that fails leaves the one before."""
    folder = _folder(spark)
    changes = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), "event_id")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/states/v{n}")  # noqa: E731  complete mode: the whole table
    ingest.job_states(changes).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ingest.latest(spark, f"{folder}/states")


_STATUS = {"view": "queued", "click": "processing", "signup": "embedding", "purchase": "indexed", "error": "failed"}
_RANKED = "CASE " + " ".join(f"WHEN status = '{s}' THEN {r}" for s, r in jobs.RANK.items()) + " ELSE -1 END"


@query(f"""WITH e AS (SELECT user_id, event_id, ts, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} ELSE event_type END AS status FROM events),
r AS (SELECT *, {_RANKED} AS rank FROM e),
t AS (SELECT *, max(rank) OVER w AS top, arg_max(status, (rank, -epoch_us(ts), -event_id)) OVER w AS was FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id::VARCHAR AS job_id, event_id, CASE WHEN top >= 0 THEN was END AS from_status, status, rank >= 0 AND rank > coalesce(top, -1) AS accepted,
  CASE WHEN rank < 0 THEN 'unknown status' WHEN rank > coalesce(top, -1) THEN NULL WHEN top = 5 THEN 'finished' WHEN status = was THEN 'repeated' ELSE 'backwards' END AS reason FROM t""")
def stream_job_machine(spark, sf_dir):
    """Events of a user as changes of a job: what the status machine accepts, and why it refuses the rest."""
    folder = _folder(spark)
    events = _stream(spark, sf_dir, "events")
    status = F.coalesce(F.create_map(*[F.lit(x) for p in _STATUS.items() for x in p])[F.col("event_type")], F.col("event_type"))
    changes = events.select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("updated_at"), status.alias("status"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    jobs.use_rocksdb(spark)
    try:
        ingest.run_once(jobs.changes_of(changes), f"{folder}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{folder}/changes").select("job_id", "event_id", "from_status", "status", "accepted", "reason")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def stream_upsert(spark, sf_dir):
    """The last event of each user, kept in versions of a table."""
    folder = _folder(spark)
    rows = _stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("moment"))
    ingest.run_available(rows, f"{folder}/checkpoint", ingest.upsert_parquet(f"{folder}/out", "user_id", "moment"))
    return ingest.latest(spark, f"{folder}/out").select("user_id", "event_type", "event_id")


@query("SELECT event_id, event_type FROM events")
def stream_row_load(spark, sf_dir):
    """Rows of a table in batches: the first replaces, others append."""
    folder = _folder(spark)
    spark.range(3).write.parquet(f"{folder}/out")
    ingest.run_available(_stream(spark, sf_dir, "events").select("event_id", "event_type"), f"{folder}/checkpoint", ingest.replaced_then_appended(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").select("event_id", "event_type")


@query("SELECT user_id, count(*) AS searches, max(ts) AS last_at FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL")
def search_history(spark, sf_dir):
    """Searches appended to a log in the background, and what it says of each user."""
    log, events = f"{_folder(spark)}/log", table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    for kind in ("view", "click", "purchase"):
        ingest.appended(events.where(F.col("event_type") == kind), log)
    return spark.read.parquet(log).groupBy("user_id").agg(F.count("*").alias("searches"), F.max("ts").alias("last_at"))


@query("SELECT user_id, min(ts) AS start_at, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s")
def ext_session_windows(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_at, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def ext_tumbling_windows(spark, sf_dir):
    return ingest.tumbling(table(spark, sf_dir, "events"), "1 hour")
