"""The status machine of ingest jobs as a stateful stream.

A job moves forward only: queued, processing, extracting, embedding, indexed, and at last ready or failed, which nothing leaves.
Each change that arrives comes out as accepted or refused with a reason. What Spark keeps of a job is its status, its
time and the stages it went through. A job that hears nothing for the time to live is failed by a timer.

The changes of one job within a batch are put in order of their time and id; a batch is bounded by what the source hands out at
once. A change older than the job's state came too late and is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Statuses in their order; the last two end a job.
ORDER = ("queued", "processing", "extracting", "embedding", "indexed", "ready", "failed")
TERMINAL = ("ready", "failed")
RANK = {s: min(i, 5) for i, s in enumerate(ORDER)}
CHANGE = "job_id string, event_id long, updated_at timestamp, from_status string, status string, accepted boolean, reason string, stages_completed array<string>"
TTL_MS = 24 * 3600 * 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def judged(status: str, at: object, before: str | None, last: object) -> str:
    """Why a change is refused, or ok."""
    if status not in RANK:
        return "unknown status"
    if before is None:
        return "ok"
    if before in TERMINAL:
        return "finished"
    if at < last:
        return "late"
    return "ok" if RANK[status] > RANK[before] else "repeated" if status == before else "backwards"


class JobMachine(StatefulProcessor):
    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, at timestamp, stages array<string>, deadline long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values(["updated_at", "event_id"])
        status, last, stages, _ = self.state.get() if self.state.exists() else (None, None, [], 0)
        stages, moved, out = list(stages or []), False, []
        for event_id, at, wanted in zip(changes.event_id, changes.updated_at, changes.status):
            reason = judged(wanted, at, status, last)
            before = status
            if reason == "ok":
                status, last, moved = wanted, at, True
                stages = stages if wanted in stages else [*stages, wanted]
            out.append((key[0], event_id, at, before, wanted, reason == "ok", None if reason == "ok" else reason, list(stages)))
        if moved:
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms
            self.state.update((status, pd.Timestamp(last).to_pydatetime(), stages, deadline))
            if status not in TERMINAL:
                self.handle.registerTimer(deadline)  # timers set before it find a later deadline and do nothing
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, last, stages, deadline = self.state.get()
        if status in TERMINAL or expiredTimerInfo.getExpiryTimeInMs() < deadline:
            return
        stages = [*stages, "failed"]
        self.state.update(("failed", last, stages, deadline))
        yield pd.DataFrame([(key[0], None, last, status, "failed", True, "expired", stages)], columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def changes_of(stream: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """The verdict on each change. stream: (job_id, event_id, updated_at, status). Needs a RocksDB state store (``use_rocksdb``)."""
    rows = stream.selectExpr("CAST(job_id AS STRING) AS job_id", "event_id", "updated_at", "status")
    return rows.groupBy("job_id").transformWithStateInPandas(JobMachine(ttl_ms), CHANGE, "append", "processingTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
