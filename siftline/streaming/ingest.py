"""Incremental work with Structured Streaming: arriving files, content dedupe, job states, and windows on events."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.connectors import FolderConnector, Work, attempted

STATES = ("queued", "processing", "extracting", "embedding", "indexed", "ready", "failed")


def arriving(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hashed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.withColumn("content_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def deduplicated_into(target: str, text_col: str = "text") -> Callable[[DataFrame, int], None]:
    """A handler that appends each content once, for good: what any earlier batch wrote is met by a join, so no state is
    kept and no content is forgotten. A batch has a folder of its own, so a repeated batch writes the same rows again."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = hashed(batch, text_col).dropDuplicates(["content_hash"])
        for earlier in _batches(batch.sparkSession, target, batch_id):
            new = new.join(earlier.select("content_hash"), "content_hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return handle


def _batches(spark: SparkSession, target: str, before: int) -> list[DataFrame]:
    """The rows of all batches before one, as one table, if there are any."""
    return [spark.read.option("basePath", target).parquet(target).where(F.col("batch") < before)] if before > 0 else []


def replaced_then_appended(target: str) -> Callable[[DataFrame, int], None]:
    """A handler whose first batch replaces what is there and whose later ones append; a repeated batch writes itself again."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            batch.limit(0).write.mode("overwrite").parquet(target)
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return handle


def appended(rows: DataFrame, target: str) -> bool:
    """Appends to a log that may lose rows but never fails a search: says whether it worked."""
    try:
        rows.write.mode("append").parquet(target)
        return True
    except Exception:  # noqa: BLE001  a search must not fail for its log
        return False


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Everything there is now, once; a failed pass leaves the checkpoint where it was, so the next one repeats it."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """What there is now as one batch. For streams with timers by the clock: of these there is always one more batch to run, so
    "all that is available" never ends."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()


def upsert_parquet(target: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps the last row of each key in a folder of versions, one for each batch.

    A repeated batch writes the same version again, so a retry changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch
        if batch_id > 0:
            rows = spark.read.parquet(f"{target}/v{batch_id - 1}").unionByName(batch)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order)).alias("_v"))
        last.select("_v.*").write.mode("overwrite").parquet(f"{target}/v{batch_id}")

    return handle


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest version that ``upsert_parquet`` wrote; found through Spark's file source, in any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(target).inputFiles()
    return spark.read.parquet(f"{target}/v{max(int(m[1]) for f in files if (m := re.search(r'/v([0-9]+)/[^/]*$', f)))}")


def job_states(changes: DataFrame) -> DataFrame:
    """(job_id, status, stages_completed, updated_at): the state machine of each job, in batch or streaming mode.

    The last status by time wins; stages only ever add up.
    """
    order = F.struct("updated_at", "event_id")
    return changes.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.array_sort(F.collect_set("status")).alias("stages_completed"), F.max("updated_at").alias("updated_at"))


def tumbling(events: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind, late events dropped by watermark. An extension on event streams."""
    by = F.window("ts", width)
    counted = events.withWatermark("ts", delay).groupBy(by, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start_at"), "event_type", "n", F.round("value", 6).alias("value"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events without a pause of ``gap``. An extension on event streams."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start_at"), "n")


def sync(connector: FolderConnector, target: str, work: Work, schema: str) -> dict[str, int]:
    """One pass over what came since the last: ``work`` on each item, its results and failures written with the position.

    An item's failure is a row of the table of dead letters and holds up nothing else. If the pass itself fails, the checkpoint
    stays where it was and the next pass repeats it; a repeated batch writes itself again. Returns what the pass saw.
    """
    seen: list[int] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        attempted(batch, work, schema).write.mode("overwrite").parquet(f"{target}/items/batch={batch_id}")
        seen.append(batch_id)

    run_available(connector.stream(), f"{target}/checkpoint", handle)
    if not seen:
        return {"discovered": 0, "failed": 0}
    rows = connector.spark.read.parquet(f"{target}/items").where(F.col("batch").isin(seen))
    row = rows.agg(F.count("*").alias("n"), F.count("error").alias("failed")).first()
    return {"discovered": row.n, "failed": row.failed}


def _last_attempts(spark: SparkSession, target: str) -> DataFrame:
    """The last attempt at each path: a file that was written again is taken again."""
    rows = spark.read.parquet(f"{target}/items")
    return rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), F.struct("cursor", "batch")).alias("_last")).select("_last.*")


def synced(spark: SparkSession, target: str) -> DataFrame:
    """What ``sync`` has, by its last attempt at each item."""
    return _last_attempts(spark, target).where("error IS NULL").drop("error", "batch")


def dead_letters(spark: SparkSession, target: str) -> DataFrame:
    """(path, cursor, error) of the items whose last attempt failed."""
    return _last_attempts(spark, target).where("error IS NOT NULL").select("path", "cursor", "error")
