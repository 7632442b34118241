"""Where tables that outlive a query are kept, and what a table of files is known by."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for local masters a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that plans above it start from a table."""
    path = f"{shared(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identity(df: DataFrame, *more: str) -> str:
    """A digest of the files of a table as it was read, with their sizes and times: no column is read for it."""
    meta = df.select(*[F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]).distinct()
    each = F.xxhash64(*meta.columns, *[F.lit(m) for m in more])
    row = meta.agg(F.bit_xor(each).alias("x"), F.sum(F.pmod(each, F.lit(1 << 40))).alias("s"), F.count("*").alias("n")).first()
    return f"{(row.x or 0) & (1 << 64) - 1:016x}{row.s or 0:x}-{row.n}"
