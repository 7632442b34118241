"""Helpers that the corpus operators share: reading tables, staging small tables, the word rule."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space. ``bytes.split()`` applies the same rule.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data set; read by Spark alone, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for local masters a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def run_folder(spark: SparkSession) -> str:
    """Where this application stages its tables."""
    return f"{shared_folder(spark)}/siftline-{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Deletes what this application staged; for when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again.

    This cuts the lineage: what follows survives lost executors without running ``df`` again, and Spark knows
    the size of the table. Used for small tables (ids, hashes, counts), not for texts.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Inside, what is planned and run hands tasks' Python at most ``rows`` rows at a time; whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. In a text of ASCII alone lower() does just that, several times faster."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lower_bytes(data: bytes) -> bytes:
    """The same for UTF-8 bytes inside a task."""
    return data.translate(_ASCII_LOWER)


def in_blocks(values, size: int):
    """Slices of at most ``size`` items."""
    for at in range(0, len(values), size):
        yield values[at : at + size]


def lowest_hashes(df: DataFrame, limit: int, column: str = "doc_id") -> DataFrame:
    """A bounded sample: the ``limit`` rows of lowest hash of a column, the same in every run.

    Tasks hand on rows below a cut-off alone that leaves a few more than ``limit`` in all, so that what reaches the
    driver does not grow with the number of tasks. Hashes spread evenly, so the cut-off does not change the result.
    """
    rows = df.count()
    rank = F.shiftrightunsigned(F.xxhash64(column), 1)
    share = (limit + 10 * limit**0.5 + 100) / max(1, rows)
    if share < 0.5:
        df = df.where(rank < int(share * 2.0**63))
    return df.orderBy(rank, column).limit(limit)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct ``row``, with the given columns beside it, so that no name of ``df`` can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def in_row(name: str) -> Column:
    """A column of ``df`` inside its packed row."""
    return F.col(f"row.`{name}`")
