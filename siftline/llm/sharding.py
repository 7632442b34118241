"""Sharding by a Feistel permutation with cycle walking over global row numbers, with DataFrame functions only.

Every row gets a number from 0 to n - 1, the permutation maps the number to a position, and the position gives the
place: shard = position mod shards, slot = position div shards. Counts of shards therefore differ by one at most
(the law ``rows``), slots have no gaps, and where a number lands can be computed without the data (``permuted``),
as can the number that landed at a place (``unpermuted``).

The permutation works on the grid a x b with a = ceil(sqrt(n)), b = ceil(n / a): each round adds a keyed hash of one
coordinate to the other. Less than a of the a * b positions lie beyond n; a number that falls there walks on along
its cycle until it is inside. Positions beyond n are so few that WALK steps always end it: fewer than WALK of them
exist below WALK squared rows, and above that the odds of meeting WALK in a row are under (1 / WALK) ** WALK. A walk
that did not end would raise an error rather than give a wrong place.

Row numbers come from the rows themselves, not from the layout of partitions: a row belongs to one of BUCKETS hash
buckets of its key columns, and its number is the count of rows in earlier buckets plus its rank inside. So reruns,
retries after a lost executor and other cluster sizes give the same places. The counts of buckets (BUCKETS rows) are
the only thing that meets in one task or is broadcast. Keys that more than CROWD rows repeat are dealt over SPREAD
buckets, so no bucket holds a hot key whole; which of its rows gets which of its places is all that is left to chance.

Defined cases. A null text has size 1 and the CRC-32 of the empty text. Rows that repeat all key columns get places of
their own, in no particular order among themselves, which makes them interchangeable. Null ids are ordinary keys.
An empty table gives an empty result. Other columns are carried along by ``sharded``, but for its own shard and slot,
which it replaces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import packed, staged, table

SHARDS, SEED, ROUNDS, BUCKETS, WALK, CROWD, SPREAD = 16, 20_240_229, 6, 4096, 64, 10_000, 256


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest grid near the square root of ``n`` that holds ``n`` positions."""
    a = math.isqrt(max(0, n - 1)) + 1
    return a, max(1, -(-n // a))


def _mix(side: Column, step: int, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(side, F.lit(step), F.lit(seed).cast("long")), F.lit(modulus).cast("long"))


def _split(number: Column, by: int) -> tuple[Column, Column]:
    """Quotient and remainder; exact below 2 ** 53."""
    rest = F.pmod(number, F.lit(by).cast("long"))
    return ((number - rest) / F.lit(by)).cast("long"), rest


def _once(number: Column, n: int, seed: int, back: bool = False) -> Column:
    """One pass over the grid, or its inverse. Rounds change x and y in turn."""
    a, b = grid(n)
    x, y = _split(number, b)
    for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if step % 2:
            y = F.pmod(y - _mix(x, step, seed, b) if back else y + _mix(x, step, seed, b), F.lit(b).cast("long"))
        else:
            x = F.pmod(x - _mix(y, step, seed, a) if back else x + _mix(y, step, seed, a), F.lit(a).cast("long"))
    return x * F.lit(b).cast("long") + y


def _walked(number: Column, n: int, seed: int, back: bool) -> Column:
    inside = lambda at: at < F.lit(n).cast("long")
    first = _once(number, n, seed, back)
    steps = F.sequence(F.lit(1), F.lit(WALK))
    walk = F.aggregate(steps, first, lambda at, _: F.when(inside(at), at).otherwise(_once(at, n, seed, back)))
    walk = F.aggregate(F.array(walk), F.lit(0).cast("long"), lambda _, at: F.when(inside(at), at).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long")))
    return F.when(inside(first), first).otherwise(walk)


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """Position of row ``number`` among ``n``."""
    return _walked(number.cast("long"), n, seed, False)


def unpermuted(position: Column, n: int, seed: int = SEED) -> Column:
    """Row number at ``position``."""
    return _walked(position.cast("long"), n, seed, True)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_salt``: zero, but for rows of keys that more than CROWD rows repeat a number below SPREAD. Written and read
    again, so that it stays what it is when a task runs twice."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > CROWD).drop("_rows")
    hot = staged(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot")), "hot")
    if hot.isEmpty():
        return df.withColumn("_salt", F.lit(0).cast("long"))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    salt = F.when(F.col("_hot"), F.floor(F.rand(SEED) * SPREAD)).otherwise(0).cast("long")
    return staged(df.join(hot, same, "left").withColumn("_salt", salt).select(*df.columns, "_salt"), "spread")


def numbered(df: DataFrame, keys: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """Adds global row numbers from 0, which depend on the rows alone, and returns how many there are."""
    df = spread(df, keys)
    bucket = F.pmod(F.xxhash64(*keys, "_salt"), F.lit(BUCKETS)).cast("int")
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = staged(counts.select("_bucket", "_rows", F.coalesce(before, F.lit(0)).alias("_before")), "buckets")
    n = counts.agg(F.sum("_rows")).first()[0] or 0
    out = df.withColumn("_bucket", bucket).join(F.broadcast(counts), "_bucket")  # BUCKETS rows at most
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(*[F.asc_nulls_first(k) for k in keys], "_salt"))
    out = out.withColumn(number, (F.col("_before") + rank - 1).cast("long"))
    return out.drop("_bucket", "_rows", "_before", "_salt"), n


def sharded(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds shard and slot. ``keys`` should tell rows apart; all other columns are carried along."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = packed(df.drop("shard", "slot"), **{n: F.col(k) for n, k in zip(names, keys)})
    rows, n = numbered(rows, names, "number")
    slot, shard = _split(F.col("position"), shards)
    rows = rows.withColumn("position", permuted(F.col("number"), max(1, n), seed))
    return rows.select("row.*", shard.cast("int").alias("shard"), slot.alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """A folder for each shard, its rows in the order of their slots."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the id, size and checksum of a text leave the scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharded(staged(rows, "sizes"), ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first and last slot of each shard."""
    places = op4_sharding(spark, sf_dir).groupBy("shard")
    return places.agg(F.count("*").alias("rows"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


COUNTS_ORACLE = f"""
SELECT CAST(s AS INT) AS shard, (n + {SHARDS} - 1 - s) // {SHARDS} AS rows, (n + {SHARDS} - 1 - s) // {SHARDS} AS slots, 0 AS first, (n + {SHARDS} - 1 - s) // {SHARDS} - 1 AS last
FROM (SELECT count(*) AS n FROM documents), range(0, {SHARDS}) AS t(s) WHERE n > s
"""
