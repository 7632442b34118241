"""Exact order statistics of groups of any size: no group meets in one task.

Equal values of a group are counted first. The distinct ones are dealt over RANGES ranges by group and value; sums over the
ranges of a group tell which range holds a rank, and sums inside that range which value. So a task holds a range, and what
meets for one group is a row a range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siftline.sources import folders

RANGES = 256


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict, ranges: int = RANGES) -> DataFrame:
    """keys, n, and a column for each rank: the value in that place, counted from 1. ranks: name to a column of ``n``.

    Null values are not counted; NaN is the largest, as in Spark's order. A rank outside 1 to n gives null.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("v"))
    counted = rows.groupBy(*names, "v").agg(F.count("*").alias("c"))
    path = f"{folders.shared(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    counted.repartitionByRange(ranges, *names, "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    counted = df.sparkSession.read.schema(StructType([*counted.schema.fields, StructField("part", IntegerType())])).parquet(path)
    sums = counted.groupBy(*names, "part").agg(F.sum("c").alias("in_part"))
    of_group = W.partitionBy(*names) if names else W.partitionBy(F.lit(0))
    sums = sums.withColumns({"n": F.sum("in_part").over(of_group), "before": F.sum("in_part").over(of_group.orderBy("part").rowsBetween(W.unboundedPreceding, -1))})
    sums = sums.withColumn("before", F.coalesce("before", F.lit(0)))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])).alias("r")
    asked_in = sums.select(*names, "part", "in_part", "n", "before", asked).where((F.col("r.rank") > F.col("before")) & (F.col("r.rank") <= F.col("before") + F.col("in_part")))
    asked_in = asked_in.groupBy(*names, "part", "n", "before").agg(F.collect_list("r").alias("asked"))
    asked_in = asked_in.withColumnsRenamed({k: f"_{k}" for k in [*names, "part"]})
    inside = counted.join(asked_in, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*names, "part"]]).select(*counted.columns, "n", "before", "asked")
    upto = F.col("before") + F.sum("c").over(W.partitionBy(*names, "part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = inside.withColumn("upto", upto).withColumn("r", F.explode("asked"))
    hit = inside.where((F.col("r.rank") <= F.col("upto")) & (F.col("r.rank") > F.col("upto") - F.col("c")))
    out = hit.groupBy(*names).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("r.name") == name, F.col("v"))).alias(name) for name in ranks])
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", *ranks)


def medians(df: DataFrame, keys: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """keys, n, lower, upper, middle: the two values in the middle (one, of an odd number) and their mean."""
    n = F.col("n")
    out = at_ranks(df, keys, value, {"lower": F.floor((n + 1) / 2), "upper": F.floor(n / 2) + 1}, ranges)
    return out.withColumn("middle", (F.col("lower").cast("double") + F.col("upper").cast("double")) / 2)
