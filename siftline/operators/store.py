"""Upkeep of stores: retracting documents from an index, deletes that cascade, replaced bridges, versions, listings.

Every change is a join against the keys that changed and gives a new table; what to keep is never collected.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def without(df: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose key is not among ``gone``; null keys stay."""
    return df.join(gone.select(on).distinct(), on, "left_anti")


def retracted(postings: DataFrame, df: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, df) of an index without the documents ``gone`` (doc_id): the document frequencies of their terms are
    lowered, terms that no document is left to hold go. The cost follows what is retracted, not the index."""
    lost = postings.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("lost"))
    left = df.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
    return without(postings, gone, "doc_id"), left.where("df > 0")


def cascaded(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str, keep_children: bool = False) -> tuple[DataFrame, DataFrame]:
    """(parents, children) after parents were deleted: children go with them, or keep their row with a null key."""
    ids = gone.select(F.col(key).alias(foreign)).distinct()
    if keep_children:
        marked = children.join(ids.withColumn("_gone", F.lit(True)), foreign, "left")
        children = marked.withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).select(*children.columns)
    else:
        children = without(children, ids, foreign)
    return without(parents, gone, key), children


def bridged(bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, key): all keys of an entity that is written again are replaced by its new ones."""
    new = entities.select("entity_id", F.explode(F.array_distinct("normalized_keys")).alias("key"))
    return without(bridge, entities, "entity_id").select("entity_id", "key").unionByName(new)


def index_version(signature: dict[str, Any]) -> str:
    """A short digest of the settings that an index was built with; their order does not count."""
    return "idx_" + hashlib.sha256(json.dumps(signature, sort_keys=True, default=str).encode()).hexdigest()[:12]


def latest_version(versions: DataFrame) -> DataFrame:
    """The version recorded last; of versions of one moment the greatest."""
    last = F.max_by(F.struct(*versions.columns), F.struct("created_at", "index_version"))
    return versions.agg(last.alias("v")).where("v IS NOT NULL").select("v.*")


def reindexed(chunks: DataFrame, embed: Column, version: str) -> DataFrame:
    """Chunks under a new version: stored texts are embedded again, nothing is read again; image vectors stay."""
    image = F.col("modality") == "image"
    return chunks.withColumns({"embedding": F.when(image, F.col("embedding")).otherwise(embed), "index_version": F.lit(version)})


def listed(df: DataFrame, equal: dict[str, Any], order: list[Column], offset: int, limit: int, allowed: Column | None = None) -> DataFrame:
    """One page: equalities that were asked for (None: not asked), what the caller may see, an order, then the page."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return (df if allowed is None else df.where(allowed)).orderBy(*order).offset(offset).limit(limit)


def capped(links: DataFrame, entity: str, order: list[Column], most: int = 200) -> DataFrame:
    """At most ``most`` links of each entity, the best by ``order``; Spark cuts to that many in each task first."""
    return links.withColumn("_place", F.row_number().over(W.partitionBy(entity).orderBy(*order))).where(F.col("_place") <= most).drop("_place")


def described(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, int]]:
    """(table, column, type, ordinal) of the schemas: no data is read."""
    return [(t, f.name, f.dataType.simpleString(), i) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]


def orphans(tables: dict[str, DataFrame], foreign_keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """(child, column, parent, rows, orphans) for each declared foreign key: rows with a key, and those that no parent has."""
    out = None
    for child, column, parent, key in foreign_keys:
        keys = tables[parent].select(F.col(key).alias("_key")).distinct().withColumn("_there", F.lit(True))
        rows = tables[child].where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left")
        one = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("_there").isNull()).alias("orphans"))
        one = one.select(F.lit(child).alias("child"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), "rows", "orphans")
        out = one if out is None else out.unionByName(one)
    return out
