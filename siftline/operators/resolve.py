"""Entity resolution: a cascade of joins, each over what earlier steps left open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import identifiers as I
from siftline.functions import text as T
from siftline.operators.store import capped

# Scores of the steps, the gap that the best needs over the next, the least fuzzy ratio.
EXACT, NORMALISED, FUZZY_LEAST, MARGIN = 1.0, 0.95, 0.88, 0.05


def keyed(entities: DataFrame) -> DataFrame:
    """(key, entity_id, entity_type, canonical_name): one row a key that an entity is known by."""
    return entities.select(F.explode(F.array_distinct("normalized_keys")).alias("key"), "entity_id", "entity_type", "canonical_name")


def _single(candidates: DataFrame, score: float, method: str) -> DataFrame:
    """Mentions with exactly one entity."""
    one = candidates.groupBy("mention_id").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).where("n = 1")
    return one.select("mention_id", "entity_id", F.lit(score).alias("score"), F.lit(method).alias("method"))


def resolved(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mention_id, entity_id, score, method for every mention; unresolved ones get an id made from their key.

    mentions: (mention_id, surface, entity_type, key); entities: (entity_id, entity_type, canonical_name, normalized_keys).
    Exact name, then key, then the best name by edit similarity among entities that share the first three characters
    of the name, where it is good enough and clearly better than the next. A type of "other" matches all types.
    """
    typed = lambda m, e: (m.entity_type == e.entity_type) | (m.entity_type == "other")
    exact = mentions.join(entities, (mentions.surface == entities.canonical_name) & typed(mentions, entities))
    exact = _single(exact.select("mention_id", "entity_id"), EXACT, "exact")
    left = mentions.join(exact, "mention_id", "left_anti")
    keys = keyed(entities)
    by_key = left.join(keys, (left["key"] == keys["key"]) & typed(left, keys)).select("mention_id", "entity_id")
    by_key = _single(by_key, NORMALISED, "normalised")
    left = left.join(by_key, "mention_id", "left_anti")
    names = entities.select(entities.entity_id, entities.entity_type, F.lower("canonical_name").alias("name"), F.left(F.lower("canonical_name"), F.lit(3)).alias("block"))
    open_ = left.select("mention_id", "entity_type", F.lower("surface").alias("low"), F.left(F.lower("surface"), F.lit(3)).alias("block"))
    pairs = open_.join(names, (open_.block == names.block) & typed(open_, names))
    longest = F.greatest(F.length("low"), F.length("name"), F.lit(1))
    pairs = pairs.select("mention_id", "entity_id", F.round(1 - F.levenshtein("low", "name") / longest, 6).alias("score")).where(F.col("score") >= FUZZY_LEAST)
    w = W.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    best = pairs.withColumns({"place": F.row_number().over(w), "next": F.lead("score").over(w)}).where("place = 1")
    fuzzy = best.where(F.col("next").isNull() | (F.col("score") - F.col("next") > MARGIN)).select("mention_id", "entity_id", "score", F.lit("fuzzy").alias("method"))
    done = exact.unionByName(by_key).unionByName(fuzzy)
    rest = mentions.join(done, "mention_id", "left_anti")
    made = rest.select("mention_id", T.stable_id("ent", 12, F.col("entity_type"), F.col("key")).alias("entity_id"), F.lit(0.0).alias("score"), F.lit("unresolved").alias("method"))
    return done.unionByName(made)


def merged(entities: DataFrame) -> DataFrame:
    """One row an entity_id: distinct aliases and sources in order of first sight, best confidence, counts, span.

    Mentions are summed to one row for each alias and one for each source of an entity before anything is collected.
    """
    seen = F.explode(F.array(F.lit("alias"), F.lit("source"))).alias("kind")
    rows = entities.select("entity_id", "alias", "source_id", "confidence", "seen_at", seen)
    rows = rows.withColumns({"alias": F.when(F.col("kind") == "alias", F.col("alias")), "source_id": F.when(F.col("kind") == "source", F.col("source_id"))})
    rows = rows.groupBy("entity_id", "kind", "alias", "source_id").agg(
        F.min(F.struct("seen_at")).alias("at"), F.max("confidence").alias("confidence"),
        F.count("*").alias("n"), F.min("seen_at").alias("first"), F.max("seen_at").alias("last"),
    )
    ordered = lambda kind, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", F.col(c).alias("v"))))), lambda s: s["v"])
    return rows.groupBy("entity_id").agg(
        ordered("alias", "alias").alias("aliases"), ordered("source", "source_id").alias("sources"), F.max("confidence").alias("confidence"),
        F.sum(F.when(F.col("kind") == "alias", F.col("n"))).alias("mentions"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    )


def exact_ids(queries: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, chunk_id, canonical, score): chunks linked to an identifier that a query names.

    queries: (query_id, text); links: (canonical, chunk_id).
    """
    asked = queries.select("query_id", F.explode(I.identifiers_in(F.col("text"))).alias("i"))
    asked = asked.groupBy("query_id", F.col("i.canonical").alias("canonical")).agg(F.max("i.confidence").alias("confidence"))
    return asked.join(links, "canonical").select("query_id", "chunk_id", "canonical", F.lit(1.0).alias("score")).distinct()


def linked(queries: DataFrame, links: DataFrame, most: int = 200) -> DataFrame:
    """(query_id, chunk_id, score): chunks linked to the entities of each query, the surest ``most`` of each entity; a chunk
    with several links counts its best. queries: (query_id, entity_id); links: (entity_id, chunk_id, score)."""
    best = capped(links, "entity_id", [F.desc("score"), F.asc("chunk_id")], most)
    return best.join(queries.distinct(), "entity_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
