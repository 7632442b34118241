"""Fusing, gating, normalising and scoring candidates. Every step keeps queries apart by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fusion constant, pools and rerank windows by mode, evidence floor, weights, priors.
RRF_K = 60
POOLS = {"fast": (60, 12), "deep": (200, 40)}
RERANK_FLOOR = 0.35
EXACT_BONUS = 1.0
WEIGHTS = {"lexical": 0.22, "semantic": 0.24, "rerank": 0.30, "entity_match": 0.12, "metadata_match": 0.04, "source_reliability": 0.05, "freshness": 0.03}
RELIABILITY = {"postgres": 0.95, "mysql": 0.95, "sqlite": 0.90, "s3": 0.75, "local": 0.75, "rest": 0.70, "upload": 0.60}
RELIABILITY_DEFAULT = 0.70
SIGNAL_OF = {"exact_id": "entity_match", "entity": "entity_match", "lexical": "lexical", "dense": "semantic", "multimodal": "semantic"}
HALF_LIFE_DAYS, FRESHNESS_UNKNOWN, FLAT = 180.0, 0.5, 1e-12


def budget(mode: str, pool: int = 200, window: int = 40) -> tuple[int, int]:
    """Candidates a retriever and rows to rerank; an unknown mode counts as deep."""
    most_pool, most_window = POOLS.get(mode, POOLS["deep"])
    return min(pool, most_pool), min(window, most_window)


def renumbered(candidates: DataFrame) -> DataFrame:
    """The best rank of each (query, retriever, chunk), ranks without gaps again."""
    best = candidates.groupBy("query_id", "retriever", "chunk_id").agg(F.min("rank").alias("_was"), F.max("score").alias("score"))
    w = W.partitionBy("query_id", "retriever").orderBy("_was", "chunk_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).drop("_was")


def pooled(candidates: DataFrame, pool: int) -> DataFrame:
    """At most ``pool`` candidates a query and retriever."""
    return renumbered(candidates).where(F.col("rank") <= pool)


def fused(candidates: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: (query_id, chunk_id, rrf, retrievers, lexical, semantic, entity_match, is_exact)."""
    signal = lambda name: F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("retriever").isin(*[r for r, s in SIGNAL_OF.items() if s == name]), F.col("score"))), F.lit(0.0)))
    return candidates.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("rrf"),
        F.array_sort(F.collect_set("retriever")).alias("retrievers"),
        *[signal(s).alias(s) for s in ("lexical", "semantic", "entity_match")],
        F.max(F.col("retriever").isin("exact_id", "entity")).alias("is_exact"),
    )


def has_evidence() -> Column:
    """A chunk is admitted for an exact hit, an entity, a shared word or a good rerank score, never for cosine alone."""
    return F.col("is_exact") | (F.col("entity_match") > 0) | (F.col("lexical") > 0) | (F.coalesce("rerank", F.lit(0.0)) >= RERANK_FLOOR)


def normalised(signal: str, by: str = "query_id") -> Column:
    """Min-max over the query's rows; without spread 1.0 for a positive value, else 0.0. Nulls stay null."""
    w = W.partitionBy(by)
    low, high, value = F.min(signal).over(w), F.max(signal).over(w), F.col(signal)
    flat = F.when(value > 0, 1.0).otherwise(0.0)
    return F.when(value.isNotNull(), F.when(high - low <= FLAT, flat).otherwise((value - low) / (high - low)))


def rebalanced(without: str = "rerank") -> dict[str, float]:
    """Weights when a signal is missing: the others share its weight in proportion."""
    rest = {k: v for k, v in WEIGHTS.items() if k != without}
    total = sum(rest.values())
    return {k: v * (total + WEIGHTS[without]) / total for k, v in rest.items()}


def scored(rows: DataFrame, rerank: bool = True) -> DataFrame:
    """Adds ``final``: weighted sum of normalised signals, one more for exact hits, rounded to 6 places; and ``place``."""
    weights = WEIGHTS if rerank else rebalanced()
    admitted = rows.where(has_evidence())
    out = admitted.withColumns({f"{s}_norm": F.round(normalised(s), 6) for s in weights})
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(f"{name}_norm"), F.lit(0.0)) * F.lit(weight)
    total = (total + F.when(F.col("is_exact"), EXACT_BONUS).otherwise(0.0)).cast("decimal(18,9)")  # halves round as written
    out = out.withColumn("final", F.round(total, 6).cast("double"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("final"), "chunk_id"))
    return out.withColumn("place", place.cast("long"))


def explained(rows: DataFrame, rerank: bool = True) -> DataFrame:
    """(query_id, chunk_id, signal, contribution, position): what each signal adds, largest first."""
    weights = WEIGHTS if rerank else rebalanced()
    parts = F.array(*[F.struct(F.lit(n).alias("signal"), F.round(F.coalesce(F.col(f"{n}_norm"), F.lit(0.0)) * w, 6).alias("contribution")) for n, w in weights.items()])
    flat = rows.select("query_id", "chunk_id", F.inline(parts))
    w = W.partitionBy("query_id", "chunk_id").orderBy(F.desc("contribution"), "signal")
    return flat.withColumn("position", F.row_number().over(w).cast("long"))


def freshness(moment: Column, now: str) -> Column:
    """Halves every HALF_LIFE_DAYS; a moment after ``now`` counts as now, an unknown one as FRESHNESS_UNKNOWN."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))) / F.lit(86_400e6)
    return F.when(moment.isNull(), FRESHNESS_UNKNOWN).otherwise(F.round(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / HALF_LIFE_DAYS), 6))


def reliability(kind: Column, override: Column | None = None) -> Column:
    prior = F.create_map(*[F.lit(x) for pair in RELIABILITY.items() for x in pair])[kind]
    return F.coalesce(*([override] if override is not None else []), prior, F.lit(RELIABILITY_DEFAULT))


def metadata_match(facets: list[Column]) -> Column:
    """Share of requested facets that match; 0.5 if none was requested."""
    if not facets:
        return F.lit(0.5)
    hits = sum((F.when(F.coalesce(f, F.lit(False)), 1.0).otherwise(0.0) for f in facets), F.lit(0.0))
    return hits / F.lit(float(len(facets)))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows_out) of each stage."""
    out = None
    for name, rows in stages.items():
        one = rows.agg(F.count("*").alias("rows_out")).select(F.lit(name).alias("stage"), "rows_out")
        out = one if out is None else out.unionByName(one)
    return out
