"""Mixing sources to target weights by entropy balancing.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; no target exceeds CAP
times its source's words, and what is cut off is shared again by weight, until none is above (``targets``, one row for
each source).

Rates. Each document may be taken 0 to CAP times. Among all ways to take documents, the one nearest to taking each
about once (in relative entropy, against the prior of a Poisson variable of mean 1 cut off at CAP) that gives a source
its target number of words tilts the number of copies k of a document of x words by exp(k * lambda * x), with one
lambda for each source. lambda minimises a convex dual, found by Newton steps kept inside a shrinking bracket. What the
steps need from the corpus are sums over documents, and documents of like size share a rate, so one pass sums the
corpus by source and size bin (BINS an octave, some 200 rows a source at most) on the map side; then all sources step
in parallel, each over its own bins. The bins' word sums are exact, so the constraint holds for the real words.

Copies. A document takes the whole part of its rate, and one more if a hash of its id and size falls below the rest.
That is within noise of the target for large sources; a last step, for each source over at most some CANDIDATES
documents a bin picked by hash, adds or takes away copies from large to small documents until what is missing is below
the size of a small one. Hashes, not random numbers, decide, so reruns agree.

Scale. Only (source, bin) sums and the candidates shuffle; one source with a third of the rows has no more bins than
others. The table of rates is broadcast after its rows were counted, and joined by shuffle beyond SMALL rows. The table
of sources, one row each, is the only thing that meets in one task.

Defined cases. A null text has no words; a document without words is never taken. A null source is a source of its
own. A source without words has target 0. Rows that repeat an id and a size draw alike. Null ids draw by a hash as well.
Empty tables give empty results. Other columns are carried along by ``taken_rows``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import packed, staged, table

WEIGHTS, CAP, BINS, CANDIDATES, STEPS, SMALL = (5, 2, 1), 3, 8, 16, 200, 50_000
_PRIOR = np.array([1.0, 1.0, 0.5, 1 / 6])  # Poisson of mean 1, for 0 to CAP copies


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0. Counts the starts of runs, without making words."""
    starts = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(starts, r"[\x20\x09-\x0D]+", "")).cast("long")


def size_bin(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * BINS).cast("int")).otherwise(F.lit(-1))


def targets(bins: DataFrame) -> DataFrame:
    """(source, source_size, target) from sums by source and bin: shares by weight, filled up to CAP times the size.

    Sorted by the level at which they are full, each source sees the level that is left if all before it are full.
    That rises as long as sources fill and falls afterwards, so its maximum is the level in the end.
    """
    by_source = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(rank, F.lit(len(WEIGHTS))).cast("int") + 1).cast("double")
    by_source = by_source.withColumn("weight", weight)
    room = F.col("source_size") * F.lit(float(CAP))
    order = W.orderBy(room / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy(F.lit(1))).cast("double")
    spent, gone = F.coalesce(F.sum(room).over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - spent) / (F.sum("weight").over(W.partitionBy(F.lit(1))) - gone)
    by_source = by_source.withColumns({"level": level, "room": room})
    target = F.least(F.col("room"), F.col("weight") * F.max("level").over(W.partitionBy(F.lit(1))))
    return by_source.select("source", "source_size", target.alias("target"))


def tilted(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the copies of a document whose copies are tilted by exp(k * eta)."""
    k = np.arange(CAP + 1)
    logs = np.log(_PRIOR) + k * eta[:, None]
    p = np.exp(logs - logs.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    mean = p @ k
    return mean, p @ (k * k) - mean**2


def solve(words: np.ndarray, mean_size: np.ndarray, target: float) -> np.ndarray:
    """Rate of each bin such that sum(words * rate) is the target; words: of all documents in the bin."""
    total = float(words.sum())
    if total <= 0 or target <= 0:
        return np.zeros(len(words))
    if target >= CAP * total * (1 - 1e-12):
        return np.full(len(words), float(CAP))
    x = mean_size / (words * mean_size).sum() * total  # 1 for the size of a typical word's document
    low, high, at = -1.0, 1.0, 0.0
    reach = lambda lam: float(words @ tilted(lam * x)[0])
    while reach(low) > target and low > -1e12:
        low *= 4
    while reach(high) < target and high < 1e12:
        high *= 4
    for _ in range(STEPS):
        mean, variance = tilted(at * x)
        slope, excess = float(words * x @ variance), float(words @ mean) - target
        if abs(excess) <= 1e-9 * target:
            break
        low, high = (low, at) if excess > 0 else (at, high)
        step = at - excess / slope if slope > 0 else low - 1
        at = step if low < step < high else (low + high) / 2
    return tilted(at * x)[0]


def rates(bins: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, bin, rate, n): the dual of each source is solved over its bins, all sources in parallel."""

    def newton(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        words = rows.words.to_numpy(np.float64)
        rate = np.zeros(len(rows))
        some = words > 0
        rate[some] = solve(words[some], words[some] / rows.n.to_numpy()[some], float(rows.target.iloc[0]))
        return pd.DataFrame({"source": rows.source, "bin": rows.bin, "rate": rate, "n": rows.n})

    joined = bins.join(goals, bins.source.eqNullSafe(goals.source)).select(bins.source, "bin", "n", "words", "target")
    return joined.groupBy("source").applyInPandas(newton, "source string, bin int, rate double, n long")


def draw(id_col: str, size_col: str, salt: int) -> Column:
    """A number in [0, 1) that the id and size of a row decide."""
    return F.shiftrightunsigned(F.xxhash64(id_col, size_col, F.lit(salt)), 11) / F.lit(float(1 << 53))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to SMALL rows; beyond that (several hundred sources) Spark shuffles, and splits the keys that many rows share."""
    return F.broadcast(df) if rows <= SMALL else df


def _corrections(pool: pd.DataFrame) -> pd.DataFrame:
    """Copies to add or take away in one source, large documents first, until nothing brings it nearer to the target."""
    pool = pool.sort_values(["size", "id", "copies"], ascending=[False, True, True]).drop_duplicates(["id", "size"])
    missing, change = float(pool.missing.iloc[0]), []
    for size, copies, rows in zip(pool["size"], pool.copies, pool.rows):
        by = int(min(CAP - copies, max(-copies, np.floor(missing / (size * rows) + 0.5))))
        missing -= by * size * rows
        change.append(by)
    pool = pool.assign(change=change)
    return pool[pool.change != 0][["source", "id", "size", "change"]]


class Plan:
    """What the mix needs to give a row its copies: rates by source and size bin, corrections of some rows, targets."""

    def __init__(self, sized: DataFrame):
        """sized: (id, source, size); it is read three times."""
        rows = sized.withColumn("bin", size_bin(F.col("size")))
        bins = staged(rows.groupBy("source", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "bins")
        self.targets = staged(targets(bins), "targets")
        by_bin = staged(rates(bins, self.targets), "rates")
        self.rates = small_side(by_bin.select(F.col("source").alias("_source"), F.col("bin").alias("_bin"), "rate", "n"), by_bin.count())
        self.changes = None
        drawn = self.copies(sized)
        taken = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        missing = self.targets.join(taken, self.targets.source.eqNullSafe(taken.source)).select(self.targets.source.alias("_source"), (F.col("target") - F.col("taken")).alias("missing"))
        pool = drawn.where((F.col("size") > 0) & (draw("id", "size", 2) * F.col("n") < CANDIDATES))
        pool = pool.groupBy("source", "id", "size", "copies").agg(F.count("*").alias("rows"))
        pool = pool.join(staged(missing, "missing"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        changes = staged(pool.groupBy("source").applyInPandas(_corrections, "source string, id long, size long, change long"), "changes")
        self.changes = small_side(changes.select(F.col("source").alias("_source"), F.col("id").alias("_id"), F.col("size").alias("_size"), "change"), changes.count())

    def copies(self, rows: DataFrame) -> DataFrame:
        """Adds ``copies`` and ``n``, the rows of the bin, to rows with id, source and size. No row moves for it: rates and
        corrections are a few hundred rows a source, and what a row draws follows from the row itself."""
        bin_ = size_bin(F.col("size"))
        rows = rows.join(self.rates, F.col("source").eqNullSafe(F.col("_source")) & (bin_ == F.col("_bin")), "left").drop("_source", "_bin")
        rate = F.coalesce("rate", F.lit(0.0))
        drawn = F.floor(rate) + F.when(draw("id", "size", 1) < rate - F.floor(rate), 1).otherwise(0)
        rows = rows.withColumn("copies", F.least(drawn, F.lit(CAP)).cast("long")).drop("rate")
        if self.changes is None:
            return rows
        same = F.col("source").eqNullSafe(F.col("_source")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size"))
        rows = rows.join(self.changes, same, "left").drop("_source", "_id", "_size")
        return rows.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def taken_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix: every row of ``docs`` as often as it is taken, all columns kept. Texts stay where they are read."""
    plan = Plan(staged(sized(docs, id_col, source_col, text_col), "sizes"))
    rows = packed(docs, id=F.col(id_col).cast("long"), source=F.col(source_col), size=word_count(F.col(text_col)))
    mixed = plan.copies(rows).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(sized(table(spark, sf_dir, "documents")), "sizes")
    plan = Plan(rows)
    goals = plan.targets.withColumnRenamed("source", "_source")
    out = plan.copies(rows).join(small_side(goals, goals.count()), F.col("source").eqNullSafe(F.col("_source")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source should give: source, source_size, target."""
    rows = sized(table(spark, sf_dir, "documents")).withColumn("bin", size_bin(F.col("size")))
    found = targets(rows.groupBy("source", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    return found.select("source", "source_size", F.round("target", 3).alias("target"))


TARGETS_ORACLE = rf"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, {CAP}.0 * source_size AS room, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(room) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, source_size, round(least(room, weight * max(level) OVER ()), 3)::DOUBLE AS target FROM l
"""
