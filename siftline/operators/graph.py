"""A property graph in two tables: nodes (node_id, labels, properties) and edges (edge_id, type, start_id, end_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.store import capped

MAX_DEPTH, MAX_PATHS = 8, 25


def census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, n): nodes by label, edges by type, and the totals."""
    count = F.count("*").alias("n")
    labels = nodes.select(F.explode("labels").alias("label")).groupBy(F.concat(F.lit("label:"), "label").alias("key")).agg(count)
    types = edges.select(F.concat(F.lit("edge:"), F.col("type")).alias("key")).groupBy("key").agg(count)
    totals = nodes.agg(count).select(F.lit("nodes").alias("key"), "n").unionByName(edges.agg(count).select(F.lit("edges").alias("key"), "n"))
    return labels.unionByName(types).unionByName(totals)


def both_ways(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    some = edges if types is None else edges.where(F.col("type").isin(*types))
    out = some.select("edge_id", F.col("start_id").alias("from_id"), F.col("end_id").alias("to_id"))
    return out.unionByName(some.select("edge_id", F.col("end_id").alias("from_id"), F.col("start_id").alias("to_id")))


def neighbours(starts: DataFrame, edges: DataFrame, depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """(start_id, node_id, hops): everything within ``depth`` undirected hops of each start, with the least hops.

    One join a level with the frontier alone; a node enters once for each start.
    """
    steps = both_ways(edges, types)
    seen = starts.select("start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, min(max(depth, 0), MAX_DEPTH) + 1):
        reached = frontier.join(steps, frontier.node_id == steps.from_id).select("start_id", F.col("to_id").alias("node_id")).distinct()
        frontier = reached.join(seen, ["start_id", "node_id"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(start: str, end: str, edges: DataFrame, depth: int, limit: int = MAX_PATHS) -> DataFrame:
    """(path, hops): paths without a repeated node that end at the first visit to ``end``, by length, then by nodes."""
    steps = both_ways(edges)
    open_paths = edges.sparkSession.createDataFrame([([start],)], "path array<string>")
    found = None
    for hop in range(1, min(max(depth, 1), MAX_DEPTH) + 1):
        longer = open_paths.join(steps, F.element_at("path", -1) == F.col("from_id"))
        longer = longer.where(~F.array_contains(F.col("path"), F.col("to_id"))).select(F.array_append("path", F.col("to_id")).alias("path")).distinct()
        done = longer.where(F.element_at("path", -1) == end).withColumn("hops", F.lit(hop))
        found = done if found is None else found.unionByName(done)
        open_paths = longer.where(F.element_at("path", -1) != end)
    shown = found.select(F.array_join("path", ">").alias("path"), "hops")
    return shown.orderBy("hops", "path").limit(min(limit, MAX_PATHS))


def find_nodes(nodes: DataFrame, label: str, properties: dict[str, str]) -> DataFrame:
    """Nodes of a label whose JSON properties equal all given ones."""
    out = nodes.where(F.array_contains("labels", label))
    for name, value in properties.items():
        out = out.where(F.get_json_object("properties", f"$.{name}") == value)
    return out


def neighbourhood(starts: DataFrame, edges: DataFrame, depth: int, most: int, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each start: the ``most`` nearest nodes with ``truncated``, whether there were more, and every
    edge that a shown node has, also to nodes that are not shown."""
    reached = neighbours(starts, edges, depth, types)
    sizes = reached.groupBy("start_id").agg((F.count("*") > most).alias("truncated"))
    shown = capped(reached, "start_id", [F.asc("hops"), F.asc("node_id")], most).join(sizes, "start_id")
    steps = both_ways(edges, types)
    touched = shown.join(steps, shown.node_id == steps.from_id).select("start_id", "edge_id").distinct()
    return shown, touched


def upserted(nodes: DataFrame, edges: DataFrame, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Nodes with the missing ends of edges added as bare nodes, and the edges; those of unknown types are ``rejected``."""
    kept = edges.where(F.col("type").isin(*allowed)).dropDuplicates(["edge_id"])
    ends = kept.select(F.explode(F.array("start_id", "end_id")).alias("node_id")).distinct()
    bare = ends.join(nodes, "node_id", "left_anti").select("node_id", F.array().cast("array<string>").alias("labels"), F.lit("{}").alias("properties"))
    return nodes.unionByName(bare), kept


def rejected(edges: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """The edges that ``upserted`` leaves out, with the reason."""
    known = F.coalesce(F.col("type").isin(*allowed), F.lit(False))
    return edges.where(~known).withColumn("reason", F.concat(F.lit("unknown type "), F.coalesce("type", F.lit("(none)"))))
