"""URL filters: rules first, then a tree of path templates for each host.

Rules are exact (``judged``): the longest rule whose host is the url's host or a parent domain of it, and whose path
begins the url's path, decides. A url that a rule decides is a labelled url, and the rest are judged by what the labels
say about urls of the same shape.

Tree. A path's segments are read level by level, to the last. At each node a segment stays itself if at least SUPPORT
urls have it and they are SHARE of the node's urls or their labels differ from the node's others (a two-proportion test),
so a blocked section stays apart however large its host is. All others become the wildcard of their kind (digits, digits
with an ending, anything), so page numbers and slugs fall together. Wildcards start with "?", which no path holds. Below
a node of fewer than SUPPORT urls nothing can stay itself, so the rest of such paths is generalised at once.

Merging. The labelled templates under one parent are pooled by tenths of their share of blocked urls; one that the
test can't tell from the others of its pool is merged with them. Templates without labels stay alone and part nobody.
Each template is judged by its purity, the share of blocked urls among its labelled ones, smoothed by PSEUDO urls towards the
purity of its host, and that by as many towards "allow": at REJECT or more it is rejected and its urls blocked. So labels of one
host say nothing about another, and a host without labelled urls is allowed.

Scale. Each level is one aggregation by (host, template, segment) with partial sums, and two joins with the surviving
literals and the nodes that go on; those are staged, so Spark broadcasts or splits the joins by their real size. A level
reads the urls alone that go on. There are as many levels as the deepest path that SUPPORT urls share up to wildcards.

Defined cases. A null url, or one without "://", has empty host and path, fits no rule, and is judged by the template
of empty hosts. Repeated rows are judged each. Null ids stay. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import LOWER, UPPER, staged, table

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SUPPORT, SHARE, PSEUDO, SIGNIFICANT, REJECT, POOLS = 8, 0.02, 5.0, 2.58, 0.5, 10


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        domain, _, begins = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + begins)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def wildcard(segment: Column) -> Column:
    """What a segment that is not kept becomes."""
    return F.when(segment == "", "").when(segment.rlike(r"^[0-9]+$"), "?n").when(segment.rlike(r"^[0-9]+\.[a-zA-Z0-9]{1,5}$"), "?n.e").otherwise("?")


def differ(k: Column, n: Column, others_k: Column, others_n: Column) -> Column:
    """Whether k of n and others_k of others_n are shares that a two-proportion test tells apart; false without rows."""
    pooled = (k + others_k) / (n + others_n)
    spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n + 1 / others_n))
    return F.when((n > 0) & (others_n > 0), F.abs(k / n - others_k / others_n) > SIGNIFICANT * spread).otherwise(False)


def _sums() -> list[Column]:
    return [F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")]


def templates_of(rows: DataFrame) -> DataFrame:
    """Adds ``template`` to rows with host, path and verdict, level by level."""
    columns = rows.columns
    parts = F.split(F.col("path"), "/", -1)  # the part before the first slash is empty
    active = rows.withColumns({"template": F.lit(""), "rest": F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))})
    generalised = F.array_join(F.concat(F.array("template"), F.transform("rest", wildcard)), "/")
    done = [active.where("size(rest) = 0").select(*columns, "template")]
    active = staged(active.where("size(rest) > 0"), "level")
    while not active.isEmpty():
        node, segment = ["host", "template"], F.col("rest")[0]
        counts = active.groupBy(*node, segment.alias("segment")).agg(F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
        counts = staged(counts, "segments")
        nodes = staged(counts.groupBy(*node).agg(*_sums()).where(F.col("all_n") >= SUPPORT), "nodes")
        apart = differ(F.col("blocked"), F.col("labelled"), F.col("all_blocked") - F.col("blocked"), F.col("all_labelled") - F.col("labelled"))
        literal = counts.where(F.col("n") >= SUPPORT).join(nodes, node).where((F.col("n") >= SHARE * F.col("all_n")) | apart)
        literal = staged(literal.select(*node, "segment", F.lit(True).alias("literal")), "literals")
        active = active.withColumn("segment", segment).join(nodes.select(*node, F.lit(True).alias("open")), node, "left").join(literal, [*node, "segment"], "left")
        done.append(staged(active.where("open IS NULL").select(*columns, generalised.alias("template")), "closed"))
        step = F.concat("template", F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise(wildcard(F.col("segment"))))
        active = active.where("open").select(*columns, step.alias("template"), F.slice("rest", 2, F.size("rest")).alias("rest"))
        active = staged(active, "level")
        done.append(active.where("size(rest) = 0").select(*columns, "template"))
        active = active.where("size(rest) > 0")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def tree(rows: DataFrame) -> DataFrame:
    """(host, template, merged, labelled, blocked, purity, rejected) from rows with host, template and verdict."""
    leaves = rows.groupBy("host", "template").agg(F.count("verdict").alias("labelled"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
    parent = F.regexp_replace("template", "/[^/]*$", "")
    pool = F.when(F.col("labelled") > 0, F.floor(F.col("blocked") * POOLS / F.col("labelled") + 0.5).cast("int"))
    leaves = staged(leaves.withColumns({"parent": parent, "pool": pool}), "leaves")
    key = ["host", "parent", "pool"]
    pools = leaves.where("labelled > 0").withColumn("n", F.lit(1)).groupBy(*key).agg(*_sums(), F.min("template").alias("name"))
    pooled = leaves.join(pools, key, "left")
    apart = differ(F.col("blocked"), F.col("labelled"), F.col("all_blocked") - F.col("blocked"), F.col("all_labelled") - F.col("labelled"))
    merged = F.when((F.col("all_n") > 1) & ~apart, F.concat("name", F.lit("?+"), (F.col("all_n") - 1).cast("string"))).otherwise(F.col("template"))
    merged = staged(pooled.select("host", "template", merged.alias("merged"), "labelled", "blocked"), "merged")
    by = merged.groupBy("host", "merged").agg(F.sum("labelled").alias("m_labelled"), F.sum("blocked").alias("m_blocked"))
    hosts = merged.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("blocked").alias("h_blocked"))
    of_host = F.col("h_blocked") / (F.col("h_labelled") + PSEUDO)
    purity = (F.col("m_blocked") + PSEUDO * of_host) / (F.col("m_labelled") + PSEUDO)
    by = by.join(hosts, "host").select("host", "merged", purity.alias("purity"))
    return merged.join(by, ["host", "merged"]).withColumn("rejected", F.col("purity") >= REJECT)


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages``."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = templates_of(rows.withColumns({"rule": rule, "verdict": verdict}))
    known = staged(tree(rows).select("host", "template", "merged", "purity", "rejected"), "tree")
    rows = rows.join(known, ["host", "template"])
    says = F.coalesce("verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", says.alias("verdict"), F.col("merged").alias("template"), "purity")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say: page_id, host, path, rule, ruled."""
    host, path = split_url(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "ruled": verdict})


_FITS = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{r.split('/', 1)[0]}' AS domain, '/{r.split('/', 1)[1]}' AS begins, '{v}' AS says" for r, v in RULES)
RULES_ORACLE = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS ({_FITS})
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS ruled
FROM p LEFT JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, begins) GROUP BY page_id, host, path
"""
