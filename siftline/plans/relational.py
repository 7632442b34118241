"""Filters, joins, aggregates, windows, pages and set operations over the business tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators import chunking, order_stats
from siftline.operators import filters as P
from siftline.plans.base import Registry, table
from siftline.plans.sql_guard import Guard

query = Registry()


# ---- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source = 'src3'")
def facet_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(P.compiled({"lang": ["en", "fr"], "source": {"eq": "src3"}})).select("doc_id", "lang", "source")


@query("SELECT event_id, event_type FROM events WHERE coalesce(CASE WHEN event_type <> 'error' THEN ts END, ts + INTERVAL 20 DAY) BETWEEN (SELECT min(ts) FROM events) + INTERVAL 10 DAY AND (SELECT min(ts) FROM events) + INTERVAL 40 DAY")
def time_window_filter(spark, sf_dir):
    """The moment an event occurred counts, or else (for errors) that of its record, twenty days on."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("ts").alias("first"))  # one row
    rows = events.crossJoin(F.broadcast(first))
    occurred, created = F.when(F.col("event_type") != "error", F.col("ts")), F.col("ts") + F.expr("INTERVAL 20 DAYS")
    day = lambda n: F.col("first") + F.expr(f"INTERVAL {n} DAYS")
    return rows.where(P.in_window(occurred, created, day(10), day(40))).select("event_id", "event_type")


_ROLES = "CASE WHEN doc_id % 3 = 0 THEN ['admin'] WHEN doc_id % 3 = 1 THEN ['admin', 'analyst'] ELSE [] END"


def _with_roles(spark, sf_dir):
    chunk = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("admin"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("admin"), F.lit("analyst"))).otherwise(F.array().cast("array<string>"))
    source = F.when(F.col("source") == "src4", F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").withColumns({"roles": chunk, "source_roles": source})


@query(f"SELECT doc_id, source FROM documents WHERE source <> 'src5' AND source <> 'src4' AND (len({_ROLES}) = 0 OR list_contains({_ROLES}, 'analyst'))")
def permission_filter(spark, sf_dir):
    ok = P.permitted(F.col("source"), F.col("source_roles"), F.col("roles"), "analyst", denied=("src5",))
    return _with_roles(spark, sf_dir).where(ok).select("doc_id", "source")


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing'
  WHEN NOT (source <> 'src5' AND source <> 'src4' AND (len({_ROLES}) = 0 OR list_contains({_ROLES}, 'analyst'))) THEN 'permission'
  WHEN lang <> 'en' THEN 'filter' ELSE 'kept' END AS reason FROM documents) GROUP BY ALL""")
def rejection_counts(spark, sf_dir):
    ok = P.permitted(F.col("source"), F.col("source_roles"), F.col("roles"), "analyst", denied=("src5",))
    return P.rejection_counts(_with_roles(spark, sf_dir), P.rejection(ok, F.col("lang") == "en", F.col("doc_id") % 7 != 0))


@query(f"SELECT doc_id FROM documents WHERE list_has_any({_ROLES}, ['analyst', 'auditor'])")
def payload_overlap(spark, sf_dir):
    return _with_roles(spark, sf_dir).where(P.compiled({"roles": {"any": ["analyst", "auditor"]}}, ("roles",))).select("doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '0099') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ORDER BY c_custkey")
def contains_search(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("big")).distinct()
    rows = table(spark, sf_dir, "customer").join(big, "c_custkey", "left")
    return rows.where(P.contains_text(F.col("c_name"), "0099") | F.col("big")).select("c_custkey", "c_name")


_FOUND = "SELECT * FROM (SELECT '{t}' AS kind, {k} AS id, {n} AS name FROM {t} WHERE contains(lower({n}), '00') ORDER BY {k} LIMIT 10)"
_NAMED = (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))


@query(" UNION ALL ".join(_FOUND.format(t=t, k=k, n=n) for t, k, n in _NAMED))
def multi_table_search(spark, sf_dir):
    """Ten of each table, as the feature has it."""
    parts = [table(spark, sf_dir, t).where(P.contains_text(F.col(n), "00")).orderBy(k).limit(10).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(n).alias("name")) for t, k, n in _NAMED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' WHERE o_orderkey IS NULL")
def null_filter(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left").where("o_orderkey IS NULL").select("c_custkey")


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN map {'type': event_type, 'api_key': '***'} ELSE map {'type': event_type, 'user': user_id::VARCHAR} END::VARCHAR AS shown FROM events")
def redaction(spark, sf_dir):
    raw = F.when(F.col("event_type").isin("error", "purchase"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("api_key"), F.lit("k-123"))).otherwise(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    shown = F.transform(F.map_entries(P.redacted(raw)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("shown"))


# ---- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def entity_key_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return orders.join(customers, "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def entity_semi_join(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT v.vec_id AS chunk_id, row_number() OVER (ORDER BY v.vec_id DESC) AS rank, d.source, d.doc_id IS NULL AS missing FROM (SELECT vec_id FROM embeddings) v LEFT JOIN documents d ON d.doc_id = v.vec_id AND d.lang = 'en'")
def hydrate_left_join(spark, sf_dir):
    """Candidates keep their rank, found or not."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "source", F.lit(False).alias("found"))
    rows = ids.join(docs, "chunk_id", "left").select("chunk_id", "source", F.col("found").isNull().alias("missing"))
    return ranked_down(rows, ids, "chunk_id", "rank").select("chunk_id", "rank", "source", "missing")


def ranked_down(rows: DataFrame, ids: DataFrame, column: str, rank: str, ranges: int = 256) -> DataFrame:
    """Numbers ``rows`` by ``column`` descending, nulls last, without one task for all: rows are counted by range of the
    column, each range starts after those of larger values, and rows are numbered inside. ``ids`` gives the bounds."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.agg(F.percentile_approx(column, shares)).first()[0] or []))
    above = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col(column))) if bounds else F.lit(0)
    rows = rows.withColumn("_range", F.when(F.col(column).isNull(), len(bounds) + 1).otherwise(above))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # ranges + 1 rows at most
    counts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(F.desc(column)))
    return rows.join(F.broadcast(counts), "_range").withColumn(rank, F.col("_before") + inside).drop("_range", "_before")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("""WITH s AS (SELECT conv_id * 1000 + k AS scene_id, conv_id, k * 3.0::DOUBLE AS a, k * 3.0::DOUBLE + 2.5 AS b FROM (SELECT conv_id, max(turn) // 3 AS last FROM conversations GROUP BY ALL), unnest(range(0, last + 1)) AS r(k))
SELECT scene_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations c JOIN s ON c.conv_id = s.conv_id AND turn + 1.0 > a AND turn < b GROUP BY scene_id""")
def interval_overlap_join(spark, sf_dir):
    """Turns as spans of a second, scenes of 2.5 seconds every three up to the last turn: overlap within a conversation."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.floor(F.max("turn") / 3).alias("last"))
    scenes = last.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("k"))
    scenes = scenes.select("conv_id", (F.col("conv_id") * 1000 + F.col("k")).alias("scene_id"), (F.col("k") * 3.0).alias("start_s"), (F.col("k") * 3.0 + 2.5).alias("end_s"))
    return chunking.scene_text(turns.select("conv_id", F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.0).alias("stop"), "text"), scenes)


@query("SELECT DISTINCT o_custkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def distinct_via_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return rows.select("o_custkey", "p_brand").distinct()


@query("SELECT 'orders' AS source, o_orderkey AS id, 'customer' AS matched FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'customer', c_custkey, 'customer' FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'events', event_id, 'user' FROM events WHERE user_id = 7")
def multi_source_lookup(spark, sf_dir):
    parts = (("orders", "o_orderkey", "o_custkey", "customer"), ("customer", "c_custkey", "c_custkey", "customer"), ("events", "event_id", "user_id", "user"))
    found = [table(spark, sf_dir, t).where(F.col(c) == 7).select(F.lit(t).alias("source"), F.col(k).alias("id"), F.lit(m).alias("matched")) for t, k, c, m in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


# ---- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) > 5")
def having_threshold(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors")).where("errors > 5")


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def count_by_group(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY ALL")
def conditional_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT c_custkey, count(o_orderkey) AS linked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def linked_count(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("linked"))
    return table(spark, sf_dir, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("linked", F.lit(0)).alias("linked"))


def _at(p: int) -> str:
    return f"v[CAST(round_even({p} / 100.0 * (len(v) - 1), 0) AS INT) + 1] AS p{p}"


@query(f"""SELECT event_type, len(v) AS n, round(list_avg(v), 6) AS mean, {_at(50)}, {_at(95)}, {_at(99)} FROM (
  SELECT event_type, list(value ORDER BY value) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 512 GROUP BY ALL)""")
def latency_percentiles(spark, sf_dir):
    """The last 512 samples of each kind; percentiles by nearest rank, halves to even."""
    w = W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 512")
    v = last.groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("v"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    at = lambda p: F.element_at("v", (F.bround(F.lit(p / 100) * (F.col("n") - 1), 0) + 1).cast("int")).alias(f"p{p}")
    return v.select("event_type", "n", F.round("mean", 6).alias("mean"), at(50), at(95), at(99))


@query("SELECT l_returnflag, round(median(l_extendedprice), 6) AS middle, round(quantile_disc(l_quantity, 0.5), 6) AS lower FROM lineitem GROUP BY ALL")
def median_agg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.median("l_extendedprice"), 6).alias("middle"), F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)"), 6).alias("lower"))


_SORTED = "SELECT {k} AS l_returnflag, count(*) AS n, list_sort(list({v})) AS l FROM lineitem GROUP BY 1"


@query("SELECT l_returnflag, what, n, l[(n + 1) // 2]::DOUBLE AS lower, l[n // 2 + 1]::DOUBLE AS upper, (l[(n + 1) // 2] + l[n // 2 + 1])::DOUBLE / 2 AS middle FROM (SELECT *, 'price' AS what FROM ("
       + _SORTED.format(k="l_returnflag", v="l_extendedprice::DOUBLE") + ") UNION ALL SELECT *, 'all' FROM (" + _SORTED.format(k="'*'", v="l_quantity::DOUBLE") + "))")
def exact_medians(spark, sf_dir):
    """The middle, lower and upper medians of prices by flag, and of all quantities as one group."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"))
    out = order_stats.medians(rows, ["l_returnflag"], "price").withColumn("what", F.lit("price"))
    every = order_stats.medians(rows.withColumn("l_returnflag", F.lit("*")), ["l_returnflag"], "quantity").withColumn("what", F.lit("all"))
    return out.unionByName(every).select("l_returnflag", "what", "n", "lower", "upper", "middle")


@query("SELECT user_id, max(value) AS best, arg_max(event_type, (value, event_id)) AS kind FROM events GROUP BY ALL")
def max_per_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_type", F.struct("value", "event_id")).alias("kind"))


@query("SELECT user_id, list(event_type ORDER BY first_at, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_at"))
    return first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first_at", "event_type")))["event_type"].alias("kinds"))


# ---- order, pages, sets ----------------------------------------------------------------------------------------------

_PAGE = 25


@query(f"SELECT o_orderkey, o_totalprice, (SELECT greatest(1, ceil(count(*) / {_PAGE}.0))::BIGINT FROM orders) AS pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {_PAGE} OFFSET {3 * _PAGE}")
def paginate(spark, sf_dir):
    """The fourth page of orders by price; the page is the feature."""
    orders = table(spark, sf_dir, "orders")
    pages = orders.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / _PAGE)).cast("long").alias("pages"))
    page = orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(3 * _PAGE).limit(_PAGE)
    return page.crossJoin(F.broadcast(pages))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_n(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type", "ts")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def topn_per_group(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")


@query("SELECT t, (n > 500) AS truncated, least(n, 500) AS shown FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'region', count(*) FROM region)")
def truncation_probe(spark, sf_dir):
    """One row more than the cap tells whether there was more."""
    probe = lambda t: table(spark, sf_dir, t).limit(501).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), (F.col("n") > 500).alias("truncated"), F.least("n", F.lit(500)).alias("shown"))
    return probe("orders").unionByName(probe("region"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey > 100").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_orderstatus")


@query("SELECT chunk_id, string_agg(r, ',' ORDER BY r) AS retrievers FROM (SELECT doc_id AS chunk_id, 'labels' AS r FROM labels UNION SELECT vec_id, 'vectors' FROM embeddings WHERE label < 5) GROUP BY ALL")
def union_retrievers(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.lit("labels").alias("r"))
    b = table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("chunk_id"), F.lit("vectors").alias("r"))
    return a.unionByName(b).groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("retrievers"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def intersect_tables(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "events").select("user_id"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_tables(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def content_dedupe(spark, sf_dir):
    """Of equal contents the earliest stays."""
    return table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT user_id, event_type AS status, ts AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    """Last writer wins: one aggregation, no window."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct(F.col("event_type").alias("status"), F.col("ts").alias("updated_at")), F.struct("ts", "event_id")).alias("v"))
    return last.select("user_id", "v.status", "v.updated_at")


# ---- windows ---------------------------------------------------------------------------------------------------------


def _blocks(spark, sf_dir) -> DataFrame:
    """Turns as blocks: those of users are headings, those of a length divisible by 7 tables."""
    kind = F.when(F.col("role") == "user", "heading").when(F.length("text") % 7 == 0, "table").otherwise("paragraph")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), kind.alias("kind"), "text")


_BLOCKS = "SELECT conv_id AS doc_id, turn AS ordinal, text, CASE WHEN role = 'user' THEN 'heading' WHEN length(text) % 7 = 0 THEN 'table' ELSE 'paragraph' END AS kind FROM conversations"
_SECTIONS = f"SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal) AS section FROM ({_BLOCKS})"


@query(f"SELECT doc_id, ordinal, section FROM ({_SECTIONS})")
def section_carry_forward(spark, sf_dir):
    return chunking.with_sections(_blocks(spark, sf_dir)).select("doc_id", "ordinal", "section")


@query(f"""SELECT doc_id, ordinal, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY ordinal) AS BIGINT) AS "group" FROM (
  SELECT *, CASE WHEN kind IN ('heading', 'table') OR coalesce(lag(kind) OVER w = 'table', true) OR section IS DISTINCT FROM lag(section) OVER w THEN 1 ELSE 0 END AS b FROM ({_SECTIONS}) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))""")
def group_breaks(spark, sf_dir):
    return chunking.with_groups(chunking.with_sections(_blocks(spark, sf_dir))).select("doc_id", "ordinal", "group")


@query("SELECT o_custkey, CAST((r - 1) // 25 AS BIGINT) AS batch, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY ALL")
def row_batches(spark, sf_dir):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor((r - 1) / 25).alias("batch"))
    return rows.groupBy("o_custkey", "batch").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


_CUTS = "SELECT user_id AS id, start, stop, d FROM (SELECT user_id, cut AS start, lead(cut) OVER w AS stop, max(cut) OVER (PARTITION BY user_id) AS d FROM (SELECT user_id, value AS cut FROM events UNION SELECT DISTINCT user_id, 0.0::DOUBLE FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY cut)) WHERE stop IS NOT NULL"


@query(f"""SELECT id, ordinal, min(start) AS start, max(stop) AS stop FROM (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY id ORDER BY start) AS BIGINT) - 1 AS ordinal FROM (
    SELECT *, CASE WHEN stop - start >= least(1.5, greatest(d / 4, 0.25)) OR start = 0 THEN 1 ELSE 0 END AS fresh FROM ({_CUTS}))) GROUP BY ALL""")
def scene_spans(spark, sf_dir):
    """The values of each user's events as cut points: spans between them, too short ones joined to the one before."""
    events = table(spark, sf_dir, "events")
    cuts = events.select(F.col("user_id").alias("id"), F.col("value").alias("start")).unionByName(events.select(F.col("user_id").alias("id"), F.lit(0.0).alias("start"))).distinct()
    w = W.partitionBy("id")
    spans = cuts.select("id", "start", F.lead("start").over(w.orderBy("start")).alias("stop"), F.max("start").over(w).alias("d")).where("stop IS NOT NULL")
    return chunking.merged_spans(spans, chunking.least_scene(F.col("d")))


@query("SELECT conv_id AS id, k AS ordinal, k * 10.0::DOUBLE AS start_s, least(d, (k + 1) * 10.0)::DOUBLE AS end_s FROM (SELECT conv_id, sum(length(text)) / 15.0 AS d FROM conversations GROUP BY ALL), unnest(range(0, CAST(ceil(d / 10) AS BIGINT))) AS u(k)")
def uniform_scenes(spark, sf_dir):
    spoken = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg((F.sum(F.length("text")) / 15.0).alias("duration"))
    return chunking.uniform_scenes(spoken, 10)


_SPOKEN = "SELECT conv_id, turn, turn * 12.0::DOUBLE AS start, turn * 12.0::DOUBLE + length(text) / 15.0::DOUBLE AS stop FROM conversations"


@query(f"SELECT conv_id, turn, 'speaker_' || (CAST(sum(g) OVER (PARTITION BY conv_id ORDER BY start, turn) AS BIGINT) % 4) AS speaker FROM (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY conv_id ORDER BY start, turn) >= 1.5 THEN 1 ELSE 0 END AS g FROM ({_SPOKEN}))")
def speaker_labels(spark, sf_dir):
    """A turn every twelve seconds, spoken at 15 characters a second: silences move on to the next of four labels."""
    start = F.col("turn") * 12.0
    spoken = table(spark, sf_dir, "conversations").select("conv_id", "turn", start.alias("start"), (start + F.length("text") / 15.0).alias("stop"))
    return chunking.speakers(spoken).select("conv_id", "turn", "speaker")


# ---- guarded SQL -----------------------------------------------------------------------------------------------------

_TABLES = ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")


def _guard(spark, sf_dir) -> Guard:
    for t in _TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return Guard(spark, _TABLES)


_AGG = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus"
_CTE = "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15) SELECT n_name, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM big JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"
_WIN = "SELECT n_name, s_suppkey, place FROM (SELECT n_name, s_suppkey, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey) AS t WHERE place <= 2"


@query(_AGG)
def guarded_sql_agg(spark, sf_dir):
    return _guard(spark, sf_dir).query(_AGG).rows


@query(_CTE)
def guarded_sql_cte(spark, sf_dir):
    return _guard(spark, sf_dir).query(_CTE).rows


@query(_WIN)
def guarded_sql_window(spark, sf_dir):
    return _guard(spark, sf_dir).query(_WIN).rows.select("n_name", "s_suppkey", F.col("place").cast("long").alias("place"))


@query("SELECT * FROM (VALUES ('region', 2), ('nation', 3), ('customer', 5), ('orders', 6), ('lineitem', 11), ('part', 6), ('supplier', 4)) AS t(name, columns) JOIN (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES) + ") USING (name)")
def table_census(spark, sf_dir):
    """Allowed tables with their rows and columns."""
    parts = [table(spark, sf_dir, t) for t in _TABLES]
    rows = [p.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), F.lit(len(p.columns)).alias("columns"), "n") for t, p in zip(_TABLES, parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(14, 2)) AS DOUBLE) AS price, lower(hex(encode(p_brand))) AS brand, nullif(trim(p_type), '') AS kind, try_cast(substr(p_brand, 7) AS BIGINT) AS brand_no FROM part")
def type_coercion(spark, sf_dir):
    from siftline.plans.sql_guard import coerced

    raw = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(14,2)").alias("price"), F.encode("p_brand", "UTF-8").alias("brand"), F.nullif(F.trim("p_type"), F.lit("")).alias("kind"), F.expr("try_cast(substr(p_brand, 7) AS BIGINT)").alias("brand_no"))
    return coerced(raw)
