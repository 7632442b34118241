"""Mentions of entities in texts: identifiers, services and dates by grammar, people by their form, bare numbers by the
nearest keyword, and of readings that overlap the strongest. Places come from cutting texts at their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import identifiers as I
from siftline.operators.marking import positions

# What else the grammars find: type, pattern, confidence.
DESCRIPTIVE = (
    ("service", r"(?i)\b([a-z][a-z0-9]*(?:-[a-z0-9]+)*-(?:service|svc|api|gateway|worker|db))\b", 0.60),
    ("event", r"\b(\d{4}-\d{2}-\d{2})\b", 0.90),
    ("event", r"(?i)\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4})\b", 0.90),
)
# Forms of names; capitalised words that are no names; confidences of a titled, an initialled and a full name.
NAME = r"(?:[A-Z][a-z]{1,20}|[A-Z]\.)"
NAMES = rf"\b{NAME}(?:\s+{NAME}){{1,3}}\b"
TITLED = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Eng|Sir|Sheikh)\.?\s+[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){0,3}\b"
NO_NAMES = (
    "the", "and", "for", "from", "with", "this", "that", "payment", "gateway", "service", "transaction", "customer", "incident",
    "asset", "report", "summary", "review", "database", "record", "video", "image", "document", "audio", "monday", "tuesday",
    "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december", "support", "engineering", "finance", "operations", "team",
    "meeting", "call", "postmortem", "root", "cause", "analysis", "system", "platform", "invoice", "refund", "account",
    "north", "south", "east", "west", "region", "europe", "asia", "america",
)
TITLED_SURE, INITIAL_SURE, NAME_SURE = 0.70, 0.65, 0.80
# Keywords that type a number nearby, how near in characters, confidence.
KEYWORDS = (
    ("customer", ("customer", "client", "account holder", "subscriber")),
    ("transaction", ("transaction", "txn", "payment", "charge", "refund", "reference")),
    ("incident", ("incident", "ticket", "outage", "case")),
    ("asset", ("asset", "equipment", "device", "terminal")),
)
NUMBER, NEAR, CONTEXT_SURE = r"\b(\d{3,8})\b", 40, 0.75
COLUMNS = ("doc_id", "entity_type", "surface", "start", "stop", "confidence", "extractor")


def found(docs: DataFrame, pattern: str, kind: str, confidence: float, extractor: str) -> DataFrame:
    hits = positions(docs, ["doc_id"], "text", F.lit(pattern))
    return hits.select("doc_id", F.lit(kind).alias("entity_type"), F.col("word").alias("surface"), "start", "stop", F.lit(confidence).alias("confidence"), F.lit(extractor).alias("extractor"))


def by_grammar(docs: DataFrame) -> DataFrame:
    out = None
    for kind, pattern, confidence in [*[(k, p, c) for k, _, p, c in I.GRAMMARS], *DESCRIPTIVE]:
        part = found(docs, pattern, kind, confidence, "pattern")
        out = part if out is None else out.unionByName(part)
    return out


def like_a_name(surface: Column) -> Column:
    """Three letters or more, some part that is no title, and no part that never is a name."""
    parts = F.filter(F.transform(F.split(F.lower(surface), r"\s+", -1), lambda p: F.regexp_replace(p, r"^\.+|\.+$", "")), lambda p: (p != "") & ~p.isin(*I.HONORIFICS))
    return (F.length(F.regexp_replace(surface, "[. ]", "")) >= 3) & (F.size(parts) > 0) & ~F.exists(parts, lambda p: p.isin(*NO_NAMES))


def people(docs: DataFrame) -> DataFrame:
    titled = found(docs, TITLED, "person", TITLED_SURE, "person")
    title = F.length(F.regexp_extract("surface", r"^(\w+\.?\s+)", 1))
    titled = titled.withColumns({"start": F.col("start") + title, "surface": F.substring("surface", title + 1, F.length("surface"))})
    plain = found(docs, NAMES, "person", NAME_SURE, "person").where(like_a_name(F.col("surface")))
    plain = plain.withColumn("confidence", F.when(F.contains("surface", F.lit(".")), INITIAL_SURE).otherwise(NAME_SURE))
    return titled.unionByName(plain)


def by_context(docs: DataFrame) -> DataFrame:
    """Bare numbers with the type of the nearest keyword on either side: one pass over numbers and keywords in order."""
    rows = positions(docs, ["doc_id"], "text", F.lit(NUMBER)).select("doc_id", F.col("word").alias("surface"), "start", "stop", F.lit(None).cast("int").alias("kind"))
    lower = docs.withColumn("text", F.lower("text"))
    for i, (_, words) in enumerate(KEYWORDS):
        hits = positions(lower, ["doc_id"], "text", F.lit("|".join(words)))
        rows = rows.unionByName(hits.select("doc_id", F.col("word").alias("surface"), "start", "stop", F.lit(i).alias("kind")))
    order = W.partitionBy("doc_id").orderBy("start", "stop")
    keyword = F.when(F.col("kind").isNotNull(), F.struct("start", "stop", "kind"))
    before = F.last(keyword, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(keyword, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    rows = rows.withColumns({"before": before, "after": after}).where("kind IS NULL")
    left = F.when(F.col("before.start") >= F.col("start") - NEAR, F.struct((F.col("start") - F.col("before.stop")).alias("gap"), F.col("before.kind").alias("kind")))
    right = F.when(F.col("after.stop") <= F.col("stop") + NEAR, F.struct((F.col("after.start") - F.col("stop")).alias("gap"), F.col("after.kind").alias("kind")))
    nearest = F.array_min(F.array_compact(F.array(left, right)))["kind"]
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in KEYWORDS]), nearest + 1)
    return rows.where(nearest.isNotNull()).select("doc_id", kind.alias("entity_type"), "surface", "start", "stop", F.lit(CONTEXT_SURE).alias("confidence"), F.lit("context").alias("extractor"))


def strongest(mentions: DataFrame) -> DataFrame:
    """Of readings that overlap, the surest stays, then the longest, then the first; others stay if they overlap no kept one.

    Readings that hang together by overlaps are an island, mostly of two or three; only an island is folded.
    """
    order = W.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = mentions.withColumn("island", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("island").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    one = F.struct((-F.col("confidence")).alias("doubt"), (F.col("start") - F.col("stop")).alias("shortness"), "start", "stop", "entity_type", "surface", "confidence", "extractor")
    islands = rows.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(one)).alias("all"))
    clear = lambda kept, c: ~F.exists(kept, lambda k: (c["start"] < k["stop"]) & (k["start"] < c["stop"]))
    kept = F.aggregate("all", F.slice("all", 1, 1), lambda kept, c: F.when(clear(kept, c), F.concat(kept, F.array(c))).otherwise(kept))
    return islands.select("doc_id", F.inline(kept)).select(*COLUMNS)


def mentions_in(docs: DataFrame) -> DataFrame:
    """(doc_id, entity_type, surface, start, stop, confidence, extractor) of the mentions in (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return strongest(by_grammar(docs).unionByName(people(docs)).unionByName(by_context(docs)))


def inferred_type(surface: Column) -> Column:
    """The type of an identifier in it, else person for what looks like a name, else other."""
    ids = I.identifiers_in(surface)
    plain = F.trim(surface)
    name = plain.rlike(f"^(?:{NAMES})$") | plain.rlike(r"^\p{Lu}\p{L}{2,}$")
    return F.when(F.size(ids) > 0, ids[0]["type"]).when(name, "person").otherwise("other")
