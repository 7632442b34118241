"""From sources to chunks: readers, splitting, transcripts, identifiers, entities, graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import embed as E
from siftline.functions import fields
from siftline.functions import identifiers as I
from siftline.functions import text as T
from siftline.operators import cascade, chunking, graph, resolve
from siftline.plans.base import Registry, table
from siftline.sources import readers

query = Registry()

_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_NORMAL = r"array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@query(rf"SELECT doc_id, {_SENTENCES} AS sentences FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("sentences"))


@query(rf"SELECT doc_id, i // 380 AS part, array_to_string(w[i + 1:i + 380], ' ') AS slice FROM (SELECT doc_id, {_WORDS} AS w FROM documents), unnest(range(0, greatest(len(w), 1), 380)) AS u(i) WHERE len(w) > 0")
def hard_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.hard_split(F.col("text"), 380)).alias("part", "slice")).withColumn("part", F.col("part").cast("long"))


@query(rf"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda b: {_NORMAL}), lambda b: b <> '') AS paragraphs FROM documents")
def txt_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("paragraphs"))


_TOKENS = "SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS token FROM part"


@query(f"SELECT token, [x for x in list_concat(list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3)), list_transform(range(1, len(t) - 2), lambda i: substr(t, i, 4)), list_transform(range(1, len(t) - 3), lambda i: substr(t, i, 5)))] AS grams FROM (SELECT token, '^' || token || '$' AS t FROM ({_TOKENS}) WHERE length(token) >= 4) UNION ALL SELECT token, [] FROM ({_TOKENS}) WHERE length(token) < 4")
def char_ngrams(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(F.explode(T.ascii_tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("token")).distinct()
    return tokens.select("token", T.char_ngrams(F.col("token")).alias("grams"))


_PART_TOKENS = "SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS t FROM part"


_GRAMS = "SELECT p_partkey, substr(x, i, n) AS gram FROM (SELECT p_partkey, '^' || unnest(t) || '$' AS x FROM ({_PART_TOKENS})), unnest([3, 4, 5]) AS s(n), unnest(range(1, length(x) - n + 2)) AS u(i) WHERE length(x) >= 6".replace("{_PART_TOKENS}", _PART_TOKENS)


@query(f"""SELECT p_partkey, feature, round(w * (1 + ln(count(*))), 6) AS weight FROM (
  SELECT p_partkey, 'w:' || unnest(t) AS feature, 1.0::DOUBLE AS w FROM ({_PART_TOKENS}) UNION ALL
  SELECT p_partkey, 'b:' || t[i] || '_' || t[i + 1], 0.5 FROM ({_PART_TOKENS}), unnest(range(1, len(t))) AS u(i) UNION ALL
  SELECT p_partkey, 'c:' || gram, 0.35 FROM ({_GRAMS})) GROUP BY p_partkey, feature, w""")
def feature_weights(spark, sf_dir):
    """Words, pairs of words and character n-grams, as the hashed embedding weighs them."""
    rows = table(spark, sf_dir, "part").select("p_partkey", T.ascii_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t"), F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    words = F.transform("t", lambda x: F.concat(F.lit("w:"), x))
    grams = F.transform(F.flatten(F.transform("t", T.char_ngrams)), lambda g: F.concat(F.lit("c:"), g))
    flat = None
    for found, weight in ((words, E.WORD), (pairs, E.PAIR), (grams, E.GRAM)):
        part = rows.select("p_partkey", F.explode(found).alias("feature"), F.lit(weight).alias("w"))
        flat = part if flat is None else flat.unionByName(part)
    return flat.groupBy("p_partkey", "feature", "w").agg(F.count("*").alias("n")).select("p_partkey", "feature", F.round(F.col("w") * (1 + F.log("n")), 6).alias("weight"))


@query(rf"SELECT doc_id, len({_WORDS}) AS tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS shown FROM (SELECT event_id, CAST(floor(value * 7.5 + event_id) AS BIGINT) AS s FROM events)")
def hms_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.hms(F.col("value") * 7.5 + F.col("event_id")).alias("shown"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS moment FROM events""")
def ts_parse_ladder(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    shown = F.element_at(F.array(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "dd/MM/yyyy"), F.date_format(ts, "yyyy/MM/dd"), F.lit("no date")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.parsed_timestamp(shown).cast("timestamp_ntz").alias("moment"))


@query("""SELECT doc_id, 'object://' || substr(h, 1, 2) || '/' || h || '.txt' AS uri, substr(h, 1, 2) AS shard, doc_id % 3 <> 0 AS valid FROM (SELECT doc_id, sha256(text) AS h FROM documents)""")
def uri_parse(spark, sf_dir):
    """Content addresses, and whether the shard of an address is the beginning of its digest; a third is given a wrong one."""
    h = F.sha2("text", 256)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("object://"), F.left(h, F.lit(2)), F.lit("/"), h, F.lit(".txt")).alias("uri"))
    given = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("uri", "^object://..", "object://zz")).otherwise(F.col("uri"))
    shard, digest = F.regexp_extract(given, "^object://([^/]{2})/([0-9a-f]{64})[.]", 1), F.regexp_extract(given, "^object://([^/]{2})/([0-9a-f]{64})[.]", 2)
    return rows.select("doc_id", "uri", F.regexp_extract("uri", "^object://([^/]{2})/", 1).alias("shard"), ((shard != "") & (shard == F.left(digest, F.lit(2)))).alias("valid"))


@query("SELECT doc_id, 'ast_' || substr(sha256(source || chr(31) || sha256(text)), 1, 16) AS asset_id, 'chk_' || substr(sha256('ast_' || substr(sha256(source || chr(31) || sha256(text)), 1, 16) || chr(31) || '0'), 1, 16) AS chunk_id FROM documents")
def stable_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", readers.asset_id(F.col("source"), F.col("text")).alias("asset_id"))
    return rows.select("doc_id", "asset_id", T.stable_id("chk", 16, F.col("asset_id"), F.lit(0)).alias("chunk_id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_path_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT event_id, list_transform(json_keys(props), lambda k: '$.' || k || ': ' || json_extract_string(props, '$.' || k)) AS lines FROM events")
def json_flatten_flat(spark, sf_dir):
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    return table(spark, sf_dir, "events").select("event_id", F.transform(pairs, lambda e: F.concat(F.lit("$."), e["key"], F.lit(": "), e["value"])).alias("lines"))


@query("SELECT o_orderkey, 'orders record where o_orderkey is ' || o_orderkey || '.' || chr(10) || concat_ws(chr(10), 'o_custkey: ' || o_custkey, 'o_orderstatus: ' || nullif(o_orderstatus, 'P'), 'o_orderpriority: ' || o_orderpriority) AS text FROM orders")
def row_serialise(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return rows.select("o_orderkey", readers.row_text("orders", "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"]).alias("text"))


_CELL = "trim(regexp_replace(replace({c}, '|', '\\|'), '\\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, '| ' || {_CELL.format(c='role')} || ' | ' || {_CELL.format(c='text')} || ' |' AS line FROM conversations")
def markdown_table(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", readers.table_line(F.array("role", "text")).alias("line"))


@query("SELECT page_id, CASE ext WHEN 'html' THEN 'document' ELSE 'other' END AS kind FROM (SELECT page_id, lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages)")
def type_by_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.kind_by_name(F.regexp_extract("url", "^([^?#]*)", 1)).alias("kind"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' ELSE 'text/plain' END AS media FROM pages")
def type_by_content(spark, sf_dir):
    heads = F.element_at(F.array(F.unhex(F.lit("255044462D312E37")), F.unhex(F.lit("FFD8FFE0")), F.lit(b"plain text")), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", readers.media_by_content(heads).alias("media"))


@query("""SELECT page_id, status, CASE WHEN status = 206 THEN lower(substr(hex(encode(html)), 2 * a + 1, 2 * (least(b, n - 1) - a + 1))) END AS part FROM (
  SELECT *, CASE WHEN page_id % 5 = 0 THEN 200 WHEN page_id % 5 = 1 THEN 400 WHEN a >= n OR a > b THEN 416 ELSE 206 END AS status FROM (
    SELECT page_id, html, octet_length(encode(html)) AS n, CASE page_id % 5 WHEN 3 THEN 200 ELSE 5 END AS a, CASE page_id % 5 WHEN 4 THEN octet_length(encode(html)) - 1 WHEN 3 THEN 1000000 ELSE 14 END AS b FROM pages))""")
def byte_range(spark, sf_dir):
    """Parts of pages by range headers of every form."""
    headers = F.array(F.lit(None).cast("string"), F.lit("bits=1-2"), F.lit("bytes=5-14"), F.lit("bytes=200-1000000"), F.lit(" bytes=5- "))
    rows = table(spark, sf_dir, "pages").withColumn("r", fields.byte_range(F.element_at(headers, (F.pmod("page_id", F.lit(5)) + 1).cast("int")), F.octet_length("html").cast("long")))
    part = F.substring(F.encode("html", "UTF-8"), (F.col("r.first") + 1).cast("int"), (F.col("r.last") - F.col("r.first") + 1).cast("int"))
    return rows.select("page_id", "r.status", F.when(F.col("r.status") == 206, F.lower(F.hex(part))).alias("part"))


@query("SELECT event_id, left(regexp_replace(replace(regexp_replace(name, '^.*/', ''), '..', '_'), '[^A-Za-z0-9._-]+', '_', 'g'), 180) AS safe, CASE WHEN value < 5 THEN 'empty' WHEN value > 90 THEN 'size' WHEN event_type = 'error' THEN 'type' ELSE 'ok' END AS reason FROM (SELECT *, '../up/' || event_type || '.. (' || user_id || ')' || CASE WHEN event_type = 'error' THEN '.exe' ELSE '.TXT' END AS name FROM events)")
def upload_rules(spark, sf_dir):
    name = F.concat(F.lit("../up/"), "event_type", F.lit(".. ("), F.col("user_id").cast("string"), F.lit(")"), F.when(F.col("event_type") == "error", ".exe").otherwise(".TXT"))
    size = F.when(F.col("value") < 5, 0).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", fields.safe_name(name).alias("safe"), fields.upload_reason(name, size, ("txt", "md"), 90).alias("reason"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/data/in/' || event_type || '/x.txt' WHEN 1 THEN '/data/in/y' WHEN 4 THEN '/data/in' END AS at FROM events")
def path_confinement(spark, sf_dir):
    """Where paths lead below a folder; those that leave it lead nowhere."""
    forms = F.array(F.concat("event_type", F.lit("/./x.txt")), F.lit("a/b/../..//y"), F.lit("../in2/z"), F.lit("/etc/passwd"), F.lit("a/.."))
    return table(spark, sf_dir, "events").select("event_id", fields.confined(F.element_at(forms, (F.col("event_id") % 5 + 1).cast("int")), "/data/in").alias("at"))


# ---- blocks, chunks, transcripts -------------------------------------------------------------------------------------

_PHRASES = ("Thank you. Thank you. Thank you!", "you you you you", "Subtitles by someone", "the payment failed twice", "Oh", "♪♪♪")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT -row_number() OVER (), p FROM (VALUES """ + ", ".join(f"('{p}')" for p in _PHRASES) + """) AS v(p)),
n AS (SELECT id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM t),
w AS (SELECT id, x, string_split(x, ' ') AS w FROM n),
c AS (SELECT id, x, coalesce((SELECT array_to_string(w[1:k], ' ') FROM unnest(range(1, len(w) // 2 + 1)) AS u(k)
  WHERE len(w) % k = 0 AND len(list_filter(range(1, len(w) + 1), lambda i: w[i] <> w[(i - 1) % k + 1])) = 0 ORDER BY k LIMIT 1), x) AS once FROM w)
SELECT id, x = '' OR once IN (""" + ", ".join(f"'{p}'" for p in chunking.NOISE) + ") OR " + " OR ".join(f"starts_with(once, '{p}')" for p in chunking.CREDITS) + f" OR length(once) < {chunking.MIN_UTTERANCE} AS noise FROM c")
def transcript_noise_filter(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    extra = spark.createDataFrame([(-i, p) for i, p in enumerate(_PHRASES, 1)], "id long, text string")
    return turns.unionByName(extra).select("id", chunking.is_noise(F.col("text")).alias("noise"))


@query()
def transcript_merge(spark, sf_dir):
    return chunking.merged_transcripts(table(spark, sf_dir, "conversations"))


@query()
def chunk_pack(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "documents"))


@query()
def html_blocks(spark, sf_dir):
    return readers.blocks(table(spark, sf_dir, "pages"), "page_id", "html", readers.html_blocks)


@query()
def markdown_blocks(spark, sf_dir):
    return readers.blocks(table(spark, sf_dir, "documents"), "doc_id", "text", readers.markdown_blocks)


@query()
def html_groups(spark, sf_dir):
    """Blocks of pages numbered in groups: headings, sections and tables start one."""
    blocks = html_blocks(spark, sf_dir).withColumnRenamed("page_id", "doc_id").drop("section")
    return chunking.with_groups(chunking.with_sections(blocks)).groupBy("doc_id", "group").agg(F.count("*").alias("blocks"), F.min("ordinal").alias("first"))


@query()
def hash_embed(spark, sf_dir):
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([E.embed(t) for t in texts])

    return table(spark, sf_dir, "documents").select("doc_id", embed("text").alias("embedding"))


@query()
def citation_ground(spark, sf_dir):
    """Answers made of conversation turns with citations; only sentences that cite one of six sources stay."""

    @F.pandas_udf("text string, used array<long>")
    def ground(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([E.grounded(t, 6) for t in texts], columns=["text", "used"])

    cited = F.regexp_replace("text", r"([a-z])\.", r"$1 [2].")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ground(cited).alias("g")).select("conv_id", "turn", "g.text", "g.used")


# ---- entities --------------------------------------------------------------------------------------------------------


def _surfaces(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    forms = F.array(F.concat(F.lit("TX"), "o_orderkey"), F.concat(F.lit("Txn #"), "o_orderkey"), F.concat(F.lit("payment ref "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")))
    return orders.select("o_orderkey", F.posexplode(forms).alias("form", "surface"))


@query("SELECT o_orderkey, 'TX' || CASE WHEN o_orderkey < 1000 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END AS canonical, 3 AS forms FROM orders")
def canonical_ids(spark, sf_dir):
    """All spellings of an order's identifier fall together."""
    rows = _surfaces(spark, sf_dir).withColumn("canonical", I.canonical_identifier(F.col("surface"), "transaction"))
    return rows.groupBy("o_orderkey", "canonical").agg(F.count("*").cast("int").alias("forms"))


@query("SELECT c_custkey, 'person:full:' || least('customer', 'k' || c_nationkey) || '|' || greatest('customer', 'k' || c_nationkey) AS full_, 'person:init:c|k' || c_nationkey AS initials, 'person:last:k' || c_nationkey AS surname FROM customer")
def person_keys(spark, sf_dir):
    name = F.concat(F.lit("Dr. Customer K"), F.col("c_nationkey").cast("string"))
    k = I.person_keys(name)
    return table(spark, sf_dir, "customer").select("c_custkey", k["full"].alias("full_"), k["initials"].alias("initials"), k["surname"].alias("surname"))


@query("SELECT o_orderkey AS doc_id, 'transaction' AS type, 'TX' || (o_orderkey + 100000) AS canonical FROM orders UNION ALL SELECT o_orderkey, 'incident', 'INC' || (o_custkey + 1000) FROM orders")
def mention_extract(spark, sf_dir):
    text = F.concat(F.lit("see TX"), F.col("o_orderkey") + 100000, F.lit(" and inc"), F.col("o_custkey") + 1000)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(I.identifiers_in(text)).alias("m"))
    return rows.select("doc_id", "m.type", "m.canonical").distinct()


def _entities(spark, sf_dir) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(T.stable_id("ent", 12, F.lit("customer"), name).alias("entity_id"), F.lit("customer").alias("entity_type"), name.alias("canonical_name"), F.array(I.canonical_identifier(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), "customer")).alias("normalized_keys"))


@query("""WITH e AS (SELECT 'ent_' || substr(sha256('customer' || chr(31) || c_name), 1, 12) AS entity_id, c_custkey, c_name FROM customer)
SELECT o_orderkey AS mention_id, CASE o_orderkey % 3 WHEN 2 THEN 'ent_' || substr(sha256('customer' || chr(31) || 'UNKNOWN ' || o_orderkey), 1, 12) ELSE entity_id END AS entity_id,
  CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.0 END::DOUBLE AS score, CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalised' ELSE 'unresolved' END AS method
FROM orders JOIN e ON c_custkey = o_custkey""")
def cascade_exact_normalised(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(named, "o_custkey")
    surface = F.when(F.col("o_orderkey") % 3 == 0, F.col("c_name")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("client no "), "o_custkey")).otherwise(F.concat(F.lit("unknown "), "o_orderkey"))
    rows = rows.select(F.col("o_orderkey").alias("mention_id"), surface.alias("surface"), F.lit("customer").alias("entity_type"))
    key = F.when(F.col("surface").startswith("unknown"), I.text_key(F.col("surface"))).otherwise(I.canonical_identifier(F.regexp_replace("surface", " no ", " "), "customer"))
    return resolve.resolved(rows.withColumn("key", key), _entities(spark, sf_dir))


_W = "substr(sha256('{}' || c_custkey), 1, 8)"
_NAMED = f"SELECT c_custkey, 'C' || lpad(c_custkey::VARCHAR, 4, '0') AS id, {_W.format('a')} AS w1, {_W.format('b')} AS w2 FROM customer"


@query(f"""WITH e AS (SELECT *, count(*) OVER (PARTITION BY c_custkey // 2) AS pair FROM ({_NAMED})),
m AS (SELECT o_orderkey AS mention_id, o_orderkey % 7 AS form, e.*, 'ent_' || substr(sha256('customer' || chr(31) || 'DB' || o_orderkey), 1, 12) AS made FROM orders JOIN e ON c_custkey = o_custkey)
SELECT mention_id,
  CASE WHEN form <= 3 OR form = 6 AND pair = 1 THEN 'e-' || c_custkey WHEN form = 4 THEN made END AS entity_id,
  CASE form WHEN 0 THEN 'exact' WHEN 1 THEN 'normalised' WHEN 2 THEN 'fuzzy' WHEN 3 THEN 'semantic' WHEN 4 THEN 'database' WHEN 5 THEN 'none' ELSE 'exact' END AS method,
  CASE form WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN round(32 / 33.0, 4) WHEN 4 THEN 0.97 WHEN 5 THEN 0.0 WHEN 6 THEN 1.0 END::DOUBLE AS confidence,
  form = 6 AND pair > 1 AS needs_verification, CASE WHEN form IN (4, 5) THEN 0 WHEN form = 6 THEN pair ELSE 1 END AS candidates FROM m""")
def resolution_cascade(spark, sf_dir):
    """Mentions of customers in seven forms, of which each step of the cascade decides one: the id, the name as a key, the name
    without its first letter, its words turned round, a row of the system of record, a stranger, and a key that two share."""
    word = lambda salt: F.left(F.sha2(F.concat(F.lit(salt), F.col("c_custkey").cast("string")), 256), F.lit(8))
    named = table(spark, sf_dir, "customer").select("c_custkey", word("a").alias("w1"), word("b").alias("w2"))
    name, own = F.concat_ws(" ", "w1", "w2"), F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), F.greatest(F.lit(4), F.length(F.col("c_custkey").cast("string"))), F.lit("0")))
    shared = F.concat(F.lit("PAIR"), F.floor(F.col("c_custkey") / 2).cast("string"))
    entities = named.select(F.concat(F.lit("e-"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit("customer").alias("entity_type"), name.alias("canonical_name"), F.array(name).alias("aliases"), F.array(own, I.text_key(name), shared).alias("normalized_keys"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(named, "c_custkey")
    number, form = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 7
    odd = F.concat(F.lit("!"), number, F.lit("!"))
    surface = F.when(form == 0, own).when(form == 1, F.upper(name)).when(form == 2, F.substring(name, F.lit(2), F.length(name))).when(form == 3, F.concat_ws("-", "w2", "w1")).otherwise(odd)
    none = F.concat(F.lit("NONE"), number)
    keys = F.when(form == 0, F.array(own)).when(form == 1, F.array(none, I.text_key(name))).when(form == 4, F.array(F.concat(F.lit("DB"), number))).when(form == 6, F.array(shared)).otherwise(F.array(none))
    mentions = rows.select(F.col("o_orderkey").alias("mention_id"), surface.alias("surface"), F.lit("customer").alias("entity_type"), keys.alias("keys"))
    record = rows.where(form == 4).select(F.lit("customer").alias("entity_type"), F.concat(F.lit("DB"), number).alias("key"))
    found = cascade.resolved(mentions, entities, record)
    return found.select("mention_id", "entity_id", "method", F.when(F.col("method") != "semantic", F.col("confidence")).alias("confidence"), "needs_verification", F.size("candidates").alias("candidates"))


@query("SELECT user_id AS entity_id, list_distinct_ordered AS aliases, mentions, first_seen, last_seen, confidence FROM (SELECT user_id, count(*) AS mentions, min(event_id) AS first_seen, max(event_id) AS last_seen, max(value) AS confidence FROM events GROUP BY ALL) JOIN (SELECT user_id, list(event_type ORDER BY f) AS list_distinct_ordered FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY ALL) USING (user_id)")
def entity_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seen_at"), F.col("event_type").alias("alias"), F.lit("events").alias("source_id"), F.col("value").alias("confidence"))
    return resolve.merged(rows).select("entity_id", "aliases", "mentions", "first_seen", "last_seen", "confidence")


@query("SELECT c_custkey AS entity_id, modality, count(*) AS chunks, min(chunk) AS first_chunk FROM (SELECT c_custkey, 'row' AS modality, o_orderkey AS chunk FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 'event', event_id FROM customer JOIN events ON user_id = c_custkey) GROUP BY ALL")
def cross_modal_links(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.lit("row").alias("modality"), F.col("o_orderkey").alias("chunk"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.lit("event").alias("modality"), F.col("event_id").alias("chunk"))
    return rows.unionByName(events).join(customers, "entity_id", "left_semi").groupBy("entity_id", "modality").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first_chunk"))


@query("SELECT DISTINCT s_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, 'C' || lpad(l_suppkey::VARCHAR, 4, '0') AS canonical, 1.0::DOUBLE AS score FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey < 10000")
def exact_id_search(spark, sf_dir):
    """Questions that name a customer id of up to four digits find all chunks linked to it, however it was spelt."""
    asked = table(spark, sf_dir, "supplier").where("s_suppkey < 10000").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("why did customer #"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit(" fail?")).alias("text"))
    links = table(spark, sf_dir, "lineitem").select(I.canonical_identifier(F.concat(F.lit("Cust-"), F.col("l_suppkey").cast("string")), "customer").alias("canonical"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))
    return resolve.exact_ids(asked, links)


# ---- graph -----------------------------------------------------------------------------------------------------------


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    node = lambda df, key, p, label, name: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("node_id"), F.array(F.lit("Place" if p != "c" else "Party"), F.lit(label)).alias("labels"), F.to_json(F.struct(F.col(name).alias("name"))).alias("properties"))
    nodes = node(region, "r_regionkey", "r", "Region", "r_name").unionByName(node(nation, "n_nationkey", "n", "Nation", "n_name")).unionByName(node(customer, "c_custkey", "c", "Customer", "c_name"))
    edge = lambda df, a, b, kind: df.select(F.concat(F.lit(kind + ":"), a).alias("edge_id"), F.lit(kind).alias("type"), a.alias("start_id"), b.alias("end_id"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = edge(nation, name("n", "n_nationkey"), name("r", "n_regionkey"), "PART_OF").unionByName(edge(customer, name("c", "c_custkey"), name("n", "c_nationkey"), "LIVES_IN"))
    return nodes, edges


_EDGES = "edges AS (SELECT 'PART_OF' AS type, 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 'LIVES_IN', 'c' || c_custkey, 'n' || c_nationkey FROM customer), both_ AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)"


@query(f"WITH {_EDGES} SELECT 'label:Place' AS key, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'label:Party', count(*) FROM customer UNION ALL SELECT 'label:Customer', count(*) FROM customer UNION ALL SELECT 'label:Nation', count(*) FROM nation UNION ALL SELECT 'label:Region', count(*) FROM region UNION ALL SELECT 'edge:' || type, count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'nodes', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) UNION ALL SELECT 'edges', count(*) FROM edges")
def graph_census(spark, sf_dir):
    return graph.census(*_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES}, reach AS (SELECT 'r' || r_regionkey AS start_id, 'r' || r_regionkey AS node_id, 0 AS hops FROM region UNION SELECT start_id, b, hops + 1 FROM reach JOIN both_ ON a = node_id WHERE hops < 2) SELECT start_id, node_id, min(hops) AS hops FROM reach GROUP BY ALL")
def graph_neighbours(spark, sf_dir):
    """Two hops around every region."""
    _, edges = _graph(spark, sf_dir)
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start_id"))
    return graph.neighbours(starts, edges, 2)


_REACH = f"WITH RECURSIVE {_EDGES}, reach AS (SELECT 'r' || r_regionkey AS start_id, 'r' || r_regionkey AS node_id, 0 AS hops FROM region UNION SELECT start_id, b, hops + 1 FROM reach JOIN both_ ON a = node_id WHERE hops < 2), near AS (SELECT start_id, node_id, min(hops) AS hops FROM reach GROUP BY ALL), shown AS (SELECT *, count(*) OVER (PARTITION BY start_id) > 12 AS truncated FROM near QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY hops, node_id) <= 12)"


@query(f"{_REACH} SELECT start_id, node_id, hops, truncated FROM shown")
def graph_neighbourhood(spark, sf_dir):
    """Two hops around every region, the twelve nearest nodes, and whether there were more."""
    _, edges = _graph(spark, sf_dir)
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start_id"))
    return graph.neighbourhood(starts, edges, 2, 12)[0]


@query(f"{_REACH} SELECT start_id, count(DISTINCT least(a, b) || '-' || greatest(a, b)) AS edges FROM shown JOIN both_ ON a = node_id GROUP BY start_id")
def graph_neighbourhood_edges(spark, sf_dir):
    _, edges = _graph(spark, sf_dir)
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start_id"))
    return graph.neighbourhood(starts, edges, 2, 12)[1].groupBy("start_id").agg(F.count("*").alias("edges"))


@query("""SELECT 'nodes' AS what, count(*) AS n FROM (SELECT 'n' || n_nationkey AS x FROM nation UNION SELECT 'c' || o_custkey FROM orders UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION SELECT 'c' || c_custkey FROM customer) WHERE x NOT LIKE 'c%' OR x IN (SELECT 'c' || o_custkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'edges', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'unknown type PENDING', count(*) FROM orders WHERE o_orderstatus = 'P'""")
def graph_upsert(spark, sf_dir):
    """Orders become edges to their customers, whose nodes are made where they are missing; pending ones have no known type."""
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.array(F.lit("Nation")).alias("labels"), F.lit("{}").alias("properties"))
    orders, name = table(spark, sf_dir, "orders"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kind = F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("PLACED_BY")
    edges = orders.select(name("e", "o_orderkey").alias("edge_id"), kind.alias("type"), name("o", "o_orderkey").alias("start_id"), name("c", "o_custkey").alias("end_id"))
    nodes, kept = graph.upserted(nodes, edges, ("PLACED_BY",))
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    left_out = graph.rejected(edges, ("PLACED_BY",)).groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n"))
    return count(nodes, "nodes").unionByName(count(kept, "edges")).unionByName(left_out)


@query(f"WITH RECURSIVE {_EDGES}, small AS (SELECT * FROM both_ WHERE a NOT LIKE 'c%' AND b NOT LIKE 'c%'), p AS (SELECT ['n0'] AS path UNION ALL SELECT list_append(path, b) FROM p JOIN small ON a = path[len(path)] WHERE NOT list_contains(path, b) AND path[len(path)] <> 'n5' AND len(path) <= 4) SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS hops FROM p WHERE path[len(path)] = 'n5' ORDER BY hops, path LIMIT 25")
def graph_paths(spark, sf_dir):
    """Simple paths between two nations over regions."""
    _, edges = _graph(spark, sf_dir)
    return graph.simple_paths("n0", "n5", edges.where("type = 'PART_OF'"), 4)


@query("SELECT 'n' || n_nationkey AS node_id, n_name AS name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def graph_find_nodes(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    first = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return graph.find_nodes(nodes, "Nation", {"name": first}).select("node_id", F.get_json_object("properties", "$.name").alias("name"))


@query("SELECT 'chk' || doc_id AS start_id, type, end_id FROM (SELECT doc_id, 'BELONGS_TO' AS type, 'src:' || source AS end_id FROM documents UNION ALL SELECT doc_id, 'MENTIONS', 'lang:' || lang FROM documents)")
def graph_emission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("chk"), F.col("doc_id").cast("string")).alias("start_id"), F.array(F.struct(F.lit("BELONGS_TO").alias("type"), F.concat(F.lit("src:"), "source").alias("end_id")), F.struct(F.lit("MENTIONS").alias("type"), F.concat(F.lit("lang:"), "lang").alias("end_id"))).alias("e"))
    return docs.select("start_id", F.inline("e"))
