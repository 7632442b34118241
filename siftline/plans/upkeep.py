"""Store upkeep, field rules, routing of formats, mentions, snippets and highlights."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import fields
from siftline.functions import text as T
from siftline.operators import chunking, index_store, marking, mentions, resolve, sink, store
from siftline.operators.lexical import ranked
from siftline.plans.base import Registry, table
from siftline.plans.content import _SENTENCES
from siftline.plans.retrieval import _ASKED, _BM25, _INDEX, _asked, _bm25_sql, _docs, sql_stem, sql_terms
from siftline.sources import folders, readers

query = Registry()


# ---- upkeep of indexes and stores ------------------------------------------------------------------------------------

_GONE = "source = 'src3'"


def _without_a_source(spark, sf_dir) -> index_store.TextIndex:
    """An index of its own of the documents, from which one source was then taken out."""
    docs = _docs(spark, sf_dir)
    index = index_store.TextIndex(spark, f"{folders.shared(spark)}/upkeep-{uuid.uuid4().hex}")
    index.write(docs)
    index.delete(docs.where(_GONE).select("doc_id"))
    return index


@query(f"WITH {_INDEX} SELECT term, count(*) AS df FROM tf WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE {_GONE}) GROUP BY ALL")
def lexical_retract(spark, sf_dir):
    """One source leaves the index: frequencies are lowered by what its documents held."""
    return _without_a_source(spark, sf_dir).df()


@query(f"WITH {_INDEX} SELECT doc_id, count(*) AS postings FROM tf WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE {_GONE}) GROUP BY ALL")
def lexical_delete(spark, sf_dir):
    return _without_a_source(spark, sf_dir).postings().groupBy("doc_id").agg(F.count("*").alias("postings"))


_NEXT = "CASE WHEN source = 'src1' THEN text || ' upkeep ' || lang ELSE text END"


@query(f"""WITH changed AS (SELECT doc_id, {_NEXT} AS text FROM documents WHERE NOT {_GONE}), {_INDEX.replace("FROM documents", "FROM changed")},
q AS (SELECT DISTINCT query_id, term FROM ({sql_terms("(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "text")})),
lex AS (SELECT query_id, doc_id, round(sum({_BM25}), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id) CROSS JOIN corpus GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex) WHERE rank <= 10""")
def index_upkeep(spark, sf_dir):
    """Changed documents written over, a source taken out, segments merged: what is found is what an index built anew finds."""
    docs, index = _docs(spark, sf_dir), _without_a_source(spark, sf_dir)
    index.write(docs.where(f"source = 'src1' AND NOT {_GONE}").select("doc_id", F.expr(_NEXT).alias("text")))
    index.merge()
    index.store.expire()  # nobody else reads this index
    return index.search(_asked(spark, sf_dir), 10)


_AFTER = "CASE WHEN source = 'src2' THEN [c[1]] ELSE c END"


@query(f"""WITH d AS (SELECT doc_id, source, {_SENTENCES} AS c FROM documents), n AS (SELECT doc_id, source, unnest({_AFTER}) AS text, generate_subscripts({_AFTER}, 1) AS i FROM d WHERE source <> 'src3' AND len(c) > 0)
SELECT source, count(*) AS chunks, count(*) AS vectors, count(*) FILTER (i = 1) AS links, sum(length(text))::BIGINT AS chars FROM n GROUP BY ALL""")
def sink_replace(spark, sf_dir):
    """Documents written as assets of sentences; one source is written again with first sentences alone, another with none.
    The counts are those of chunks, of their vectors and of their links, which must be in step."""
    docs = _docs(spark, sf_dir)
    cut = docs.select(F.col("doc_id").alias("asset_id"), "source", F.posexplode(T.sentences(F.col("text"))).alias("ordinal", "text"))
    chunks = cut.select("asset_id", (F.col("asset_id") * 1_000_000 + F.col("ordinal")).alias("chunk_id"), "ordinal", F.lit("document").alias("modality"), "text", "source")
    links = lambda some: some.where("ordinal = 0").select("asset_id", "chunk_id", F.concat(F.lit("source:"), "source").alias("entity_id"), F.lit(1.0).alias("score"))
    held = sink.Sink(spark, f"{folders.shared(spark)}/sink-{uuid.uuid4().hex}")
    held.write(docs.select(F.col("doc_id").alias("asset_id")), chunks, links=links(chunks))
    again = chunks.where("source = 'src2' AND ordinal = 0")
    held.write(docs.where("source IN ('src2', 'src3')").select(F.col("doc_id").alias("asset_id")), again, links=links(again))
    have = lambda t, name: held.read(t).select("chunk_id", F.lit(1).alias(name))
    rows = held.read("chunks").join(have("text_vectors", "v"), "chunk_id", "left").join(have("links", "l"), "chunk_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.count("v").alias("vectors"), F.count("l").alias("links"), F.sum(F.length("text")).alias("chars"))


@query("SELECT label, count(*) AS vectors FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3') GROUP BY ALL")
def vector_delete(spark, sf_dir):
    gone = _docs(spark, sf_dir).where(_GONE).select(F.col("doc_id").alias("vec_id"))
    return store.without(table(spark, sf_dir, "embeddings"), gone, "vec_id").groupBy("label").agg(F.count("*").alias("vectors"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_asset_chunks(spark, sf_dir):
    """Finished orders stand for assets, their lines for chunks."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.without(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("SELECT source, count(*) AS n FROM documents WHERE source <> 'src7' GROUP BY ALL")
def delete_source(spark, sf_dir):
    gone = spark.createDataFrame([("src7",)], "source string")
    return store.without(_docs(spark, sf_dir).select("source"), gone, "source").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT 'cascade' AS how, o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'null', o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN o_custkey END FROM orders")
def fk_cascade(spark, sf_dir):
    """The customers of a nation go; their orders go as well, or lose their customer."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    gone = customers.where("c_nationkey = 3")
    with_them = store.cascaded(customers, orders, gone, "c_custkey", "o_custkey")[1]
    orphans = store.cascaded(customers, orders, gone, "c_custkey", "o_custkey", keep_children=True)[1]
    return with_them.select(F.lit("cascade").alias("how"), "o_orderkey", "o_custkey").unionByName(orphans.select(F.lit("null").alias("how"), "o_orderkey", "o_custkey"))


@query("SELECT o_custkey AS entity_id, 'TX' || o_orderkey AS key FROM orders WHERE o_custkey % 2 = 1 UNION ALL SELECT c_custkey, unnest(['C' || c_custkey, upper(c_mktsegment)]) FROM customer WHERE c_custkey % 2 = 0")
def entity_key_bridge(spark, sf_dir):
    """Every second customer is written again, with new keys."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.concat(F.lit("TX"), "o_orderkey").alias("key"))
    segment = F.upper("c_mktsegment")
    again = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity_id"), F.array(F.concat(F.lit("C"), "c_custkey"), segment, segment).alias("normalized_keys"))
    return store.bridged(old, again)


@query("SELECT 'idx_' || event_id AS index_version, event_type AS embedding_model, ts AS created_at FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, 'idx_' || event_id DESC LIMIT 1")
def index_version_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return store.latest_version(rows.select(F.concat(F.lit("idx_"), "event_id").alias("index_version"), F.col("event_type").alias("embedding_model"), F.col("ts").alias("created_at")))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [1.0, 0.0]::DOUBLE[] ELSE [length(text), length(source)]::DOUBLE[] END AS embedding, 'idx_next' AS index_version FROM documents")
def reindex(spark, sf_dir):
    """Texts are embedded again from what is stored (here by their lengths), images keep their vectors."""
    chunks = _docs(spark, sf_dir).select("doc_id", "text", "source", F.when(F.col("doc_id") % 5 == 0, "image").otherwise("document").alias("modality"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    again = store.reindexed(chunks, F.array(F.length("text").cast("double"), F.length("source").cast("double")), "idx_next")
    return again.select("doc_id", "embedding", "index_version")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber")
def point_lookup(spark, sf_dir):
    """The chunks of one asset by ordinal."""
    return table(spark, sf_dir, "lineitem").where("l_orderkey = 7").orderBy("l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, 'customer/' || c_custkey AS locator FROM customer WHERE c_custkey = 11")
def record_by_key(spark, sf_dir):
    """One row and where it stands."""
    row = table(spark, sf_dir, "customer").where("c_custkey = 11").limit(1)
    return row.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("customer/"), "c_custkey").alias("locator"))


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def listing_filters(spark, sf_dir):
    """The second page by size; a filter that was not asked for does nothing."""
    page = store.listed(_docs(spark, sf_dir), {"lang": "en", "source": None}, [F.desc("n_chars"), F.asc("doc_id")], 20, 20)
    return page.select("doc_id", "source", "lang")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2') ORDER BY doc_id LIMIT 25 OFFSET 25")
def permission_listing(spark, sf_dir):
    """What the caller may not see goes before the page is cut, so pages are full."""
    page = store.listed(_docs(spark, sf_dir), {}, [F.asc("doc_id")], 25, 25, ~F.col("source").isin("src1", "src2"))
    return page.select("doc_id", "source")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 200")
def entity_link_cap(spark, sf_dir):
    """The 200 surest links of each entity."""
    return store.capped(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", [F.desc("value"), F.asc("event_id")])


@query("""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT s_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, max(round(l_discount * 10, 6)) AS score FROM supplier
  JOIN (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) ON l_suppkey = s_suppkey WHERE r <= 200 GROUP BY ALL)""")
def entity_link_search(spark, sf_dir):
    """Chunks linked to the entities that a question names: the surest 200 of each entity, ranked for each question."""
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("entity_id"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_discount").alias("confidence"))
    links = links.withColumn("score", F.round(F.col("confidence") * 10, 6))
    return ranked(resolve.linked(asked, links), None, "chunk_id")


_NAMES = ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")


@query("SELECT table_name AS name, column_name AS field, ordinal_position AS ordinal FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in _NAMES) + ")")
def schema_describe(spark, sf_dir):
    """Tables and columns of the catalogue, from schemas alone."""
    rows = store.described({t: table(spark, sf_dir, t) for t in _NAMES})
    return spark.createDataFrame(rows, "name string, field string, type string, ordinal int").select("name", "field", "ordinal")


_KEYS = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]


@query(" UNION ALL ".join(f"SELECT '{c}' AS child, '{f}' AS \"column\", '{p}' AS parent, count({f}) AS rows, count({f}) FILTER ({f} NOT IN (SELECT {k} FROM {p})) AS orphans FROM {c}" for c, f, p, k in _KEYS))
def catalog_keys(spark, sf_dir):
    """The declared relationships of the tables, and whether they hold."""
    names = {t for c, _, p, _ in _KEYS for t in (c, p)}
    return store.orphans({t: table(spark, sf_dir, t) for t in names}, _KEYS)


@query("SELECT (place - 1) // 500 AS batch, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders) GROUP BY ALL")
def table_stream(spark, sf_dir):
    """A table read by key in batches of 500; places are counted by range of the key, not in one task."""
    from siftline.plans.relational import ranked_down

    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = ranked_down(keys, keys, "o_orderkey", "place")
    return rows.groupBy(F.floor((F.col("place") - 1) / 500).alias("batch")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


# ---- fields ----------------------------------------------------------------------------------------------------------

_RAW_ID = "CASE o_orderkey % 5 WHEN 0 THEN ' tx' || (o_orderkey + 10000) || ' ' WHEN 1 THEN 'c' || (o_custkey + 1000) WHEN 2 THEN 'INC' || o_orderkey % 90 WHEN 3 THEN 'ast000' || o_orderkey % 10 ELSE 'tx00000000000000000' END"


@query(f"SELECT o_orderkey, CASE WHEN k THEN CASE WHEN regexp_matches(x, '^C[0-9]{{4,8}}$') THEN 'customer' WHEN regexp_matches(x, '^TX[0-9]{{4,8}}$') THEN 'transaction' WHEN regexp_matches(x, '^INC[0-9]{{3,8}}$') THEN 'incident' WHEN regexp_matches(x, '^AST[0-9]{{3,8}}$') THEN 'asset' END END AS type, CASE WHEN k AND regexp_matches(x, '^(C[0-9]{{4,8}}|TX[0-9]{{4,8}}|INC[0-9]{{3,8}}|AST[0-9]{{3,8}})$') THEN x END AS id FROM (SELECT o_orderkey, upper(trim(raw)) AS x, length(trim(raw)) <= 16 AS k FROM (SELECT o_orderkey, {_RAW_ID} AS raw FROM orders))")
def record_id_type(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.record_type(F.expr(_RAW_ID)).alias("r")).select("o_orderkey", "r.type", "r.id")


_WORDS = "CASE event_id % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'F' WHEN 2 THEN '' WHEN 3 THEN '12.50' WHEN 4 THEN 'NaN' WHEN 5 THEN 'maybe' ELSE NULL END"


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'F' WHEN 3 THEN '12.50' WHEN 4 THEN 'NaN' WHEN 5 THEN 'maybe' END AS text, CASE event_id % 7 WHEN 3 THEN 12.5::DOUBLE END AS number, CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN false END AS truth FROM events")
def field_coercion(spark, sf_dir):
    raw = F.expr(_WORDS)
    return table(spark, sf_dir, "events").select("event_id", fields.text_or_null(raw).alias("text"), fields.number_or_null(raw).alias("number"), fields.boolean_or_null(raw).alias("truth"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS shown, turn % 4 <> 3 AS had FROM conversations")
def reasoning_strip(spark, sf_dir):
    """Turns with reasoning of every form put around them."""
    forms = F.array(F.concat(F.lit("<think>a\nb</think> "), "text"), F.concat(F.lit("so it is </Reasoning>"), "text"), F.concat("text", F.lit("\n<scratchpad depth=1>and then")), F.col("text"))
    cut = fields.without_reasoning(F.element_at(forms, (F.pmod("turn", F.lit(4)) + 1).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cut.alias("c")).select("conv_id", "turn", F.col("c.text").alias("shown"), F.col("c.had_reasoning").alias("had"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(p_size * 1000 / 1001.0::DOUBLE, 3) WHEN 1 THEN p_size::DOUBLE ELSE NULL END AS rate FROM part")
def rate_parse(spark, sf_dir):
    forms = F.array(F.concat(F.col("p_size").cast("string"), F.lit("000/1001")), F.col("p_size").cast("string"), F.concat(F.col("p_size").cast("string"), F.lit("/0")), F.lit("n/a"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.rate(F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("rate"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def accent_strip(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.unaccented(F.col("text")).alias("plain"))


@query("""SELECT conv_id, turn, CASE WHEN v IS NULL AND s IS NULL THEN '' ELSE concat_ws(chr(10), 'Scene ' || turn, 'Visual: ' || v, 'Spoken: ' || s) END AS scene, concat_ws(chr(10), 'Image: ' || conv_id, v, 'Text in image: ' || s) AS image
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS v, CASE WHEN turn % 3 = 0 THEN nullif(text, '') END AS s FROM conversations)""")
def media_text_compose(spark, sf_dir):
    """The texts of scenes (nothing, if only the head is known) and of images (never nothing)."""
    seen, said = F.when(F.col("turn") % 2 == 0, F.col("role")), F.when(F.col("turn") % 3 == 0, F.col("text"))
    scene = fields.labelled_lines(F.concat(F.lit("Scene "), "turn"), ("Visual", seen), ("Spoken", said))
    image = fields.labelled_lines(F.concat(F.lit("Image: "), "conv_id"), ("", seen), ("Text in image", said), least=0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scene.alias("scene"), image.alias("image"))


_LOCATED = "CASE event_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'video' WHEN 2 THEN 'database' WHEN 3 THEN 'graph' ELSE 'image' END"


@query(f"""SELECT event_id, CASE m WHEN 'graph' THEN 'external' ELSE m END AS kind, CASE WHEN m IN ('database', 'graph') THEN 's1' ELSE 'a' || user_id END AS id,
  CASE m WHEN 'document' THEN 3 END AS page, CASE m WHEN 'video' THEN event_id / 2.0::DOUBLE END AS start_s,
  CASE m WHEN 'database' THEN 'unknown' WHEN 'graph' THEN 'a' || user_id END AS "table", CASE m WHEN 'database' THEN 'c' || event_id END AS record, CASE m WHEN 'document' THEN event_type END AS section
FROM (SELECT *, {_LOCATED} AS m FROM events)""")
def locator_reconstruct(spark, sf_dir):
    """Locators of chunks of every modality from their own columns; nothing is made up."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    metadata = F.create_map(F.lit("page"), F.lit("3"), F.lit("start_seconds"), (F.col("event_id") / 2.0).cast("string"))
    at = fields.locator(F.expr(_LOCATED), name("a", "user_id"), F.lit("s1"), name("c", "event_id"), F.col("event_id"), F.col("event_type"), metadata)
    return table(spark, sf_dir, "events").select("event_id", at.alias("at")).select("event_id", "at.kind", "at.id", "at.page", "at.start_s", "at.table", "at.record", "at.section")


_SCHEMA = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}, "mode": {"type": "string", "enum": ["fast", "deep"], "default": "fast"}}}
_OBJECT = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{\"k\": \"' || event_type || '\"}' WHEN 2 THEN '{\"mode\": \"slow\", \"more\": 1}' ELSE '{\"k\": 50, \"mode\": \"deep\"}' END"


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN k < 10 THEN ['k: beyond minimum 10'] WHEN k > 80 THEN ['k: beyond maximum 80'] ELSE [] END WHEN 1 THEN ['k: expected integer']
  WHEN 2 THEN ['(root): k is required', '(root): unknown more', 'mode: not one of the values'] ELSE [] END AS wrong, CASE event_id % 4 WHEN 2 THEN '"slow"' WHEN 3 THEN '"deep"' ELSE '"fast"' END AS mode
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def schema_validate(spark, sf_dir):
    """Objects held against a schema, and their properties with defaults filled in."""
    value = F.expr(_OBJECT)
    return table(spark, sf_dir, "events").select("event_id", fields.violations(value, _SCHEMA).alias("wrong"), fields.with_defaults(value, _SCHEMA)["mode"].alias("mode"))


# ---- formats ---------------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey, block, '| c_custkey | c_name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' | a, b |', chr(10) ORDER BY c_custkey) AS text FROM (
  SELECT n_nationkey, c_custkey, c_name, (row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1) // 25 AS block FROM nation JOIN customer ON c_nationkey = n_nationkey) GROUP BY n_nationkey, block""")
def csv_blocks(spark, sf_dir):
    """The customers of each nation as a CSV file with quoted cells and blank rows, read in tables of 25 rows."""
    line = F.concat(F.lit("\n\n"), "c_custkey", F.lit(","), "c_name", F.lit(',"a, b"'))
    files = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line"))))["line"].alias("lines"))
    files = files.select("n_nationkey", F.concat(F.lit("c_custkey,c_name,note"), F.array_join("lines", ""), F.lit("\n , ,\n")).alias("text"))
    return readers.csv_tables(files, "n_nationkey", "text")


@query("""SELECT o_orderkey, unnest(list_concat(['$.order.key: ' || o_orderkey], list_transform(range(0, len(n)), lambda i: '$.order.lines[' || i || '].number: ' || n[i + 1]))) AS line
FROM (SELECT o_orderkey, list(l_linenumber ORDER BY l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)""")
def json_nested(spark, sf_dir):
    """Nested objects and arrays as lines, one for each leaf."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.struct(n.alias("number"))).alias("lines"))
    value = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("key"), "lines").alias("order")))
    return readers.json_leaves(lines.select("o_orderkey", value.alias("text")), "o_orderkey", "text").select("o_orderkey", "line")


_MEDIA = "CASE doc_id % 6 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'Text/HTML; charset=utf-8' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/markdown' WHEN 4 THEN 'application/x-unknown' ELSE 'text/plain' END"


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'html' WHEN 2 THEN 'json' WHEN 3 THEN 'markdown' WHEN 4 THEN NULL ELSE 'text' END AS reader FROM documents")
def format_routing(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", readers.reader_for(F.expr(_MEDIA)).alias("reader"))


@query("SELECT o_orderkey, '| col_1 | col_2 | col_3 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || o_orderstatus || ' | a\\|b |  |' || chr(10) || '| ' || o_orderkey || ' |  | x y |' AS shown FROM orders")
def markdown_ragged(spark, sf_dir):
    """Rows of unequal width without a header: filled up, the header numbered, blank rows dropped."""
    rows = F.array(F.array(F.col("o_orderstatus"), F.lit("a|b")), F.array(F.lit(" "), F.lit(None)), F.array(F.col("o_orderkey").cast("string"), F.lit(""), F.lit(" x \n y ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", readers.markdown_table(rows, header=False).alias("shown"))


@query("SELECT c_custkey, list_filter([trim(c_name), trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END)], lambda x: x <> '') AS cells FROM customer WHERE c_custkey % 2 = 0")
def non_empty_rows(spark, sf_dir):
    """Rows whose cells are all blank go."""
    cells = F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" "), F.when((F.col("c_custkey") % 3 == 0) | (F.col("c_custkey") % 2 == 1), "  ").otherwise(F.col("c_mktsegment")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", cells.alias("cells")).where(readers.not_blank(F.col("cells")))
    return rows.select("c_custkey", F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "").alias("cells"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem w WHERE NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderkey = w.l_orderkey AND w.l_quantity >= o_custkey % 40 - 1 AND w.l_quantity + 2 <= o_custkey % 40 + 15 + 1 AND w.l_linenumber >= 1 - 1 AND w.l_linenumber + 1 <= 4 + 1)""")
def spatial_containment(spark, sf_dir):
    """Words on a page that lie in no table of it: boxes of words and tables, with one unit to spare. A page is the equal key."""
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("page"), F.struct(F.col("l_quantity").alias("x0"), F.col("l_linenumber").alias("y0"), (F.col("l_quantity") + 2).alias("x1"), (F.col("l_linenumber") + 1).alias("y1")).alias("box"))
    left = (F.col("o_custkey") % 40).cast("double")
    tables = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.struct(left.alias("x0"), F.lit(1).alias("y0"), (left + 15).alias("x1"), F.lit(4).alias("y1")).alias("box"))
    return readers.outside(words, tables, "page", 1.0).select("l_orderkey", "l_linenumber")


# ---- mentions, snippets, highlights ----------------------------------------------------------------------------------

_REPORT = "'Mr. Karl Weber reported INC' || (o_custkey + 1000) || ' about payment ' || (o_orderkey + 20000) || ' at pay-gateway on ' || o_orderdate::DATE || '. Root Cause Analysis follows.'"


@query(f"""SELECT o_orderkey AS doc_id, unnest([
    {{'entity_type': 'person', 'surface': 'Karl Weber', 'confidence': 0.8::DOUBLE, 'extractor': 'person'}}, {{'entity_type': 'incident', 'surface': 'INC' || (o_custkey + 1000), 'confidence': 0.99, 'extractor': 'pattern'}},
    {{'entity_type': 'transaction', 'surface': (o_orderkey + 20000)::VARCHAR, 'confidence': 0.75, 'extractor': 'context'}}, {{'entity_type': 'service', 'surface': 'pay-gateway', 'confidence': 0.6, 'extractor': 'pattern'}},
    {{'entity_type': 'event', 'surface': (o_orderdate::DATE)::VARCHAR, 'confidence': 0.9, 'extractor': 'pattern'}}], recursive := true),
  unnest([strpos(t, 'Karl') - 1, strpos(t, 'INC') - 1, strpos(t, 'payment') + 7, strpos(t, 'pay-') - 1, strpos(t, ' on ') + 3]) AS start FROM (SELECT *, {_REPORT} AS t FROM orders)""")
def mention_readings(spark, sf_dir):
    """People, identifiers, services, dates and numbers in context; of overlapping readings the strongest."""
    text = F.concat(F.lit("Mr. Karl Weber reported INC"), F.col("o_custkey") + 1000, F.lit(" about payment "), F.col("o_orderkey") + 20000, F.lit(" at pay-gateway on "), F.col("o_orderdate").cast("date").cast("string"), F.lit(". Root Cause Analysis follows."))
    found = mentions.mentions_in(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    return found.select("doc_id", "entity_type", "surface", F.col("start").cast("long").alias("start"), "confidence", "extractor")


@query("SELECT doc_id, word AS surface, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{3,8}\\b')) AS word FROM documents) GROUP BY ALL")
def bare_numbers(spark, sf_dir):
    """The numbers that documents hold, which context may type."""
    numbers = mentions.found(_docs(spark, sf_dir).select("doc_id", "text"), mentions.NUMBER, "other", mentions.CONTEXT_SURE, "context")
    return numbers.groupBy("doc_id", "surface").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'transaction' WHEN 1 THEN 'person' WHEN 2 THEN 'person' ELSE 'other' END AS kind FROM orders")
def type_inference(spark, sf_dir):
    forms = F.array(F.concat(F.lit("txn "), F.col("o_orderkey") + 1000), F.lit("Anna Roth"), F.lit("Imran"), F.lit("the gateway"))
    return table(spark, sf_dir, "orders").select("o_orderkey", mentions.inferred_type(F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("kind"))


_SNIPPET_STOP = ", ".join(f"'{w}'" for w in T.SNIPPET_STOPWORDS)
_TERMS = f"(SELECT item_id AS query_id, list(w ORDER BY length(w) DESC, i) AS terms FROM (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(x) AS w, unnest(range(0, len(x))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9#]+') AS x FROM benchmark)) WHERE length(w) >= 3 AND w NOT IN ({_SNIPPET_STOP}) GROUP BY ALL) GROUP BY item_id)"


@query(f"SELECT b.item_id AS query_id, coalesce(terms, []) AS terms FROM benchmark b LEFT JOIN {_TERMS} t ON t.query_id = b.item_id")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), marking.query_terms(F.col("text")).alias("terms"))


def _results(spark, sf_dir) -> DataFrame:
    """(query_id, doc_id, text): the three best documents of each benchmark question."""
    best = index_store.stored(_docs(spark, sf_dir)).search(_asked(spark, sf_dir), 3)
    return best.select("query_id", "doc_id").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")


_BEST = f"{_bm25_sql(_ASKED)}, best AS (SELECT query_id, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM lex) JOIN documents USING (doc_id) WHERE r <= 3)"


@query(f"""WITH {_BEST},
b AS (SELECT query_id, doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, '(?i)(' || array_to_string(terms, '|') || ')' AS pattern FROM best JOIN {_TERMS} USING (query_id)),
h AS (SELECT query_id, doc_id, unnest(regexp_extract_all(flat, pattern)) AS word, unnest(list_transform(regexp_split_to_array(flat, pattern), lambda g: length(g))[1:len(regexp_extract_all(flat, pattern))]) AS gap, unnest(range(0, len(regexp_extract_all(flat, pattern)))) AS nth FROM b),
p AS (SELECT query_id, doc_id, CAST(sum(gap + length(word)) OVER (PARTITION BY query_id, doc_id ORDER BY nth) AS BIGINT) AS stop, length(word) AS n FROM h),
d AS (SELECT *, stop - n AS start, count(*) OVER (PARTITION BY query_id, doc_id ORDER BY stop - n RANGE BETWEEN 120 PRECEDING AND 120 FOLLOWING) AS near FROM p),
m AS (SELECT query_id, doc_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY near DESC, start) AS r FROM d) WHERE r = 1),
w AS (SELECT b.*, start IS NULL AS none, greatest(0, least((start + stop) // 2 - 120, greatest(0, length(flat) - 240))) AS low FROM b LEFT JOIN m USING (query_id, doc_id)),
x AS (SELECT *, least(length(flat), low + 240) AS high FROM w),
y AS (SELECT *, length(regexp_extract(left(flat, low), '^.* ')) AS a, CASE WHEN high < length(flat) AND substr(flat, high, 1) <> ' ' THEN high + length(regexp_extract(substr(flat, high + 1), '^[^ ]*')) ELSE high END AS z FROM x)
SELECT query_id, doc_id, CASE WHEN none THEN left(flat, 240) || CASE WHEN length(flat) > 240 THEN '…' ELSE '' END
  ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || regexp_replace(substr(flat, a + 1, z - a), pattern, '«\\1»', 'g') || CASE WHEN z < length(flat) THEN '…' ELSE '' END END AS snippet FROM y""")
def snippets(spark, sf_dir):
    """For each result of each question the part of the text that says most about it."""
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), marking.query_terms(F.col("text")).alias("terms"))
    return marking.snippets(_results(spark, sf_dir).join(terms, "query_id"), ["query_id", "doc_id"])


@query(f"""WITH {_BEST},
t AS (SELECT query_id, doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS words, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}_]+') AS gaps FROM best),
u AS (SELECT query_id, doc_id, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap, unnest(range(0, len(words))) AS nth FROM t),
p AS (SELECT query_id, doc_id, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY query_id, doc_id ORDER BY nth) AS BIGINT) AS stop FROM u),
h AS (SELECT query_id, doc_id, stop - length(word) AS start, stop FROM (SELECT *, lower(word) AS lw FROM p) JOIN (SELECT DISTINCT query_id, term FROM ({sql_terms(f"({_ASKED})", "query_id", "text")})) q USING (query_id)
      WHERE term = {sql_stem("lw")} AND lw NOT IN ({", ".join(f"'{w}'" for w in T.STOPWORDS)})),
g AS (SELECT *, CASE WHEN coalesce(start > lag(stop) OVER o + 90, true) THEN 1 ELSE 0 END AS fresh FROM h WINDOW o AS (PARTITION BY query_id, doc_id ORDER BY start)),
l AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY query_id, doc_id ORDER BY start) AS BIGINT) AS place FROM g),
f AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY query_id, doc_id, place ORDER BY start), greatest(start - 90, 0)) AS since FROM l WHERE place <= 3),
z AS (SELECT query_id, doc_id, place, any_value(text) AS text, min(since) AS low, max(stop) AS last, string_agg(substr(text, since + 1, start - since) || '<em>' || substr(text, start + 1, stop - start) || '</em>', '' ORDER BY start) AS body
      FROM f JOIN best USING (query_id, doc_id) GROUP BY ALL)
SELECT query_id, doc_id, place, CASE WHEN low > 0 THEN '...' ELSE '' END || regexp_replace(body || substr(text, last + 1, least(90, length(text) - last)), '^\\s+|\\s+$', '', 'g') || CASE WHEN last + 90 < length(text) THEN '...' ELSE '' END AS highlight FROM z""")
def highlights(spark, sf_dir):
    """For each result of each question the first windows around its words."""
    terms = _asked(spark, sf_dir).select("query_id", F.array_distinct(T.analysed(F.col("text"))).alias("terms"))
    return marking.highlights(_results(spark, sf_dir).join(terms, "query_id"), ["query_id", "doc_id"])


_SIGNATURE = {"embedding_model": "hashed", "embedding_dimension": 512, "parser_version": "1"}


def _fixture_version() -> str:
    return "idx_" + hashlib.sha256(b'{"embedding_dimension": 512, "embedding_model": "hashed", "parser_version": "1"}').hexdigest()[:12]


@query(f"SELECT '{_fixture_version()}' AS version, count(*) AS chunks FROM documents")
def index_signature(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.count("*").alias("chunks")).select(F.lit(store.index_version(_SIGNATURE)).alias("version"), "chunks")
