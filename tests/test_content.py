import pytest
from pyspark.sql import functions as F

from siftline.functions import embed
from siftline.functions import identifiers as I
from siftline.operators import chunking, graph, marking, mentions, resolve
from siftline.plans.sql_guard import Guard, Rejected
from siftline.sources import readers


def test_spellings_of_an_identifier(spark):
    rows = spark.createDataFrame([("Txn 82931",), ("TX82931",), ("transaction #0082931",), ("82931",), ("tx-7",), ("",), ("abc",)], "s string")
    assert [r.k for r in rows.select(I.canonical_identifier(F.col("s"), "transaction").alias("k")).collect()] == ["TX82931"] * 4 + ["TX0007", "", "ABC"]


def test_person_keys(spark):
    r = spark.createDataFrame([("Dr. Mohammed  Imran",)], "s string").select(I.person_keys(F.col("s")).alias("k")).first().k
    assert (r["full"], r["initials"], r["surname"]) == ("person:full:imran|mohammed", "person:init:m|imran", "person:last:imran")


def test_identifiers_in_text(spark):
    r = spark.createDataFrame([("why did customer #00123456 and INC1829 fail, see txn 82931 or DOC2201",)], "s string").select(I.identifiers_in(F.col("s")).alias("i")).first().i
    assert {(x["type"], x["canonical"]) for x in r} == {("customer", "C123456"), ("incident", "INC1829"), ("transaction", "TX82931"), ("asset", "DOC2201")}


def test_packing():
    sizes = [100, 200, 50, 40, 300, 10]
    units = [" ".join(["w"] * n) for n in sizes]
    assert chunking.pack(units) == [[0, 1, 2], [2, 3], [4, 5]] or chunking.pack(units)[0] == [0, 1, 2]
    for chunk in chunking.pack(units):
        assert sum(sizes[i] for i in chunk) <= 380 or len(chunk) == 1
    assert {i for c in chunking.pack(units) for i in c} == set(range(6)) and chunking.pack([]) == []
    assert [len(u.split()) for u in chunking.units_of("w " * 800)] == [380, 380, 40]


@pytest.mark.parametrize("text,noise", [("Thank you. Thank you!", True), ("Oh", True), ("♪", True), ("Subtitles by me", True), ("you you you", True), ("the card payment failed", False), ("thank you for the refund today", False)])
def test_noise(spark, text, noise):
    assert spark.createDataFrame([(text,)], "t string").select(chunking.is_noise(F.col("t")).alias("n")).first().n is noise


def test_transcripts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "w " * 100), (1, 1, "assistant", "w " * 100), (1, 2, "user", "w " * 250), (1, 3, "user", " ")], "conv_id long, turn long, role string, text string")
    got = chunking.merged_transcripts(rows).orderBy("ordinal").collect()
    assert [(r.first_turn, r.last_turn, r.tokens) for r in got] == [(0, 1, 200), (2, 2, 250)]


def test_snippets(spark):
    text = "start " * 60 + "the payment failed because the payment\n gateway broke " + "end " * 60
    rows = spark.createDataFrame([(1, text, ["payment", "gateway"]), (2, None, ["x"]), (3, "short text", ["zzz"]), (4, "w " * 200, []), (5, "payments", ["payment"])], "id long, text string, terms array<string>")
    got = {r.id: r.snippet for r in marking.snippets(rows, ["id"]).collect()}
    assert "«payment» failed" in got[1] and got[1].startswith("…") and got[1].endswith("…") and "«payment» «gateway» broke" in got[1]
    assert 240 <= len(got[1].replace("«", "").replace("»", "")) <= 260
    assert got[2] == "" and got[3] == "short text" and got[4] == ("w " * 120 + "…") and got[5] == "«payment»s"
    terms = spark.createDataFrame([("Why did TX82931 fail, and the payments fail?",), (None,)], "q string").select(marking.query_terms(F.col("q")).alias("t")).collect()
    assert terms[0].t == ["payments", "tx82931", "fail"] and terms[1].t == []


def test_highlights(spark):
    far = "x " * 100
    rows = spark.createDataFrame([(1, f"payments one {far}payment two payment {far}Payment {far}payment", ["payment"]), (2, "nothing", ["payment"]), (3, None, ["a"])], "id long, text string, terms array<string>")
    got = [(r.place, r.highlight) for r in marking.highlights(rows, ["id"]).orderBy("id", "place").collect()]
    assert [p for p, _ in got] == [1, 2, 3] and got[0][1].startswith("<em>payments</em> one x") and got[0][1].endswith("...")
    assert "<em>payment</em> two <em>payment</em>" in got[1][1] and got[1][1].startswith("...") and "<em>Payment</em>" in got[2][1]


def test_mentions(spark):
    text = "Dr. Anna Roth and M. Imran saw Root Cause and customer 12345678 with 4821 near the ticket, billing-service, 11 March 2024, 1234"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "4821"), (4, "outage" + " " * 41 + "4821")], "doc_id long, text string")
    found = mentions.mentions_in(rows).orderBy("doc_id", "start").collect()
    assert all(text[r.start : r.stop] == r.surface for r in found)
    assert [(r.entity_type, r.surface, r.confidence) for r in found] == [
        ("person", "Anna Roth", 0.8), ("person", "M. Imran", 0.65), ("customer", "customer 12345678", 0.92), ("incident", "4821", 0.75),
        ("service", "billing-service", 0.6), ("event", "11 March 2024", 0.9), ("incident", "1234", 0.75),
    ]


def test_accents_do_not_tell_people_apart(spark):
    rows = spark.createDataFrame([("Jürgen Müller",), ("Jurgen Muller",), ("Ju\u0308rgen Mu\u0308ller",)], "s string")
    assert {r.k for r in rows.select(I.person_keys(F.col("s"))["full"].alias("k")).collect()} == {"person:full:jurgen|muller"}


def test_csv_and_tables(spark):
    rows = spark.createDataFrame([(1, 'a;b\n1;"x;y"\n;\n2;z|z\n'), (2, ""), (3, None), (4, "alone,row")], "id long, text string")
    got = {(r.id, r.block): r.text for r in readers.csv_tables(rows, "id", "text", 1).collect()}
    assert got == {(1, 0): "| a | b |\n| --- | --- |\n| 1 | x;y |", (1, 1): "| a | b |\n| --- | --- |\n| 2 | z\\|z |", (4, 0): "| col_1 | col_2 |\n| --- | --- |\n| alone | row |"}


def test_merged_spans(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.5), (1, 0.5, 3.0), (1, 3.0, 4.0), (1, 4.0, 4.5), (1, 4.5, 9.0)], "id long, start double, stop double")
    got = [(r.start, r.stop) for r in chunking.merged_spans(rows, F.lit(1.5)).orderBy("ordinal").collect()]
    assert got == [(0.0, 0.5), (0.5, 4.5), (4.5, 9.0)]


def test_html_and_markdown():
    html = "<h1>T</h1><script>var x='<p>'</script><p>a <b>b</b><p>c<table><tr><th>k</th><td>v|w</td></tr></table><li>d"
    assert readers.html_blocks(html) == [("heading", "T"), ("paragraph", "a b"), ("paragraph", "c"), ("table", "| k | v\\|w |"), ("paragraph", "d")]
    assert readers.markdown_blocks("# H\ntext\nmore\n\n| a |\n```\n# no\n```\n") == [("heading", "H"), ("paragraph", "text\nmore"), ("table", "| a |"), ("code", "# no")]
    assert readers.json_lines('{"a": [1, {"b": null}], "c": "x"}') == ["$.a[0]: 1", "$.a[1].b: ", "$.c: x"] and readers.json_lines("{") == []


def test_embedding_and_grounding():
    v = embed.embed("payment failed")
    assert len(v) == 512 and abs(sum(x * x for x in v) - 1) < 1e-9 and embed.embed("") == [0.0] * 512
    assert embed.grounded("A fact. [1]\nAnother [9]. None here. Last [2][3].", 3) == ("A fact. [1] Last [2][3].", [1, 2, 3])


def test_cascade(spark):
    entities = spark.createDataFrame([("e1", "person", "Mohammed Imran", ["person:full:imran|mohammed"]), ("e2", "person", "Anna Berg", ["k"]), ("e3", "person", "Anna Bergs", ["k"])], "entity_id string, entity_type string, canonical_name string, normalized_keys array<string>")
    mentions = spark.createDataFrame([(1, "Mohammed Imran", "person", "x"), (2, "Imran, Mohammed", "person", "person:full:imran|mohammed"), (3, "Mohammed Imrans", "person", "y"), (4, "who", "person", "k"), (5, "nobody", "other", "z")], "mention_id long, surface string, entity_type string, key string")
    got = {r.mention_id: (r.entity_id, r.method) for r in resolve.resolved(mentions, entities).collect()}
    assert got[1] == ("e1", "exact") and got[2] == ("e1", "normalised") and got[3] == ("e1", "fuzzy")
    assert got[4][1] == "unresolved" and got[5][1] == "unresolved"  # a key of two entities decides nothing


def test_graph(spark):
    edges = spark.createDataFrame([("e1", "R", "a", "b"), ("e2", "R", "b", "c"), ("e3", "S", "c", "d"), ("e4", "R", "a", "c")], "edge_id string, type string, start_id string, end_id string")
    start = spark.createDataFrame([("a",)], "start_id string")
    assert {(r.node_id, r.hops) for r in graph.neighbours(start, edges, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.node_id for r in graph.neighbours(start, edges, 3, ("R",)).collect()} == {"a", "b", "c"}
    assert [r.path for r in graph.simple_paths("a", "d", edges, 4).collect()] == ["a>c>d", "a>b>c>d"]
    nodes, kept = graph.upserted(spark.createDataFrame([("a", ["L"], "{}")], "node_id string, labels array<string>, properties string"), edges, ("R",))
    assert {r.node_id for r in nodes.collect()} == {"a", "b", "c"} and kept.count() == 3


def test_sql_guard(spark):
    spark.range(3).createOrReplaceTempView("open_table")
    spark.range(3).createOrReplaceTempView("closed_table")
    guard = Guard(spark, ("open_table",), row_cap=2)
    r = guard.query("SELECT id FROM open_table WHERE id >= :low", {"low": 0})
    assert r.truncated and r.rows.count() == 2
    assert guard.query("WITH x AS (SELECT id FROM open_table) SELECT count(*) AS n FROM x").rows.first().n == 3
    for bad in ("SELECT * FROM closed_table", "DROP TABLE open_table", "SELECT 1; SELECT 2", "SELECT * FROM open_table WHERE id IN (SELECT id FROM closed_table)",
                "WITH closed_table AS (SELECT * FROM closed_table) SELECT * FROM closed_table", "INSERT INTO open_table VALUES (1)", "SELECT /*! 1 */ 1", "SELECT * FROM open_table UNION ALL SELECT * FROM closed_table"):
        with pytest.raises(Rejected):
            guard.query(bad)
    with pytest.raises(Rejected):
        guard.query("SELECT 1", role="viewer")
    assert guard.audit().where("not ok").count() == 9


def test_sql_guard_reads_the_tree_and_not_its_text(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("open_table")
    guard = Guard(spark, ("open_table",))
    for bad in ("SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT 'CTE [parquet.zz]' AS a FROM parquet.zz",
                "SELECT 'CTE [closed_table]' AS a FROM closed_table", "SELECT * FROM range(3)", "SELECT id FROM open_table WHERE input_file_name() = ''", "SELECT id FROM open_table ORDER BY (SELECT max(reflect('a', 'b')) FROM open_table)",
                "SELECT current_user()", "WITH x AS (SELECT * FROM parquet.`/etc`) SELECT * FROM x", "SELECT x.* FROM open_table, LATERAL (SELECT * FROM closed_table) AS x", "DESCRIBE open_table", "SET spark.sql.ansi.enabled=false"):
        with pytest.raises(Rejected):
            guard.query(bad)
    fine = "WITH x AS (SELECT id, row_number() OVER (ORDER BY id) AS r, upper(concat('a', id)) AS u FROM open_table) SELECT count(*) AS n, round(sum(id) / 2, 2) AS h, max(u) AS u, array_join(collect_list(CASE WHEN r > 1 THEN 'y' END), ',') AS j FROM x WHERE EXISTS (SELECT 1 FROM open_table o WHERE o.id = x.id)"
    assert guard.query(fine).rows.first().n == 3
    guard.write_audit(f"file://{tmp_path}/audit")
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 13 and guard.trail == []


def test_sql_guard_lets_no_name_be_computed(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("open_table")
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).write.parquet(f"file://{tmp_path}/file")
    spark.sql("CREATE OR REPLACE TEMP VIEW looks_open AS SELECT * FROM secret")
    guard = Guard(spark, ("open_table",))
    for bad in ("SELECT * FROM IDENTIFIER('secret')", f"SELECT * FROM IDENTIFIER('parquet.`{tmp_path}/file`')", "SELECT IDENTIFIER('java_method')('java.lang.System','getProperty','user.home')",
                "SELECT IDENTIFIER('id') FROM open_table", "SELECT * FROM open_table WHERE id IN (SELECT id FROM IDENTIFIER('se' || 'cret'))", "WITH x AS (SELECT * FROM IDENTIFIER('secret')) SELECT * FROM x",
                "SELECT * FROM open_table TABLESAMPLE (10 PERCENT)", "TABLE secret", "FROM secret SELECT *", "SELECT TRANSFORM(id) USING 'cat' FROM open_table", "FROM open_table |> SELECT id |> UNION ALL (TABLE secret)",
                "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'", "VALUES ((SELECT max(id) FROM secret))", "SELECT * FROM looks_open", "SELECT * FROM open_table LATERAL VIEW java_method('java.lang.System', 'exit', '0') AS e"):
        with pytest.raises(Rejected):
            guard.query(bad)
    with pytest.raises(Rejected):
        guard.query("SELECT * FROM IDENTIFIER(:t)", {"t": "secret"})
    with pytest.raises(Rejected):
        guard.check_read(spark.sql("SELECT * FROM open_table WHERE id IN (SELECT id FROM secret)"))
    for fine in ("SELECT id FROM open_table WHERE id IN (1, 2) UNION SELECT 7 ORDER BY 1 LIMIT 2 OFFSET 1", "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y)", "SELECT transform(array(id), x -> x + 1) AS a FROM open_table", "SELECT id, e FROM open_table LATERAL VIEW explode(array(1, 2)) AS e",
                 "SELECT a.id, b.n FROM open_table a LEFT JOIN (SELECT id, count(*) AS n FROM open_table GROUP BY id HAVING count(*) > 0) b USING (id)",
                 "SELECT sum(id) OVER w AS s FROM open_table WINDOW w AS (ORDER BY id)", "WITH a AS (SELECT id FROM open_table), b AS (SELECT * FROM a) SELECT * FROM b JOIN a USING (id)"):
        assert guard.query(fine).rows.count() > 0


def test_sql_guard_has_a_deadline(spark):
    spark.range(40_000_000_000).createOrReplaceTempView("long_table")
    with pytest.raises(TimeoutError):
        Guard(spark, ("long_table",), timeout_s=1).query("SELECT sum(sqrt(id) * sin(id)) AS s FROM long_table")
    assert spark.range(5).count() == 5


def test_ranks_with_gaps_and_repeats(spark, tmp_path):
    from siftline.plans import relational

    ids = [1, 5, 5, 9, 1_000, 1_000_000, -3]
    spark.createDataFrame([(i,) for i in ids], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(5, "a", "en"), (1_000, "b", "de"), (9, "c", "en")], "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["rank"], r.chunk_id, r.source, r.missing) for r in relational.hydrate_left_join(spark, str(tmp_path)).collect())
    source = {5: "a", 9: "c"}
    assert got == [(n, i, source.get(i), i not in source) for n, i in enumerate(sorted(ids, reverse=True), 1)]


def test_groups_are_not_taken_whole(spark):
    rows = spark.createDataFrame([(c, t, "user", "w " * 100) for c in (1, 2) for t in range(300)], "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        merged = chunking.merged_transcripts(rows)
        got = sorted((r.conv_id, r.ordinal, r.first_turn, r.last_turn, r.segments) for r in merged.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(c, n, 3 * n, 3 * n + 2, 3) for c in (1, 2) for n in range(100)]
    assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().toString()


def test_merging_sums_mentions_before_it_collects(spark):
    rows = spark.createDataFrame([(1, 3, "b", "x", 0.5), (1, 1, "a", "y", 0.2), (1, 2, "b", "y", 0.9), (1, 9, None, "x", 0.1), (2, 4, "c", "z", None)], "entity_id long, seen_at long, alias string, source_id string, confidence double")
    merged = resolve.merged(rows)
    got = {r.entity_id: (r.aliases, r.sources, r.confidence, r.mentions, r.first_seen, r.last_seen) for r in merged.collect()}
    assert got == {1: (["a", "b", None], ["y", "x"], 0.9, 4, 1, 9), 2: (["c"], ["z"], None, 1, 4, 4)}
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_embedding_covers_documents_whole(spark, sf):
    from siftline.plans import content

    rows = content.hash_embed(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and all(len(r.embedding) == 512 for r in rows)
    assert all(r.embedding == embed.embed(texts[r.doc_id]) for r in rows[:5])


def test_a_restarted_stream_goes_on_where_it_was(spark, tmp_path):
    from siftline.streaming import ingest

    source, target, checkpoint = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], schema)
    first.coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.run_available(ingest.arriving(spark, source, first), checkpoint, ingest.deduplicated_into(target))
    run()
    spark.createDataFrame([(5, "b"), (6, "c"), (7, "")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    rows = spark.read.parquet(target).collect()
    assert sorted(r.text or "" for r in rows) == ["", "a", "b", "c"] and {r.batch for r in rows} == {0, 1}


def test_embedding_hashes_a_word_once_and_is_what_it_was(monkeypatch):
    import hashlib
    import math

    def plain(text):
        out = [0.0] * embed.DIMENSION
        for feature, weight in embed.weights(text).items():
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
            out[h % embed.DIMENSION] += weight if h >> 63 else -weight
        size = math.sqrt(sum(x * x for x in out))
        return out if size < 1e-12 else [x / size for x in out]

    texts = ["Payment payment failed, payment again: TX82931!", "", None, "?!", "a b a b a", "the longest words of all " * 50]
    assert [embed.embed(t) for t in texts] == [plain(t) for t in texts]
    made, real = [], hashlib.blake2b
    monkeypatch.setattr(embed.hashlib, "blake2b", lambda *a, **b: made.append(a) or real(*a, **b))
    embed.embed("unheard words")
    first = len(made)
    embed.embed("unheard words")
    assert first and len(made) == first
