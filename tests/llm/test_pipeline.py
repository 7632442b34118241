import corpus_pipeline as C
from siftline.llm import toxicity


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in C.STAGES:
        docs = C.staged(stage(spark, docs, sf), f"test-{name}")
        counts.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert all(i in kept for i, toxic in labels.items() if not toxic)
        if name == "exact_dedup":
            texts = [r.text.lower() for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts))
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    assert toxicity.THRESHOLD == 0.3 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_run_agrees_with_itself(spark, sf):
    rows = lambda: sorted(map(tuple, C.run(spark, sf).collect()))
    assert rows() == rows()


def test_odd_empty_and_clashing_tables(spark, sf, clashing, empty):
    for docs in (clashing, empty):
        columns, before = docs.columns, docs.count()
        for name, stage in C.STAGES:
            docs = C.staged(stage(spark, docs, sf), f"test-odd-{name}")
            if name != "byte_bpe":
                assert docs.columns == columns
            if name == "exact_dedup":
                kept = docs.select("text").collect()
                assert len({(r.text or "").lower() for r in kept}) == len(kept)
        assert (docs.count() == 0) == (before == 0) and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_clean_documents_stay_and_toxic_ones_go(spark):
    """A size at which labels of both kinds are many; held-out labels count as well."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in C.toxicity(spark, docs, sf).select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean, toxic = ([i for i, t in labels.items() if t == v] for v in (0, 1))
    assert sum(i in kept for i in clean) > 0.99 * len(clean) and sum(i in kept for i in toxic) < 0.1 * len(toxic)


def test_staged_tables_can_be_cleared(spark):
    from siftline.llm import common

    df = common.staged(spark.range(3), "clear-me")
    assert df.count() == 3
    other = spark.newSession()
    assert common.run_folder(spark) == common.run_folder(other)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.run_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    common.clear_staged(spark)
    assert not files.exists(path)
