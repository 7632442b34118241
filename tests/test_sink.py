from pyspark.sql import functions as F

from siftline.operators.sink import Sink

CHUNK = "asset_id long, chunk_id long, ordinal int, modality string, text string"


def test_assets_are_replaced_in_every_table(spark, tmp_path):
    sink = Sink(spark, f"file://{tmp_path}/s")
    assets = lambda *ids: spark.createDataFrame([(i,) for i in ids], "asset_id long")
    chunks = lambda *rows: spark.createDataFrame(list(rows), CHUNK)
    images = spark.createDataFrame([(1, 12, [1.0, 0.0])], "asset_id long, chunk_id long, embedding array<double>")
    links = spark.createDataFrame([(1, 10, "e1", 0.9), (2, 20, "e1", 0.8)], "asset_id long, chunk_id long, entity_id string, score double")
    report = sink.write(assets(1, 2), chunks((1, 10, 0, "document", "payments failed twice"), (1, 12, 1, "image", "a diagram"), (2, 20, 0, "document", "payments worked")), images, links)
    assert report.counts == {"chunks": 3, "text_vectors": 2, "image_vectors": 1, "links": 2} and report.warnings == ()
    asked = spark.createDataFrame([(1, "payments")], "query_id long, text string")
    assert {r.chunk_id for r in sink.search(asked, 5).collect()} == {10, 20}
    report = sink.write(assets(1), chunks((1, 11, 0, "document", "refunds arrived")))
    assert report.counts == {"chunks": 1, "text_vectors": 1}
    ids = lambda t: sorted(r.chunk_id for r in sink.read(t).collect())
    assert ids("chunks") == [11, 20] and ids("text_vectors") == [11, 20] and ids("image_vectors") == [] and ids("links") == [20]
    assert [(r.chunk_id, r.asset_id) for r in sink.search(asked, 5).collect()] == [(20, 2)] and sink.words.totals()[0] == 2
    assert {r.index_version for r in sink.read("chunks").collect()} == {report.index_version}


def test_a_failing_step_is_a_warning(spark, tmp_path):
    sink = Sink(spark, f"file://{tmp_path}/s")
    bad = spark.range(1).select(F.lit(1).cast("long").alias("asset_id"), F.lit(10).cast("long").alias("chunk_id"), F.raise_error(F.lit("the model is down")).cast("array<double>").alias("embedding"))
    report = sink.write(spark.createDataFrame([(1,)], "asset_id long"), spark.createDataFrame([(1, 10, 0, "document", "one text")], CHUNK), image_vectors=bad)
    assert report.counts == {"chunks": 1, "text_vectors": 1} and len(report.warnings) == 1 and report.warnings[0].startswith("image_vectors")
    assert sink.read("image_vectors") is None and sink.read("chunks").count() == 1
