"""Folders that documents were written to, scanned, streamed and kept in step with."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from siftline.plans.base import Registry, table
from siftline.sources import assets, folders, office
from siftline.sources.connectors import FolderConnector, write_files
from siftline.streaming import ingest

query = Registry()


def _root(spark) -> str:
    return f"{folders.shared(spark)}/connector-{uuid.uuid4().hex}"


def _written(spark, sf_dir: str, root: str, where: str = "true", content=None) -> None:
    """A file for each document, in folders by source and language."""
    docs = table(spark, sf_dir, "documents").where(where)
    text = F.coalesce("text", F.lit(""))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    write_files(docs, root, path, F.encode(text, "UTF-8") if content is None else content)


def _id():
    return F.regexp_extract("path", r"(-?[0-9]+)\.txt$", 1).cast("long").alias("doc_id")


@query("SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, 'document' AS kind, octet_length(encode(text)) AS bytes, sha256(text) AS sha FROM documents")
def folder_scan(spark, sf_dir):
    """Every file of a folder through the data source: where it is, of what kind, how large, and its content's digest."""
    root = _root(spark)
    _written(spark, sf_dir, root)
    items = FolderConnector(spark, "docs", root)._reader(extensions="txt")
    return items.where("error IS NULL").select(_id(), "path", "kind", "bytes", F.sha2("content", 256).alias("sha"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS pass, sha256(text) AS sha FROM documents")
def folder_stream(spark, sf_dir):
    """A stream over a folder that is stopped and started again: the second pass brings what came since, once."""
    root, out = _root(spark), f"{folders.shared(spark)}/stream-{uuid.uuid4().hex}"
    source = FolderConnector(spark, "docs", root)
    for n, some in ((1, "doc_id % 2 = 0"), (2, "doc_id % 2 <> 0")):
        _written(spark, sf_dir, root, some)
        ingest.run_available(source.stream(), f"{out}/checkpoint", lambda batch, i, n=n: batch.withColumn("pass", F.lit(n)).write.mode("overwrite").parquet(f"{out}/items/batch={i}"))
    return spark.read.parquet(f"{out}/items").select(_id(), "pass", F.sha2("content", 256).alias("sha"))


@query("SELECT doc_id, doc_id % 10 <> 3 AS indexed, CASE WHEN doc_id % 10 <> 3 THEN length(text) END AS n_chars, CASE WHEN doc_id % 10 <> 3 THEN lang END AS lang FROM documents")
def incremental_sync(spark, sf_dir):
    """Documents as JSON files, of which some are cut off: these fail alone and stand in the table of dead letters."""
    root, target = _root(spark), f"{folders.shared(spark)}/sync-{uuid.uuid4().hex}"
    whole = F.encode(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")), "UTF-8")
    cut = F.substring(whole, F.lit(1), (F.octet_length(whole) - 1).cast("int"))
    _written(spark, sf_dir, root, content=F.when(F.col("doc_id") % 10 == 3, cut).otherwise(whole))

    def work(path: str, content: bytes) -> tuple:
        found = json.loads(content)
        return len(found["text"]), found.get("lang")

    ingest.sync(FolderConnector(spark, "docs", root), target, work, "n_chars long, lang string")
    good, bad = ingest.synced(spark, target), ingest.dead_letters(spark, target)
    good = good.select(_id(), F.lit(True).alias("indexed"), "n_chars", "lang")
    none = lambda kind: F.lit(None).cast(kind)
    return good.unionByName(bad.select(_id(), F.lit(False).alias("indexed"), none("long").alias("n_chars"), none("string").alias("lang")))


# ---- assets to blocks ------------------------------------------------------------------------------------------------

_FIELDS = "'| field | value |' || chr(10) || '| --- | --- |' || chr(10) || '| key | ' || c_custkey || ' |' || chr(10) || '| nation | ' || c_nationkey || ' |'"


@query(f"""SELECT c_custkey, ordinal, kind, section, locator, text FROM (
  SELECT c_custkey, 0 AS ordinal, 'heading' AS kind, c_name AS section, NULL AS locator, c_name AS text FROM customer WHERE c_custkey % 3 = 0 UNION ALL
  SELECT c_custkey, 1, 'paragraph', c_name, NULL, 'of the nation ' || c_nationkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL
  SELECT c_custkey, 2, 'table', c_name, NULL, {_FIELDS} FROM customer WHERE c_custkey % 3 = 0 UNION ALL
  SELECT c_custkey, 0, 'heading', c_name, 'slide=1', c_name FROM customer WHERE c_custkey % 3 = 1 UNION ALL
  SELECT c_custkey, 1, 'paragraph', c_name, 'slide=1', 'of the nation ' || c_nationkey FROM customer WHERE c_custkey % 3 = 1 UNION ALL
  SELECT c_custkey, 2, 'caption', c_name, 'slide=1', 'key ' || c_custkey FROM customer WHERE c_custkey % 3 = 1 UNION ALL
  SELECT c_custkey, 0, 'table', 'customer', 'sheet=customer;rows=2-3', {_FIELDS} FROM customer WHERE c_custkey % 3 = 2)""")
def office_blocks(spark, sf_dir):
    """A document, a presentation or a workbook for each customer, read back as blocks by the table function."""

    @F.pandas_udf("binary")
    def made(key: pd.Series, name: pd.Series, nation: pd.Series) -> pd.Series:
        out = []
        for k, who, n in zip(key, name, nation):
            cells = [["field", "value"], ["key", str(k)], ["nation", str(n)]]
            of = (lambda: office.write_docx(who, [f"of the nation {n}"], cells), lambda: office.write_pptx([(who, [f"of the nation {n}"], f"key {k}")]), lambda: office.write_xlsx({"customer": cells}))
            out.append(of[k % 3]())
        return pd.Series(out)

    files = table(spark, sf_dir, "customer").select("c_custkey", F.lit("file.bin").alias("name"), made("c_custkey", "c_name", "c_nationkey").alias("content"))
    return assets.extracted(files, "c_custkey").where("error IS NULL").drop("error")


@query()
def page_chunks(spark, sf_dir):
    """Web pages through the table function: blocks with their section, kind and place."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("page.html").alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return assets.extracted(pages, "page_id")
