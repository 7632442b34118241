"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 hashes every text to HASHES positions of a bit table and counts the hits on each position. Only positions
hit twice or more are kept, as bitmaps of 32,768 bits, one row each. Pass 2 looks every row up in the bitmaps:
a row with a position hit by itself alone has no equal and passes straight through. The remaining rows are
possibly repeated, and only they shuffle, to be grouped by the SHA-256 of the normalised text, so a false positive
of the filter costs a little traffic and never a wrong answer.

Scale. A position row of pass 1 is a number, summed on the map side. The bitmaps are broadcast; MAX_BITS bounds
them to 64 MB at any input size. Beyond about MAX_BITS / BITS_PER_ROW rows the filter grows denser and lets more
rows through to the grouping, which is exact by itself. Rows are summed by text and id before the shuffle and groups
again, so a text that makes up a third of the corpus arrives as one row per task and id, and rows that repeat both as
one number; the join that hands a group's result back is a plain equi-join of two staged tables, which adaptive
execution splits where one group is large.

Defined cases. A null text counts as empty, and empty texts equal each other. Null ids are smaller than any other
id; a group of null ids alone has a null keep_id and one of its rows stays. Rows that repeat both id and text count
towards group_size, and of those that tie for keep_id exactly one is kept. An empty table gives an empty result.
Other columns, whatever their names, are not read by ``ledger`` and are carried along by ``kept_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import ascii_lower, in_row, packed, staged, table

BITS_PER_ROW, HASHES, MAX_BITS = 16, 2, 1 << 29
BLOCK_BITS, PART = 32_768, 65_536  # bits of a block are fixed by bitmap_construct_agg
NO_ID = -(1 << 63)


def text_hash(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(ascii_lower(text), F.lit("")), 256)


def filter_blocks(rows: int) -> int:
    """Blocks of the filter: BITS_PER_ROW bits a row, at most MAX_BITS together."""
    return max(1, min(MAX_BITS, rows * BITS_PER_ROW) // BLOCK_BITS)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(HASHES)]


def bitmaps_of(keys: DataFrame, key: str, blocks: int, least: int = 1) -> DataFrame:
    """(block, bitmap) of the bits that ``least`` rows or more hit."""
    hit = keys.select(_block(F.col(key), blocks).alias("block"), F.array_distinct(F.array(*_bits(F.col(key)))).alias("bits"))
    hit = hit.select("block", F.explode("bits").alias("bit"))
    if least > 1:
        hit = hit.groupBy("block", "bit").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    return hit.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def repeated_bits(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Pass 1: (block, bitmap) of the bits that two rows or more hit."""
    return bitmaps_of(keys, key, blocks, 2)


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8))) == 1


def mark_possible(rows: DataFrame, key: Column, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """Pass 2: adds ``_possible``, false only for rows whose key occurs once."""
    side = F.broadcast(bitmaps.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap")))  # MAX_BITS at most
    found = rows.withColumn("_key", key).join(side, _block(F.col("_key"), blocks) == F.col("_block"), "left")
    possible = F.lit(True)
    for bit in _bits(F.col("_key")):
        possible = possible & _is_set(F.col("_bitmap"), bit)
    return found.withColumn("_possible", F.coalesce(possible, F.lit(False))).drop("_key", "_block", "_bitmap")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    hashes = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_sha256")), "hashes")
    blocks = filter_blocks(hashes.count())
    marked = mark_possible(hashes, F.col("text_sha256"), repeated_bits(hashes, "text_sha256", blocks), blocks)
    alone = marked.where("not _possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # rows that agree in id and text are told apart by number alone, so they are counted and written out again
    some = marked.where("_possible").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("rows"))
    some = staged(some, "possible")
    groups = staged(some.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")), "groups")
    some = some.join(groups, "text_sha256").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    once = some.where("rows = 1").select(*columns)
    many = some.where("rows > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PART))))
    many = many.repartition("text_sha256", "doc_id", "part")  # PART copies of a row are a task's at a time
    copy = F.explode(F.sequence(F.col("part") * PART, F.least((F.col("part") + 1) * PART, F.col("rows")) - 1))
    many = many.withColumn("copy", copy).withColumn("kept", F.col("kept") & (F.col("copy") == 0)).select(*columns)
    return alone.unionByName(once).unionByName(many)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest id.

    Only possibly repeated rows shuffle, dealt by text and id together, so copies of one text spread out.
    """
    cheap = lambda text: F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))  # noqa: E731  equal for texts that differ in case alone
    keys = staged(docs.select(cheap(F.col(text_col)).alias("key")), "keys")
    blocks = filter_blocks(keys.count())
    bitmaps = staged(repeated_bits(keys, "key", blocks), "bitmaps")
    marked = mark_possible(packed(docs), cheap(in_row(text_col)), bitmaps, blocks)
    some = marked.where("_possible").withColumn("_sha", text_hash(in_row(text_col)))
    some = some.withColumn("_id", F.coalesce(in_row(id_col).cast("long"), F.lit(NO_ID)))
    last = some.groupBy("_sha").agg(F.max("_id").alias("_id"))
    some = some.join(last, ["_sha", "_id"]).dropDuplicates(["_sha", "_id"])
    return marked.where("not _possible").select("row.*").unionByName(some.select("row.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       (doc_id IS NOT DISTINCT FROM max(doc_id) OVER g) AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept,
       text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
