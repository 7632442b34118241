"""Readers: files of many formats and relational rows as blocks or texts."""

from __future__ import annotations

import csv
import io
import itertools
import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as T

BLOCKS = "ordinal long, kind string, section string, text string"
ROWS_A_BLOCK, BLOCKS_AT_ONCE, LEAVES_A_BLOCK, MAX_DEPTH, MAX_LEAVES, MAX_VALUE = 25, 64, 40, 12, 20_000, 2_000


def files(spark: SparkSession, path: str, glob: str = "*", modified_after: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) below a folder, in any store Spark reads; hidden files are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(path)


def asset_id(source: Column, content: Column) -> Column:
    return T.stable_id("ast", 16, source, F.sha2(content, 256))


# Extension to kind, by a connector's naming.
KIND_OF = {"csv": "table", "xlsx": "table", "parquet": "table", "jsonl": "table", "txt": "document", "md": "document", "html": "document", "json": "document", "pdf": "document", "docx": "document", "pptx": "document", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "mp3": "audio", "wav": "audio", "mp4": "video", "mov": "video"}
# First bytes, as hex, to media type.
MAGIC = (("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("504B0304", "application/zip"), ("494433", "audio/mpeg"), ("1F8B", "application/gzip"))


def kind_by_name(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for p in KIND_OF.items() for x in p])[extension], F.lit("other"))


def media_by_content(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit("text/plain")
    for magic, media in reversed(MAGIC):
        out = F.when(head.startswith(magic), media).otherwise(out)
    return out


def row_text(table: str, key: str, columns: list[str]) -> Column:
    """``<table> record where <key> is <value>.`` and a line for each other column that is not null; "" without one."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.left(F.col(c).cast("string"), F.lit(MAX_VALUE)))) for c in columns if c != key]
    head = F.concat(F.lit(f"{table} record where {key} is "), F.col(key).cast("string"), F.lit("."))
    body = F.array_compact(F.array(*lines))
    return F.when(F.size(body) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(head), body), "\n"))


def cell(value: Column) -> Column:
    """A value as a cell of a Markdown table: bars escaped, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))


def table_line(cells: Column) -> Column:
    """One line of a Markdown table."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))


def not_blank(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) != "")


def markdown_table(rows: Column, header: bool = True) -> Column:
    """Rows of cells as a Markdown table: blank rows go, short ones are filled up. Without a header, or with one row alone,
    columns are numbered."""
    rows = F.filter(rows, not_blank)
    width = F.array_max(F.transform(rows, F.size))
    rows = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))
    numbered = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    named = (F.size(rows) > 1) & F.lit(header)
    head = F.when(named, rows[0]).otherwise(numbered)
    body = F.when(named, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    lines = F.concat(F.array(table_line(head), table_line(F.array_repeat(F.lit("---"), width))), F.transform(body, table_line))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(lines, "\n"))


# Media types and their readers.
READERS = {"text/csv": "csv", "text/plain": "text", "text/markdown": "markdown", "application/json": "json", "text/html": "html"}


def reader_for(media: Column) -> Column:
    """The reader of a media type, whatever its case and parameters; null if there is none."""
    plain = F.lower(F.trim(F.split_part(media, F.lit(";"), F.lit(1))))
    return F.create_map(*[F.lit(x) for pair in READERS.items() for x in pair])[plain]


def outside(words: DataFrame, tables: DataFrame, page: str, slack: float) -> DataFrame:
    """Words whose box lies in no table's box on their page, give or take ``slack``. Pages meet by equality, boxes by range."""
    w, t = words.alias("w"), tables.select(F.col(page).alias("_page"), F.col("box").alias("_box"))
    inside = (F.col("w.box.x0") >= F.col("_box.x0") - slack) & (F.col("w.box.y0") >= F.col("_box.y0") - slack) & (F.col("w.box.x1") <= F.col("_box.x1") + slack) & (F.col("w.box.y1") <= F.col("_box.y1") + slack)
    return w.join(t, (F.col(f"w.{page}") == F.col("_page")) & inside, "left_anti")


def csv_rows(text: str | None) -> Iterator[list[str]]:
    """Rows of cells of a CSV text, one by one; the separator is guessed from the beginning."""
    try:
        dialect = csv.Sniffer().sniff((text or "")[:4096], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    return csv.reader(io.StringIO(text or "", newline=""), dialect)


def csv_cells(text: str | None) -> list[list[str]]:
    """All rows of cells of a CSV text."""
    return list(csv_rows(text))


def csv_parts(text: str | None, rows_a_block: int) -> Iterator[list[list[str]]]:
    """The rows of a CSV text that are not blank, ``rows_a_block`` at a time, each time after the first row of all."""
    rows = (r for r in csv_rows(text) if any(c.strip(" \t\n\x0b\f\r") for c in r))
    if (header := next(rows, None)) is None:
        return
    part = list(itertools.islice(rows, rows_a_block))
    while True:
        yield [header, *part]
        if not (part := list(itertools.islice(rows, rows_a_block))):
            return


def csv_tables(files: DataFrame, id_col: str, text_col: str, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """(id, block, text): CSV texts as Markdown tables of ``rows_a_block`` rows under their header; blank rows go.

    A task hands on BLOCKS_AT_ONCE tables at a time, however long a text is.
    """
    kind = files.schema[id_col].dataType.simpleString()
    cells = pa.list_(pa.list_(pa.string()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = enumerate(csv_parts(batch.column(1)[i].as_py(), rows_a_block))
                while some := list(itertools.islice(parts, BLOCKS_AT_ONCE)):
                    ids = batch.column(0).take(pa.array([i] * len(some)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in some], pa.int64()), pa.array([rows for _, rows in some], cells)], names=["id", "block", "rows"])

    out = files.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, block long, rows array<array<string>>")
    return out.select(F.col("id").alias(id_col), "block", markdown_table(F.col("rows")).alias("text"))


def json_leaves(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, line): each leaf of a JSON text, nested or not."""

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(json_lines)

    return df.select(id_col, F.posexplode(lines(text_col)).alias("at", "line"))


class _HtmlBlocks(HTMLParser):
    """Blocks of a page; text inside scripts, styles and the like is dropped, tables are rows of cells."""

    DROP, OPEN = {"script", "style", "noscript", "template"}, {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.dropped, self.tag, self.parts = 0, None, []
        self.table: list[list[str]] | None = None

    def _close(self) -> None:
        text = " ".join("".join(self.parts).split())
        if self.tag and text:
            self.blocks.append(("heading" if self.tag[0] == "h" and len(self.tag) == 2 else "paragraph", text))
        self.tag, self.parts = None, []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.DROP:
            self.dropped += 1
        elif tag == "table":
            self._close()
            self.table = []
        elif self.table is not None:
            if tag == "tr":
                self.table.append([])
            elif tag in ("td", "th") and self.table:
                self.table[-1].append("")
        elif tag in self.OPEN:
            self._close()
            self.tag = tag
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROP:
            self.dropped = max(0, self.dropped - 1)
        elif tag == "table" and self.table is not None:
            rows = ["| " + " | ".join(" ".join(c.split()).replace("|", "\\|") for c in r) + " |" for r in self.table if any(c.strip() for c in r)]
            if rows:
                self.blocks.append(("table", "\n".join(rows)))
            self.table = None
        elif tag in self.OPEN and tag == self.tag:
            self._close()

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.table is not None:
            if self.table and self.table[-1]:
                self.table[-1][-1] += data
        elif self.tag:
            self.parts.append(data)


def html_blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of each block of a page."""
    parser = _HtmlBlocks()
    parser.feed(html or "")
    parser.close()
    parser._close()
    return parser.blocks


def markdown_blocks(text: str | None) -> list[tuple[str, str]]:
    """(kind, text): ATX headings, fenced code, lines of tables, paragraphs."""
    out, now, kind = [], [], "paragraph"

    def close() -> None:
        body = "\n".join(now).strip("\n")
        if body.strip():
            out.append((kind, body))
        now.clear()

    for line in (text or "").splitlines():
        if line.lstrip().startswith("```"):
            close()
            kind = "paragraph" if kind == "code" else "code"
            continue
        if kind == "code":
            now.append(line)
            continue
        bare = line.strip()
        marks = len(bare) - len(bare.lstrip("#"))
        if 1 <= marks <= 6 and bare[marks : marks + 1] == " ":
            close()
            out.append(("heading", bare[marks:].strip()))
            continue
        wanted = "table" if bare.startswith("|") else "paragraph"
        if not bare or wanted != kind:
            close()
            kind = wanted
        if bare:
            now.append(bare)
    close()
    return out


def json_lines(text: str | None) -> list[str]:
    """``$.path: value`` for each leaf, in order; a null shows nothing."""
    try:
        root = json.loads(text or "null")
    except ValueError:
        return []
    out: list[str] = []
    todo = [("$", root, 0)]
    while todo and len(out) < MAX_LEAVES:
        path, value, depth = todo.pop()
        if isinstance(value, dict) and depth < MAX_DEPTH:
            todo += [(f"{path}.{k}", v, depth + 1) for k, v in reversed(value.items())]
        elif isinstance(value, list) and depth < MAX_DEPTH:
            todo += [(f"{path}[{i}]", v, depth + 1) for i, v in reversed(list(enumerate(value)))]
        else:
            out.append(f"{path}: {'' if value is None else value}")
    return out


def blocks(df: DataFrame, id_col: str, text_col: str, reader) -> DataFrame:
    """(id, ordinal, kind, section, text) by one of the block readers; a heading is the section of what follows it."""
    kind_of_id = dict(df.dtypes)[id_col]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.id, batch.text):
                section = None
                for n, (kind, body) in enumerate(reader(text)):
                    section = body if kind == "heading" else section
                    rows.append((key, n, kind, section, body))
            yield pd.DataFrame(rows, columns=["id", "ordinal", "kind", "section", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(read, f"id {kind_of_id}, {BLOCKS}").withColumnRenamed("id", id_col)
