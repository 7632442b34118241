"""From assets to blocks as a table function: ``extract_blocks(name, content)``, joined laterally to a table of files.

The reader follows from what the content is, and only then from the name: an archive is looked into. An asset that can't be read
gives one row with the error, so it fails alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from siftline.sources import office, readers

BLOCK = "ordinal int, kind string, section string, locator string, text string, error string"


def kind_of(name: str | None, content: bytes) -> str:
    """docx, pptx, xlsx, pdf, image, html, json, markdown or text."""
    if content[:4] == b"PK\x03\x04":
        return office.office_kind(content) or "archive"
    head = content[:512].lstrip().lower()
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith((b"\x89PNG", b"\xff\xd8\xff", b"GIF8")):
        return "image"
    ending = (name or "").rpartition(".")[2].lower()
    if head.startswith((b"<!doctype html", b"<html")) or ending in ("html", "htm"):
        return "html"
    if ending in ("json", "md"):
        return {"json": "json", "md": "markdown"}[ending]
    return "text"


def blocks_of(name: str | None, content: bytes) -> Iterator[office.Block]:
    kind = kind_of(name, content)
    if kind in office.BLOCKS_OF:
        yield from office.BLOCKS_OF[kind](content)
        return
    if kind in ("archive", "pdf", "image"):
        raise ValueError(f"no reader for {kind}")
    text, section = content.decode("utf-8"), None
    if kind == "json":
        yield from (office.Block("paragraph", None, None, line) for line in readers.json_lines(text))
    elif kind == "text":
        for n, part in enumerate((" ".join(p.split()) for p in text.split("\n\n")), 1):
            if part:
                yield office.Block("paragraph", None, f"paragraph={n}", part)
    else:
        for what, body in (readers.html_blocks if kind == "html" else readers.markdown_blocks)(text):
            section = body if what == "heading" else section
            yield office.Block(what, section, None, body)


@udtf(returnType=BLOCK, useArrow=True)
class ExtractBlocks:
    def eval(self, name: str, content: bytes):
        n = 0
        try:
            for block in blocks_of(name, content or b""):
                yield n, block.kind, block.section, block.locator, block.text, None
                n += 1
        except Exception as e:  # noqa: BLE001  whatever it is, it is this asset's failure
            yield n, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


def extracted(assets: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """(id, ordinal, kind, section, locator, text, error) of assets with columns name and content."""
    spark: SparkSession = assets.sparkSession
    spark.udtf.register("extract_blocks", ExtractBlocks)
    return spark.sql(f"SELECT a.`{id_col}`, b.* FROM {{assets}} AS a, LATERAL extract_blocks(a.name, a.content) AS b", assets=assets.select(id_col, "name", F.col("content").cast("binary").alias("content")))
