"""The sink of an ingest: chunks and their four indexes (text vectors, image vectors, words, links to entities), in step.

A write replaces all that the sink holds of the assets it brings: their old chunks are hidden in every table and taken back
from the word index, then the new ones are written, and one manifest shows both. A step that fails is a warning of the report
and leaves the other steps alone. Chunks carry the version of the index that they were written for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import embed as E
from siftline.operators.index_store import SegmentStore, TextIndex

TABLES = ("chunks", "text_vectors", "image_vectors", "links")


@dataclass(frozen=True)
class Report:
    index_version: str
    counts: dict[str, int]
    warnings: tuple[str, ...]


def text_vectors(chunks: DataFrame) -> DataFrame:
    """(asset_id, chunk_id, embedding) of chunks that are no images, by the deterministic embedding."""

    @F.pandas_udf("array<double>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(E.embed)

    return chunks.where("modality <> 'image'").select("asset_id", "chunk_id", vector("text").alias("embedding"))


@dataclass
class Sink:
    """chunks: (asset_id, chunk_id long, ordinal, modality, text); ids tell chunks apart over all assets."""

    spark: SparkSession
    root: str
    signature: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        signature = {"embedding": "hashed", "dimension": E.DIMENSION, **self.signature}
        self.store = SegmentStore(self.spark, f"{self.root}/sink", signature, key="asset_id")
        self.words = TextIndex(self.spark, f"{self.root}/words", signature)

    def write(self, assets: DataFrame, chunks: DataFrame, image_vectors: DataFrame | None = None, links: DataFrame | None = None) -> Report:
        """Puts ``chunks`` in the place of all that is held of ``assets`` (asset_id); an asset without chunks is purged.

        image_vectors: (asset_id, chunk_id, embedding); links: (asset_id, chunk_id, entity_id, score).
        """
        warnings: list[str] = []
        note = lambda step, e: warnings.append(f"{step}: {type(e).__name__}: {str(e)[:200]}")
        before = self.store.live("chunks")
        chunks = chunks.withColumn("index_version", F.lit(self.store.version))
        tables = {"chunks": chunks, "text_vectors": text_vectors(chunks)}
        if image_vectors is not None:
            tables["image_vectors"] = image_vectors
        if links is not None:
            tables["links"] = links
        try:  # words first: a manifest of their own, found again by what the last manifest of the sink shows
            if before is not None:
                old = before.join(assets.select("asset_id").distinct(), "asset_id", "left_semi").select(F.col("chunk_id").alias("doc_id"))
                self.words.delete(old)
            self.words.write(chunks.select(F.col("chunk_id").alias("doc_id"), "text"))
        except Exception as e:  # noqa: BLE001
            note("words", e)
        manifest = self.store.commit(tables, assets.select("asset_id"), failed=note)
        generation = max(int(s.split(":")[0]) for s in manifest.segments)
        counts = {t: self.store.read(t, manifest).where(F.col("generation") == generation).count() for t in tables if any(t in names and s.startswith(f"{generation}:") for s, names in manifest.segments.items())}
        return Report(self.store.version, counts, tuple(warnings))

    def read(self, table: str) -> DataFrame | None:
        """What is live of a table."""
        rows = self.store.live(table)
        return None if rows is None else rows.drop("generation")

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, asset_id, score, rank) by words."""
        found = self.words.search(questions, k).withColumnRenamed("doc_id", "chunk_id")
        return found.join(self.read("chunks").select("chunk_id", "asset_id"), "chunk_id").select("query_id", "chunk_id", "asset_id", "score", "rank")
