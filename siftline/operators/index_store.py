"""A stored index of segments: immutable parts, tombstones, one manifest that is switched last.

``SegmentStore`` keeps named tables under a folder whose name carries a digest of the settings that the tables were made
with, so an index of another analyser is another store. A commit writes a segment (a folder of its own), the keys that it
replaces or deletes (a tombstone hides a key in all earlier segments), and then a manifest with the next number. The
manifest is created, never overwritten: of two writers that started from the same one, the second is told so. Readers
see the last manifest and nothing that is not in it; a writer that died leaves files that no manifest names.

``TextIndex`` is a store of documents for BM25. A segment deals its documents over ranges of some POSTINGS postings. A range is
one row: ids and lengths of its documents, and the postings of its terms in BUCKETS columns by hash of the term, so
a question reads the columns of its terms alone. Document frequencies and totals are kept as changes, which a commit adds
for what it writes and takes back for what it replaces, so they always equal those of an index built anew.

Top k. A task takes range after range with the best k of each question so far. In a range the largest share of each of a
question's terms bounds the rest: terms whose shares together stay beneath the current kth score can't bring a document
in by themselves, and a document is given up as soon as what it has and what is left can't reach that score. A
task hands on k rows a question. One range in SAMPLE is taken first, and its kth scores are where all tasks begin.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators.lexical import K1, B, postings
from siftline.operators.store import index_version
from siftline.sources import folders

POSTINGS, BUCKETS, SAMPLE, ASKED_AT_ONCE = 250_000, 32, 16, 256
#: Of the text analysis; another number makes another index.
ANALYSER = 1


class ConcurrentCommit(RuntimeError):
    """Another writer committed meanwhile; read the store again and repeat."""


@dataclass(frozen=True)
class Manifest:
    """segments: generation to the names of its tables. tombstones: generations that hide keys in earlier segments."""

    version: int = 0
    segments: dict[str, list[str]] = field(default_factory=dict)
    tombstones: list[int] = field(default_factory=list)
    totals: dict[str, int] = field(default_factory=dict)
    created_at: float = 0.0


@dataclass
class SegmentStore:
    spark: SparkSession
    root: str
    signature: dict[str, Any]
    key: str = "doc_id"
    options: dict[str, dict[str, str]] = field(default_factory=dict)  # of the writers of its tables

    def __post_init__(self) -> None:
        self.version = index_version(self.signature)
        self.path = f"{self.root}/{self.version}"
        jvm = self.spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The last that is whole."""
        folder = self._path(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        for name in sorted((n for n in names if n.endswith(".json") and not n.startswith(".")), reverse=True):
            found = self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()
            try:
                return Manifest(**json.loads(found.value))
            except (ValueError, AttributeError):  # being written
                continue
        return Manifest()

    def _put(self, manifest: Manifest) -> None:
        """Creates the next manifest; of two writers one wins."""
        at = self._path(f"{self.path}/manifest/{manifest.version:09d}.json")
        try:
            out = self._files.create(at, False)
        except Exception as e:
            if self._files.exists(at):
                raise ConcurrentCommit(f"version {manifest.version} is there already") from None
            raise e
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()

    def commit(self, tables: dict[str, DataFrame], gone: DataFrame | None = None, totals: dict[str, int] | None = None, base: Manifest | None = None, replace: bool = False, failed: Callable[[str, Exception], None] | None = None) -> Manifest:
        """Adds a segment and hides ``gone`` (the key column) in the segments before it; ``replace`` leaves it as the only one.

        If ``failed`` is given, a table that can't be written is reported to it and left out of the segment.
        """
        base = self.manifest() if base is None else base
        generation = base.version + 1
        folder = f"{self.path}/segments/g{generation:09d}-{uuid.uuid4().hex[:8]}"
        for name, df in list(tables.items()):
            try:
                df.write.options(**self.options.get(name, {})).parquet(f"{folder}/{name}")
            except Exception as e:
                if failed is None:
                    raise
                failed(name, e)
                tables = {k: v for k, v in tables.items() if k != name}
        segments = {} if replace else dict(base.segments)
        if tables:
            segments[f"{generation}:{folder.rpartition('/')[2]}"] = sorted(tables)
        tombstones = [] if replace else list(base.tombstones)
        if gone is not None:
            gone.select(self.key).where(F.col(self.key).isNotNull()).distinct().write.parquet(f"{self.path}/tombstones/{generation}-{folder.rpartition('-')[2]}")
            tombstones.append(f"{generation}-{folder.rpartition('-')[2]}")
        sums = {} if replace else dict(base.totals)
        for name, n in (totals or {}).items():
            sums[name] = sums.get(name, 0) + n
        new = Manifest(generation, segments, tombstones, sums, time.time())
        self._put(new)
        return new

    def drop(self, path: str) -> None:
        """Deletes a folder of this store that nothing reads any more."""
        self._files.delete(self._path(path), True)

    def expire(self) -> None:
        """Deletes segments and tombstones that the last manifest doesn't name. For stores without readers of older ones, and
        without another writer."""
        last = self.manifest()
        named = {s.partition(":")[2] for s in last.segments} | set(map(str, last.tombstones))
        for kind in ("segments", "tombstones"):
            folder = self._path(f"{self.path}/{kind}")
            for name in [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []:
                if name not in named:
                    self.drop(f"{self.path}/{kind}/{name}")

    def read(self, name: str, manifest: Manifest | None = None) -> DataFrame | None:
        """All rows of a table with the ``generation`` of their segment, hidden ones too; None if no segment has it."""
        manifest, out = manifest or self.manifest(), None
        for segment, tables in manifest.segments.items():
            if name in tables:
                generation, folder = segment.split(":")
                part = self.spark.read.parquet(f"{self.path}/segments/{folder}/{name}").withColumn("generation", F.lit(int(generation)))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def hidden(self, manifest: Manifest | None = None) -> DataFrame | None:
        """(key, before): keys are hidden in segments of a generation below ``before``."""
        manifest, out = manifest or self.manifest(), None
        for t in manifest.tombstones:
            part = self.spark.read.parquet(f"{self.path}/tombstones/{t}").withColumn("before", F.lit(int(str(t).split("-")[0])))
            out = part if out is None else out.unionByName(part)
        return None if out is None else out.groupBy(self.key).agg(F.max("before").alias("before"))

    def live(self, name: str, manifest: Manifest | None = None) -> DataFrame | None:
        """The rows of a keyed table that no tombstone hides."""
        manifest = manifest or self.manifest()
        rows, hidden = self.read(name, manifest), self.hidden(manifest)
        if rows is None or hidden is None:
            return rows
        hidden = hidden.select(F.col(self.key).alias("_key"), "before")
        return rows.join(hidden, (F.col(self.key) == F.col("_key")) & (F.col("generation") < F.col("before")), "left_anti")


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return dict(found)


def _column(bucket: int) -> str:
    return f"b{bucket:02d}"


def _ranges(tf: DataFrame, documents: DataFrame) -> DataFrame:
    """(range, docs, b00, b01, ...): a row for each range."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    rows = tf.join(documents.select("doc_id", "range", "ord"), "doc_id").select("range", bucket.alias("bucket"), "term", "ord", F.col("tf").cast("int").alias("tf"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["term", "ord"])
        terms, start = np.unique(rows.term.to_numpy(dtype=str), return_index=True)
        data = _packed(terms=terms, start=np.append(start, len(rows)).astype(np.uint32), ord=rows.ord.to_numpy(np.uint32), tf=rows.tf.to_numpy(np.uint32))
        return pd.DataFrame({"range": [rows.range.iloc[0]], "bucket": [rows.bucket.iloc[0]], "data": [data]})

    def docs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        return pd.DataFrame({"range": [rows.range.iloc[0]], "docs": [_packed(ids=rows.doc_id.to_numpy(np.int64), length=rows.length.to_numpy(np.int64))]})

    packed = rows.groupBy("range", "bucket").applyInPandas(pack, "range long, bucket int, data binary")
    wide = packed.groupBy("range").pivot("bucket", list(range(BUCKETS))).agg(F.first("data"))
    wide = wide.select("range", *[F.col(str(i)).alias(_column(i)) for i in range(BUCKETS)])
    own = documents.select("range", "ord", "doc_id", "length").groupBy("range").applyInPandas(docs, "range long, docs binary")
    return own.join(wide, "range", "left")


class _Best:
    """The best k of each question over the ranges seen so far."""

    def __init__(self, asked: pd.DataFrame, floors: np.ndarray, avg_len: float, k: int):
        self.k, self.avg, self.floors = k, avg_len, floors
        self.by_bucket = {b: g for b, g in asked.groupby("bucket")}
        self.scores, self.ids = np.full((len(floors), k), -np.inf), np.full((len(floors), k), np.iinfo(np.int64).max)
        self.pairs = 0  # documents scored to the end

    def over(self, columns: dict[int, bytes | None], docs: dict[str, np.ndarray], mask: np.ndarray | None) -> None:
        """One range. columns: of the buckets that the questions need. mask: documents that may be found."""
        ids, norm = docs["ids"], K1 * (1 - B + B * docs["length"] / self.avg)
        shares: dict[int, list[tuple[float, np.ndarray, np.ndarray]]] = {}
        for bucket, asked in self.by_bucket.items():
            if columns.get(bucket) is None:
                continue
            held = _unpacked(columns[bucket])
            terms = held["terms"]
            for term, some in asked.groupby("term"):
                at = int(np.searchsorted(terms, term))
                if at == len(terms) or terms[at] != term:
                    continue
                part = slice(int(held["start"][at]), int(held["start"][at + 1]))
                ords, tf = held["ord"][part], held["tf"][part].astype(np.float64)
                if mask is not None:
                    ords, tf = ords[mask[ords]], tf[mask[ords]]
                if not len(ords):
                    continue
                below = tf + norm[ords]
                share = np.where(below > 0, some.idf.iloc[0] * tf * (K1 + 1) / np.where(below > 0, below, 1), 0.0)
                for q in some.question:
                    shares.setdefault(q, []).append((float(share.max()), ords, share))
        for q, parts in shares.items():
            self._question(q, sorted(parts, key=lambda p: -p[0]), ids)

    def _question(self, q: int, parts: list, ids: np.ndarray) -> None:
        least = max(self.floors[q], self.scores[q, -1]) - 2e-6  # scores are rounded to six places
        left = np.append(np.cumsum([p[0] for p in parts][::-1])[::-1], 0.0)  # what parts from here on can bring
        if left[0] < least:
            return
        acc, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
        some = None  # once no new document can come in: those that still can
        for n, (_, ords, share) in enumerate(parts):
            if some is None and left[n] < least:
                some = seen & (acc + left[n] >= least)
            if some is None:
                acc[ords] += share
                seen[ords] = True
            else:
                keep = some[ords]
                acc[ords[keep]] += share[keep]
                some &= acc + left[n + 1] >= least
                if not some.any():
                    return
        found = np.flatnonzero(seen if some is None else some)
        self.pairs += len(found)
        scores = np.concatenate([self.scores[q], np.round(acc[found], 6)])
        names = np.concatenate([self.ids[q], ids[found]])
        best = np.lexsort((names, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[best], names[best]

    def rows(self) -> pd.DataFrame:
        at, nth = np.nonzero(np.isfinite(self.scores))
        return pd.DataFrame({"question": at.astype(np.int64), "doc_id": self.ids[at, nth], "score": self.scores[at, nth], "pairs": np.where(np.arange(len(at)) == 0, self.pairs, 0).astype(np.int64)})


@dataclass
class TextIndex:
    """Documents under BM25, kept in step by commits. ``signature``: what else the index depends on."""

    spark: SparkSession
    root: str
    signature: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # row groups of a few ranges, so that tasks can share a file
        small = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4"}
        self.store = SegmentStore(self.spark, self.root, {"analyser": ANALYSER, "buckets": BUCKETS, **self.signature}, options={"ranges": small})

    def write(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> Manifest:
        """Puts documents in, in place of those of the same ids; a null id is no document."""
        base = self.store.manifest()
        docs = docs.where(F.col(id_col).isNotNull()).withColumn(id_col, F.col(id_col).cast("long"))
        folder = f"{self.store.path}/work/{uuid.uuid4().hex}"
        postings(docs, id_col, text_col, title_col).write.parquet(f"{folder}/tf")
        tf = self.spark.read.parquet(f"{folder}/tf")
        lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
        ids = docs.select(F.col(id_col).alias("doc_id")).distinct().join(lengths, "doc_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))
        ranges = max(1, -(-tf.count() // POSTINGS))
        ids = ids.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)))
        ids = ids.withColumn("ord", F.row_number().over(W.partitionBy("range").orderBy("doc_id")) - 1)
        ids.write.parquet(f"{folder}/documents")
        documents = self.spark.read.parquet(f"{folder}/documents")
        more = tf.groupBy("term").agg(F.count("*").alias("df"))
        gone = documents.select("doc_id")
        change, less = self._taken_back(gone, base)
        added = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        totals = {"n": added.n - change["n"], "tokens": added.tokens - change["tokens"]}
        df = more if less is None else more.unionByName(less)
        tables = {"documents": documents, "ranges": _ranges(tf, documents), "df": df}
        manifest = self.store.commit(tables, gone if base.segments else None, totals, base)
        self.store.drop(folder)
        return manifest

    def delete(self, gone: DataFrame) -> Manifest:
        """Takes documents (doc_id) out."""
        base = self.store.manifest()
        change, less = self._taken_back(gone, base)
        return self.store.commit({"df": less} if less is not None else {}, gone, {"n": -change["n"], "tokens": -change["tokens"]}, base)

    def _taken_back(self, gone: DataFrame, base: Manifest) -> tuple[dict[str, int], DataFrame | None]:
        """What live documents among ``gone`` counted for; only ranges that hold one of them are read."""
        live = self.store.live("documents", base)
        if live is None:
            return {"n": 0, "tokens": 0}, None
        lost = live.join(gone.select("doc_id").distinct(), "doc_id", "left_semi")
        row = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        words = self._postings_of(lost, base).groupBy("term").agg((-F.count("*")).alias("df"))
        return {"n": row.n, "tokens": row.tokens}, words

    def _postings_of(self, documents: DataFrame, manifest: Manifest) -> DataFrame:
        """(doc_id, term, tf, length) of some rows of the table of documents."""
        wanted = documents.groupBy("generation", "range").agg(F.collect_list("ord").alias("ords"))  # of one range
        rows = self.store.read("ranges", manifest).join(wanted, ["generation", "range"])
        names = [_column(i) for i in range(BUCKETS)]

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    docs = _unpacked(row.docs)
                    keep = np.zeros(len(docs["ids"]), bool)
                    keep[np.asarray(row.ords, np.int64)] = True
                    for name in names:
                        if (data := getattr(row, name)) is None:
                            continue
                        held = _unpacked(data)
                        term = np.repeat(np.arange(len(held["terms"])), np.diff(held["start"].astype(np.int64)))
                        some = keep[held["ord"]]
                        at = held["ord"][some]
                        yield pd.DataFrame({"doc_id": docs["ids"][at], "term": held["terms"][term[some]], "tf": held["tf"][some].astype(np.int64), "length": docs["length"][at]})

        return rows.select("docs", "ords", *names).mapInPandas(unpack, "doc_id long, term string, tf long, length long")

    def postings(self) -> DataFrame:
        """(doc_id, term, tf, length) of what is live."""
        manifest = self.store.manifest()
        live = self.store.live("documents", manifest)
        if live is None:
            return self.spark.createDataFrame([], "doc_id long, term string, tf long, length long")
        return self._postings_of(live, manifest)

    def df(self) -> DataFrame:
        """(term, df) of what is live."""
        changes = self.store.read("df")
        if changes is None:
            return self.spark.createDataFrame([], "term string, df long")
        return changes.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def totals(self) -> tuple[int, float]:
        """Documents, and their average length (1 at least)."""
        sums = self.store.manifest().totals
        n = sums.get("n", 0)
        return n, max(1.0, sums.get("tokens", 0) / n) if n else 1.0

    def merge(self) -> Manifest:
        """All live documents in one segment, without tombstones; what is found stays what it was."""
        base = self.store.manifest()
        live = self.store.live("documents", base)
        if live is None:
            return base
        folder = f"{self.store.path}/work/{uuid.uuid4().hex}"
        self._postings_of(live, base).drop("length").write.parquet(f"{folder}/tf")
        tf = self.spark.read.parquet(f"{folder}/tf")
        ranges = max(1, -(-tf.count() // POSTINGS))
        ids = live.select("doc_id", "length").withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)))
        ids.withColumn("ord", F.row_number().over(W.partitionBy("range").orderBy("doc_id")) - 1).write.parquet(f"{folder}/documents")
        documents = self.spark.read.parquet(f"{folder}/documents")
        tables = {"documents": documents, "ranges": _ranges(tf, documents), "df": tf.groupBy("term").agg(F.count("*").alias("df"))}
        manifest = self.store.commit(tables, None, base.totals, base, replace=True)
        self.store.drop(folder)
        return manifest

    def search(self, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the best k documents of each question. questions: (query_id, text).

        Questions with the same terms of the index are searched once. Those that differ go in blocks of ASKED_AT_ONCE, each a
        pass over the ranges.
        """
        return self.counted(questions, k, allowed)[0]

    def counted(self, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, int]:
        """The same, and how many pairs of a set of terms and a document were scored to the end. allowed: (doc_id) of those
        that may be found."""
        manifest = self.store.manifest()
        ranges = self.store.read("ranges", manifest)
        kind = dict(questions.dtypes)["query_id"]
        none, pairs = self.spark.createDataFrame([], f"query_id {kind}, doc_id long, score double, rank long"), 0
        if ranges is None:
            return none, 0
        masks = self._masks(manifest, allowed)
        if masks is not None:
            ranges = ranges.join(masks, ["generation", "range"], "left" if allowed is None else "inner")
        n, avg = self.totals()
        folder = f"{self.store.path}/work/{uuid.uuid4().hex}"
        words = questions.select("query_id", F.explode(F.array_distinct(T.analysed(F.col("text")))).alias("term"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        words = words.join(self.df(), "term").select("query_id", F.struct("term", idf.alias("idf"), F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).alias("word"))
        sets = words.groupBy("query_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
        sets.withColumn("terms", F.array_join(F.col("words.term"), " ")).write.parquet(f"{folder}/asked")
        asked_by = self.spark.read.parquet(f"{folder}/asked")
        sets = asked_by.groupBy("terms").agg(F.min("words").alias("words"))
        blocks = max(1, -(-sets.count() // ASKED_AT_ONCE))
        sets.select("terms", F.inline("words")).withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks))).write.partitionBy("block").parquet(f"{folder}/words")
        words, best = self.spark.read.schema("terms string, term string, idf double, bucket int, block long").parquet(f"{folder}/words"), 0
        for block in range(blocks):
            asked = words.where(F.col("block") == block).toPandas()  # the terms of ASKED_AT_ONCE sets or so
            if not len(asked):
                continue
            codes, names = pd.factorize(asked.terms)
            asked = asked.assign(question=codes)
            found = self._block(ranges, asked, len(names), avg, k, masks is not None, allowed is not None)
            found.write.parquet(f"{folder}/found-{block}")
            found = self.spark.read.parquet(f"{folder}/found-{block}")
            pairs += found.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
            of = self.spark.createDataFrame(pd.DataFrame({"question": np.arange(len(names)), "terms": names}), "question long, terms string")
            rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "doc_id")).cast("long")
            top = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(of), "question")
            top.select("terms", "doc_id", "score", "rank").write.parquet(f"{folder}/best/block={block}")
            self.store.drop(f"{folder}/found-{block}")
            best += 1
        self.store.drop(f"{folder}/words")
        if not best:
            return none, 0
        top = self.spark.read.parquet(f"{folder}/best").join(asked_by.select("query_id", "terms"), "terms")
        return top.select("query_id", "doc_id", "score", "rank"), pairs

    def _masks(self, manifest: Manifest, allowed: DataFrame | None) -> DataFrame | None:
        """(generation, range, ords): of each range the documents that may be found, if not all; bounded by the range."""
        if allowed is None and not manifest.tombstones:
            return None
        live = self.store.live("documents", manifest)
        if allowed is not None:
            live = live.join(allowed.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return live.groupBy("generation", "range").agg(F.collect_list("ord").alias("ords"))

    def _block(self, ranges: DataFrame, asked: pd.DataFrame, n: int, avg: float, k: int, masked: bool, only: bool) -> DataFrame:
        buckets = sorted(set(asked.bucket))
        columns = [_column(b) for b in buckets]  # the rest is not read
        ranges = ranges.select("generation", "range", "docs", *columns, *(["ords"] if masked else []))

        def run(rows: DataFrame, floors: np.ndarray) -> DataFrame:
            def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                best = _Best(asked, floors, avg, k)
                for batch in batches:
                    for row in batch.itertuples():
                        docs, mask = _unpacked(row.docs), None
                        if masked:
                            mask = np.zeros(len(docs["ids"]), bool)
                            if row.ords is not None:
                                mask[np.asarray(row.ords, np.int64)] = True
                        best.over({b: getattr(row, c) for b, c in zip(buckets, columns)}, docs, mask)
                yield best.rows()

            return rows.mapInPandas(take, "question long, doc_id long, score double, pairs long")

        first = F.pmod(F.xxhash64("generation", "range"), F.lit(SAMPLE)) == 0
        some = run(ranges.where(first), np.full(n, -np.inf))
        rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score")))
        some = some.withColumn("rank", rank).where(F.col("rank") == k).select("question", "score").toPandas()  # a row a question
        floors = np.full(n, -np.inf)
        floors[some.question.to_numpy()] = some.score.to_numpy()
        return run(ranges, floors)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, *made_by: str) -> TextIndex:
    """The index of a table of files, known by the files with their sizes and times, so a changed table gets a new one.
    made_by: how columns of ``docs`` are made of the table, if they are.

    It is built by the first who asks; one who builds it at the same moment yields to whoever was first.
    """
    index = TextIndex(docs.sparkSession, f"{folders.shared(docs.sparkSession)}/text-index", {"table": folders.identity(docs), "columns": [id_col, text_col, title_col, *made_by]})
    if not index.store.manifest().version:
        try:
            index.write(docs, id_col, text_col, title_col)
        except ConcurrentCommit:
            pass
    return index

