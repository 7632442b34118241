"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than CHUNK characters is cut into chunks that overlap by OVERLAP characters, and the chunks are dealt
to all tasks. Each chunk is split into pre-tokens from its own start, which may lie inside a word. The pattern looks
ahead only, so two splits that share one boundary agree from there on: the first boundary common to a chunk and to
the run of its predecessor into the overlap is where the chunks are stitched. Boundaries at the very end of a chunk's
text are not trusted, since the pattern can't see what follows there. The text between two stitches is a piece; pieces
are encoded in parallel, and a document's ids are its pieces' ids in order. If some overlap has no common boundary
(one run of letters longer than OVERLAP), the chunks before and after it are not stitched and form one longer piece,
up to the end of the document if need be: slower, still exact. Short texts are one piece and never leave their task.

Each distinct pre-token is merged once a worker (a bounded table of CACHE entries); decoding maps every id to its raw
bytes and concatenates them, so characters that span tokens come out whole.

Defined cases. A null text counts as empty and has no tokens. Special tokens are ordinary text. Rows that repeat are
encoded each; long ones share the work. Null and repeated ids are allowed, since pieces are grouped by a hash of the
text itself. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import arrow_batches, staged, table
from siftline.llm.memory import begin, give_back, keeps

CHUNK, OVERLAP, CACHE, SHORT = 32_768, 1_024, 150_000, 1_024
#: Beyond these characters, \w, \d and \s of re and the classes of the pattern may differ.
_NOT_PLAIN = re.compile("[^\t\n\r -~\xa1\xa7\xab\xb0\xb4\xb7\xbb\xbf-\u02af\u2013\u2014\u2018-\u201e\u2026]")


class Codec:
    """Merges by rank; one for each worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        # re has no \p{L} and \p{N}, but on plain characters these classes say the same, and it is faster
        self.plain_pieces = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
        self.raw = {i: b for b, i in ranks.items()}
        self.known: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {"": b""}

    def merge(self, data: bytes) -> list[int]:
        """Joins the adjacent pair of lowest rank, the leftmost of equals, until no pair has a rank."""
        if data in self.ranks:
            return [self.ranks[data]]
        if len(data) > 500:
            return self._merge_long(data)
        rank, none = self.ranks.get, 1 << 30
        at = list(range(len(data) + 1))  # where parts start, and the end
        low = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]  # of each part with the next
        while low and (best := min(low)) < none:
            i = low.index(best)
            del at[i + 1], low[i]
            if i:
                low[i - 1] = rank(data[at[i - 1] : at[i + 1]], none)
            if i < len(low):
                low[i] = rank(data[at[i] : at[i + 2]], none)
        return [self.ranks[data[i:j]] for i, j in zip(at, at[1:])]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap and links, for runs without a boundary."""
        import heapq

        end = list(range(1, len(data) + 1))  # of the part that starts here; 0 once it was joined to the one before
        start_before = list(range(-1, len(data)))
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < len(data) and (r := self.ranks.get(data[a : end[end[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[end[a]]))

        for a in range(len(data) - 1):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            if not end[a] or end[a] >= len(data) or end[end[a]] != stop:
                continue
            gone, end[a] = end[a], stop
            end[gone] = 0
            if stop < len(data):
                start_before[stop] = a
            offer(a)
            offer(start_before[a])
        out, a = [], 0
        while a < len(data):
            out.append(self.ranks[data[a : end[a]]])
            a = end[a]
        return out

    def pre_tokens(self, text: str) -> list[str]:
        return (self.pieces if _NOT_PLAIN.search(text) else self.plain_pieces).findall(text)

    def encode(self, text: str) -> list[str]:
        """Ids as decimal text, a blank-separated string for each pre-token."""
        words, known = self.pre_tokens(text), self.known
        out = [known.get(w) for w in words]
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    ids = " ".join(map(str, self.merge(words[i].encode())))
                    if len(known) < CACHE and len(words[i]) < 64:
                        known[words[i]] = ids
                    out[i] = ids
        return out

    def decode(self, ids: list[str]) -> bytes:
        """Raw bytes of blank-separated ids, concatenated."""
        known = self.bytes_of
        out = [known.get(i) for i in ids]
        if None in out:
            for i, data in enumerate(out):
                if data is None:
                    data = out[i] = b"".join(map(self.raw.__getitem__, map(int, ids[i].split())))
                    if len(known) < CACHE and len(ids[i]) < 200:
                        known[ids[i]] = data
        return b"".join(out)

    def boundaries(self, text: str) -> list[int]:
        """Ends of pre-tokens that do not depend on what follows ``text``."""
        return [m.end() for m in self.pieces.finditer(text) if m.end() < len(text)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as lines:  # an installed package's file, present on every worker
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    keeps(__name__, codec.cache_clear)
    return Codec(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _digest(ids: list[str], c: Codec) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids as text, SHA-256 of the bytes they decode to."""
    joined, decoded = " ".join(ids), c.decode(ids)
    n = joined.count(" ") + 1 if joined else 0
    return n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _long_chunks(rows: DataFrame) -> DataFrame:
    """(key, at, text): overlapping chunks of the texts, each text once."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch.key, batch.text):
                starts = range(0, len(text), CHUNK)
                yield pd.DataFrame({"key": key, "at": [s // CHUNK for s in starts], "text": [text[s : s + CHUNK + OVERLAP] for s in starts]})

    return rows.select("key", "text").mapInPandas(cut, "key string, at long, text string").dropDuplicates(["key", "at"])


def _stitches(chunks: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """(key, at, begin, end, whole): the piece in each chunk, or that the rest of the text is not stitched."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(*vocabulary)
        for batch in batches:
            heads, tails = [], []
            for at, text in zip(batch["at"], batch.text):
                ends = c.boundaries(text)
                heads.append([at * CHUNK] + [at * CHUNK + e for e in ends if e < OVERLAP])
                tails.append([at * CHUNK + e for e in ends if e >= CHUNK])
            yield pd.DataFrame({"key": batch.key, "at": batch["at"], "head": heads, "tail": tails})

    w = W.partitionBy("key").orderBy("at")
    borders = chunks.mapInPandas(split, "key string, at long, head array<long>, tail array<long>")
    common = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(w), "head")))
    borders = borders.select("key", "at", common.alias("begin"))
    sound = F.min(F.col("begin").isNotNull()).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    borders = borders.select("key", "at", F.when(sound, F.col("begin")).alias("begin"))
    nxt, more = F.lead("begin").over(w), F.lead("at").over(w).isNotNull()
    return borders.select("key", "at", "begin", nxt.alias("end"), (F.col("begin").isNull() | (more & nxt.isNull())).alias("whole"))


def _pieces_encoded(chunks: DataFrame, stitches: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """(key, at, ids): ids of each piece, an array of one string for each pre-token."""
    pieces = chunks.join(stitches, ["key", "at"])
    out = "key string, at long, ids array<string>"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(*vocabulary)
        for batch in batches:
            ids = []
            for at, text, begin, end in zip(batch["at"], batch.text, batch.begin, batch.end):
                ids.append(c.encode(text[int(begin) - at * CHUNK : None if pd.isna(end) else int(end) - at * CHUNK]))
            yield pd.DataFrame({"key": batch.key, "at": batch["at"], "ids": ids})
            give_back()

    def encode_rest(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values("at")
        first, text = rest.iloc[0], "".join(t[:CHUNK] for t in rest.text)
        ids = codec(*vocabulary).encode(text[int(first.begin) - first["at"] * CHUNK :])
        return pd.DataFrame({"key": [first.key], "at": [first["at"]], "ids": [ids]})

    done = pieces.where("not whole").mapInPandas(encode, out)
    return done.unionByName(pieces.where("whole").groupBy("key").applyInPandas(encode_rest, out))


def digests(docs: DataFrame, vocabulary: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, ids_sha256, decoded_sha256."""
    vocabulary = vocabulary or default_vocabulary()
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin(__name__)
        c = codec(*vocabulary)
        for batch in batches:
            n, ids, data = zip(*[_digest(c.encode(t), c) for t in batch.text]) if len(batch) else ((), (), ())
            yield pd.DataFrame({"id": batch.id, "n_tokens": n, "ids_sha256": ids, "decoded_sha256": data})
            give_back()

    def gathered(pieces: pd.DataFrame) -> pd.DataFrame:
        c = codec(*vocabulary)
        ids = [i for piece in pieces.sort_values("at").ids for i in piece]
        n, a, b = _digest(ids, c)
        give_back()
        return pd.DataFrame({"key": [pieces.key.iloc[0]], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]})

    with arrow_batches(docs.sparkSession, SHORT):
        short = staged(rows.where(F.length("text") <= CHUNK).mapInPandas(whole, f"id {kind}, {DIGEST}"), "short-digests")
    long = rows.where(F.length("text") > CHUNK).withColumn("key", F.sha2("text", 256))
    chunks = staged(_long_chunks(long), "chunks")
    pieces = _pieces_encoded(chunks, staged(_stitches(chunks, vocabulary), "stitches"), vocabulary)
    with arrow_batches(docs.sparkSession, 64):  # pieces of CHUNK characters and their ids
        found = staged(pieces.groupBy("key").applyInPandas(gathered, f"key string, {DIGEST}"), "long-digests")
    long = long.select("id", "key").join(found, "key").select("id", "n_tokens", "ids_sha256", "decoded_sha256")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
