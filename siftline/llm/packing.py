"""Vector best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

A piece asks for tokens, for one place among a sequence's pieces, and for attention (the square of its length, as
pieces don't attend to each other). A sequence has a capacity of each. Pieces go in decreasing order; each goes to the
open sequence that has room in every dimension and fits best: the smallest weighted norm of what would be left ("norm"),
or the largest weighted dot product of what is asked and what is left ("dot"); only if none has room is one opened.

What a piece asks depends on its length alone, so lengths with their counts are all that planning needs: at most
``tokens`` rows, whatever the corpus. Sequences in the same state are one group with a count. All pieces of a length are
placed group by group in the order of fit, and in each sequence as many as fit, which under "norm" is where best fit
would put them one by one, as a sequence fits better the fuller it is. What is left in a dimension at least halves with
each length that a group takes, so there are at most some tens of placements a group, and three groups a length.
A placement is a range of ranks among the pieces of a length, so each piece finds its sequence and offset by arithmetic.

Ranks need no sort: a task counts the pieces of each length as it cuts them, the staged table keeps that number and the
task's, and sums over tasks before it give the rank. A task that runs again writes the same numbers.

Scale. Texts are read once, and only lengths, checksums and numbers leave the tasks (with ids only if asked for). One
join of such rows with the sums by task and length; the placements are broadcast, bounded by the capacity. Planning
takes time with the square of the capacity: half a second at 1,024 tokens, some ten seconds at 8,192.

Ids are those of the ``tokenizers`` library for the JSON file. They are taken from ``tiktoken`` with the same ranks,
which takes a fifth of the time and gives the same ids (tests compare them); a special token written out in a text is that
token in both. Long texts are encoded in segments that end before a blank after an ASCII letter or digit, where a
pre-token always ends; a task holds four bytes a token of one text at a time.

Defined cases. A null text counts as empty: its one piece is the end token. Null and repeated ids and rows that repeat are
packed each. Ties go to the sequence opened first. Which of the pieces of one length goes where depends on the layout of the
input, how many sequences there are does not. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import staged, table
from siftline.llm.memory import give_back

END, SEGMENT = 2, 1 << 16
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50_256
_SAFE = re.compile("(?<=[A-Za-z0-9]) ")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the weight of each dimension in the score.

    With the default capacities of pieces and attention, tokens alone decide how many sequences it takes.
    """

    tokens: int = 1024
    pieces: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces, self.attention], np.int64)


def demand(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


@dataclass(frozen=True)
class Placement:
    """Pieces of a length with ranks first <= rank < last: ``each`` to a sequence from ``sequence`` on, behind ``offset`` tokens."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


class _Groups:
    """Open sequences by state: where their numbers start, how many there are, what is left of each capacity."""

    def __init__(self, limits: Limits):
        self.limits, self.used = limits, 0
        self.start, self.count, self.left = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros((64, 3), np.int64)

    def add(self, start: int, count: int, left: np.ndarray) -> None:
        if count <= 0 or left[0] <= 0 or left[1] <= 0:  # nothing fits any more
            return
        if self.used == len(self.start):
            for name in ("start", "count", "left"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.start[self.used], self.count[self.used], self.left[self.used] = start, count, left
        self.used += 1

    def fitting(self, asks: np.ndarray, score: str) -> np.ndarray:
        """Where the groups with room are, the best first; places hold until the next call."""
        keep = np.flatnonzero(self.count[: self.used])
        self.used = len(keep)
        for name in ("start", "count", "left"):
            getattr(self, name)[: len(keep)] = getattr(self, name)[keep]
        self.count[self.used :] = 0
        left = self.left[: self.used]
        at = np.flatnonzero((left >= asks).all(1))
        capacity, weights = self.limits.capacity, np.array(self.limits.weights)
        if score == "norm":
            rate = ((left[at] - asks) / capacity) ** 2 @ weights
        else:
            rate = -((left[at] / capacity) * (asks / capacity)) @ weights
        return at[np.lexsort((self.start[at], rate))]

    def take(self, i: int) -> tuple[int, int, np.ndarray]:
        out = int(self.start[i]), int(self.count[i]), self.left[i].copy()
        self.count[i] = 0
        return out


def plan(counts: dict[int, int], limits: Limits = Limits(), score: str = "norm") -> tuple[list[Placement], int]:
    """Placements of all pieces, given how many there are of each length, and the number of sequences."""
    if score not in ("norm", "dot"):
        raise ValueError(f"score is norm or dot, not {score!r}")
    groups, out, opened = _Groups(limits), [], 0

    def place(length: int, rank: int, start: int, bins: int, each: int, left: np.ndarray) -> int:
        """``each`` pieces into each of ``bins`` sequences of one state; returns the next rank."""
        if not bins or not each:
            return rank
        out.append(Placement(length, rank, rank + bins * each, start, each, int(limits.tokens - left[0])))
        groups.add(start, bins, left - each * demand(length))
        return rank + bins * each

    for length in sorted(counts, reverse=True):
        asks, n, rank = demand(length), counts[length], 0
        if (asks > limits.capacity).any():
            raise ValueError(f"a piece of {length} tokens is beyond the capacity of an empty sequence")
        for i in groups.fitting(asks, score):
            if rank == n:
                break
            start, bins, left = groups.take(i)
            each = int((left // asks).min())
            full = min(bins, (n - rank) // each)
            rank = place(length, rank, start, full, each, left)
            if full < bins and rank < n:  # the last of them takes fewer
                rank = place(length, rank, start + full, 1, n - rank, left)
                full += 1
            groups.add(start + full, bins - full, left)
        each = int((limits.capacity // asks).min())
        for bins, some in (((n - rank) // each, each), (1, (n - rank) % each)):
            if bins and some:
                rank = place(length, rank, opened, bins, some, limits.capacity)
                opened += bins
    return out, opened


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:  # an installed package's file, present on every worker
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A text in parts of about ``size`` characters, each ended where a pre-token ends."""
    at = 0
    while at + size < len(text) and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def token_ids(text: str, enc, end: int = END) -> np.ndarray:
    """Ids of a text and the end token, as little-endian unsigned 32-bit numbers."""
    encode = (lambda t: enc.encode(t, allowed_special="all")) if SPECIAL in text else enc.encode_ordinary
    return np.concatenate([*(np.array(encode(part), "<u4") for part in segments(text)), np.array([end], "<u4")])


def cuts(tokens: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``most`` tokens but for the first, which takes what is over."""
    first = min(tokens, (tokens - 1) % most + 1)
    return [(0, first), *((at, most) for at in range(first, tokens, most))]


PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, most: int = 1024, vocabulary: tuple[str, str] | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces with the task that cut them and their number among its pieces of that length.

    The numbers hold for one run of the tasks, so the result must be written before it is used twice. With ids, each
    piece carries its ids as bytes.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, seen, task = encoder(*vocabulary), {}, TaskContext.get().partitionId()
        for batch in batches:
            of, out = [], []
            for i, text in enumerate(batch.text):
                ids = token_ids(text, enc)
                for n, (start, length) in enumerate(cuts(len(ids), most)):
                    data, nth = ids[start : start + length].tobytes(), seen.get(length, 0)
                    seen[length] = nth + 1
                    of.append(i)
                    out.append((n, start, length, zlib.crc32(data), task, nth, *([data] if with_ids else [])))
            found = pd.DataFrame(out, columns=["piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if with_ids else [])])
            found.insert(0, "id", batch.id.take(of).reset_index(drop=True))
            yield found
            give_back()

    schema = f"id {kind}, {PIECE}, task int, nth long" + (", ids binary" if with_ids else "")
    return rows.mapInPandas(cut, schema).withColumnRenamed("id", id_col)


def packed_pieces(pieces: DataFrame, limits: Limits = Limits(), score: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to staged pieces, and drops task and nth."""
    spark = pieces.sparkSession
    sums = pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    sums = staged(sums.withColumn("before", F.coalesce(before, F.lit(0))), "lengths-by-task")
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    placed, _ = plan(counts, limits, score)
    schema = "length long, first long, last long, sequence long, each long, behind long"
    rows = [(p.length, p.first, p.last, p.sequence, p.each, p.offset) for p in placed]
    places = F.broadcast(spark.createDataFrame(rows, schema))  # bounded by the capacity, not by the pieces
    ranked = pieces.join(sums.select("task", "length", "before"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    found = ranked.join(places, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    inside = nth % F.col("each")
    sequence = F.col("sequence") + ((nth - inside) / F.col("each")).cast("long")  # exact below 2 ** 53
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    return found.select(*kept, sequence.alias("sequence_id"), (F.col("behind") + inside * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, ends) of pieces that carry ids: the sequence's ids as an array, and where each piece ends.

    A sequence is at most ``tokens`` ids, so a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").astype("int64") for parts in batch.parts]
            ends = [[p["offset"] + p["length"] for p in parts] for parts in batch.parts]
            yield pd.DataFrame({"sequence_id": batch.sequence_id, "ids": ids, "ends": ends})

    return rows.mapInPandas(joined, "sequence_id long, ids array<long>, ends array<long>")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = Limits()
    pieces = staged(pieces_of(table(spark, sf_dir, "documents"), limits.tokens), "pieces")
    return packed_pieces(pieces, limits)
