"""Near copies by verified similarity: SimHash links, MinHash bands for what they can't see, exact Jaccard on word shingles.

Sets. A text is the set of its SHINGLE-word shingles, lower-cased (A-Z), as 64-bit hashes; two texts are near copies if
the Jaccard similarity of their sets is SIMILAR or more. Texts of one set are one node from the start.

Candidates. One Arrow pass gives each text a SimHash of its shingles, the keys of its bands and a sketch (its SKETCH least
hashes). ``simhash.links`` joins fingerprints by generalised pigeonhole, which finds close copies cheaply. At a similarity
of 0.8 fingerprints of 64 bits differ in some ten bits, beyond what a pigeonhole can search, so bands carry the rest: ROWS
minima each, as many that a pair of similarity SIMILAR shares none with a chance under MISS. Long passages or lines in
common don't bring unlike texts together: a band needs ROWS shingles to be shared at once.

Verification. A pair goes if its sizes or its sketches rule the similarity out (which errs with a chance under MISS);
sets that fit in their sketches are compared there, others are made again from the texts. Texts move only for that: a
bitmap of their hashes, bounded and broadcast, lets all other rows stay where they were read.

Links. Keys are worked through in rounds: each key pairs one hub with its other nodes, first its centre (the node that
shares most keys with most others: the text that a large group was copied from), then one picked by hash for each key;
most of a large group of copies is then one component. A round's links join the components of the rounds before, each named
once; links inside one are not looked at again. Last, for keys whose nodes still are in several components, the
nodes outside the key's largest meet all of it in blocks of BLOCK by BLOCK, where whole sets are compared and a node
hands on one link to each component it is similar to. Components come from ``simhash.labelled``. What remains quadratic is a family of texts that share bands and yet are not similar.

Defined cases. A null text counts as empty; texts without words are near copies of each other and of nothing else.
Texts of fewer than SHINGLE words hash their whole sequence. A row without an id is smaller than any other. Rows that
repeat id and text stay once; rows that repeat an id with another text are rows of their own. Empty tables give empty
results. All columns are carried along.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import simhash
from siftline.llm.common import arrow_batches, in_row, lower_bytes, lowest_hashes, packed, staged
from siftline.llm.exact_dedup import bitmaps_of, filter_blocks, mark_possible
from siftline.llm.memory import give_back

SHINGLE, SKETCH, ROWS, MISS, BLOCK, SMALL, PART, BATCH = 5, 64, 5, 1e-9, 1_024, 4_096, 4_096, 512
SIMILAR = (4, 5)  # as a fraction, so that comparisons are exact
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles, hashed, in ascending order."""
    words = lower_bytes((text or "").encode()).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, 1) for w in set(words)}
    each = np.array([known[w] for w in words], np.uint64)
    n, size = max(1, len(each) - size + 1), min(size, len(each))
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ each[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_count(similar: tuple[int, int] = SIMILAR) -> int:
    """Bands that leave a pair of just this similarity without a common one with a chance under MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (similar[0] / similar[1]) ** ROWS))


def least_common(n: int, chance: float) -> int:
    """The most that of ``n`` trials of this chance succeed but for a chance under MISS."""
    below, c = 0.0, 0
    while below + (one := math.comb(n, c) * chance**c * (1 - chance) ** (n - c)) <= MISS:
        below, c = below + one, c + 1
    return c


def band_keys(s: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band: its number and ROWS minima of the shingles under as many hash functions."""
    if not len(s):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1 << 63, (2, bands * ROWS), dtype=np.uint64)
    a = a * np.uint64(2) + np.uint64(1)
    least = np.full(bands * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(s), PART):
        h = s[at : at + PART, None] * a + b
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(0), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for i in range(ROWS):
        key = (key ^ least[i::ROWS]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fingerprint(s: np.ndarray) -> np.int64:
    """SimHash of a set of hashes: a bit is set if more than half have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(s), PART):
        counts += np.unpackbits(s[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(s), bitorder="little").view(np.int64)[0]


def _sketched(rows: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """(id, hash, node, fp, n, bands, sketch) for each of ``rows`` (id, hash, text)."""
    bands = band_count(similar)

    @F.pandas_udf("node long, fp long, n long, bands array<long>, sketch array<long>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            s = shingles(text, size)
            node = np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)
            out.append((node, fingerprint(s), len(s), band_keys(s, bands), s[:SKETCH].view(np.int64)))
        give_back()
        return pd.DataFrame(out, columns=["node", "fp", "n", "bands", "sketch"])

    return rows.select("id", "hash", describe("text").alias("d")).select("id", "hash", "d.*")


def _pairs(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def block_links(block: pd.DataFrame, similar: tuple[int, int]) -> pd.DataFrame:
    """Links of the few nodes of a block to its others, one to each component. Only hashes that both sides have are counted."""
    few, rest = block[block.few], block[~block.few]
    if not len(few) or not len(rest):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    sizes, flat, row = [], [], []
    for side in (few, rest):
        n = np.array([len(x) for x in side["set"]])
        sizes.append(n)
        flat.append(np.concatenate([*side["set"], np.zeros(0, np.int64)]).astype(np.int64))
        row.append(np.repeat(np.arange(len(side)), n))
    shared = np.intersect1d(flat[0], flat[1])
    both = np.zeros((len(few), len(rest)), np.float32)
    for at in range(0, len(shared), PART // 4):
        part, dense = shared[at : at + PART // 4], []
        for x, r, n in zip(flat, row, map(len, sizes)):
            code = np.minimum(np.searchsorted(part, x), len(part) - 1)
            hit = part[code] == x
            m = np.zeros((n, len(part)), np.float32)
            m[r[hit], code[hit]] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    p, q = similar
    label, other = few.label.to_numpy(np.int64), rest.label.to_numpy(np.int64)
    close = (both * (p + q) >= (sizes[0][:, None] + sizes[1][None, :]) * p) & (label[:, None] != other[None, :]) & (sizes[0][:, None] > 0)
    a, b = few.node.to_numpy(np.int64), rest.node.to_numpy(np.int64)
    out = []
    for i in np.flatnonzero(close.any(1)):
        js = np.flatnonzero(close[i])
        out += [(a[i], b[js[k]]) for k in np.unique(other[js], return_index=True)[1]]
    found = np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


class _Join:
    """One run over (id, hash, text): nodes, their sketches, and verified links."""

    def __init__(self, rows: DataFrame, size: int, similar: tuple[int, int]):
        self.rows, self.size, self.similar = rows, size, similar
        with arrow_batches(rows.sparkSession, BATCH):
            self.prints = staged(_sketched(rows, size, similar), "prints")
        first = F.min(F.struct("id", "hash", "fp", "n", "bands", "sketch")).alias("f")
        self.nodes = staged(self.prints.groupBy("node").agg(first).select("node", "f.*"), "nodes")
        self.labels = None

    def fingerprint_pairs(self) -> DataFrame:
        """Nodes of one fingerprint, and of fingerprints that the pigeonhole links."""
        by_fp = staged(self.nodes.groupBy("fp").agg(F.min("node").alias("hub")), "fps")
        sample = lowest_hashes(by_fp.select("fp"), simhash.SAMPLE, "fp").toPandas().fp  # SAMPLE rows, for the plan alone
        links = simhash.links(by_fp, simhash.plan(sample.to_numpy(np.int64).view(np.uint64), by_fp.count()))
        equal = self.nodes.select("fp", "node").join(by_fp, "fp").where("node <> hub").select(*_pairs(F.col("hub"), F.col("node")))
        names = by_fp.select(F.col("fp").alias("a"), F.col("hub").alias("x"))
        others = by_fp.select(F.col("fp").alias("b"), F.col("hub").alias("y"))
        return equal.unionByName(links.join(names, "a").join(others, "b").select(*_pairs(F.col("x"), F.col("y"))))

    def posts(self) -> DataFrame:
        """(key, node, k) of the bands that several nodes have, with their number."""
        posts = self.nodes.select("node", F.explode("bands").alias("key"))
        shared = posts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
        return staged(posts.join(shared, "key"), "posts")

    def centre_pairs(self, posts: DataFrame) -> DataFrame:
        """Each node with the centre of each of its keys: the node that shares most keys with most others. Copies of one
        text are alike through it, though two of them may be too far apart."""
        weight = posts.groupBy("node").agg(F.sum("k").alias("weight"))
        centres = posts.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
        return posts.join(staged(centres, "centres"), "key").where("node <> hub").select(*_pairs(F.col("hub"), F.col("node")))

    def open_posts(self, posts: DataFrame) -> DataFrame:
        """(key, node, label, largest) of keys whose nodes are in several components, with the largest component."""
        posts = posts.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        posts = staged(posts, "posts")
        by = posts.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key")
        by = by.agg(F.max(F.struct("k", "label"))["label"].alias("largest"), F.count("*").alias("labels"))
        return staged(posts.join(by.where("labels > 1").drop("labels"), "key"), "open")

    def hub_pairs(self, posts: DataFrame, by: Column) -> DataFrame:
        """Each node with the hub of each of its keys, the node of least ``by``, unless they are together already."""
        hubs = posts.groupBy("key").agg(F.min_by(F.struct("node", "label"), by).alias("hub"))
        return posts.join(hubs, "key").where(F.col("label") != F.col("hub.label")).select(*_pairs(F.col("hub.node"), F.col("node")))

    def across_links(self, posts: DataFrame) -> DataFrame:
        """Links between the components of a key, but for those inside its largest. Keys of one largest component are one
        group, whose other nodes meet all of it: in a group of at most SMALL meetings as pairs, which sketches thin out, in
        a larger one in blocks of BLOCK by BLOCK, compared there on whole sets."""
        rows = posts.select(F.col("largest").alias("g"), "node", "label", (F.col("label") != F.col("largest")).alias("few")).distinct()
        rows = staged(rows, "across")
        groups = staged(rows.groupBy("g").agg(F.count_if("few").alias("m"), F.count("*").alias("k")), "groups")
        rows = rows.join(groups, "g")
        small = rows.where(F.col("m") * F.col("k") <= SMALL)
        others = small.select("g", F.col("node").alias("y"), F.col("label").alias("other"), F.col("few").alias("few2"))
        met = small.where("few").join(others, "g").where((F.col("label") != F.col("other")) & (~F.col("few2") | (F.col("node") < F.col("y"))))
        return self.verified(met.select(*_pairs(F.col("node"), F.col("y")))).unionByName(self.block_links(rows.where(F.col("m") * F.col("k") > SMALL)))

    def block_links(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"m": F.ceil(F.col("m") / BLOCK).cast("int"), "k": F.ceil(F.col("k") / BLOCK).cast("int")})
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        left = rows.where("few").select("g", "node", "label", F.lit(True).alias("few"), own(F.col("m")).alias("i"), each("k").alias("j"))
        right = rows.select("g", "node", "label", F.lit(False).alias("few"), each("m").alias("i"), own(F.col("k")).alias("j"))
        dealt = left.unionByName(right).join(self.sets_of(rows.select("node").distinct()), "node")
        similar = self.similar

        def compare(block: pd.DataFrame) -> pd.DataFrame:
            return block_links(block, similar)

        return dealt.groupBy("g", "i", "j").applyInPandas(compare, "a long, b long")

    def add(self, pairs: DataFrame) -> None:
        """Verifies candidates and lets the links among them join components."""
        self.link(self.verified(pairs))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are similar, by sizes, sketches and whole sets."""
        pairs, (p, q) = pairs.distinct(), self.similar
        side = lambda c, m, s: self.nodes.select(F.col("node").alias(c), F.col("n").alias(m), F.col("sketch").alias(s))
        met = pairs.join(side("a", "m", "s"), "a").where("m > 0").join(side("b", "n", "t"), "b")
        met = met.where((F.col("n") * q >= F.col("m") * p) & (F.col("m") * q >= F.col("n") * p))
        both = F.array_intersect("s", "t")
        exact = (F.col("n") <= SKETCH) & (F.col("m") <= SKETCH)
        # SKETCH least hashes of the union; hashes sort as unsigned numbers
        least = F.slice(F.array_sort(F.transform(F.array_union("s", "t"), lambda h: h.bitwiseXOR(F.lit(simhash.NO_ID).cast("long")))), 1, SKETCH)
        common = F.size(F.array_intersect(least, F.transform(both, lambda h: h.bitwiseXOR(F.lit(simhash.NO_ID).cast("long")))))
        similar = F.size(both) * (p + q) >= (F.col("n") + F.col("m")) * p
        met = met.select("a", "b", exact.alias("exact"), F.when(exact, similar).otherwise(common >= least_common(SKETCH, p / q)).alias("close")).where("close")
        met = staged(met.select("a", "b", "exact"), "close")
        return met.where("exact").select("a", "b").unionByName(self.compared(met.where("not exact").select("a", "b")))

    def link(self, links: DataFrame) -> None:
        """Names the components that links make of those that there are. Links inside one of them change nothing."""
        if self.labels is None:
            links = staged(links, "links")
            self.labels = simhash.labelled(simhash.ends(links), links).select(F.col("fp").alias("node"), "label")
            return
        of = lambda c, n: self.labels.select(F.col("node").alias(c), F.col("label").alias(n))
        links = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
        links = links.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        links = staged(links.where("a <> b").distinct(), "links")
        names = simhash.labelled(simhash.ends(links), links)
        new = names.select(F.col("fp").alias("node"), "label").join(self.labels.select("node"), "node", "left_anti")
        known = self.labels.join(names.select(F.col("fp").alias("label"), F.col("label").alias("name")), "label", "left")
        self.labels = staged(known.select("node", F.coalesce("name", "label").alias("label")).unionByName(new), "named")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, set): whole sets, made again from the texts."""
        size = self.size

        @F.pandas_udf("array<long>")
        def whole(texts: pd.Series) -> pd.Series:
            give_back()
            return pd.Series([shingles(t, size).view(np.int64) for t in texts])

        first = staged(self.nodes.join(nodes, "node", "left_semi").select("node", "id", "hash"), "first")
        texts = only(self.rows, F.col("hash"), first).join(first, ["id", "hash"]).dropDuplicates(["node"])
        with arrow_batches(nodes.sparkSession, BATCH):
            return staged(texts.select("node", whole("text").alias("set")), "sets")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are similar, compared on whole sets."""
        p, q = self.similar
        sets = self.sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
        return met.where(F.size(F.array_intersect("s", "t")) * (p + q) >= (F.size("s") + F.size("t")) * p).select("a", "b")

    def run(self) -> DataFrame:
        """(id, hash, label) of each row."""
        posts = self.posts()
        self.add(self.fingerprint_pairs().unionByName(self.centre_pairs(posts)))
        posts = self.open_posts(posts.select("key", "node"))
        self.add(self.hub_pairs(posts, F.xxhash64("node", "key")))
        posts = self.open_posts(posts.select("key", "node"))
        self.link(self.across_links(posts))
        return self.prints.select("id", "hash", "node").join(self.labels, "node", "left").select("id", "hash", F.coalesce("label", "node").alias("label"))


def only(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be one of the hashes of ``wanted``, by bitmaps: all of those, and few others; nothing shuffles."""
    return marked(rows, key, wanted).where("_possible").drop("_possible")


def marked(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    blocks = filter_blocks(wanted.count())
    return mark_possible(rows, key, staged(bitmaps_of(wanted.select("hash"), "hash", blocks), "bitmaps"), blocks)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group that links connect: that of the smallest id.

    Rows alone in their group pass straight through; only members of groups shuffle.
    """
    number = lambda c: F.coalesce(c.cast("long"), F.lit(simhash.NO_ID))
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = docs.select(number(F.col(id_col)).alias("id"), F.xxhash64(text(F.col(text_col))).alias("hash"), text(F.col(text_col)).alias("text"))
    member = staged(_Join(rows, size, similar).run(), "members")
    groups = member.groupBy("label").agg(F.min(F.struct("id", "hash")).alias("f"), F.count("*").alias("rows")).where("rows > 1")
    member = staged(member.join(groups.select("label", "f"), "label").select("id", "hash", "f"), "grouped")
    stay = member.select(F.col("f.id").alias("_id"), F.col("f.hash").alias("_hash")).distinct()
    out = marked(packed(docs, _hash=F.xxhash64(text(F.col(text_col)))), F.col("_hash"), member)
    some = out.where("_possible").withColumn("_id", number(in_row(id_col)))
    grouped = member.select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    kept = some.join(stay, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("row.*")
    others = some.join(grouped, ["_id", "_hash"], "left_anti").select("row.*")
    return out.where("not _possible").select("row.*").unionByName(others).unionByName(kept)
