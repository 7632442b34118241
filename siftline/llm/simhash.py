"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints. Each text gives one 64-bit fingerprint (see ``fingerprints``), computed in one Arrow pass in blocks of
shingles, so a very long text needs no more memory than a block.

Links. Texts of equal fingerprint collapse to one row first, summed before the shuffle. Two fingerprints link when at
most TAU = 4 bits differ. The bits are divided into m partitions with thresholds t_i whose sum is TAU - m + 1 (t_i of
-1 skips a partition): whatever way 4 differing bits fall, some partition has at most t_i of them. So every
fingerprint is stored once for each partition under its bits there, and probes with all keys within t_i bits of its
own; a probe meets the stored fingerprints of its key as one list and is verified against each on all 64 bits. Those that
it is near to are not paired with each other one by one: a star of links joins them, and one more link for each two of
them that several probes have in common, so a group of copies gives links in proportion to its size. ``plan`` chooses partitions and thresholds from a bounded sample
of fingerprints: correlated bits are put together, so that one partition's bits repeat each other and the others stay
selective, and for every m a dynamic program gives each partition the threshold that minimises probes plus estimated
candidates. More data moves the choice towards fewer, wider partitions. The choice changes the cost alone; any choice
finds every link.

Crowded keys. A key that stores more than CROWD fingerprints (many near copies, which agree on most bits) would give
the square of its size in links. Its fingerprints first meet HUBS of its own alone, picked by hash, which joins most of
a large group of near copies to one component. Only those outside the key's largest component are then held against
the others: stored and probing fingerprints are cut into blocks of about CROWD_BLOCK by hash, every pair of blocks is a
group of its own, and a group returns a spanning forest of its links: at most one link for each fingerprint it read, with
the same components.

Components are found by contraction of the table of links: each round every fingerprint takes the label of its least
neighbour's least neighbour, and only links between different labels go on to the next, so the first round outweighs all
others. Nothing is collected but the sample.

Defined cases. A null text counts as empty; texts without words have fingerprint zero and link like others. Texts of
fewer than SHINGLE words hash their whole sequence. Null ids are smaller than any id but never name a component unless
all of its ids are null. Rows that repeat get equal answers. Empty tables give empty results. Other columns are not read.
``near_copies`` keeps one row of each group, columns and all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import lower_bytes, lowest_hashes, staged, table

SHINGLE, TAU, HASH_SEED = 4, 4, 42
SAMPLE, CROWD, CROWD_BLOCK, HUBS, BLOCK, KNOWN = 8_192, 128, 2_048, 16, 65_536, 1_000_000
NO_ID = -(1 << 63)


def fingerprint(text: str | None) -> int:
    """Bit b is set if more than half of the shingles' XXH64 values have it."""
    words = lower_bytes((text or "").encode()).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    ends = ends.tolist()  # of each word, with the blank after it
    view, xxh, last = memoryview(joined), xxhash.xxh64_intdigest, len(words) - 1
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        starts = [0, *ends[: stop - 1]] if at == 0 else ends[at - 1 : stop - 1]
        hashes = [xxh(view[a : ends[min(last, i + SHINGLE - 1)] - 1], HASH_SEED) for i, a in enumerate(starts, at)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, text_col: str = "text", column: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    return docs.withColumn(column, prints(F.col(text_col)))


# ---- plan ----------------------------------------------------------------------------------------------------------


def grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """Divides the 64 bits into m groups of near-equal size, correlated bits together. bits: a row for each print."""
    if len(bits) < 32:
        return [list(range(i * 64 // m, (i + 1) * 64 // m)) for i in range(m)]
    centred = bits - bits.mean(0)
    scale = np.sqrt((centred**2).sum(0))
    with np.errstate(invalid="ignore", divide="ignore"):
        close = np.nan_to_num(np.abs(centred.T @ centred) / np.outer(scale, scale))
    np.fill_diagonal(close, 0)
    left, groups = set(range(64)), []
    for i in range(m):
        size = (i + 1) * 64 // m - i * 64 // m
        order = sorted(left)
        group = [max(order, key=lambda b: (close[b, order].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: (close[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def probes_within(width: int, t: int) -> int:
    """Keys within t bits of a key of ``width`` bits."""
    return sum(len(list(itertools.combinations(range(width), k))) for k in range(t + 1)) if t >= 0 else 0


def plan(sample: np.ndarray, total: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, for ``total`` fingerprints like ``sample`` (unsigned 64-bit)."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, max(1, len(sample)), (2, 200_000))
    differ = bits[pairs[0]] != bits[pairs[1]] if len(sample) else np.zeros((1, 64), bool)
    best, chosen = np.inf, []
    for m in range(2, TAU + 2):
        groups = grouped_bits(bits, m)
        cost = []  # of a partition, by threshold + 1
        for group in groups:
            near = np.bincount(differ[:, group].sum(1), minlength=TAU + 1)[: TAU + 1]
            floor = np.cumsum([probes_within(len(group), t) - probes_within(len(group), t - 1) for t in range(TAU + 1)]) / 2.0 ** len(group)
            share = np.maximum(np.cumsum(near) / max(1, len(differ)), floor)  # of all prints that become candidates
            cost.append([0.0] + [1.0 + probes_within(len(group), t) + 0.1 * share[t] * total for t in range(TAU + 1)])
        # dynamic program over partitions: least cost for each sum of (threshold + 1); the sums must reach TAU + 1
        table_ = {0: (0.0, [])}
        for by in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table_.items():
                for t1 in range(TAU + 2 - used):
                    new = (c + by[t1], [*ts, t1 - 1])
                    if used + t1 not in nxt or new[0] < nxt[used + t1][0]:
                        nxt[used + t1] = new
            table_ = nxt
        c, ts = table_[TAU + 1]
        if c < best:
            best, chosen = c, [(g, t) for g, t in zip(groups, ts) if t >= 0]
    return chosen


# ---- links ---------------------------------------------------------------------------------------------------------


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _keys(fp: Column, bits: list[int], t: int) -> Column:
    """All keys within t bits of the print's own in this partition, the own key first."""
    own = fp.bitwiseAND(F.lit(_mask(bits)).cast("long"))
    flips = [_mask(list(c)) for k in range(t + 1) for c in itertools.combinations(bits, k)]
    flips = F.expr("array(" + ",".join(f"{f}L" if f != NO_ID else "(-9223372036854775807L - 1L)" for f in flips) + ")")
    return F.transform(flips, lambda flip: own.bitwiseXOR(flip))


def links(prints: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` of ``prints``, enough of them for the components."""
    stored, probing = [], []
    for i, (bits, t) in enumerate(partitions):
        part = F.lit(i).cast("byte").alias("part")
        stored.append(prints.select(part, F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("key"), F.col("fp").alias("b")))
        probing.append(prints.select(part, F.explode(_keys(F.col("fp"), bits, t)).alias("key"), F.col("fp").alias("a")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    stored, probing = union(stored), union(probing)
    crowded = staged(stored.groupBy("part", "key").agg(F.count("*").alias("n")).where(f"n > {CROWD}").drop("n"), "crowded")
    if crowded.isEmpty():
        return _listed(stored, probing)
    full = crowded.withColumn("full", F.lit(True))
    plain = staged(_listed(stored.join(full, ["part", "key"], "left").where("full IS NULL").drop("full"), probing), "plain")
    rows = stored.withColumnRenamed("b", "fp").withColumn("is_stored", F.lit(True)).unionByName(probing.withColumnRenamed("a", "fp").withColumn("is_stored", F.lit(False)))
    rows = staged(rows.join(crowded, ["part", "key"]), "crowd")
    found = staged(plain.unionByName(_stars(rows)).distinct(), "stars")
    return found.unionByName(_across(rows, labelled(ends(found), found))).distinct()


def ends(links: DataFrame) -> DataFrame:
    """The fingerprints that ``links`` join."""
    return links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).distinct()


def _listed(stored: DataFrame, probing: DataFrame) -> DataFrame:
    """Links of keys that store at most CROWD fingerprints. Each probe meets its key's as one list; of two that are near the
    greater one's probe finds the other."""
    lists = stored.groupBy("part", "key").agg(F.collect_list("b").alias("others"))
    lesser = F.filter("others", lambda b: (b < F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= TAU))
    met = probing.join(lists, ["part", "key"]).select(F.col("a").alias("fp"), F.array_sort(lesser).alias("near")).where("size(near) > 0")
    return _joined(staged(met.distinct(), "near-listed"))


def _stars(rows: DataFrame) -> DataFrame:
    """Links of the fingerprints of crowded keys to the hubs of their key."""
    place = F.row_number().over(W.partitionBy("part", "key").orderBy(F.xxhash64("fp")))
    hubs = rows.where("is_stored").withColumn("place", place).where(F.col("place") <= HUBS)
    hubs = staged(hubs.groupBy("part", "key").agg(F.array_sort(F.collect_list("fp")).alias("hubs")), "hubs")
    near = F.filter("hubs", lambda h: F.bit_count(h.bitwiseXOR(F.col("fp"))) <= TAU)
    met = rows.join(hubs, ["part", "key"]).select("fp", near.alias("near")).where("size(near) > 0")
    return _joined(staged(met.distinct(), "near-hubs"))


def _joined(met: DataFrame) -> DataFrame:
    """Links that join each ``fp`` and all that it is ``near`` to: one to the first of them each; of the fingerprints that have
    the first and another in common, one has a link to both."""
    bridges = met.where("size(near) > 1").mapInPandas(_bridges, "hub long, to long, fp long").groupBy("hub", "to").agg(F.min("fp").alias("fp"))
    pair = lambda to: (F.least("fp", to).alias("a"), F.greatest("fp", to).alias("b"))
    return met.select(*pair(F.col("near")[0])).unionByName(bridges.select(*pair(F.col("to")))).where("a <> b").distinct()


def _bridges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(hub, to, fp) for each other one that ``fp`` is near to, unless rows before joined the two in this task. What a task
    remembers is bounded by KNOWN; to forget costs rows alone."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        out = []
        for fp, near in zip(batch.fp.tolist(), batch.near):
            if len(up) > KNOWN:
                up.clear()
            hub, *others = near.tolist()
            up[root(fp)] = top = root(hub)
            for to in others:
                if (other := root(to)) != top:
                    up[other] = top
                    out.append((hub, to, fp))
        yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["hub", "to", "fp"])


def _across(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Links of crowded keys between components: those outside a key's largest against all of the key, by blocks."""
    key = ["part", "key"]
    rows = rows.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    rows = staged(rows, "crowd-labels")
    largest = rows.groupBy(*key, "label").agg(F.count("*").alias("k")).groupBy(*key).agg(F.max(F.struct("k", "label"))["label"].alias("largest"), F.count("*").alias("labels"))
    rows = rows.join(largest.where("labels > 1").drop("labels"), key).withColumn("minor", F.col("label") != F.col("largest"))
    # blocks of each kind; those of the largest component come after the others
    cut = lambda stored, minor: F.ceil(F.count_if((F.col("is_stored") == stored) & (F.col("minor") == minor)) / CROWD_BLOCK).cast("int")
    sizes = staged(rows.groupBy(*key).agg(cut(True, True).alias("stored_few"), cut(True, False).alias("stored_most"), cut(False, True).alias("asking_few"), cut(False, False).alias("asking_most")), "crowd-blocks")
    own_few, own_most = F.when(F.col("is_stored"), F.col("stored_few")).otherwise(F.col("asking_few")), F.when(F.col("is_stored"), F.col("stored_most")).otherwise(F.col("asking_most"))
    other_few, other_most = F.when(F.col("is_stored"), F.col("asking_few")).otherwise(F.col("stored_few")), F.when(F.col("is_stored"), F.col("asking_most")).otherwise(F.col("stored_most"))
    own = F.when(F.col("minor"), F.pmod(F.xxhash64("fp"), own_few)).otherwise(own_few + F.pmod(F.xxhash64("fp"), own_most))
    meets = F.when(F.col("minor"), other_few + other_most).otherwise(other_few)
    dealt = rows.join(sizes, key).withColumns({"own": own.cast("int"), "meets": meets}).where("meets > 0")
    dealt = dealt.select(*key, "fp", "label", "is_stored", "own", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other"))
    i, j = F.when(F.col("is_stored"), F.col("own")).otherwise(F.col("other")), F.when(F.col("is_stored"), F.col("other")).otherwise(F.col("own"))
    return dealt.withColumns({"i": i, "j": j}).groupBy(*key, "i", "j").applyInPandas(forest, "a long, b long")


def forest(block: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between components of the stored and the probing prints of one pair of blocks."""
    stored = block.fp[block.is_stored].unique().astype(np.int64).view(np.uint64)
    probing = block.fp[~block.is_stored].unique().astype(np.int64).view(np.uint64)
    prints, first = np.unique(block.fp.to_numpy(np.int64).view(np.uint64), return_index=True)
    label, out = np.unique(block.label.to_numpy(np.int64)[first], return_inverse=True)[1], []
    where = np.searchsorted(prints, stored)
    for at in np.searchsorted(prints, probing):
        others = where[label[where] != label[at]]
        if not len(others):
            continue
        for o in others[np.bitwise_count(prints[others] ^ prints[at]) <= TAU]:
            if label[o] != label[at]:
                out.append((prints[at], prints[o]))
                label[label == label[o]] = label[at]
    pairs = np.array(out, np.uint64).reshape(-1, 2)
    pairs = np.sort(pairs.view(np.int64), axis=1)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, label): the least fingerprint that links reach, for the fingerprints of ``nodes``, among which are all ends of links.

    A round names each fingerprint by its least neighbour's least neighbour (itself counts as one) and carries links between
    different names on to the next round. The least fingerprint of a component keeps its name, so the last name is that.
    """
    apart = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges, both, steps = staged(edges.where("a <> b").select(*apart("a", "b")).distinct(), "edges"), nodes.select("fp", F.col("fp").alias("to")), []
    while not steps or not edges.isEmpty():
        ways = edges.select(F.col("a").alias("fp"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("fp"), F.col("a").alias("to")))
        both = ways if steps else both.unionByName(ways)
        up = staged(both.groupBy("fp").agg(F.min("to").alias("to")).select("fp", F.least("fp", "to").alias("up")), "up")
        # pointer jumping
        step = staged(up.join(up.select(F.col("fp").alias("up"), F.col("up").alias("label")), "up").select("fp", "label"), "labels")
        steps.append(step)
        edges = edges.withColumnRenamed("a", "fp").join(step, "fp").select(F.col("label").alias("x"), F.col("b").alias("fp"))
        edges = edges.join(step, "fp").select("x", F.col("label").alias("y")).where("x <> y")
        edges = staged(edges.select(*apart("x", "y")).distinct(), "edges")
    named = steps.pop()
    for step in reversed(steps):
        named = step.join(named.select(F.col("fp").alias("label"), F.col("label").alias("last")), "label", "left").select("fp", F.coalesce("last", "label").alias("label"))
    return staged(named, "named") if steps else named


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id."""
    prints = fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    prints = staged(prints, "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    sample = lowest_hashes(distinct.select("fp"), SAMPLE, "fp").toPandas().fp  # SAMPLE rows, for the plan alone
    found = staged(links(distinct, plan(sample.to_numpy(np.int64).view(np.uint64), distinct.count())), "links")
    linked = ends(found)
    merged = staged(labelled(linked, found).join(distinct, "fp"), "merged")
    names = staged(merged.groupBy("label").agg(F.min("first").alias("component_id")), "names")
    merged = merged.join(names, "label").select("fp", "component_id")
    single = distinct.join(linked, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    return prints.join(staged(single.unionByName(merged), "components"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
