import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siftline.llm import simhash as S


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Component of each distinct print by comparing all pairs."""
    prints = sorted(set(prints))
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                label[root(b)] = root(a)
    return {p: root(p) for p in prints}


def check(found, rows):
    assert len(found) == len(rows)
    roots = slow_components([r.fp & (1 << 64) - 1 for r in found])
    least = {}
    for r in found:
        k = roots[r.fp & (1 << 64) - 1]
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    for r in found:
        assert r.component_id == least.get(roots[r.fp & (1 << 64) - 1])


def test_documents_against_brute_force(spark, sf, docs):
    found = S.op1_simhash(spark, sf).collect()
    texts = {i: t for i, t, _ in docs}
    assert all(int(r.fingerprint, 16) == slow_fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16 for r in found)
    check(S.components(spark.read.parquet(f"{sf}/documents.parquet")).collect(), docs)


def test_odd_rows(odd, empty):
    check(S.components(odd).collect(), odd.collect())
    assert S.components(empty).collect() == []


def clusters(rng, centres, size, flips):
    out = []
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(size):
            out.append(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, flips + 1), replace=False)))
    return sorted(set(out))


def test_every_plan_finds_every_link_and_crowds_too(spark, monkeypatch):
    prints = clusters(np.random.default_rng(3), 6, 60, 3)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = slow_components(prints)
    plans = [S.plan(np.array(prints, np.uint64), n) for n in (10, 10**5, 10**7)]
    plans.append([(list(range(0, 20)), 1), (list(range(20, 40)), 0), (list(range(40, 64)), 1)])
    assert len({str(p) for p in plans}) > 1
    for crowd, block, hubs in ((10**6, 10**6, 16), (4, 16, 1), (4, 16, 16)):
        monkeypatch.setattr(S, "CROWD", crowd)
        monkeypatch.setattr(S, "CROWD_BLOCK", block)
        monkeypatch.setattr(S, "HUBS", hubs)
        for plan in plans:
            assert sum(t + 1 for _, t in plan) == S.TAU + 1
            found = S.links(frame, plan).collect()
            assert all((r.a ^ r.b).bit_count() <= 4 or ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in found)
            labels = {p: p for p in prints}

            def root(p, labels=labels):
                while labels[p] != p:
                    p = labels[p]
                return p

            for r in found:
                labels[root(r.b & (1 << 64) - 1)] = root(r.a & (1 << 64) - 1)
            assert len({root(p) for p in prints}) == len(set(roots.values()))
        plans = plans[-1:]


def test_label_propagation_on_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 100, 101]], "fp long")
    labels = {r.fp: r.label for r in S.labelled(nodes, edges).collect()}
    assert labels == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_links_of_a_group_of_copies_grow_with_its_size_alone(spark):
    rng, base = np.random.default_rng(9), 0x1234_5678_9ABC_DEF0
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(140)})[:100]
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    plan = [(list(range(0, 20)), 1), (list(range(20, 40)), 0), (list(range(40, 64)), 1)]
    found = S.links(frame, plan).collect()
    assert len(prints) == 100 <= S.CROWD and 99 <= len(found) <= 15 * len(prints)  # 4,950 pairs, all near
    half = S.links(frame.where(F.col("fp").isin([r.fp for r in frame.collect()[::2]])), plan).count()
    assert len(found) <= 3 * half  # and not four times
    labels = S.labelled(frame, spark.createDataFrame(found, "a long, b long")).collect()
    assert len(labels) == 100 and {r.label for r in labels} == {min(r.fp for r in labels)}


def test_labels_of_random_links_and_of_nodes_without_any(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))]
    label = list(range(160))
    for a, b in pairs:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    nodes = spark.range(160).withColumnRenamed("id", "fp")
    for edges in (pairs, []):
        found = S.labelled(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.fp: r.label for r in found} == (dict(enumerate(label)) if edges else {i: i for i in range(160)}) and len(found) == 160


def test_a_print_near_to_many_that_are_apart_joins_them_all(spark):
    centre = (1 << 62) - 1
    sets = [[20 + a, 25 + b, 30 + (a + b) % 5, 35 + (a + 2 * b) % 5] for a in range(5) for b in range(5)]  # two share a bit at most
    prints = [centre, *(centre ^ sum(1 << b for b in s) for s in sets)]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = S.links(frame, [(list(range(0, 20)), 1), (list(range(20, 40)), 0), (list(range(40, 64)), 1)])
    assert len({r.label for r in S.labelled(frame, found).collect()}) == 1 and found.count() == len(sets) > S.HUBS + 1
