import random
import re

import corpus_pipeline as C
from siftline.llm import near_copies as N


def slow_kept(rows):
    """Ids that stay when all pairs are compared."""
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    label = list(range(len(sets)))
    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if label[x] != label[y] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = label[x], label[y]
                label = [new if v == old else v for v in label]
    return sorted(min(sets[x][0] for x in range(len(sets)) if label[x] == k) for k in set(label))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    """Bases of 30 to 400 words with copies at similarities around 0.8, and a line that unlike texts share."""
    rng, texts = random.Random(5), []
    line = "this very common line stands in many texts that are otherwise not alike at all"
    for _ in range(25):
        words = [f"w{rng.randrange(5_000)}" for _ in range(rng.choice([30, 60, 120, 400]))]
        texts += [edited(rng, words, e) for e in (0, 1, len(words) // 60, len(words) // 50, len(words) // 40, len(words) // 20)]
    texts += [f"{line} {rng.random()} {rng.random()} {rng.random()}" for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_every_near_copy_is_found_and_nothing_else(spark, sf, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow_kept(rows)
    assert len(want) < len(rows) - 50
    assert sorted(r.doc_id for r in C.near(spark, docs, sf).collect()) == want
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "SMALL", 4)
    assert sorted(r.doc_id for r in N.kept_rows(docs).collect()) == want


def test_documents_against_brute_force(spark, docs):
    rows = [(i, t) for i, t, _ in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in N.kept_rows(frame).collect()) == slow_kept(rows)


def test_odd_rows(clashing, empty):
    kept = N.kept_rows(clashing)
    assert kept.columns == clashing.columns
    # ids 1 and 2, the texts without words, 7, 5 and 6, the two without an id in equal texts
    assert sorted((r.doc_id is not None, r.doc_id or 0, (r.text or "")[:6]) for r in kept.collect()) == [
        (False, 0, ""), (False, 0, "a text"), (True, 1, "The sa"), (True, 5, "word0 "), (True, 7, "É é ß "),
    ]
    assert N.kept_rows(empty).collect() == []


def test_texts_that_share_an_id_or_have_none_stay(spark):
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef"]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (5, texts[4]), (5, texts[4]), (6, texts[4] + " more"), (4, texts[5])]
    kept = N.kept_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in [*rows[:5], rows[7]])


def test_bands_and_sketches_miss_nothing_at_the_bound():
    bands, rng = N.band_count(), random.Random(2)
    assert (1 - 0.8**N.ROWS) ** bands <= N.MISS
    for _ in range(200):
        both = [f"x{rng.random()}" for _ in range(400)]
        a, b = N.shingles(" ".join(both), 1), N.shingles(" ".join([*both[:356], *(f"y{rng.random()}" for _ in range(44))]), 1)
        assert len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) >= 0.8
        assert (N.band_keys(a, bands) == N.band_keys(b, bands)).any()
        least = sorted(set(a[: N.SKETCH].tolist()) | set(b[: N.SKETCH].tolist()))[: N.SKETCH]
        assert len(set(least) & set(a.tolist()) & set(b.tolist())) >= N.least_common(N.SKETCH, 0.8)


def test_links_are_named_once(spark, monkeypatch):
    """Rounds after the first hand on links between components alone."""
    spread = [(1, 2), (2, 3), (10, 11), (20, 21)], [(1, 3), (3, 10), (2, 11), (30, 31), (31, 21)], [(10, 1)], [(30, 40), (20, 11)]
    join, seen, named = N._Join.__new__(N._Join), [], N.simhash.labelled
    join.labels = None
    monkeypatch.setattr(N.simhash, "labelled", lambda nodes, edges: seen.append(edges.count()) or named(nodes, edges))
    for links in spread:
        join.link(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in join.labels.collect()} == dict.fromkeys((1, 2, 3, 10, 11, 20, 21, 30, 31, 40), 1)
    assert seen == [4, 3, 0, 2]
