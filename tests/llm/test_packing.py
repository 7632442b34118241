import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftline.llm import packing as P


def one_by_one(lengths, limits):
    """Best fit decreasing on single pieces: the number of sequences."""
    bins = []
    weights = np.array(limits.weights)
    for length in sorted(lengths, reverse=True):
        asks = P.demand(length)
        fits = [(float((((left - asks) / limits.capacity) ** 2) @ weights), i) for i, left in enumerate(bins) if (left >= asks).all()]
        if fits:
            bins[min(fits)[1]] -= asks
        else:
            bins.append(limits.capacity - asks)
    return len(bins)


def unfolded(counts, limits, score="norm"):
    """(sequence, offset, length) of every piece of a plan; every rank must be placed once."""
    placed, opened = P.plan(counts, limits, score)
    ranks, out = defaultdict(list), []
    for p in placed:
        for k in range(p.last - p.first):
            ranks[p.length].append(p.first + k)
            out.append((p.sequence + k // p.each, p.offset + k % p.each * p.length, p.length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    return out, opened


def check_sequences(places, limits):
    by = defaultdict(list)
    for sequence, offset, length in places:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(parts) <= limits.pieces and sum(n * n for _, n in parts) <= limits.attention
    return len(by)


@pytest.mark.parametrize("limits", [P.Limits(), P.Limits(64, 64, 4096), P.Limits(64, 3, 4096), P.Limits(64, 64, 1800), P.Limits(64, 5, 2500, (1, 1, 1))])
@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_limit(limits, score):
    rng = random.Random(5)
    most = max(n for n in range(1, limits.tokens + 1) if n * n <= limits.attention)
    for rows in (0, 1, 7, 400, 3000):
        lengths = [rng.choice((rng.randint(1, most), rng.randint(1, max(1, most // 10)), most)) for _ in range(rows)]
        places, opened = unfolded(Counter(lengths), limits, score)
        assert check_sequences(places, limits) == opened
        if score == "norm" and rows < 3000:
            assert opened == one_by_one(lengths, limits)


def test_plan_is_close_to_the_least():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 1024) for _ in range(50_000))
    _, opened = P.plan(counts)
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert least <= opened <= least * 1.01


def test_plan_does_not_grow_with_counts():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 1025)}
    placed, opened = P.plan(counts)
    assert len(placed) < 40_000 and opened >= sum(n * c for n, c in counts.items()) // 1024


def test_a_piece_beyond_the_capacity():
    with pytest.raises(ValueError):
        P.plan({65: 1}, P.Limits(64))


def by_hand(docs, most=1024):
    """Pieces by the tokenizers library."""
    enc, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text, *_ in docs:
        ids = [*enc.encode(text or "", add_special_tokens=False).ids, 2]
        starts = [0]
        if len(ids) > most:
            starts = [0, *range(len(ids) % most or most, len(ids), most)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out.append((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


key = lambda r: tuple((x is None, x or 0) for x in r)


def test_documents(spark, sf, docs):
    found = P.op11_packing(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(by_hand(docs))
    n = check_sequences([(r.sequence_id, r.offset, r.length) for r in found], P.Limits())
    lengths = [r.length for r in found]
    assert n == one_by_one(lengths, P.Limits()) and n <= 1.05 * sum(lengths) / 1024 + 1


def test_odd_rows(spark, odd, clashing, empty):
    more = spark.createDataFrame([(30, "ends <|endoftext|> here <|endoftext|>"), (31, "x" * 200_000), (32, "日本語 " * 5000)], "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionByName(more)
    pieces = P.staged(P.pieces_of(rows, 64, with_ids=True), "test-pieces")
    limits = P.Limits(64, 6, 4096)
    out = P.packed_pieces(pieces, limits)
    found = out.collect()
    got = sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], key=key)
    assert got == sorted(by_hand([tuple(r) for r in rows.collect()], 64), key=key)
    assert check_sequences([(r.sequence_id, r.offset, r.length) for r in found], limits) == P.sequences(out).count()
    whole = {r.sequence_id: r for r in P.sequences(out).collect()}
    for r in found:
        part = whole[r.sequence_id].ids[r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.offset + r.length in whole[r.sequence_id].ends
    assert P.packed_pieces(P.staged(P.pieces_of(clashing), "test-pieces")).count() >= clashing.count()
    assert P.packed_pieces(P.staged(P.pieces_of(empty), "test-pieces")).collect() == []


def test_segments_leave_ids_alone():
    enc = P.encoder(*P.default_vocabulary())
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "'s", " ", "  ", "\n", "é", "12", "日", ".", "Zz "]) for _ in range(300))
        parts = list(P.segments(text, 20))
        assert "".join(parts) == text and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_ids_equal_those_of_the_tokenizers_library():
    enc, theirs = P.encoder(*P.default_vocabulary()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, 0x3100, 64):  # scripts, marks, digits and blanks of the first planes
        text = " ".join(f"a{chr(c)}b 1{chr(c)}{chr(c)}2  {chr(c)} " for c in points[at : at + 64])
        assert P.token_ids(text, enc)[:-1].tolist() == theirs.encode(text, add_special_tokens=False).ids
