import hashlib

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import byte_bpe as B

CODEC = B.codec(*B.default_vocabulary())
LIBRARY = tiktoken.Encoding("own", pat_str=B.default_vocabulary()[1], mergeable_ranks=CODEC.ranks, special_tokens={})


def expected(text):
    ids = LIBRARY.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def ids(text):
    return [int(i) for piece in CODEC.encode(text) for i in piece.split()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])) | st.text(alphabet=" \t\n'sdrelvmta1.!éÉ_²½\x1c <|>"))
def test_encodes_as_the_library_and_decodes_back(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=2, max_size=60) | st.text(alphabet="aeth", min_size=2, max_size=60).map(str.encode))
def test_both_merges_agree(data):
    if data not in CODEC.ranks:
        assert CODEC.merge(data) == CODEC._merge_long(data)


def test_long_runs():
    for text in ("a" * 3000, "ab" * 900, "<|endoftext|>" * 3):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_documents(spark, sf, docs):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op10_byte_bpe(spark, sf).collect()}
    assert found == {i: expected(t) for i, t, _ in docs}


def test_chunks_are_stitched(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 200)
    monkeypatch.setattr(B, "OVERLAP", 24)
    texts = ["one two  three\n\nfour don't 12345 " * 40, "x" * 900 + " then words " * 30, "y " * 60 + "z" * 500 + " and so on" * 30, "\n" * 700, None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    found = B.digests(rows).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(texts[r.doc_id])
    monkeypatch.undo()
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in B.digests(odd).collect()))) == sorted(repr((r.doc_id, expected(r.text)[0])) for r in odd.collect())
    assert B.digests(empty).collect() == []
