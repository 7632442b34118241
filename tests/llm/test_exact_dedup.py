import hashlib
from collections import defaultdict

from siftline.llm import exact_dedup as D
from siftline.llm.common import LOWER, UPPER

_TABLE = str.maketrans(UPPER, LOWER)


def groups(rows):
    out = defaultdict(list)
    for doc_id, text, *_ in rows:
        out[hashlib.sha256((text or "").translate(_TABLE).encode()).hexdigest()].append(doc_id)
    return out


def check(found, rows):
    expected, kept = groups(rows), defaultdict(list)
    assert len(found) == len(rows)
    for r in found:
        ids = expected[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (max(known) if known else None) and r.group_size == len(ids)
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
            assert r.doc_id == r.keep_id
    assert set(kept) == set(expected) and all(len(v) == 1 for v in kept.values())


def test_documents_against_brute_force(spark, sf, docs):
    check(D.op7_exact_dedup(spark, sf).collect(), docs)


def test_odd_rows(odd, empty):
    check(D.ledger(odd).collect(), [tuple(r) for r in odd.collect()])
    assert D.ledger(empty).collect() == []


def test_rows_that_stay_keep_their_columns(clashing, empty):
    kept = D.kept_rows(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    expected = groups([tuple(r)[:2] for r in clashing.collect()])
    assert len(rows) == len(expected)
    for r in rows:
        ids = [i for i in expected[hashlib.sha256((r.text or "").translate(_TABLE).encode()).hexdigest()] if i is not None]
        assert r.doc_id == (max(ids) if ids else None) and r["_key"] == "x-_key"
    assert D.kept_rows(empty).collect() == []


def test_a_full_filter_is_still_exact(odd, monkeypatch):
    monkeypatch.setattr(D, "MAX_BITS", D.BLOCK_BITS)
    monkeypatch.setattr(D, "BITS_PER_ROW", 1)
    check(D.ledger(odd).collect(), [tuple(r) for r in odd.collect()])


def test_rows_that_repeat_everything_are_counted(spark, monkeypatch):
    monkeypatch.setattr(D, "PART", 7)
    rows = [(None, "")] * 100 + [(3, "x")] * 15 + [(2, "X")] * 8 + [(1, "alone")]
    ledger = D.ledger(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    check(ledger.collect(), rows)
    assert "Window" not in ledger._jdf.queryExecution().executedPlan().toString()
