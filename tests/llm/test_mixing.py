import re
from collections import defaultdict

import numpy as np

from siftline.llm import mixing as M


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_documents(spark, sf, docs):
    found = M.op8_mixing(spark, sf).collect()
    source = {i: s for i, _, s in docs}
    size = {i: words(t) for i, t, _ in docs}
    totals, taken = defaultdict(int), defaultdict(int)
    for i in size:
        totals[source[i]] += size[i]
    goals = slow_targets(totals)
    assert len(found) == len(docs)
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == totals[source[r.doc_id]] and abs(r.target - goals[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goals[s]) <= 0.08 * goals[s] for s in goals)
    assert {(r.doc_id, r.taken) for r in M.op8_mixing(spark, sf).collect()} == {(r.doc_id, r.taken) for r in found}


def test_full_sources(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 2 + ["b"] * 100 + ["c"] * 100 + [None] * 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = M.Plan(M.sized(frame))
    copies, goals = plan.copies(M.sized(frame)), {r.source: r.target for r in plan.targets.collect()}
    expected = slow_targets({"a": 20, "b": 1000, "c": 1000, None: 500})
    assert goals["a"] == 60 and all(abs(goals[s] - expected[s]) < 1e-9 for s in expected)
    assert {r.copies for r in copies.where("source = 'a'").collect()} == {3}


def test_the_dual_meets_its_constraint():
    sizes = np.array([1.0, 5.0, 40.0, 900.0, 20_000.0])
    totals = np.array([50, 4000, 90_000, 500_000, 900_000.0])
    for share in (0.01, 0.3, 0.9, 1.0, 1.7, 2.9):
        rate = M.solve(totals, sizes, share * totals.sum())
        assert abs(totals @ rate / totals.sum() - share) < 1e-6 and (rate >= 0).all() and (rate <= 3).all()
    assert (M.solve(totals, sizes, 3 * totals.sum()) == 3).all() and (M.solve(totals, sizes, 0.0) == 0).all()


def test_odd_rows(odd, clashing, empty):
    rows = M.Plan(M.sized(odd)).copies(M.sized(odd)).collect()
    assert len(rows) == odd.count() and all(0 <= r.copies <= 3 and (r.size or not r.copies) for r in rows)
    mixed = M.taken_rows(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == sum(r.copies for r in rows)
    assert M.taken_rows(empty).collect() == []


def test_texts_stay_where_they_are_read(clashing):
    plan = M.taken_rows(clashing)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
