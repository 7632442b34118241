import re
from collections import Counter

from siftline.llm import quality_rules as Q


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measurements_against_brute_force(docs, odd):
    repeats = "a b c d e f g h " * 3 + "x y\nx y\n\nx y " + "one two three four five six seven eight nine one two three four five six seven eight"
    for text in [t for _, t, *_ in docs] + [repeats, "", None, "a " * 50, "\x0b\x0c", "é#\u00a0ü"]:
        assert Q.measure(text)[:6] == slow(text)


def test_query(spark, sf, docs):
    rows = {r.doc_id: r for r in Q.op6_quality_rules(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, text, _ in docs:
        n_words, word_chars, n_symbols, _, dup, repeat = slow(text)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, dup, repeat)
        assert r.base_failed == (n_words < 20 or 100 * repeat > 30 * n_words) and not (r.base_failed and r.kept)


def test_policies_and_ablation(spark, sf):
    rows = Q.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r.failures for r in rows.collect()]
    for policy, mask in Q.POLICIES.items():
        assert Q.apply_policy(rows, policy).where("kept").count() == sum(not b & mask for b in bits)
    found = {r.rule: r for r in Q.ablation(rows).collect()}
    mask = Q.POLICIES["v1"]
    for rule in Q.RULES:
        r = found[rule.name]
        assert r.fails == sum(b >> rule.bit & 1 for b in bits) and r.fails_alone == sum(b & mask == 1 << rule.bit for b in bits)
        assert r.kept_without - r.kept_with == r.fails_alone


def test_odd_rows(odd, clashing, empty):
    assert Q.ledger(odd).count() == odd.count()
    both = Q.ledger(clashing)
    assert both.count() == clashing.count() and dict(both.dtypes)["measures"].startswith("struct") and both.columns == [c for c in clashing.columns if c != "text"] + ["failures", "rules_version"]
    assert Q.ledger(empty).collect() == [] and all(r.fails == 0 and r.kept_with == 0 for r in Q.ablation(Q.ledger(empty)).collect())
