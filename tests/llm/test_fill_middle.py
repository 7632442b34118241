import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import fill_middle as M

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc_id, text):
    """The contract, word for word, without the operator's code."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    p, m = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:p], units[p:m], units[m:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), sha(output), sha(text)


def test_documents(spark, sf, docs):
    found = sorted(map(tuple, M.op12_fill_middle(spark, sf).collect()))
    assert found == sorted(by_hand(i, t) for i, t, _ in docs)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


MARKED = [(20, "a <P> inside"), (21, "<S>"), (22, "x<M"), (23, "<"), (24, "<<P"), (25, "P>S>M>"), (26, "\n  \x00 é \U0001f600"), (-7, "below zero")]


def test_odd_rows(spark, odd):
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame(MARKED, "doc_id long, text string"))
    made = M.transformed(rows).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    ours = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, sha(r.back)) for r in made), key=key)
    assert ours == sorted((by_hand(r.doc_id, r.text) for r in rows.collect()), key=key)
    assert all(r.back == (r.text or "") and sha(r.output) == r.output_sha256 for r in made)


def test_columns_that_clash_and_empty_tables(clashing, empty):
    rows = clashing.withColumn("form", F.lit("x")).withColumn("output", F.lit("y")).withColumn("made", F.lit("z"))
    out = M.transformed(rows)
    assert set(out.columns) == set(rows.columns) | {"n", "prefix_chars", "middle_chars", "output_sha256"}
    assert out.where("made = 'z' and row = 'x-row' and form in ('plain', 'psm', 'spm')").count() == clashing.count()
    assert M.transformed(empty).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12), st.text(alphabet="<>PSM aZ\né\U0001f600", max_size=40))
def test_round_trip(doc_id, text):
    import regex

    spec = M.Spec()
    _, form, _, _, output = M.transform(doc_id, text, regex.compile(M.UNIT), spec)
    assert M.restore(output, form, spec) == text


def test_other_marks_and_rates(spark):
    spec = M.Spec("[pre]", "[suf]", "[mid]", 100, 100, "s")
    rows = spark.createDataFrame([(i, f"text number {i} with <P> in it") for i in range(20)], "doc_id long, text string")
    made = M.transformed(rows, spec).withColumn("back", M.restored(F.col("output"), F.col("form"), spec)).collect()
    assert all(r.form == "spm" and r.output.startswith("[suf]") and r.back == r.text for r in made)
