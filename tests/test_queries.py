"""A sample of the queries against DuckDB at the smallest size, and the contract of the entry module."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from siftline import catalogue
from siftline.plans import retrieval

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Of the retrieval queries, which build an index each, some; of the others all.
SAMPLE = ["hybrid_search", "bm25_filtered", "knn_topk", "score_explain", "freshness_decay", "metadata_match", "stem_terms"]
NAMES = sorted([n for n in catalogue.oracle_sql() if n not in retrieval.query.sql] + SAMPLE)


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted([shown(r[c]) for c in cols] for r in df.collect())
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert ours == sorted([shown(r[i]) for i in at] for r in rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "final" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.queries()) <= set(entry.queries())


def copied(tmp_path, *names):
    """The given parts of the repository in a folder of their own, and an environment that finds them first."""
    for name in names:
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=lambda _, found: [n for n in found if n in ("llm", "__pycache__")])
        else:
            shutil.copy(source, tmp_path)
    return os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)}


@pytest.mark.skipif("SIFTLINE_INNER" in os.environ, reason="this is the inner run")
def test_rest_passes_without_the_corpus_operators(tmp_path):
    env = copied(tmp_path, "siftline", "__spark_entry__.py", "tests") | {"SIFTLINE_INNER": "1"}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    (tmp_path / "run.py").write_text(code)
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
    some = "not against_sql or contains_search or hybrid_search or folder_scan or resolution_cascade"  # the rest of the SQL is compared in the outer run
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", some], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1800)
    assert done.returncode == 0, done.stdout[-800:]


def test_a_missing_dependency_is_not_hidden(tmp_path):
    """Only the absence of the corpus operators themselves is no error."""
    for name in ("siftline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path)
    if not (tmp_path / "siftline/llm").exists():
        pytest.skip("no corpus operators")
    (tmp_path / "run.py").write_text("import sys; sys.modules['xxhash'] = None; import __spark_entry__")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "xxhash" in done.stderr
