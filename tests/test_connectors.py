import json
import os
import time

import pytest
from pyspark.sql import functions as F

from siftline.sources import connectors as C
from siftline.streaming import ingest


@pytest.fixture()
def root(tmp_path):
    for at in ("a.txt", "b.md", "deep/er/c.TXT", "deep/d.csv", ".hidden/e.txt", "deep/.f.txt", "large.txt"):
        (tmp_path / "in" / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / at).write_text("x" * 500 if at == "large.txt" else at)
    (tmp_path / "secret.txt").write_text("outside")
    os.symlink(tmp_path / "secret.txt", tmp_path / "in/link.txt")
    os.symlink(tmp_path / "in", tmp_path / "in/deep/loop")
    return tmp_path / "in"


def test_a_walk_is_confined_and_complete(spark, root):
    source = C.FolderConnector(spark, "s", f"file://{root}", {"max_bytes": "400", "api_token": "t", "spread": "1"})
    for spread in ("1", "2", "50"):
        rows = {r.path: r for r in source._reader(spread=spread).collect()}
        assert set(rows) == {"a.txt", "b.md", "deep/er/c.TXT", "deep/d.csv", "large.txt", "link.txt"}
        assert bytes(rows["deep/d.csv"].content) == b"deep/d.csv" and rows["deep/d.csv"].kind == "table" and rows["a.txt"].error is None
        assert rows["link.txt"].content is None and "out of" in rows["link.txt"].error and "larger" in rows["large.txt"].error
    assert {r.path for r in source._reader(extensions="txt", hidden="true").collect()} == {"a.txt", "deep/er/c.TXT", ".hidden/e.txt", "deep/.f.txt", "large.txt", "link.txt"}
    got = {r.path: r for r in source.fetch(spark.createDataFrame([(p,) for p in ("a.txt", "../secret.txt", "link.txt", "/etc/passwd", "none.txt", str(root / "b.md"))], "path string")).collect()}
    assert bytes(got["a.txt"].content) == b"a.txt" and bytes(got[str(root / "b.md")].content) == b"b.md"
    assert all(got[p].content is None and got[p].error for p in ("../secret.txt", "link.txt", "/etc/passwd", "none.txt"))
    assert source.metadata()["api_token"] == "***"


def test_health_never_raises(spark, root):
    assert C.FolderConnector(spark, "s", f"file://{root}").validate() == C.Health("healthy", "6 files", 6)
    assert C.FolderConnector(spark, "s", f"file://{root}/none").validate().status == "unreachable"
    assert C.FolderConnector(spark, "s", f"file://{root}/a.txt").validate().status == "unreachable"
    assert C.FolderConnector(spark, "s", "nonsense://x").validate().status == "unreachable"


def test_positions_resume(spark, root):
    source = C.FolderConnector(spark, "s", f"file://{root}")
    first = source.discover()
    assert first.count() == 6 and "content" not in first.columns
    cursor = source.checkpoint(first)
    assert source.discover().count() == 0
    time.sleep(0.02)
    (root / "new.txt").write_text("new")
    later = C.FolderConnector(spark, "s", f"file://{root}")
    later.restore(cursor)
    assert [r.path for r in later.discover().collect()] == ["new.txt"]


def test_uploads_break_rules(spark, root):
    (root / "bad name (1).exe").write_text("x")
    (root / "empty.txt").write_text("")
    source = C.UploadConnector(spark, "u", f"file://{root}", kinds=("txt",), largest=100)
    got = {r.path: (r.name, r.error) for r in source.discover().collect()}
    assert got["a.txt"] == ("a.txt", None) and got["bad name (1).exe"] == ("bad_name_1_.exe", "upload refused: type")
    assert got["empty.txt"][1] == "upload refused: empty" and got["large.txt"][1] == "upload refused: size"


def test_a_poisoned_file_fails_alone_and_a_failed_pass_repeats(spark, tmp_path):
    root, target = tmp_path / "in", f"file://{tmp_path}/out"
    work = lambda path, content: (json.loads(content)["n"],)
    root.mkdir()
    for i in range(6):
        (root / f"{i}.json").write_text("{" if i == 3 else json.dumps({"n": i}))
    source = C.FolderConnector(spark, "s", f"file://{root}")
    broken = lambda batch, i: (_ for _ in ()).throw(RuntimeError("the pass fails"))
    with pytest.raises(Exception, match="the pass fails"):
        ingest.run_available(source.stream(), f"{target}/checkpoint", broken)
    assert ingest.sync(source, target, work, "n long") == {"discovered": 6, "failed": 1}
    assert sorted(r.n for r in ingest.synced(spark, target).collect()) == [0, 1, 2, 4, 5]
    assert [r.path for r in ingest.dead_letters(spark, target).collect()] == ["3.json"]
    assert ingest.sync(source, target, work, "n long") == {"discovered": 0, "failed": 0}
    time.sleep(0.02)
    (root / "3.json").write_text('{"n": 3}')
    (root / "1.json").write_text("now broken")
    again = C.FolderConnector(spark, "s", f"file://{root}")  # as after a restart
    assert ingest.sync(again, target, work, "n long") == {"discovered": 2, "failed": 1}
    assert sorted(r.n for r in ingest.synced(spark, target).collect()) == [0, 2, 3, 4, 5]
    assert [r.path for r in ingest.dead_letters(spark, target).collect()] == ["1.json"]


def test_many_files_in_one_folder_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "FILES_A_PART", 7)
    rows = spark.range(50).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".txt")).alias("p"))
    assert C.write_files(rows, f"file://{tmp_path}/in", F.col("p"), F.encode("p", "UTF-8")) == 50
    walk = C.Walk(C.Settings(f"file://{tmp_path}/in"))
    parts = walk.parts(-1, None)
    assert len(parts) == 8 and sorted(f.base_name for p in parts for f in walk.items(p)) == sorted(f"f{i}.txt" for i in range(50))
