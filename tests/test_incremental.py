"""Adding, editing and deleting files, end to end."""

import time

import pytest
from pyspark.sql import functions as F

from fathomer.plans import ingest, search
from fathomer.streaming import live
from fathomer.streaming.incremental import Target


def test_update_matrix(spark, tmp_path):
    root, path = tmp_path / "notes", str(tmp_path / "table")
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("Vectors are  fast.\r\n\r\nThey rank documents.")
    (root / "sub" / "b.py").write_text("def f():\n    return 1\n")
    (root / "skip.bin").write_bytes(b"\x00")
    n = lambda **kw: {**dict.fromkeys(("adds", "reprocesses", "unchanged", "deletes"), 0), **kw}
    run = lambda: {k: v for k, v in ingest.update(spark, str(root), path).items() if k in n()}
    assert run() == n(adds=2)
    assert run() == n(unchanged=2)
    c = {r.source_key: r for r in ingest.chunks(spark, path).collect()}
    assert set(c) == {"a.md", "sub/b.py"} and c["a.md"].text == "Vectors are fast.\n\nThey rank documents."
    source = (root / "a.md").read_bytes().decode()
    assert source[c["a.md"].start_offset : c["a.md"].end_offset].split() == c["a.md"].text.split()
    (root / "a.md").write_text("Something else about graphs.")
    assert run() == n(reprocesses=1, unchanged=1)
    (root / "sub" / "b.py").unlink()
    assert run() == n(deletes=1, unchanged=1)
    assert [r.source_key for r in ingest.chunks(spark, path).collect()] == ["a.md"]
    q = spark.createDataFrame([(1, "graphs", "lexical")], "query_id bigint, query string, mode string")
    assert [r.file_path for r in search.search(q, search.Corpus(ingest.chunks(spark, path))).collect()] == ["a.md"]


def test_row_diff_and_failure(spark, tmp_path):
    t = Target(spark, str(tmp_path / "t"), "val string")
    src = lambda *rows: spark.createDataFrame([(k, v) for k, v in rows], "source_key string, content string")
    lines = lambda s: s.select("source_key", F.posexplode(F.split("content", ",")).alias("row_id", "val"))
    assert t.update(src(("a", "1,2,3")), lines)["writes"] == 3
    got = t.update(src(("a", "1,9,3")), lines)
    assert (got["writes"], got["skips"]) == (1, 2) and t.rows.read().count() == 3
    before = t.rows.version()
    with pytest.raises(ZeroDivisionError):
        t.update(src(("a", "5")), lambda s: 1 / 0)
    assert t.rows.version() == before and sorted(r.val for r in t.rows.read().collect()) == ["1", "3", "9"]
    assert t.update(src(("a", "1,9,3")), lines, force=True)["skips"] == 3
    assert t.drop_source("a") == 3 and t.rows.read().count() == 0


def test_live_reacts_to_additions_edits_and_deletions(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("hello")
    seen = []
    keys = lambda s: seen.append(sorted(r.source_key for r in s.select("source_key").collect()))
    go = lambda: live.poll(spark, str(root), keys, str(tmp_path / "state"))
    assert go() and not go() and seen == [["a.md"]]
    (root / "b.md").write_text("more")
    assert go() and seen[-1] == ["a.md", "b.md"] and not go()
    (root / "a.md").write_text("hello, edited")
    assert go() and len(seen) == 3 and not go()
    (root / "b.md").unlink()
    assert go() and seen[-1] == ["a.md"] and not go()

    def fails(_):
        raise OSError

    (root / "c.md").write_text("third")
    with pytest.raises(OSError):
        live.poll(spark, str(root), fails, str(tmp_path / "state"))
    assert go() and seen[-1] == ["a.md", "c.md"]
    query = live.watch(spark, str(root), keys, str(tmp_path / "state"), "200 milliseconds")
    try:
        (root / "c.md").unlink()
        for _ in range(150):
            if seen[-1] == ["a.md"]:
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[-1] == ["a.md"]


def test_roots_as_uris_and_vanished_roots(spark, tmp_path):
    root, path = tmp_path / "my notes", str(tmp_path / "table")
    (root / "sub").mkdir(parents=True)
    (root / "a+b 1%.md").write_text("one")
    (root / "sub" / "ü.md").write_text("two")
    assert ingest.update(spark, str(root), path)["adds"] == 2
    for uri in (f"file://{root}", f"file:{root}", f"{root}/"):
        got = ingest.update(spark, uri, path)
        assert (got["unchanged"], got["deletes"], got["adds"]) == (2, 0, 0), uri
    assert {r.source_key for r in ingest.chunks(spark, path).collect()} == {"a+b 1%.md", "sub/ü.md"}
    with pytest.raises(FileNotFoundError):
        ingest.update(spark, str(tmp_path / "none"), path)
    for f in (root / "a+b 1%.md", root / "sub" / "ü.md"):
        f.unlink()
    with pytest.raises(ValueError, match="known sources are gone"):
        ingest.update(spark, str(root), path)
    assert ingest.chunks(spark, path).count() == 2
    assert ingest.update(spark, str(root), path, allow_empty=True)["deletes"] == 2 and ingest.chunks(spark, path).count() == 0


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    t = Target(spark, str(tmp_path / "t"), "val string")
    src = lambda n, odd="x": spark.createDataFrame([(f"k{i}", odd if i == 3 else "x") for i in range(n)], "source_key string, content string")
    rows = lambda s: s.select("source_key", F.lit(1).alias("row_id"), F.col("content").alias("val"))
    t.update(src(40), rows)
    first = t.rows._manifest()["parts"]
    assert t.update(src(40, "y"), rows)["writes"] == 1
    second = t.rows._manifest()["parts"]
    assert sum(first[p] != second[p] for p in first) == 1 and t.rows.read().count() == 40
    t.update(src(40, "z"), rows)
    t.update(src(40, "w"), rows)
    folders = {f.name for f in (tmp_path / "t" / "rows").iterdir() if f.name.startswith("v=")}
    assert len(folders) <= 3 and {r.val for r in t.rows.read().collect()} == {"x", "w"}
