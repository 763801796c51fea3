"""The serving surfaces over a small folder."""

import json

import pytest

from fathomer.plans import serve


@pytest.fixture(scope="module")
def knowledge(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")
    (root / "a.md").write_text("Apache Spark runs on Java Machines. The Query Planner reads parquet_files.")
    (root / "b.md").write_text("Cache Eviction drops the oldest entries when memory is short.")
    k = serve.Knowledge(spark, str(tmp_path_factory.mktemp("table")), gate=0.9)
    assert k.update(str(root))["adds"] == 2
    return k


def test_handlers(knowledge):
    status, got = serve.handle(knowledge, "GET", "/search?q=oldest%20entries&mode=lexical&limit=99")
    assert status == 200 and [r["file_path"] for r in got["results"]] == ["b.md"] and isinstance(got["results"][0]["chunk_id"], str)
    assert serve.handle(knowledge, "GET", "/search")[0] == 400 and serve.handle(knowledge, "GET", "/search?q=x&mode=odd")[0] == 400
    assert serve.handle(knowledge, "POST", "/search", b"{")[0] == 400 and serve.handle(knowledge, "GET", "/nowhere")[0] == 404
    assert serve.handle(knowledge, "GET", "/health") == (200, {"status": "ok"})
    assert len(serve.handle(knowledge, "GET", "/lineage?file=a.md")[1]) == 1


def test_review_and_graph(knowledge):
    waiting = knowledge.pending()
    names = {e["name"] for e in waiting["entities"]}
    assert {"Apache Spark", "Java Machines", "parquet_files"} <= names and knowledge.neighbours("apache spark") == []
    assert knowledge.review("approve", []) == 0
    assert knowledge.review("approve") == len(waiting["entities"]) + len(waiting["relations"])
    assert [r["neighbour"] for r in knowledge.neighbours("apache spark")] == ["Java Machines"]
    assert knowledge.pending() == {"entities": [], "relations": []}


def test_command_line(knowledge, spark, tmp_path, capsys):
    run = lambda *a: (serve.main(["--table", knowledge.path, *a], spark), json.loads(capsys.readouterr().out))[1]
    assert [s["file_path"] for s in run("ls")] == ["a.md", "b.md"]
    (tmp_path / "gold.json").write_text(json.dumps({"cases": [{"query": "oldest entries", "relevant_files": ["b.md"], "mode": "lexical"}]}))
    assert run("eval", str(tmp_path / "gold.json"))["hit"] == 1.0
    run("drop", "--file", "b.md")
    assert [s["file_path"] for s in run("ls")] == ["a.md"]
