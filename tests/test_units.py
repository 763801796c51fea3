"""Expected values of single functions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomer import ids
from fathomer.functions import text as fx
from fathomer.operators import chunk, evaluate, extract, fusion, graph, refine, rerank, resolve
from fathomer.plans import catalog


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_ids(spark):
    assert value(spark, ids.stable_id(F.lit("grün"))) == ids.stable_id_of("grün")
    a, b = (value(spark, ids.fingerprint(*[F.lit(x) for x in p])) for p in (("ab", "c"), ("a", "bc")))
    assert a != b and value(spark, ids.fingerprint(F.lit(None).cast("string"))) != value(spark, ids.fingerprint(F.lit("")))


def test_refine():
    assert refine.refine("a  =  1")[0] == "a = 1" and refine.refine("a  =  1", code=True)[0] == "a  =  1"
    out, at = refine.refine("café naïve")
    assert out == "café naïve" and len(at) == len(out) and at[4] == 5
    assert refine.refine("a \r\n\r\n\r\n  b\t\n") == ("a\n\nb", [0, 2, 4, 10])
    assert refine.refine("x\n    y\n\n\n\nz", code=True)[0] == "x\n    y\n\nz"
    assert refine.refine(None) == ("", []) and refine.refine(" \n\t") == ("", [])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \t\n\r.", max_size=60))
def test_refined_characters_come_from_their_offsets(t):
    out, at = refine.refine(t)
    assert len(out) == len(at) and at == sorted(at)
    assert all(c == t[i] or (c, t[i]) in ((" ", "\t"), ("\n", "\r")) for c, i in zip(out, at))


def test_offsets_map_back(spark):
    m = F.array(*[F.lit(i) for i in (3, 5, 9)])
    assert [value(spark, refine.source_offset(m, F.lit(i))) for i in (-1, 0, 2, 3)] == [3, 3, 9, 10]
    assert value(spark, refine.source_offset(F.array().cast("array<int>"), F.lit(4))) == 4


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(1, 40), st.integers(-3, 50))
def test_recursive_chunks(t, size, overlap):
    spans = chunk.recursive_spans(t, size, overlap)
    assert all(0 < b - a <= size for a, b in spans) and all(t[a:b].strip() for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(t) if not c.isspace())


def test_splitters():
    assert [("Para1\n\nPara2\n\nPara3")[a:b] for a, b in chunk.separator_spans("Para1\n\nPara2\n\nPara3", ["\n\n+"])] == ["Para1", "Para2", "Para3"]
    with pytest.raises(ValueError):
        chunk.recursive_spans("x", 0)
    with pytest.raises(ValueError):
        chunk.separator_spans("x", [])
    assert chunk.separator_spans("a,b", [","], keep="left") == [(0, 2), (2, 3)] and chunk.separator_spans("a,b", [","], keep="right") == [(0, 1), (1, 3)]
    code = "import x\n\ndef f():\n    return 1\n\ndef g():\n    return 2\n"
    assert [code[a:b].strip()[:5] for a, b in chunk.recursive_spans(code, 30, 0, chunk.separators_for("py"))] == ["impor", "def f", "def g"]
    text = "Cats purr. Cats purr. Dogs bark at night. Dogs bark at night."
    v = {"Cats purr.": [1.0, 0.0], "Dogs bark at night.": [0.0, 1.0]}
    assert chunk.semantic_spans(text, lambda s: np.array([v[x] for x in s]), least=5) == [(0, 22), (22, 61)]
    assert chunk.semantic_spans(text, lambda s: np.zeros((len(s), 3))) == [(0, 61)]
    assert chunk.semantic_spans(text, lambda s: 1 / 0) == chunk.recursive_spans(text)


def test_text_functions(spark):
    assert value(spark, fx.expand(F.lit("AUTH flow"))) == "AUTH flow authentication authorization"
    assert value(spark, fx.expand(F.lit("write wal"))) == "write wal ahead log"
    assert value(spark, fx.normalise_name(F.lit("  Grüne-Äpfel,  Inc. "))) == "grüne äpfel inc"
    routes = {"parse_payload validation": "lexical", "what calls foo(": "lexical", "how does caching work": "graph", "cache eviction policy": "hybrid"}
    assert {q: value(spark, fx.route(F.lit(q))) for q in routes} == routes
    assert value(spark, fx.resolve_mode(F.lit("how does it work"), F.lit("auto"), graph=False)) == "hybrid"
    assert value(spark, fx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert value(spark, fx.language_of(F.lit("a/b.TSX"))) == "typescript" and value(spark, fx.language_of(F.lit("a.xyz"))) is None


def test_fusion_ties_and_weights(spark):
    lists = spark.createDataFrame([(1, "vector", 10, 1), (1, "lexical", 20, 1)], "query_id bigint, strategy string, chunk_id bigint, rank int")
    got = fusion.fuse(lists).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [10, 20] and all(abs(r.score - 1 / 61) < 1e-12 for r in got)
    got = fusion.fuse(lists, {"vector": 0.0}).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got][1] == (10, 0.0)


def test_mmr():
    v = [np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([0.0, 1.0])]
    s = np.array([1.0, 0.9, 0.5])
    assert rerank.mmr_order(s, v, 1.0, 2) == [0, 1] and rerank.mmr_order(s, v, 0.3, 2) == [0, 2]
    assert rerank.mmr_order(s, [None, None, None], 0.5, 3) == [0, 1, 2]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate("abcd")], "case_id int, rank int, item string")
    rel = spark.createDataFrame([(1, "c"), (2, "z")], "case_id int, item string")
    got = {r.case_id: r for r in evaluate.case_metrics(hits, rel, 4).collect()}
    assert abs(got[1].mrr - 1 / 3) < 1e-12 and got[1].precision == 0.25 and got[1].recall == 1 and abs(got[1].map - 1 / 3) < 1e-12
    assert got[2].hit == 0 and evaluate.case_metrics(hits, rel, 2).where("case_id = 1").first().recall == 0
    assert evaluate.compare({"map": 0.4, "mrr": 0.5}, {"map": 0.5, "hit": 1.0}, 0.05) == ["map"]
    for bad in ("[]", '{"cases": [{}]}', '{"cases": [{"query": "q", "relevant_files": []}]}'):
        with pytest.raises(ValueError):
            evaluate.load_cases(bad)
    best, n = evaluate.coordinate_ascent(lambda w: w["lexical"] - w["vector"])
    assert best == {"vector": 0.0, "lexical": 2.0, "graph": 1.0} and n < 64


def test_resolution(spark):
    e = spark.createDataFrame([(1, "SQLite", "Concept", 0.9), (2, "sqlite", "Concept", 0.5), (3, "Postgres", "Concept", 0.8)], "id bigint, name string, type string, confidence double")
    found, trail = resolve.resolve(e)
    got = {r.name: r for r in found.collect()}
    assert set(got) == {"SQLite", "Postgres"} and got["SQLite"].aliases == ["sqlite"] and trail.first().merged == "sqlite"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7071, 0.7071])], "id bigint, embedding array<double>")
    two = spark.createDataFrame([(1, "alpha", "Concept", 0.9), (2, "omega", "Concept", 0.5)], e.schema)
    assert resolve.resolve(two, v)[0].count() == 2
    assert resolve.resolve(two, v, adjudicate=lambda a, b: F.lit(True))[0].count() == 1


def test_candidates_of_either_side(spark):
    rng = np.random.default_rng(3)
    x = rng.random((30, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x @ x.T, 9)
    want = set()
    for i in range(30):
        near = sorted(((sim[i, j], j) for j in range(30) if j != i and sim[i, j] >= 0.5), reverse=True)
        want |= {(min(i, j), max(i, j)) for _, j in near[:2]}
    assert {(r.i, r.j) for r in resolve.candidate_pairs(v, 0.5, 2).collect()} == want


def test_resolve_merges_the_closest_pair_of_the_larger_id(spark):
    """0 has ten larger partners that are closer than 11, whose closest partner is 0."""
    angle = [0.0, *[0.2 + 0.001 * k for k in range(10)], -0.3]
    e = spark.createDataFrame([(i, f"name{i}", "Concept", 0.5) for i in range(12)], "id bigint, name string, type string, confidence double")
    v = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)], "id bigint, embedding array<double>")
    assert resolve.resolve(e, v)[0].count() == 1


def test_graph_search_has_all_edges(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(14, 3))
    e = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x @ x.T, 12)
    rows = [(0, i, j, "near", round(float(sim[i, j]), 6), i) for i in range(14) for j in range(i + 1, 14) if sim[i, j] >= 0.35]
    assert max(sum(r[1] == i for r in rows) for i in range(14)) > 3
    edges = spark.createDataFrame(rows, "id bigint, subject_id bigint, object_id bigint, predicate string, confidence double, chunk_id bigint").withColumn("id", F.xxhash64("subject_id", "object_id"))
    nodes = e.selectExpr("vec_id AS id", "embedding", "array(vec_id) AS chunk_ids")
    want = graph.search(e.selectExpr("vec_id AS query_id", "embedding AS query_vector"), nodes, edges, 5)
    assert sorted(map(tuple, catalog.QUERIES["graph_search"](spark, str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))


def test_reply_parsing(spark):
    reply = 'Sure: {"entities": [{"name": "A", "type": "T", "confidence": 2}, {"name": ""}], "relations": [{"subject": "A", "predicate": "Depends On", "object": "B"}]} done'
    v = value(spark, extract.parse_reply(F.lit(reply)))
    assert [(e.name, e.confidence) for e in v.entities] == [("A", 1.0)] and v.relations[0].predicate == "depends_on" and v.relations[0].confidence == 0.8
    assert value(spark, extract.parse_reply(F.lit("no object"))) is None


def test_review(spark):
    n = spark.createDataFrame([(1, "a", "pending"), (2, "b", "pending"), (3, "c", "approved")], "id bigint, name string, status string")
    log = spark.createDataFrame([(1, "approve", 1), (2, "reject", 1)], "id bigint, action string, at int")
    assert {(r.id, r.status) for r in graph.overlay(n, log).collect()} == {(1, "approved"), (3, "approved")}
