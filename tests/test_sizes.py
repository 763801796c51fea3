"""What tasks hold and what is shuffled stays bounded, with the same results."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomer.operators import chunk, evaluate, extract, lexical, refine, slices, vector


def test_text_functions_work_in_slices(spark):
    """Results of a batch come in pieces of about SLICE_BYTES of text, in order, nulls and long texts included."""
    texts = ["ab  c\n" * 30_000, None, "", "é  x" * 10, *["wörter und mehr  " * 900] * 150, "z" * 3_000_000]
    seen = []

    def lengths(t):
        seen.append(len(t))
        return pa.array([len(x or "") for x in t.to_pylist()])

    got = pa.concat_arrays(list(slices.sliced(lengths, "int").func(iter([pa.array(texts)])))).to_pylist()
    assert got == [len(t or "") for t in texts] and len(seen) > 3 and max(seen) < 100
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    rows = {r.id: r.r for r in df.select("id", refine.refined(F.col("t"), F.lit(False)).alias("r")).collect()}
    assert all((rows[i].text, rows[i].offset_map) == refine.refine(t) for i, t in enumerate(texts))
    parts = df.select("id", chunk.splitter("recursive")(F.col("t")).alias("c")).collect()
    assert all([(c.start, c.end, c.text) for c in r.c] == [(a, b, texts[r.id][a:b]) for a, b in chunk.recursive_spans(texts[r.id] or "")] for r in parts)


@pytest.mark.parametrize("t", ["café x", "́a", "ạ̇b", "Å क़", "ȩ́́ ü", "plain", "ǘ⃒ y"])
def test_offsets_of_clusters(t):
    """Each character of the composed text comes from the start of its cluster."""
    out, at = refine._composed(t)
    begin = [i for i, c in enumerate(t) if i == 0 or not unicodedata.combining(c)]
    want = [(c, i) for i, j in zip(begin, [*begin[1:], len(t)]) for c in unicodedata.normalize("NFC", t[i:j])]
    assert list(zip(out, at.tolist())) == want and at.dtype == np.int32


def test_nfc_composes_across_starters(spark):
    """Hangul letters compose, though none of them is a combining mark (as in the SQL twin)."""
    assert spark.range(1).select(refine.nfc(F.lit("한")).alias("v")).first().v == "한"


def _unit(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + 20] = x[:20]  # copies
    return x


@pytest.mark.parametrize("few", [1000, 5])
def test_nearest_rows_in_groups(spark, monkeypatch, few):
    """Many groups and few queries give the rows of a brute force, and no row a pair of blocks is shuffled."""
    monkeypatch.setattr(vector, "FEW_QUERIES", few)
    monkeypatch.setattr(vector, "GROUP_ROWS", 40)
    x = _unit(150, 4, 7)
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    got = {(r.query_id, r.row_id): r.rank for r in vector.top_k(e.selectExpr("vec_id AS query_id", "embedding AS query_vector"), e, 6).collect()}
    want = {(i, j): n + 1 for i in range(150) for n, j in enumerate(sorted(range(150), key=lambda j: (-round(s[i, j], 9), j))[:6])}
    assert got == want
    above = {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= 0.35}
    assert {(r.i, r.j) for r in vector.pairs_above(e, 0.35).collect()} == above
    hashes = {(r.i, r.j): r.h for r in spark.createDataFrame(sorted(above), "i bigint, j bigint").withColumn("h", F.xxhash64("i", "j")).collect()}
    first = set()
    for i in range(150):
        near = sorted((p for p in above if i in p), key=lambda p: (-round(s[p], 6), hashes[p]))
        first |= set(near[:5])
    pairs = vector.first_pairs(e, 0.35, 5)
    assert {(r.i, r.j) for r in pairs.collect()} == first and len(first) < len(above) / 2


def test_phrases_are_counted_without_postings(spark, monkeypatch):
    """bm25_top with phrases of several words equals top(bm25), and doesn't take the way over postings."""
    monkeypatch.setattr(lexical, "_top_of_postings", lambda *a: 1 / 0)
    words = np.random.default_rng(3).choice("aa bb cc dd ee ff gg".split(), (60, 40))
    docs = spark.createDataFrame([*((i, " ".join(w[: 5 + i % 30])) for i, w in enumerate(words)), (60, ""), (61, "zz-aa")], "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame([(1, "aa bb"), (2, "aa-bb cc"), (3, "aa.aa"), (4, "nothing zz"), (5, "gg_ff-ee aa bb bb")], "query_id bigint, query string")
    order = lambda df: sorted((r.query_id, r.rank, r.row_id, round(r.score, 9)) for r in df.collect())
    assert order(lexical.bm25_top(docs, q, "doc_id", 7)) == order(lexical.top(lexical.bm25(docs, q, "doc_id"), 7))


def test_passages_meet_texts_without_a_shuffle_of_them(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one two three four"), (2, "xone two three fourx"), (3, None), (4, "two"), (5, "")], "doc_id bigint, text string")
    p = spark.createDataFrame([(1, "one two three four"), (2, "two"), (3, ""), (4, "e two t")], "item_id bigint, passage string")
    rows = lambda: {(r.item_id, r.doc_id) for r in evaluate.containing(d, p).collect()}
    got = rows()
    monkeypatch.setattr(evaluate, "MOST_PASSAGES", 0)
    assert got == rows() == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 4), (4, 1), (4, 2)}


def test_pairs_in_runs(spark):
    x = _unit(90, 4, 9)
    e = spark.createDataFrame([(f"g{i % 7}", i, r.tolist()) for i, r in enumerate(x)], "g string, id bigint, embedding array<float>")
    got = vector.pairs_in_runs(e.repartition(3, "g").sortWithinPartitions("g"), 0.6, "g")
    want = vector.pairs_above(e.withColumnRenamed("id", "vec_id"), 0.6, by=("g",))
    pairs = lambda df: sorted((r.i, r.j, r.sim) for r in df.collect())
    assert pairs(got) == pairs(want) and "Exchange" not in vector.pairs_in_runs(e, 0.6, "g")._jdf.queryExecution().executedPlan().toString()


def test_relations_are_made_within_the_row(spark):
    d = spark.createDataFrame([(1, "Alpha Beta met Gamma and my_var. Gamma left Gamma. none here"), (2, None)], "doc_id bigint, text string")
    r = extract.relations(extract.named(d, "doc_id"), "doc_id")
    assert sorted((x.sent, x.subject, x.object) for x in r.collect()) == [(0, "Alpha Beta", "Gamma"), (0, "Alpha Beta", "my_var"), (0, "Gamma", "my_var")]
    assert "Join" not in r._jdf.queryExecution().executedPlan().toString()
