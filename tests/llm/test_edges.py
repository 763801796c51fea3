"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: the defined result of each operator."""

import corpus_pipeline
from fathomer.llm import ann, exact_dedup, html_extract, langid, licenses, line_dedup, minhash, mixing, packing, toxicity


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup(awkward, nothing):
    got = sorted(rows(exact_dedup.duplicates(awkward)), key=str)
    assert sorted((a, b) for a, b, _ in got if a is not None) == [(2, 1), (5, 4), (9, 8), (10, 10)]
    assert [b for a, b, _ in got if a is None] == [1]
    kept = exact_dedup.drop_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 5
    assert rows(exact_dedup.duplicates(nothing)) == [] and exact_dedup.drop_duplicates(nothing).count() == 0


def test_exact_dedup_in_a_tree(spark, monkeypatch):
    """Groups beyond FANIN are compared in two levels with the same result."""
    monkeypatch.setattr(exact_dedup, "FANIN", 5)
    df = spark.createDataFrame([(i, f"text {i % 2}") for i in range(40)], "doc_id bigint, text string")
    assert sorted(rows(exact_dedup.duplicates(df))) == [(i, i % 2, 6) for i in range(2, 40)]
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(df).collect()) == [0, 1]


def test_minhash(awkward, nothing):
    got = sorted(r[:2] for r in rows(minhash.duplicates(awkward)))
    assert got == [(2, 1), (3, 1), (9, 8)]
    kept = minhash.drop_near_duplicates(awkward)
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert kept.columns == awkward.columns and ids == sorted([1, 4, 5, 6, 7, 8, 10, 11, 12, 13, None, None], key=str)
    assert rows(minhash.duplicates(nothing)) == [] and minhash.drop_near_duplicates(nothing).count() == 0


def test_line_dedup(awkward, nothing):
    got = {r[:4] for r in rows(line_dedup.removed_lines(awkward))}
    assert {(2, 0, 1, 0), (9, 0, 8, 0)} <= got and (3, 0) in {g[:2] for g in got}
    assert not {g[0] for g in got} & {None, 4, 5, 6, 7, 10, 11, 13}
    cleaned = {r.doc_id: r.text for r in line_dedup.without_lines(awkward.where("doc_id < 10"), line_dedup.removed_lines(awkward)).collect()}
    assert cleaned[2] == "" and cleaned[1].startswith("The quick") and cleaned[6] is None
    assert rows(line_dedup.removed_lines(nothing)) == []
    clash = awkward.where("doc_id < 10").selectExpr("*", "7 AS _fx_id", "array(1) AS _fx_lines", "'s' AS _shield0")
    cleaned = line_dedup.without_lines(clash, line_dedup.removed_lines(clash))
    assert cleaned.columns == clash.columns and {r._fx_id for r in cleaned.collect()} == {7} and {r.doc_id: r.text for r in cleaned.collect()}[2] == ""


def test_mixing(spark, awkward, nothing):
    topics = spark.createDataFrame([(1, 3), (1, 2), (2, None), (None, 4)], "vec_id bigint, label int")
    p = mixing.probabilities(awkward, topics)
    assert p.where("p < 0 or p > 1 or p is null").count() == 0
    assert {(r.source, r.lang, r.topic) for r in p.collect()} >= {("", "", -1), ("s1", "en", 2)}
    kept = mixing.mix(awkward, topics)
    assert kept.columns == awkward.columns and kept.count() <= awkward.count()
    twice = mixing.mix(awkward.union(awkward), topics)
    assert all(r["count"] % 2 == 0 for r in twice.groupBy("doc_id", "text").count().collect())  # null and repeated ids are drawn alike
    assert mixing.mix(nothing, topics).count() == 0 and mixing.mix(awkward, topics.limit(0)).columns == awkward.columns


def test_packing(awkward, nothing):
    got = packing.pack(awkward)
    assert got.count() == awkward.count() and got.where("bucket_length < n_tokens or slot < 0 or batch < 0").count() == 0
    assert got.groupBy("bucket_length", "batch", "slot").count().where("count > 1").count() == 0
    assert {r.n_tokens for r in got.where("doc_id in (4, 5, 6, 7)").collect()} == {0}
    assert packing.pack(nothing).collect() == []


def test_toxicity(spark, awkward, nothing, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.drop_toxic(awkward, labels.limit(0)).count() == awkward.count()  # nothing to learn from: nothing is rejected
    both = awkward.select("doc_id", "text").union(docs.selectExpr("doc_id + 1000", "text")).union(spark.createDataFrame([(None, "you idiot moron, pathetic worthless trash, stupid scum, loser clown disgusting")], "doc_id bigint, text string"))
    known = labels.selectExpr("doc_id + 1000 AS doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None), (999_999, 1)], "doc_id bigint, toxic int"))
    bad = [r.doc_id for r in toxicity.toxic_documents(both, known).collect()]
    assert None in bad and not {4, 5, 6, 7, 13} & set(bad)
    assert toxicity.drop_toxic(awkward, labels).columns == awkward.columns and toxicity.drop_toxic(nothing, labels).count() == 0


def test_licenses(awkward, nothing):
    assert [r[:4] for r in rows(licenses.scan(awkward))] == [(12, "MIT", 0, 5)]
    assert rows(licenses.scan(nothing)) == []


def test_langid(awkward, nothing):
    got = rows(langid.identify(awkward))
    assert len(got) == awkward.count()
    empty = [r for r in got if r[0] in (4, 5, 6, 7)]
    assert all(r[1] is None and r[2] == 0 and r[3] == 0 and not any(r[4].values()) for r in empty)
    assert all(sum(r[4].values()) == r[3] for r in got)
    assert rows(langid.identify(nothing)) == []


def test_html(spark):
    schema = "page_id bigint, url string, html string, text string, share int"
    pages = spark.createDataFrame([(1, "u", "<p>hello big world &amp; all", "t", 1), (1, "u", "<p>hello big world &amp; all", "t", 1), (None, None, None, None, None), (2, "u", "", "t", 1), (3, "u", "plain text only", "t", 1), (4, "u", "<script>never closed", "t", 1), (5, "u", "<p>" + "long words here " * 100_000, "t", 1)], schema)
    got = {(r.page_id, r.text[:40]) for r in html_extract.extract_pages(pages).collect()}
    assert got >= {(1, "hello big world & all"), (None, ""), (2, ""), (3, "plain text only"), (4, "")}
    assert html_extract.extract_pages(pages).count() == 7 and html_extract.extract_pages(pages.limit(0)).collect() == []


def test_ann(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (None, [1.0, 1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [])]
    v = spark.createDataFrame([(*r, 0, "x") for r in data], "vec_id bigint, embedding array<float>, label int, id string")
    got = sorted(tuple(r)[:3] for r in ann.neighbours(v, k=2).collect())
    assert got == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2), (4, 1, 1), (4, 2, 2)]
    assert ann.neighbours(v.limit(0)).collect() == []


def test_pipeline_stages(spark, awkward, nothing, sf):
    for docs in (awkward, nothing):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == docs.columns, name
            now = out
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == now.count()
