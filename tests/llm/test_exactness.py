"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import functools
import hashlib
import itertools
import re
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from fathomer.llm import ann, exact_dedup, frames, html_extract, kernels, langid, licenses, line_dedup, minhash, mixing, packing, queries, toxicity

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abÉé .\nZ9ß-日本々。ไท“’–\u00a0«ªは！Ａ‥က\U00020000", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_do_not_depend_on_pieces(texts, most):
    col = pa.array(texts, pa.string())
    data, off = kernels.buffers(col)
    cut = [h for p in kernels.pieces(data, off, most) for h in p.words().tolist()]
    whole = kernels.words_of(col)
    assert cut == whole.hashes.tolist()
    for i, t in enumerate(texts):
        mine = whole.hashes[whole.bounds[i] : whole.bounds[i + 1]].tolist()
        assert mine == [int(kernel_hash(w)) for w in kernels.word_list(t)]


@functools.lru_cache(maxsize=None)
def kernel_hash(word: bytes) -> int:
    return kernels.word_hash([word.decode()])[0]


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2**40)), min_size=1, max_size=50))
def test_blobs_round_trip(rows):
    dtype = np.dtype([("a", "<i8"), ("b", "<u4", (2,)), ("c", "<f4")])
    rec = np.zeros(len(rows), dtype)
    rec["a"], rec["b"][:, 0], rec["c"] = [r[1] for r in rows], [r[0] for r in rows], 1.5
    part = np.array([r[0] for r in rows])
    batch = kernels.scatter(part, rec, 6)
    back = kernels.gather([batch], dtype)
    assert sorted(r.tobytes() for r in back) == sorted(r.tobytes() for r in rec) and batch.num_rows == len(set(part))


# exact dedup


def poly(data: bytes) -> tuple[int, int, int]:
    out = []
    for p, b in zip(exact_dedup.PRIMES, exact_dedup.BASES):
        h = 0
        for x in data:
            h = (h * b + x + 1) % p
        out.append(h)
    return out[0], out[1], len(data)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.integers(4000, 13000).map(lambda n: "añb" * (n // 4))), max_size=6))
def test_fingerprints_are_polynomial_and_compose(texts):
    got = exact_dedup.fingerprints(pa.array(texts, pa.string()))
    for t, f in zip(texts, got.tolist()):
        data = (t or "").encode()
        assert tuple(f) == poly(data)
        k = len(data) // 3
        assert exact_dedup.combine(poly(data[:k]), poly(data[k:])) == tuple(f)


def test_fingerprints_of_documents_in_parts(spark):
    whole = "".join(chr(97 + i % 26) for i in range(20_000))
    parts = spark.createDataFrame([(1, i, whole[i * 3001 : (i + 1) * 3001]) for i in range(7)], "doc bigint, part int, text string")
    assert [tuple(r) for r in exact_dedup.fingerprint_parts(parts, "doc", "part", "text").collect()] == [(1, *poly(whole.encode()))]


def test_equal_fingerprints_are_still_compared(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_W", exact_dedup._W * 0)  # every hash collides
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc")], "doc_id bigint, text string")
    assert sorted(tuple(r)[:2] for r in exact_dedup.duplicates(df).collect()) == [(3, 1), (4, 2)]


# line dedup


@pytest.mark.parametrize(("threshold", "block"), [(0.85, None), (0.6, None), (0.6, 150)])
def test_line_join_is_exact(spark, docs, threshold, block, monkeypatch):
    """Small blocks: many tokens' postings are compared in pairs of blocks, in several passes."""
    if block:
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        monkeypatch.setattr(line_dedup, "PASS_BYTES", 200_000)
    extra = spark.createDataFrame([(10_000 + i, "alpha beta gamma delta epsilon zeta eta theta iota kappa v%d w%d" % (i % 7, i // 7)) for i in range(60)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(extra)
    lines = sorted((r.doc_id, i, frozenset(kernels.word_list(t))) for r in both.collect() for i, t in enumerate(r.text.split("\n")))
    lines = [x for x in lines if x[2]]
    sets = {(a, b): s for a, b, s in lines}
    want, seen = set(), {}
    for a, b, s in lines:
        fits = (t for n in range(int(threshold * len(s)), int(len(s) / threshold) + 2) for t in seen.get(n, ()))
        if any(len(s & t) >= threshold * len(s | t) - 1e-9 for t in fits):
            want.add((a, b))
        seen.setdefault(len(s), set()).add(s)
    got = line_dedup.removed_lines(both, threshold).collect()
    assert {(r.doc_id, r.line_no) for r in got} == want
    for r in got:
        s, t = sets[r.doc_id, r.line_no], sets[r.match_doc_id, r.match_line_no]
        assert (r.match_doc_id, r.match_line_no) < (r.doc_id, r.line_no)
        assert abs(len(s & t) / len(s | t) - r.jaccard) < 1e-5 and r.jaccard >= threshold - 1e-6


@pytest.mark.parametrize("block", [None, 16])
def test_every_link_of_similar_lines(spark, docs, block, monkeypatch, tmp_path):
    """Members of classes, and every pair of representatives, also of lines that are removed anyway."""
    if block:
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        monkeypatch.setattr(line_dedup, "PASS_BYTES", 200_000)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    extra = [(10_000 + i, f"{words} v{i % 40}\n{'mu ' * (i % 3)}{words} v{i % 40} w") for i in range(60)] + [(1_000_000, f"{words} v1 x\nseen once"), (1_000_000, f"{words} v2 y")]
    spark.createDataFrame(extra, "doc_id bigint, text string").union(docs.select("doc_id", "text")).write.parquet(f"{tmp_path}/documents.parquet")
    lines = sorted({(r.doc_id, i, frozenset(kernels.word_list(t))) for r in frames.read(spark, str(tmp_path), "documents").collect() for i, t in enumerate(r.text.split("\n"))}, key=lambda x: x[:2])
    first, want = {}, {}
    for a, b, s in lines:
        if s and first.setdefault(s, (a, b)) != (a, b):
            want[(a, b, *first[s])] = 1.0
    for s, t in itertools.combinations(first, 2):
        if min(len(s), len(t)) >= 0.85 * max(len(s), len(t)) and len(s & t) >= 0.85 * len(s | t) - 1e-9 and first[s] != first[t]:
            want[(*max(first[s], first[t]), *min(first[s], first[t]))] = round(len(s & t) / len(s | t), 6)
    got = [tuple(r) for r in line_dedup.similar_lines(frames.read(spark, str(tmp_path), "documents")).collect()]
    assert len(got) == len(want) and {r[:4] for r in got} == set(want)
    assert all(abs(r[4] - want[r[:4]]) < 2e-6 for r in got)
    assert len(want) > len({r[:2] for r in got}) + 1000  # many more links than removed lines


@pytest.mark.parametrize("block", [None, 16])
def test_links_are_counted_by_line(spark, docs, block, monkeypatch, tmp_path):
    """The whole output of the query, one row per line, against all pairs. Small blocks: groups are compared by prefix token and in pairs of blocks."""
    if block:
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        monkeypatch.setattr(line_dedup, "PASS_BYTES", 200_000)
        monkeypatch.setattr(line_dedup, "_FOLD", 1000)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    extra = [(10_000 + i, f"{words} v{i % 40}\n{'mu ' * (i % 3)}{words} v{i % 40} w") for i in range(60)]
    extra += [(20_000 + i, " ".join(f"c{j}" for j in range(i, i + 20))) for i in range(50)]  # a chain: each is similar to its neighbours only
    extra += [(1_000_000, f"{words} v1 x\nseen once"), (1_000_000, f"{words} v2 x"), (1_000_000, f"{words} v1 x\nseen once")]
    extra += [(1_000_001, "p q r s t u v w"), (1_000_001, "p q r s t u v w x"), (1_000_002, "only here\n\nonly here here"), (None, words), (1_000_003, None)]
    spark.createDataFrame(extra, "doc_id bigint, text string").union(docs.select("doc_id", "text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_id, r.text) for r in frames.read(spark, str(tmp_path), "documents").collect() if r.doc_id is not None and r.text is not None}
    lines = {}
    for d, text in rows:
        for i, t in enumerate(text.split("\n")):
            if s := frozenset(kernels.word_list(t)):
                lines.setdefault(s, set()).add((d, i))
    first, near = {s: min(at) for s, at in lines.items()}, {s: {} for s in lines}
    for s, t in itertools.combinations(lines, 2):
        if min(len(s), len(t)) >= 0.85 * max(len(s), len(t)) and len(s & t) >= 0.85 * len(s | t) - 1e-9 and len(lines[s] | lines[t]) > 1:
            near[s][t] = near[t][s] = round(len(s & t) / len(s | t), 6)
    want = []
    for s, at in lines.items():
        group, queue = {s}, [s]
        while queue:
            for t in near[queue.pop()]:
                if t not in group:
                    group.add(t)
                    queue.append(t)
        head = min(first[t] for t in group)
        early = min(((*first[t], j) for t, j in near[s].items() if first[t] < first[s]), default=(None, None, None))
        for line in at if near[s] or len(at) > 1 else ():
            want.append((*line, *first[s], len(at) - 1, *head, len(near[s]), *(early if line == first[s] else (*first[s], 1.0))))
    got = [tuple(r) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert [r[:-1] for r in sorted(got, key=order)] == [r[:-1] for r in sorted(want, key=order)]
    assert all(a[-1] == b[-1] or abs(a[-1] - b[-1]) < 2e-6 for a, b in zip(sorted(got, key=order), sorted(want, key=order)))
    assert sum(r[7] for r in got if r[:2] == r[2:4]) > 2 * len(got)  # the rows follow the lines, not the links


def test_lines_are_cut_out(spark):
    df = spark.createDataFrame([(1, "a b c d\nkeep one two\n\nx y z w"), (2, "x y z w\nnew line here\na b c d")], "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in line_dedup.without_lines(df, line_dedup.removed_lines(df)).collect()}
    assert out == {1: "a b c d\nkeep one two\n\nx y z w", 2: "new line here"}


def test_lines_of_a_hot_word(spark, monkeypatch):
    """Lines that all share their rarest words, and differ enough to stay open until the join."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, "hot " + " ".join(f"w{k}" for k in rng.choice(7, 5, replace=False))) for i in range(150)]
    seen, want = [], set()
    for i, t in rows:
        s = set(t.split())
        if any(len(s & o) >= 0.7 * len(s | o) - 1e-9 for o in seen):
            want.add(i)
        seen.append(s)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in line_dedup.removed_lines(df, 0.7).collect()} == want


# minhash


def groups_of(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def minhash_roots(rows: list[tuple[int, str]]) -> dict[int, int]:
    """The least id of each document's group, from all pairs of documents."""
    h, bounds = minhash.shingles(kernels.words_of(pa.array([r[1] for r in rows], pa.string())))
    m = minhash.minima(h, bounds)
    keys, sig, has = minhash.band_keys(m), minhash.pack(m), np.diff(bounds) > 0
    most = minhash.most_mismatches(minhash.THRESHOLD)
    pairs = []
    for i in range(len(rows)):
        near = (keys[i + 1 :] == keys[i]).any(axis=1) & (minhash.mismatches(sig[i + 1 :], sig[i]) <= most) & has[i + 1 :] & has[i]
        pairs += [(rows[i][0], rows[i + 1 + j][0]) for j in np.flatnonzero(near)]
    return groups_of(pairs, [r[0] for r in rows])


def test_minhash_groups(spark, docs):
    """The groups are the components of all documents that share a band and match; most true near copies are found."""
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows += [(9000 + i, r[1] + " ending %d" % i) for i, r in enumerate(rows) if len(r[1]) > 400]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    h, bounds = minhash.shingles(kernels.words_of(pa.array([r[1] for r in rows])))
    ids, has = [r[0] for r in rows], np.diff(bounds) > 0
    root = minhash_roots(rows)
    got = {r.doc_id: r.duplicate_of for r in minhash.duplicates(df).collect()}
    assert got == {i: r for i, r in root.items() if i != r}
    true, sets = 0, [set(h[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    for i in range(len(rows)):
        a = sets[i]
        for j in range(i + 1, len(rows)):
            if has[i] and has[j] and abs(bounds[i + 1] - bounds[i] - bounds[j + 1] + bounds[j]) < 50:
                b = sets[j]
                if len(a & b) >= 0.7 * len(a | b):
                    true += 1
                    assert root[ids[i]] == root[ids[j]]
    assert true > 20


def test_similarity_is_corrected():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (400, 128), dtype=np.uint64).astype(np.uint32)
    b = rng.integers(0, 1 << 32, (400, 128), dtype=np.uint64).astype(np.uint32)
    b[:, :96] = a[:, :96]
    est = minhash.similarity(minhash.mismatches(minhash.pack(a), minhash.pack(b)))
    assert abs(est.mean() - 0.75) < 0.01


# mixing and packing


def test_raking_meets_targets_and_budget(spark, docs, sf, monkeypatch):
    topics = spark.read.parquet(f"{sf}/embeddings.parquet")
    monkeypatch.setattr(mixing, "SETTLED", 1e-4)  # a sweep of the Spark version takes seconds; either stops after the same one
    a = {(r.source, r.lang, r.topic): r.p for r in mixing.probabilities(docs, topics).collect()}
    b = {(r.source, r.lang, r.topic): r.p for r in mixing.probabilities(docs, topics, driver_cells=0).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 2e-9
    rng = np.random.default_rng(2)
    monkeypatch.undo()
    codes = [rng.integers(0, k, 200) for k in (5, 4, 3)]
    w = rng.random(200) * 1000
    t = [rng.dirichlet(np.ones(k)) for k in (5, 4, 3)]
    x = mixing.rake(codes, w, t)
    assert all(np.abs(np.bincount(c, x, len(g)) - g).max() < 1e-11 for c, g in zip(codes, t))


def test_contradictory_targets_are_told():
    codes = [np.array([0, 1]), np.array([0, 1])]
    with pytest.warns(UserWarning, match="largest miss of a target is 0.4"):
        mixing.rake(codes, np.ones(2), [np.array([0.9, 0.1]), np.array([0.5, 0.5])], 20)


def test_drawn_margins_meet_targets(spark, monkeypatch):
    """Targets far from the actual shares on all three margins; what is drawn meets them up to the noise of the draw."""
    monkeypatch.setattr(mixing, "TARGETS", {"source": {"hot": 0.3, "rare": 0.2}, "lang": {"en": 0.4, "de": 0.35}, "topic": {"-1": 0.3, "0": 0.5}})
    rng = np.random.default_rng(8)
    n = 12_000
    rows = [(i, "w " * int(k), ("en", "de", "fr")[la], ("hot", "mid", "rare")[so]) for i, k, la, so in zip(range(n), rng.integers(1, 20, n), rng.choice(3, n, p=[0.6, 0.25, 0.15]), rng.choice(3, n, p=[0.5, 0.4, 0.1]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    topics = spark.createDataFrame([(i, int(i % 3)) for i in range(0, n, 2)], "vec_id bigint, label int")
    got = mixing.sample(docs, topics).toPandas()
    p = {(r.source, r.lang, r.topic): r.p for r in mixing.probabilities(docs, topics).collect()}
    kept: dict = {}
    for i, t, la, so in rows:
        cell = (so, la, i // 2 * 2 % 3 if i % 2 == 0 else -1)
        kept[cell] = kept.get(cell, 0.0) + len(t.split()) * p[cell]
    for at, m in enumerate(mixing.MARGINS):
        drawn = got.groupby(got[m].astype(str))["n_tokens"].sum() / got["n_tokens"].sum()
        for v, t in mixing.TARGETS[m].items():
            expected = sum(x for c, x in kept.items() if str(c[at]) == v) / sum(kept.values())
            assert abs(expected - t) < 1e-6 and abs(drawn[v] - t) < 0.04, (m, v)


def test_kept_margins_meet_targets(spark):
    """Few documents in other languages: the English share is met though far fewer tokens than ``fraction`` are left."""
    docs = spark.createDataFrame([(i, "a word " * (1 + i % 5), "en" if i % 10 else "de", f"s{i % 3}") for i in range(300)], "doc_id bigint, text string, lang string, source string")
    topics = spark.createDataFrame([(i, i % 2) for i in range(200)], "vec_id bigint, label int")
    weight = {}
    for r in docs.collect():
        cell = (r.source, r.lang, r.doc_id % 2 if r.doc_id < 200 else -1)
        weight[cell] = weight.get(cell, 0) + len(r.text.split())
    p = {(r.source, r.lang, r.topic): r.p for r in mixing.probabilities(docs, topics).collect()}
    kept = sum(weight[k] * p[k] for k in weight)
    for m, name in enumerate(mixing.MARGINS):
        values = sorted({k[m] for k in weight})
        actual, got = (np.array([sum(v * (p[k] if drawn else 1) for k, v in weight.items() if k[m] == x) for x in values]) for drawn in (False, True))
        assert np.abs(got / kept - mixing._targets(name, np.array(values), actual)).max() < 1e-9, name
    assert max(p.values()) > 0.999 and kept / sum(weight.values()) < mixing.FRACTION


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(hist, k):
    length = np.array(sorted(hist))
    count = np.array([hist[x] for x in length])

    def cost(ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(length, count))

    best = min(cost((*inner, length[-1])) for r in range(min(k, len(length))) for inner in itertools.combinations(length[:-1].tolist(), r))
    got = packing.boundaries(length, count, k)
    assert len(got) <= k and got[-1] == length[-1] and cost(got) == best


# html


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=9), st.lists(st.sampled_from(["p", "a", "li", "x"]), min_size=8, max_size=8))
def test_region_is_the_best_one(words, tags):
    w = html_extract.Weights(1.0, {"p": -0.5, "a": -3.0, "li": -2.0}, -7.0)
    tags = tags[: len(words) - 1]

    def total(i, j):
        return sum(words[i:j]) * w.word + sum(w.tags.get(t, w.other) for t in tags[i : j - 1])

    spans = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
    best = max([0.0, *(total(i, j) for i, j in spans)])
    i, j = html_extract.best_region(words, tags, w)
    assert (i, j) == (min((s for s in spans if total(*s) == best), key=lambda s: (s[1], -s[0])) if best else (0, 0))  # sums of halves are exact


def test_extraction_on_held_out_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    w = html_extract.learn(pages[:120])
    hit = got = want = 0
    for p in pages[120:]:
        words, tags, inside, _ = html_extract._labelled(p)
        i, j = html_extract.best_region(words, tags, w)
        hit += sum(n for n, y in zip(words[i:j], inside[i:j]) if y)
        got += sum(words[i:j])
        want += sum(n for n, y in zip(words, inside) if y)
    assert hit / got > 0.98 and hit / want > 0.98


# toxicity


def test_toxicity_on_held_out_documents(spark):
    d, la = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.text, r.toxic) for r in d.join(la, "doc_id").orderBy("doc_id").collect()]
    feats = []
    for t, _ in rows:
        feats.append(kernels.unique_pairs(*toxicity.features(pa.array([t])))[1])
    y = np.array([r[1] for r in rows])
    half = len(rows) * 2 // 3
    chain = toxicity.train(feats[:half], y[:half])
    p = chain.score(pa.array([r[0] for r in rows[half:]]))[:, -1] >= toxicity.THRESHOLD
    truth = y[half:] > 0
    assert (p & truth).sum() / p.sum() > 0.97 and (p & truth).sum() / truth.sum() > 0.8  # about a tenth of the labels are noise
    assert len(chain.weights) == len(toxicity.CATEGORIES) and len(chain.weights[2]) == len(chain.weights[0]) + 2


@functools.lru_cache(maxsize=None)
def feature(part: bytes, kind: int) -> int:
    """The feature of a word or of one of its ends, byte by byte."""
    h = sum((x + 1) * pow(kernels._BASE, i, 1 << 64) for i, x in enumerate(part)) % (1 << 64)
    inner = int(kernels.mix64(np.array([h], np.uint64))[0])
    return int(kernels.mix64(np.array([(inner + kind) % (1 << 64)], np.uint64))[0]) & ((1 << toxicity.HASH_BITS) - 1)


def test_toxicity_features_in_little_memory():
    """Distinct features of long documents and of documents that span pieces, in memory that doesn't follow the words."""
    rng = np.random.default_rng(5)
    words = [f"{'abcdefgh'[i % 8] * (i % 7)}{i}" for i in range(3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, hi, n)) for n, hi in ((300_000, 3000), (7, 50), (60_000, 900), (0, 1))] + [None]
    size = sum(len(t or "") for t in texts)
    col = pa.array(texts)
    toxicity.features(col.slice(1, 1))  # makes the tables of powers
    tracemalloc.start()
    doc, f = toxicity.features(col)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = []
    for i, t in enumerate(texts):
        found = set()
        for w in set(kernels.word_list(t)):
            found |= {feature(w, 0)} | {feature(w[:k], k) for k in (4, 5, 6) if len(w) > k} | {feature(w[-k:], 10 + k) for k in (4, 5) if len(w) > k}
        want += [(i, x) for x in sorted(found)]
    assert list(zip(doc.tolist(), f.tolist())) == want
    assert size > 8 * kernels.PIECE_BYTES and peak < 10 * size, f"{peak} bytes for {size} bytes of text"


def chain_scores(text: str | None, chain: toxicity.Chain) -> list[float]:
    """The chain's probabilities of one text, link by link over its words."""
    found = set()
    for w in kernels.word_list(text):
        found.add(feature(w, 0))
        found |= {feature(w[:k], k) for k in (4, 5, 6) if len(w) > k} | {feature(w[-k:], 10 + k) for k in (4, 5) if len(w) > k}
    on = sorted({int(chain.table[f]) for f in found} - {-1})
    k, out = int(chain.table.max()) + 1, []
    for w in chain.weights:
        z = sum(float(w[i]) for i in on) + sum(float(w[k + c]) * p for c, p in enumerate(out)) + float(w[-1])
        out.append(1 / (1 + np.exp(-z)))
    return out


def test_toxicity_query_against_brute_force(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.fit(docs, labels)
    want = {}
    for r in docs.collect():
        p = chain_scores(r.text, chain)
        if p[-1] >= toxicity.THRESHOLD:
            want[r.doc_id] = p
    got = {r.doc_id: [r[f"p_{c}"] for c in toxicity.NAMES] for r in queries.op6_toxicity(spark, sf).collect()}
    assert got.keys() == want.keys() and len(want) > 3
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


def test_later_links_meet_out_of_fold_probabilities(monkeypatch):
    """Each fold's inputs to later links come from a model that hasn't seen it."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.uint32) for _ in range(80)]
    toxic = np.array([int((r < 8).sum() > 1) for r in rows])
    seen, fit = [], toxicity._logistic

    def spy(doc, idx, extra, y, k, *a):
        w = fit(doc, idx, extra, y, k, *a)
        seen.append((len(y), extra.copy(), w))
        return w

    monkeypatch.setattr(toxicity, "_logistic", spy)
    monkeypatch.setattr(toxicity, "LEAST_G", 0.5)
    chain = toxicity.train(rows, toxic)
    folds, fold = toxicity.FOLDS, np.arange(80) % toxicity.FOLDS
    whole = [seen[c * (folds + 1) + folds] for c in range(len(toxicity.NAMES))]
    for c in range(1, len(whole)):
        for f in range(folds):
            w = seen[(c - 1) * (folds + 1) + f][2]
            for i in np.flatnonzero(fold == f):
                on = [j for j in chain.table[rows[i]] if j >= 0]
                k = len(w) - 1 - (c - 1)
                z = w[on].sum() + whole[c][1][i, : c - 1] @ w[k:-1] + w[-1]
                assert abs(whole[c][1][i, c - 1] - 1 / (1 + np.exp(-z))) < 1e-9


# licences


def brute_scan(words: list[bytes], index: licenses.Index) -> list[tuple[str, int, int, float]]:
    """Every template at every alignment, without an index; of overlapping finds of a licence the best covered."""
    h = [int(kernel_hash(w)) for w in words]
    at = {int(x): i for i, x in enumerate(index.vocab)}
    got = []
    for t, (name, _, _) in enumerate(licenses.TEMPLATES):
        mine = index.words[t].tolist()
        hits = [(i - j, at[x]) for i, x in enumerate(h) if x in at and index.rare[at[x]] for j, y in enumerate(mine) if y == at[x]]
        anchors, places = set(index.anchors[t].tolist()), {}
        for x, v in hits:
            places.setdefault(x, set()).add(v)
        for d in sorted(places):
            run = [(x, v) for x in range(d, d + licenses.SLACK + 1) for v in places.get(x, ())]
            if sum(index.idf[v] for v in {v for _, v in run} & anchors) / sum(index.idf[v] for v in anchors) < licenses.LEAST_SHARE:
                continue
            last = max(x for x, _ in run)
            stretch = h[max(0, d - licenses.SLACK) : min(len(h), last + len(mine) + licenses.SLACK)]
            if all(any(stretch[i : i + len(p)] == p.tolist() for i in range(len(stretch))) for p in index.phrases[t]):
                cover = round(sum(int(index.vocab[v]) in stretch for v in set(mine)) / len(set(mine)), 6)
                got.append((-cover, max(0, d), t, min(len(h), last + len(mine)), name))
    out = []
    for cover, s, t, e, name in sorted(got):
        if not any(n == name and s < b and a < e for n, a, b, _ in out):
            out.append((name, s, e, -cover))
    return out


def test_license_scan(spark, docs):
    """Licences, positions, coverage and overlaps; among the texts, templates in a row, in pieces and with words in between."""
    texts = [t for _, t, _ in licenses.TEMPLATES]
    planted = [f"some code before {t} and some after" for t in texts] + [" ".join(texts), " ".join(texts[:6] * 2), " so ".join("".join(texts[:8]).split(" "))]
    planted += [" ".join(w if i % 9 else f"{w} really" for i, w in enumerate(t.split(" "))) for t in texts]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(planted, 90_000)), "doc_id bigint, text string"))
    index = licenses.build(*licenses.frequencies(both))
    got = {}
    for r in licenses.scan(both).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start_word, r.end_word, r.coverage))
    want = {r.doc_id: f for r in both.collect() if (f := brute_scan(kernels.word_list(r.text), index))}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(name in {f[0] for f in got[90_000 + i]} for i, (name, _, _) in enumerate(licenses.TEMPLATES))


def test_license_wordings(spark, docs):
    """Notices that aren't copies of a template, and sentences that are no notice."""
    found = [
        ("MIT", "// SPDX-License-Identifier: MIT"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0-or-later", "/* SPDX-License-Identifier: GPL-3.0-or-later */"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
        ("Apache-2.0", "distributed under Apache License 2.0, see the file"), ("GPL-3.0", "this program is GNU GPL v3 software"), ("GPL-3.0", "covered by the GNU GPLv3"), ("MIT", "see LICENSE (MIT License) for details"),
        ("All-rights-reserved", "Copyright 2020 Somebody. All rights reserved."),
    ]
    none = ["all seats were reserved by right", "a license from the mit campus", "the apache version of 2 0", "spdx identifier of a license"]
    planted = [(90_000 + i, t) for i, t in enumerate([t for _, t in found] + none)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id bigint, text string"))
    got = {}
    for r in licenses.scan(both).where("doc_id >= 90000").collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {90_000 + i: {name} for i, (name, _) in enumerate(found)}


# language identification


def test_gradients_by_differences(monkeypatch):
    monkeypatch.setattr(langid, "HIDDEN", 3)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 257, (5, 4))
    wx, wh, probe = rng.standard_normal((257, 9)), rng.standard_normal((3, 9)), rng.standard_normal((5, 4, 3))
    loss = lambda: float((langid._forward(x, wx, wh)[0].astype(float) * probe).sum())
    gx, gh = np.zeros_like(wx), np.zeros_like(wh)
    langid._backward(x, probe.astype(np.float32), langid._forward(x, wx, wh)[1], wh, gx, gh)
    for w, g, cells in ((wh, gh, [(0, 0), (1, 4), (2, 8)]), (wx, gx, [(x[0, 0], 1), (x[4, 3], 7)])):
        for c in cells:
            w[c] += 1e-2
            up = loss()
            w[c] -= 2e-2
            down = loss()
            w[c] += 1e-2
            assert abs((up - down) / 2e-2 - g[c]) < 2e-2 * max(1, abs(g[c]))


def test_language_on_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(2400).collect()
    cut = [(w, r.lang) for r in rows[:1200] for w in langid._cuttings(r.text.encode(), r.doc_id)]
    model = langid.train([w for w, _ in cut], [la for _, la in cut])
    p, c = langid.score(model, pa.array([r.text for r in rows[1200:]]))
    good = [model.langs[i] == r.lang for i, r in zip(p.argmax(axis=1), rows[1200:])]
    assert np.mean(good) > 0.97
    text = rows[5].text * 3
    labels = langid.label_bytes(model, text)
    one_p, one_c = langid.score(model, pa.array([text]))
    assert len(labels) == len(text.encode()) and [labels.count(k) for k in model.langs] == one_c[0].tolist()


def reading(model: langid.Model, data: bytes, a: int, b: int) -> np.ndarray:
    """Probabilities at bytes a:b from states that run over them and CONTEXT bytes on either side."""
    lo, hi = max(0, a - langid.CONTEXT), min(len(data), b + langid.CONTEXT)
    x = np.frombuffer(data[lo:hi], np.uint8).astype(np.int64)[:, None]
    f, _ = langid._forward(x, model.wx[0], model.wh[0])
    r, _ = langid._forward(x[::-1], model.wx[1], model.wh[1])
    z = (np.concatenate([f[:, 0], r[::-1][:, 0], np.ones((len(x), 1))], axis=1) @ model.out)[a - lo : b - lo]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def test_language_query_against_plain_states(spark, docs, sf):
    """op10's rows are those of plain states over each stretch with its context; states over whole texts label nearly every byte alike."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in queries.op10_language_id(spark, sf).collect()}
    same = total = 0
    rows = docs.collect()
    assert got.keys() == {r.doc_id for r in rows}
    for doc in rows:
        data = (doc.text or "").encode()
        if not 0 < len(data) < 1500:
            continue
        p = np.concatenate([reading(model, data, a, min(len(data), a + langid.WINDOW)) for a in range(0, len(data), langid.WINDOW)])
        mine, mean = got[doc.doc_id], p.mean(axis=0)
        assert abs(mine.p - mean.max()) < 2e-4 and mean[model.langs.index(mine.lang_pred)] > mean.max() - 2e-4 and mine.n_bytes == len(data)
        count = np.bincount(p.argmax(axis=1), minlength=len(model.langs))
        assert sum(abs(mine.label_counts[la] - count[i]) for i, la in enumerate(model.langs)) <= 2  # float noise at even odds
        whole = reading(model, data, 0, len(data))
        same += int((whole.argmax(axis=1) == p.argmax(axis=1)).sum())
        total += len(data)
    assert same > 0.97 * total, same / total


# nearest neighbours


def test_recall_and_exact_cosines(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_PARTITION", 300)
    monkeypatch.setattr(ann, "TASK_QUERIES", 400)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = e.toPandas().sort_values("vec_id", ignore_index=True)
    x, ids = ann.normalised(np.stack(pdf["embedding"].to_list())), pdf["vec_id"].to_numpy()
    idx, sims = ann.exact_top(x, x, ann.K, ids, ids)
    got = ann.neighbours(e).toPandas()
    assert (got.groupby("vec_id").size() == ann.K).all() and len(got) == ann.K * len(ids)
    pairs = set(zip(got["vec_id"], got["neighbour_id"]))
    true = {(ids[i], ids[j]) for i in range(len(ids)) for j in idx[i]}
    assert len(pairs & true) / len(true) >= 0.9
    at = {v: i for i, v in enumerate(ids)}
    some = got.sample(200, random_state=0)
    assert all(abs(float(x[at[r.vec_id]] @ x[at[r.neighbour_id]]) - r.cosine) < 1e-4 for r in some.itertuples())


def test_partitions_are_balanced():
    rng = np.random.default_rng(0)
    x = ann.normalised(rng.standard_normal((640, 8)))
    near, _ = ann.exact_top(x, x, 5, np.arange(640))
    label = ann.balanced_partitions(x, near, 8)
    cut = (label[near] != label[:, None]).mean()
    assert np.bincount(label).tolist() == [80] * 8 and cut < (rng.permutation(label)[near] != label[:, None]).mean() - 0.2


# the pipeline


def test_pipeline_against_brute_force(spark, sf, docs, duck, same_rows):
    labels, topics = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "embeddings"))
    chain = toxicity.fit(docs, labels)
    rows = [r for r in sorted(docs.collect()) if chain_scores(r.text, chain)[-1] < toxicity.THRESHOLD]
    first = {r.text: r.doc_id for r in reversed(rows)}
    rows = [r for r in rows if r.text is None or first[r.text] == r.doc_id]
    root = minhash_roots([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if root[r.doc_id] == r.doc_id]
    assert 3 < len(rows) < docs.count() - 3

    label: dict = {}
    for r in topics.collect():
        label[r.vec_id] = min(r.label, label.get(r.vec_id, r.label))
    cell = {r.doc_id: (r.source or "", r.lang or "", label.get(r.doc_id, -1)) for r in rows}
    n = {r.doc_id: len([w for w in re.split(r"[ \t\r\n]+", r.text or "") if w]) for r in rows}
    cells = sorted({c for c in cell.values()})
    weight = np.array([float(sum(n[i] for i, c in cell.items() if c == x)) for x in cells])
    share = weight / weight.sum()
    for _ in range(mixing.MOST_SWEEPS):
        was = share
        for m, name in enumerate(mixing.MARGINS):
            actual, goal = {}, {}
            for c, w in zip(cells, weight):
                actual[c[m]] = actual.get(c[m], 0.0) + w / weight.sum()
            named, power = mixing.TARGETS[name], mixing.POWER[name]
            rest = sum(a**power for v, a in actual.items() if str(v) not in named)
            for v, a in actual.items():
                goal[v] = named[str(v)] if str(v) in named else (1 - sum(named.values())) * a**power / rest
            now: dict = {}
            for c, x in zip(cells, share):
                now[c[m]] = now.get(c[m], 0.0) + x
            share = np.array([x * goal[c[m]] / sum(goal.values()) / now[c[m]] for c, x in zip(cells, share)])
        if np.abs(share - was).max() <= mixing.SETTLED:
            break
    ratio = share * weight.sum() / weight
    p = dict(zip(cells, np.round(np.minimum(1, min(mixing.FRACTION, 1 / ratio.max()) * ratio), 9)))
    rows = [r for r in rows if int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) / 2**52 < p[cell[r.doc_id]]]
    kept = pd.DataFrame([r.asDict() for r in rows])  # noqa: F841 - the SQL reads it
    want = duckdb.sql("WITH documents AS (SELECT * FROM kept) SELECT * FROM (" + packing.SQL + ")").fetchdf()
    assert same_rows(corpus_pipeline.run(spark, sf).toPandas(), want)


# queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, duck, sf, same_rows, name):
    assert same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).fetchdf())
