"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models; each later model also sees the
probabilities of the earlier categories. In training those inputs are out-of-fold predictions, so that a later
model meets them as uncertain as they will be on new documents.

Features are the presence in a document of hashed words, word beginnings (4, 5, 6 bytes) and word endings
(4, 5 bytes); beginnings and endings catch inflected and disguised forms. Of all hashed features, those that
differ most between toxic and clean labelled documents (G-test) are kept. The label table has one toxicity
column; the chain's earlier categories are weakly labelled: a document labelled toxic that holds one of the
category's terms. The last category, ``toxic``, uses the label itself and decides.

The models are fitted on at most ``LABELLED_ROWS`` labelled documents (least md5 of doc_id first);
everything else covers all documents and their whole texts.

Defined results: a null or empty text has no features, so only the intercept speaks, and with fewer than
``LEAST_LABELS`` labelled documents of either class nothing is rejected. A null label, or a label without a document, is ignored;
repeated labels of one document count once, as toxic if any says so. Rows with a null doc_id or a repeated
doc_id are scored like any other. Extra columns pass through the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, kernels

#: The bound on the rows that the classifiers are fitted on.
LABELLED_ROWS = 12_000
LEAST_LABELS = 5
HASH_BITS = 20
FEATURES = 4096
#: Least log-likelihood ratio (nats) of a kept feature.
LEAST_G = 8.0
FOLDS = 5
THRESHOLD = 0.5
CATEGORIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("insult", ("idiot", "moron", "loser", "clown", "scum", "fool", "imbecile")),
    ("demeaning", ("stupid", "pathetic", "worthless", "disgusting", "trash", "garbage", "useless")),
    ("toxic", ()),
)
NAMES = [c for c, _ in CATEGORIES]


def features(col: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hashed feature), by document, then by feature; with a table, (document, index) of the features that it selects.

    Repeats go piece by piece, so memory follows the distinct pairs and not six times the words.
    """
    data, off = kernels.buffers(col)
    keys = [np.zeros(0, np.uint64)]
    mask, bits = np.uint64((1 << HASH_BITS) - 1), np.uint64(HASH_BITS)
    for p in kernels.pieces(data, off):
        doc = (np.searchsorted(off, p.starts + p.base, "right") - 1).astype(np.uint64) << bits
        size, part = p.ends - p.starts, []
        for kind, h, ok in [(0, p.words, None), *((k, lambda k=k: p.prefixes(k), size > k) for k in (4, 5, 6)), *((10 + k, lambda k=k: p.suffixes(k), size > k) for k in (4, 5))]:
            f = kernels.mix64(h() + np.uint64(kind)) & mask
            if table is not None:
                f = table[f]
                ok = f >= 0 if ok is None else ok & (f >= 0)
            key = doc if ok is None else doc[ok]
            part.append(key | (f if ok is None else f[ok]).astype(np.uint64))
        keys.append(_distinct(np.concatenate(part)))
    key = _distinct(np.concatenate(keys))
    return (key >> bits).astype(np.int64), (key & mask).astype(np.uint32)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[kernels.runs(keys)[0]]


@dataclass
class Chain:
    """Selected features (table: hash -> index or -1) and the weights of each link: features, earlier probabilities, intercept."""

    table: np.ndarray
    weights: list[np.ndarray]

    def predict(self, doc: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
        """(n, categories) probabilities from distinct (document, selected feature) pairs."""
        out = np.zeros((n, len(self.weights)))
        k = int(self.table.max()) + 1 if len(self.table) else 0
        for c, w in enumerate(self.weights):
            z = np.bincount(doc, w[:k][idx], n) + out[:, :c] @ w[k : k + c] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        return self.predict(*features(col, self.table), len(col))


def _logistic(doc: np.ndarray, idx: np.ndarray, extra: np.ndarray, y: np.ndarray, k: int, l2: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights of an L2 logistic model over sparse presence features and dense extra columns.

    Accelerated gradient descent with a diagonal bound of the curvature, so that rare features learn as fast as common ones.
    """
    n, e = len(y), extra.shape[1]
    w = np.zeros(k + e + 1)
    v = w.copy()
    ridge = np.append(np.full(k + e, l2), 0.0)
    size = np.bincount(doc, minlength=n) + extra.sum(axis=1) + 1
    bound = np.concatenate([np.bincount(idx, size[doc], k), size @ extra, [size.sum()]])
    step = 1 / (0.25 * bound / n + ridge + 1e-9)
    t = 1.0
    for _ in range(rounds):
        z = np.bincount(doc, v[:k][idx], n) + extra @ v[k : k + e] + v[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([np.bincount(idx, r[doc], k), r @ extra, [r.sum()]]) + ridge * v
        new = v - step * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def train(rows: list[np.ndarray], toxic: np.ndarray) -> Chain | None:
    """rows: the distinct hashed features of each labelled document."""
    n, size = len(rows), 1 << HASH_BITS
    if min(toxic.sum(), n - toxic.sum()) < LEAST_LABELS:
        return None
    a, b = np.zeros(size), np.zeros(size)
    for r, y in zip(rows, toxic):
        (a if y else b)[r] += 1  # a row's features are distinct
    n1, n0 = toxic.sum(), n - toxic.sum()
    p = (a + b) / n

    def part(x: np.ndarray, m: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (m * p)), 0.0) + np.where(m - x > 0, (m - x) * np.log((m - x) / (m * (1 - p))), 0.0)

    g = np.nan_to_num(part(a, n1) + part(b, n0))
    g[a + b < 2] = 0
    best = np.lexsort((np.arange(size), -g))[:FEATURES]
    best = best[g[best] > LEAST_G]
    table = np.full(size, -1, np.int32)
    table[best] = np.arange(len(best))
    kept = [i[i >= 0] for i in (table[r] for r in rows)]
    doc, idx = np.repeat(np.arange(n), [len(i) for i in kept]), np.concatenate(kept)
    fold = np.arange(n) % FOLDS
    weights, before = [], np.zeros((n, 0))
    for _, terms in CATEGORIES:
        y = toxic.astype(float)
        if terms:
            marks = (kernels.mix64(kernels.word_hash(list(terms))) & np.uint64(size - 1)).astype(np.uint32)
            y = y * np.array([np.isin(marks, r).any() for r in rows])
        oof = np.zeros(n)
        for f in range(FOLDS):
            use = fold[doc] != f
            renum = np.cumsum(fold != f) - 1
            w = _logistic(renum[doc[use]], idx[use], before[fold != f], y[fold != f], len(best))
            z = np.bincount(doc, w[: len(best)][idx], n) + before @ w[len(best) : -1] + w[-1]
            oof[fold == f] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[fold == f]
        weights.append(_logistic(doc, idx, before, y, len(best)))
        before = np.column_stack([before, oof])
    return Chain(table, weights)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Chain | None:
    """Fit the chain on at most LABELLED_ROWS labelled documents."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(LABELLED_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in kernels.slices(batch, "text", kernels.SMALL_SLICE_BYTES):
                doc, f = features(b.column(1))
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                blobs = [f[cut[i] : cut[i + 1]].tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "f"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    got = texts.join(F.broadcast(y.selectExpr("doc_id", "cast(toxic as int) toxic")), "doc_id").select("doc_id", "text", "toxic")  # at most LABELLED_ROWS rows
    table = got.mapInArrow(run, "doc_id bigint, toxic int, f binary").toArrow()
    ids, blobs = np.asarray(table.column("doc_id"), np.int64), table.column("f").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], blobs[i]))
    order = [i for k, i in enumerate(order) if k == 0 or ids[i] != ids[order[k - 1]]]
    toxic = np.asarray(table.column("toxic"), np.int64)[order] > 0
    return train([np.frombuffer(blobs[i], np.uint32) for i in order], toxic)


def _scored(docs: DataFrame, chain: Chain | None, text: str, most: float | None) -> DataFrame:
    """docs with _fx_<category> probabilities; with ``most``, only the rows below it, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # of fixed size: 2**HASH_BITS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for b in kernels.slices(batch, text, kernels.SMALL_SLICE_BYTES):
                p = model.score(b.column(b.schema.get_field_index(text))) if model else np.zeros((b.num_rows, len(NAMES)))
                if most is not None:
                    yield b.filter(pa.array(p[:, -1] < most))
                else:
                    yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, i]) for i in range(len(NAMES)))], [*b.schema.names, *(f"_fx_{c}" for c in NAMES)])

    return docs.mapInArrow(run, frames.with_fields(docs.schema, *([] if most is not None else [(f"_fx_{c}", "double") for c in NAMES])))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the chain rejects: doc_id and the probability of each category."""
    chain = fit(docs, labels, doc_id, text)
    out = _scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), chain, "text", None).where(F.col(f"_fx_{NAMES[-1]}") >= threshold)
    return out.select("doc_id", *[F.round(f"_fx_{c}", 6).alias(f"p_{c}") for c in NAMES])


@frames.shielded
def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that the chain rejects; columns as they were."""
    return _scored(docs, fit(docs, labels, doc_id, text), text, threshold)
