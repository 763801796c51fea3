"""Language identification by a bidirectional gated recurrent network over bytes.

A GRU reads the UTF-8 bytes of a text left to right, another right to left; at every position a softmax over both
states labels the byte, and a document's probabilities are the mean over all its positions. The network is trained in
numpy by backpropagation through time on ``WINDOWS_PER_ROW`` windows, drawn over the whole texts, of each of at most ``LABELLED_ROWS``
documents with a language (least md5 of doc_id first; both bound the fit only). Scoring reads whole texts: they are cut into windows of
``WINDOW`` bytes, each read with ``CONTEXT`` more bytes on either side so that states are warm at the seams, and windows of all
texts of a batch advance together, one byte a step.

Defined results: a null or empty text has no positions: lang_pred null, p 0 and all counts 0; every row is
returned, so repeated rows and null doc_ids give a row each; languages are those of the labelled rows, in alphabetical
order (ties go to the first); with fewer than one labelled row every lang_pred is null. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, kernels

#: The bound on the rows that the network is fitted on.
LABELLED_ROWS = 2000
#: Training windows that are drawn from each of them.
WINDOWS_PER_ROW = 32
HIDDEN = 8
WINDOW, CONTEXT = 256, 16
LANES = 2048
TRAIN_STEPS, TRAIN_BATCH, TRAIN_ROUNDS = 40, 256, 220
NONE = 256  # the byte beyond a text's ends


@dataclass
class Model:
    langs: list[str]
    wx: list[np.ndarray]  # per direction: (257, 3H) input weights with biases
    wh: list[np.ndarray]  # (H, 3H)
    out: np.ndarray  # (2H + 1, languages)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _forward(x: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, B, H) of a GRU over bytes x (T, B), with what the backward pass needs."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states, kept = np.empty((*x.shape, HIDDEN), np.float32), []
    for t in range(len(x)):
        g = wx[x[t]]
        u = h @ wh
        z = _sigmoid(g[:, :HIDDEN] + u[:, :HIDDEN])
        r = _sigmoid(g[:, HIDDEN : 2 * HIDDEN] + u[:, HIDDEN : 2 * HIDDEN])
        n = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        kept.append((h, z, r, n, u[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(x: np.ndarray, dstates: np.ndarray, kept: list, wh: np.ndarray, gx: np.ndarray, gh: np.ndarray) -> None:
    """Backpropagation through time: adds to the gradients of the input and the recurrent weights."""
    dh = np.zeros(dstates.shape[1:], np.float32)
    du = np.empty((dstates.shape[1], 3 * HIDDEN), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, un = kept[t]
        dh = dh + dstates[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dg = np.concatenate([dz, dr, dn], axis=1)
        du[:, :HIDDEN], du[:, HIDDEN : 2 * HIDDEN], du[:, 2 * HIDDEN :] = dz, dr, dn * r
        np.add.at(gx, x[t], dg)
        gh += h.T @ du
        dh = dh * z + du @ wh.T


def _rest() -> np.ndarray:
    """Input weights of NONE: both gates shut and no candidate, so that the state beyond a text's ends is zero."""
    return np.concatenate([np.full(2 * HIDDEN, -40, np.float32), np.zeros(HIDDEN, np.float32)])


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> Model | None:
    names = sorted(set(langs))
    texts_langs = [(t, names.index(la)) for t, la in zip(texts, langs) if t]
    if not texts_langs:
        return None
    rng = np.random.default_rng(seed)
    y_all = np.array([y for _, y in texts_langs])
    by = [np.flatnonzero(y_all == k) for k in range(len(names))]
    by = [b for b in by if len(b)]
    p = {}
    for d in (0, 1):
        p[f"x{d}"] = (rng.standard_normal((257, 3 * HIDDEN)) * 0.3).astype(np.float32)
        p[f"x{d}"][NONE] = _rest()
        p[f"h{d}"] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) * 0.3).astype(np.float32)
    p["o"] = (rng.standard_normal((2 * HIDDEN + 1, len(names))) * 0.1).astype(np.float32)
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    ones = np.ones((TRAIN_STEPS, TRAIN_BATCH, 1), np.float32)
    for step in range(1, TRAIN_ROUNDS + 1):
        pick = [by[k][rng.integers(len(by[k]))] for k in rng.integers(0, len(by), TRAIN_BATCH)]  # languages evenly
        x = np.full((TRAIN_BATCH, TRAIN_STEPS), NONE, np.int64)
        for i, k in enumerate(pick):
            t = texts_langs[k][0]
            a = int(rng.integers(0, max(1, len(t) - TRAIN_STEPS + 1)))
            part = np.frombuffer(t[a : a + TRAIN_STEPS], np.uint8)
            x[i, : len(part)] = part
        x, y = x.T, y_all[pick]
        f, kf = _forward(x, p["x0"], p["h0"])
        b, kb = _forward(x[::-1], p["x1"], p["h1"])
        s = np.concatenate([f, b[::-1], ones], axis=2)
        z = s @ p["o"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        z /= z.sum(axis=2, keepdims=True)
        dz = z.copy()
        dz[:, np.arange(TRAIN_BATCH), y] -= 1
        dz *= (x != NONE)[:, :, None] / max(1, int((x != NONE).sum()))
        g = {k: np.zeros_like(w) for k, w in p.items()}
        g["o"] = s.reshape(-1, s.shape[2]).T @ dz.reshape(-1, dz.shape[2])
        ds = (dz @ p["o"].T).astype(np.float32)
        _backward(x, ds[:, :, :HIDDEN], kf, p["h0"], g["x0"], g["h0"])
        _backward(x[::-1], ds[::-1, :, HIDDEN : 2 * HIDDEN], kb, p["h1"], g["x1"], g["h1"])
        rate = 0.03 * min(1.0, step / 10) * (1 - step / (TRAIN_ROUNDS + 1))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        p["x0"][NONE] = p["x1"][NONE] = _rest()
    return Model(names, [p["x0"], p["x1"]], [p["h0"], p["h1"]], p["o"])


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """States (T, H, B) for bytes x (T, B): feature-major, so that every gate is one contiguous block."""
    H, B = HIDDEN, x.shape[1]
    # A gate is a sigmoid: half its input goes through tanh with the candidate's, all in one call.
    half = np.concatenate([np.full(2 * H, 0.5, np.float32), np.ones(H, np.float32)])
    w = np.ascontiguousarray((wx * half).T)
    u = np.ascontiguousarray((wh * half).T)
    out = np.empty((len(x), H, B), np.float32)
    h, g, a = np.zeros((H, B), np.float32), np.empty((3 * H, B), np.float32), np.empty((3 * H, B), np.float32)
    for t in range(len(x)):
        np.take(w, x[t], axis=1, out=g, mode="clip")
        np.matmul(u, h, out=a)
        zr = g[: 2 * H]
        zr += a[: 2 * H]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n, c = g[2 * H :], a[2 * H :]
        c *= zr[H:]
        n += c
        np.tanh(n, out=n)
        h -= n
        h *= zr[:H]
        h += n
        out[t] = h
    return out


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and size of each window."""
    size = np.diff(off)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = off[:-1][doc] + k * WINDOW
    return doc, begin, np.minimum(WINDOW, off[1:][doc] - begin)


def positions(model: Model, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window numbers, labels (T, B) with -1 beyond a window's end, probabilities summed over its positions (languages, B))."""
    doc, begin, size = windows(data, off)
    order = np.argsort(-size, kind="stable")
    w = np.ascontiguousarray(model.out[:-1].T)
    bias = model.out[-1][:, None]
    for at in range(0, len(order), LANES):
        sel = order[at : at + LANES]
        longest = int(size[sel[0]])
        grid = begin[sel][None, :] + np.arange(-CONTEXT, longest + CONTEXT)[:, None]
        inside = (grid >= off[:-1][doc[sel]]) & (grid < off[1:][doc[sel]])
        x = np.where(inside, data[np.clip(grid, 0, len(data) - 1)].astype(np.intp), NONE)  # NONE doesn't fit a byte
        f = _run(x, model.wx[0], model.wh[0])[CONTEXT : CONTEXT + longest]
        b = _run(x[::-1], model.wx[1], model.wh[1])[::-1][CONTEXT : CONTEXT + longest]
        labels = np.empty((longest, len(sel)), np.int8)
        total = np.zeros((len(model.langs), len(sel)), np.float32)
        for t in range(longest):
            z = w[:, :HIDDEN] @ f[t] + w[:, HIDDEN:] @ b[t] + bias
            labels[t] = z.argmax(axis=0)
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            on = t < size[sel]
            total += z * on
            labels[t][~on] = -1
        yield sel, labels, total


def score(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, languages) mean probabilities and numbers of positions by label."""
    data, off = kernels.buffers(col)
    k, n = len(model.langs), len(col)
    p, c = np.zeros((n, k)), np.zeros((n, k), np.int64)
    doc = windows(data, off)[0]
    for sel, labels, total in positions(model, data, off):
        np.add.at(p, doc[sel], total.T)
        for j in range(k):
            np.add.at(c[:, j], doc[sel], (labels == j).sum(axis=0))
    return p / np.maximum(1, np.diff(off))[:, None], c


def label_bytes(model: Model, text: str) -> list[str]:
    """The label of every byte of one text."""
    data, off = kernels.buffers(pa.array([text]))
    _, begin, _ = windows(data, off)
    out = np.zeros(len(data), np.int8)
    for sel, labels, _ in positions(model, data, off):
        for i, k in enumerate(sel):
            good = labels[:, i][labels[:, i] >= 0]
            out[begin[k] : begin[k] + len(good)] = good
    return [model.langs[i] for i in out]


def _cuttings(data: bytes, seed: int) -> list[bytes]:
    """WINDOWS_PER_ROW stretches of TRAIN_STEPS bytes, from anywhere in a text; a shorter text is itself one."""
    if len(data) <= TRAIN_STEPS:
        return [data] * WINDOWS_PER_ROW
    at = np.random.default_rng(seed).integers(0, len(data) - TRAIN_STEPS + 1, WINDOWS_PER_ROW)
    return [data[a : a + TRAIN_STEPS] for a in at.tolist()]


def fit(docs: DataFrame) -> Model | None:
    """Training windows are cut from whole texts where these lie; only the windows come to the driver."""
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    picked = frames.written(known.select("doc_id", key.alias("k")).orderBy("k", "doc_id").limit(LABELLED_ROWS), "labelled-docs")
    rows = known.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id")  # LABELLED_ROWS ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in kernels.slices(batch, "text"):
                data, off = kernels.buffers(b.column(2))
                ids = b.column(0).to_pylist()
                cut = [_cuttings(data[x:y].tobytes(), zlib.crc32(str(i).encode())) for i, x, y in zip(ids, off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.list_(pa.binary()))], ["doc_id", "lang", "cut"])

    kind = dict(docs.dtypes)["doc_id"]
    got = rows.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, cut array<binary>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["cut"]))
    return train([w for r in got for w in r["cut"]], [r["lang"] for r in got for _ in r["cut"]])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang_pred, p, n_bytes, label_counts (map language -> bytes labelled so) of every row."""
    narrow = docs.select("doc_id", "text", "lang")
    model = model or fit(narrow)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        langs = m.langs if m else []
        for batch in batches:
            for b in kernels.slices(batch, "text", 16 << 20):
                n, size = b.num_rows, np.diff(kernels.buffers(b.column(1))[1])
                p, c = score(m, b.column(1)) if m else (np.zeros((n, 0)), np.zeros((n, 0), np.int64))
                best = p.argmax(axis=1) if langs else np.zeros(n, np.int64)
                pred = [langs[i] if langs and s else None for i, s in zip(best, size)]
                top = np.round(p.max(axis=1) if langs else np.zeros(n), 4)
                maps = pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * len(langs), pa.int32()), pa.array(langs * n, pa.string()), pa.array(c.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.where(size > 0, top, 0.0)), pa.array(size), maps], ["doc_id", "lang_pred", "p", "n_bytes", "label_counts"])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, p double, n_bytes bigint, label_counts map<string,bigint>")
