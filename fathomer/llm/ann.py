"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a sample is cut into balanced partitions by recursive bisection (a split at the median of the
leading direction, then exchanges of the vertices that save most edges). A small network learns to predict
where a vector's neighbours lie; it assigns every row to its most probable partition and routes every row, as a query, to several of the
most probable ones. How many is calibrated: exact neighbours of held-out queries over the whole table show the
smallest number whose recall reaches ``TARGET_RECALL``. Candidates of the probed partitions are ranked by exact cosine.

At most ``SAMPLE_ROWS`` rows (least md5 of vec_id first) build the graph and train the network, and
``CHECK_QUERIES`` others calibrate; every row is assigned, and every row is searched for.

Defined results: rows with a null id, a null vector, null or non-finite elements or another length than
the most common one are neither searched nor found; repeated rows of one vec_id count once (least vector); a row is never its own
neighbour; the cosine of a zero vector is 0; ties go to the smaller id; tables of fewer than k + 1 rows give
what there is. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, kernels

K = 10
#: The bound on the rows that the partitions are learned from.
SAMPLE_ROWS = 16_000
CHECK_QUERIES = 400
ROWS_PER_PARTITION = 2000
GRAPH_DEGREE = 10
HIDDEN = 128
TARGET_RECALL = 0.94
#: Queries that one task ranks at most; beyond it, a partition is copied to several tasks.
TASK_QUERIES = 200_000


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def routes(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable partitions, in order."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :probes]


def normalised(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def exact_top(queries: np.ndarray, base: np.ndarray, k: int, skip: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, cosines) of the k nearest; skip[i]: the id that query i must not find; -1 where there are fewer."""
    ids = np.arange(len(base)) if ids is None else ids
    order = np.argsort(ids, kind="stable")
    base, sorted_ids = base[order], ids[order]
    out, sims = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf, np.float32)
    m = len(base)
    most = min(k, m)
    if most == 0:
        return out, sims
    g = max(1, min(64, m // (4 * most)))
    whole = m // g * g
    for a in range(0, len(queries), 512):
        s = queries[a : a + 512] @ base.T
        if skip is not None:
            at = np.minimum(np.searchsorted(sorted_ids, skip[a : a + 512]), m - 1)
            own = np.flatnonzero(sorted_ids[at] == skip[a : a + 512])
            s[own, at[own]] = -np.inf
        # The k-th largest of the maxima of groups of columns: at least k values reach it, and few more.
        top = s[:, :whole].reshape(len(s), -1, g).max(axis=2)
        if whole < m:
            top = np.column_stack([top, s[:, whole:].max(axis=1)])
        i, j = np.nonzero(s >= np.partition(top, top.shape[1] - most, axis=1)[:, -most, None])
        v = s[i, j]
        o = np.lexsort((j, -v, i))
        i, j, v = i[o], j[o], v[o]
        start, size = kernels.runs(i)
        rank = np.arange(len(i)) - np.repeat(start, size)
        ok = (rank < most) & np.isfinite(v)
        out[a + i[ok], rank[ok]], sims[a + i[ok], rank[ok]] = order[j[ok]], v[ok]
    return out, sims


def bisect(members: np.ndarray, x: np.ndarray, near: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A balanced cut of a vertex set: a boolean side for each member."""
    n = len(members)
    local = np.full(len(x), -1, np.int64)
    local[members] = np.arange(n)
    c = x[members] - x[members].mean(axis=0)
    direction = np.ones(c.shape[1], np.float32)
    for _ in range(20):
        direction = c.T @ (c @ direction)
        direction /= max(float(np.linalg.norm(direction)), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(c @ direction, kind="stable")[n // 2 :]] = True
    u = np.repeat(np.arange(n), near.shape[1])
    v = local[near[members].reshape(-1)]
    u, v = np.concatenate([u[v >= 0], v[v >= 0]]), np.concatenate([v[v >= 0], u[v >= 0]])
    best, kept = None, side
    for _ in range(rounds):
        cross = side[u] != side[v]
        if best is None or cross.sum() < best:
            best, kept = int(cross.sum()), side.copy()
        gain = np.bincount(u, np.where(cross, 1.0, -1.0), n)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        good = int((gain[a[:m]] + gain[b[:m]] > 0).sum())
        if good == 0:
            break
        good = max(1, good // 3)  # exchanges at once disturb each other: take the best third
        side[a[:good]], side[b[:good]] = False, True
    return kept


def balanced_partitions(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [g for m in groups for side in [bisect(m, x, near)] for g in (m[~side], m[side])]
    for i, g in enumerate(groups):
        label[g] = i
    return label


def train_router(x: np.ndarray, soft: np.ndarray, seed: int = 11, epochs: int = 25, batch: int = 512) -> Router:
    """A one-hidden-layer softmax network for the distribution of a vector's neighbours over partitions."""
    rng = np.random.default_rng(seed)
    d, m = x.shape[1], soft.shape[1]
    p = [(rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d)).astype(np.float32), np.zeros(HIDDEN, np.float32), (rng.standard_normal((HIDDEN, m)) * np.sqrt(1 / HIDDEN)).astype(np.float32), np.zeros(m, np.float32)]
    mo, ve = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    step, total = 0, max(1, epochs * -(-len(x) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            step += 1
            i = order[a : a + batch]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            dz = ((z - soft[i]) / len(i)).astype(np.float32)
            dh = (dz @ p[2].T) * (h > 0)
            grads = [x[i].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
            rate = 0.004 * (1 - step / (total + 1))
            for k, g in enumerate(grads):
                mo[k] = 0.9 * mo[k] + 0.1 * g
                ve[k] = 0.999 * ve[k] + 0.001 * g * g
                p[k] = p[k] - (rate * (mo[k] / (1 - 0.9**step)) / (np.sqrt(ve[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Router(*p)


def learn(x: np.ndarray, parts: int) -> Router:
    near, _ = exact_top(x, x, min(GRAPH_DEGREE, max(1, len(x) - 1)), np.arange(len(x)))
    near = np.where(near < 0, np.arange(len(x))[:, None], near)
    label = balanced_partitions(x, near, parts)
    soft = np.zeros((len(x), parts), np.float32)
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].reshape(-1)), 1 / (near.shape[1] + 1))
    soft[np.arange(len(x)), label] += 1 / (near.shape[1] + 1)
    return train_router(x, soft)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(-1, dim)


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int, int]:
    """(id, v) of the usable rows as a written table, their length and their number."""
    v = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0].d if dims else 0
    out = frames.written(v.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    return out, dim, out.count()


def calibrate(base: DataFrame, dim: int, router: Router, ids: np.ndarray, x: np.ndarray, k: int) -> int:
    """The least number of probes at which the given queries find TARGET_RECALL of their exact neighbours."""
    sent = base.sparkSession.sparkContext.broadcast((router, ids, x))  # CHECK_QUERIES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, qids, q = sent.value
        for b in batches:
            if b.num_rows == 0:
                continue
            got, v = b.column(0).to_numpy(), normalised(_matrix(b.column(1), dim))
            idx, sims = exact_top(q, v, k, qids, got)
            i, j = np.nonzero(idx >= 0)
            part = r.routes(v, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(got[idx[i, j]], pa.int64()), pa.array(sims[i, j], pa.float32()), pa.array(part[idx[i, j]], pa.int32())], ["q", "id", "s", "part"])

    top = base.mapInArrow(run, "q int, id bigint, s float, part int").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "id", "part"))), 1, k).alias("t"))
    rank = np.argsort(np.argsort(-router.logits(x), axis=1, kind="stable"), axis=1)
    need = [rank[row.q, t.part] for row in top.collect() for t in row.t]  # CHECK_QUERIES * k numbers
    if not need:
        return 1
    seen = np.cumsum(np.bincount(need, minlength=rank.shape[1])) / len(need)
    return int(np.argmax(seen >= TARGET_RECALL)) + 1


def neighbours(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, neighbour_id, rank (from 1), cosine: the k nearest other rows of every row."""
    spark = vectors.sparkSession
    base, dim, n = clean(vectors, vec_id, embedding)
    schema = "vec_id bigint, neighbour_id bigint, rank int, cosine double"
    if n < 2:
        return spark.createDataFrame([], schema)
    picked = base.orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(SAMPLE_ROWS + CHECK_QUERIES).toArrow()
    ids = np.asarray(picked.column("id"), np.int64)
    x = normalised(_matrix(picked.column("v").combine_chunks(), dim))
    held = min(CHECK_QUERIES, max(1, len(ids) // 5))
    sample = x[held:] if len(ids) > held else x
    parts = 1
    while parts * 2 * 64 <= len(sample) and parts * ROWS_PER_PARTITION < n:
        parts *= 2
    router = learn(sample, parts)
    probes = calibrate(base, dim, router, ids[:held], x[:held], k) if parts > 1 else 1
    copies = max(1, -(-n * probes // (parts * TASK_QUERIES)))
    record = np.dtype([("id", "<i8"), ("v", "<f4", (dim,))])
    answer = np.dtype([("q", "<i8"), ("id", "<i8"), ("s", "<f4")])
    merge_parts = frames.partitions(spark)
    sent = spark.sparkContext.broadcast(router)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            rec = np.empty(b.num_rows, record)
            rec["id"], rec["v"] = b.column(0).to_numpy(), normalised(_matrix(b.column(1), dim))
            routes = sent.value.routes(rec["v"], probes)
            for c in range(copies):
                home = kernels.scatter(routes[:, 0] * copies + c, rec, parts * copies)
                yield home.append_column("kind", pa.array(np.zeros(home.num_rows, np.int32)))
            salt = (kernels.mix64(rec["id"].astype(np.uint64)) % np.uint64(copies)).astype(np.int64)
            for j in range(probes):
                ask = kernels.scatter(routes[:, j] * copies + salt, rec, parts * copies)
                yield ask.append_column("kind", pa.array(np.ones(ask.num_rows, np.int32)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: dict[int, list[np.ndarray]] = {}
        ready: dict[int, np.ndarray] = {}
        for b in batches:
            for pid, blob, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rec = kernels.unpack(blob, record)
                if kind == 0:
                    home.setdefault(pid, []).append(rec)
                    continue
                if pid not in ready:
                    ready = {pid: np.concatenate(home.pop(pid)) if pid in home else np.zeros(0, record)}
                own = ready[pid]
                idx, sims = exact_top(rec["v"], own["v"], k, rec["id"], own["id"])
                i, j = np.nonzero(idx >= 0)
                out = np.empty(len(i), answer)
                out["q"], out["id"], out["s"] = rec["id"][i], own["id"][idx[i, j]], sims[i, j]
                got = kernels.scatter((kernels.mix64(out["q"].astype(np.uint64)) % np.uint64(merge_parts)).astype(np.int64), out, merge_parts)
                if got is not None:
                    yield got

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec = kernels.gather(batches, answer)
        rec = rec[np.lexsort((rec["id"], -rec["s"], rec["q"]))]
        at, size = kernels.runs(rec["q"])
        rank = np.arange(len(rec)) - np.repeat(at, size) + 1
        rec, rank = rec[rank <= k], rank[rank <= k]
        yield pa.RecordBatch.from_arrays([pa.array(rec["q"]), pa.array(rec["id"]), pa.array(rank.astype(np.int32)), pa.array(np.round(rec["s"].astype(float), 5))], ["vec_id", "neighbour_id", "rank", "cosine"])

    sent_rows = base.mapInArrow(emit, "pid int, blob binary, kind int")
    found = frames.by_id(sent_rows, parts * copies).sortWithinPartitions("pid", "kind").mapInArrow(search, "pid int, blob binary")
    return frames.by_id(found, merge_parts).mapInArrow(merge, schema)
