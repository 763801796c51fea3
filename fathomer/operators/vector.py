"""Exact vector search on a grid of blocks: each product of two blocks is one matrix multiplication in a task of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a task holds two blocks at a time, whatever the tables.
BLOCK_ROWS = 4096
TILE = 512


def _blocks(df: DataFrame, key: str, vector: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(by, dim, block, ids, vectors) with about BLOCK_ROWS rows each, and (by, dim, blocks). Rows without a vector are left out."""
    rows = df.select(*by, F.col(key).cast("bigint").alias("_k"), F.col(vector).cast("array<double>").alias("_v")).where("_k is not null and size(_v) > 0").withColumn("dim", F.size("_v"))
    sizes = rows.groupBy(*by, "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = rows.join(sizes if by else F.broadcast(sizes), [*by, "dim"])  # without groups, a row per vector length
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("_k"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy(*by, "dim", "block").agg(F.collect_list(F.struct("_k", "_v")).alias("_r"))
    return packed.select(*by, "dim", "block", F.col("_r._k").alias("ids"), F.flatten("_r._v").alias("vectors")), sizes


def _unit(values: pa.Scalar, dim: int) -> np.ndarray:
    v = values.values.to_numpy().reshape(-1, dim)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def _meet(a: DataFrame, b: DataFrame, sizes: DataFrame, by: tuple[str, ...], ordered: bool) -> DataFrame:
    """Every block of a with every block of b: the join key is b's block, so no key is hot. ordered: only blocks of a up to b's."""
    keys = [*by, "dim"]
    left = a.withColumnsRenamed({"block": "qb", "ids": "qi", "vectors": "qv"}).join(sizes if by else F.broadcast(sizes), keys)
    first = F.col("qb") if ordered else F.lit(0)
    left = left.withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1))).drop("blocks")
    return left.join(b, [*keys, "block"]).select("dim", "qb", "block", "qi", "qv", "ids", "vectors")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(same block, query ids, row ids, cosines) of tiles of queries."""
    for b in batches:
        for i in range(b.num_rows):
            dim, qb, rb = (b.column(c)[i].as_py() for c in range(3))
            q, r = b.column(3)[i].values.to_numpy(), b.column(5)[i].values.to_numpy()
            v, base = _unit(b.column(4)[i], dim), _unit(b.column(6)[i], dim)
            for at in range(0, len(q), TILE):
                yield qb == rb, q[at : at + TILE], r, np.round(v[at : at + TILE] @ base.T, 12) + 0.0


def _arrays(keys: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, vectors) of a batch, by vector length."""
    size = np.diff(vectors.offsets.to_numpy())
    k, flat = keys.to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield dim, k[rows], flat[at[rows][:, None] + np.arange(dim)] if len(rows) < len(size) else flat.reshape(-1, dim)


def _unit_rows(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


class _Best:
    """The k best rows so far of each of a set of queries: by score of ``digits`` digits, then by the least tie(query id, row id)."""

    def __init__(self, ids: np.ndarray, k: int, digits: int, floor: float | None, tie: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
        self.ids, self.k, self.digits, self.floor, self.tie = ids, k, digits, floor, tie
        self.near, self.score = np.zeros((len(ids), k)), np.zeros((len(ids), k))
        self.row, self.by = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.n = np.zeros(len(ids), np.int64)
        self.least = np.full(len(ids), -np.inf if floor is None else floor - 1e-11)

    def add(self, at: int, s: np.ndarray, rows: np.ndarray) -> None:
        """Cosines s of the queries from ``at`` on with some rows."""
        slack, need = 2 * 10.0**-self.digits, self.least[at : at + len(s)]
        if len(rows) > 4 * self.k and (self.n[at : at + len(s)] < self.k).any():  # the tile's own k best, before many are sorted
            need = np.maximum(need, np.partition(s, len(rows) - self.k - 1, axis=1)[:, len(rows) - self.k - 1] - slack)
        i, j = np.nonzero(s >= need[:, None])
        v = np.round(s[i, j], 12) + 0.0
        if self.floor is not None:
            ok = (v >= self.floor) & (self.ids[at + i] != rows[j])
            i, j, v = i[ok], j[ok], v[ok]
        if not len(i):
            return
        r, q = rows[j], i + at
        # half up, as SQL rounds; scores have 12 digits, so the whole numbers are exact
        unit = np.rint(np.abs(v) * 1e12).astype(np.int64)
        step = 10 ** (12 - self.digits)
        near = np.sign(v) * ((unit + step // 2) // step)
        by = r if self.tie is None else self.tie(self.ids[q], r)
        u = np.unique(q)
        had = np.arange(self.k) < self.n[u][:, None]
        q, r, v, near, by = (np.concatenate([x, y[u][had]]) for x, y in ((q, np.repeat(np.arange(len(self.n))[:, None], self.k, 1)), (r, self.row), (v, self.score), (near, self.near), (by, self.by)))
        o = np.lexsort((by, -near, q))
        rank = np.arange(len(o)) - np.searchsorted(q[o], q[o])
        o, rank = o[rank < self.k], rank[rank < self.k]
        q = q[o]
        self.near[q, rank], self.score[q, rank], self.row[q, rank], self.by[q, rank] = near[o], v[o], r[o], by[o]
        self.n[u] = np.bincount(q, minlength=len(self.n))[u]
        full = u[self.n[u] == self.k]
        self.least[full] = np.maximum(self.least[full], self.near[full, -1] / 10.0**self.digits - slack)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), 8192):
            i, j = np.nonzero(np.arange(self.k) < self.n[a : a + 8192, None])
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a + i]), pa.array(self.row[a + i, j]), pa.array(self.score[a + i, j])], ["query_id", "row_id", "score"])


#: Up to so many queries go to every task; more are dealt to groups, and each group sees all rows once. A group's vectors and results stay in a task's memory.
FEW_QUERIES, GROUP_ROWS = 2048, 1 << 15


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v) of rows with a vector, numbers of 4 bytes where the table has them so."""
    kind = "float" if dict(df.dtypes)[vector] == "array<float>" else "double"
    return df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast(f"array<{kind}>").alias("v")).where("k is not null and size(v) > 0")


_PIECE = "src int, dim int, ids binary, vectors binary"


def _pieces(df: DataFrame, key: str, vector: str, groups: int) -> DataFrame:
    """Packed rows (src, dim, ids, vectors): the group that the id's hash names, and up to BLOCK_ROWS rows of it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src = b.column(2).to_numpy()
            for g in np.unique(src).tolist():
                part = b.filter(pa.array(src == g))
                for dim, ids, v in _arrays(part.column(0), part.column(1)):
                    v = v.astype(np.float64) if v.dtype != np.float32 else v
                    for a in range(0, len(ids), BLOCK_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids[a : a + BLOCK_ROWS].tobytes()], pa.binary()), pa.array([v[a : a + BLOCK_ROWS].tobytes()], pa.binary())], ["src", "dim", "ids", "vectors"])

    return _rows(df, key, vector).withColumn("g", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int")).mapInArrow(pack, _PIECE)


def _groups(spark, n: int) -> int:
    """Groups of n rows: two a core, and more where they would pass GROUP_ROWS."""
    return max(1, -(-n // GROUP_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)))


def _dealt(own: DataFrame, others: DataFrame, to, groups: int) -> DataFrame:
    """Partition g holds the pieces of own of group g (kind 0), then the pieces of others that go to it: ``to`` gives their groups."""
    a = own.select(F.col("src").alias("grp"), F.lit(0).alias("kind"), "src", "dim", "ids", "vectors")
    b = others.select(F.explode(to).alias("grp"), F.lit(1).alias("kind"), "src", "dim", "ids", "vectors")
    return a.union(b).repartitionById(groups, F.col("grp")).sortWithinPartitions("kind")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """(group, kind, src, dim, ids, unit vectors) of pieces, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            grp, kind, src, dim = (b.column(c)[i].as_py() for c in range(4))
            ids, raw = np.frombuffer(b.column(4)[i].as_buffer(), np.int64), b.column(5)[i].as_buffer()
            v = np.frombuffer(raw, np.float32 if raw.size == 4 * dim * len(ids) else np.float64).reshape(-1, dim)
            yield grp, kind, src, dim, ids, _unit_rows(v)


_FOUND = "query_id bigint, row_id bigint, score double"


def _nearest(queries: DataFrame, base: DataFrame, k: int, key: str, vector: str, digits: int = 9, floor: float | None = None, tie=None) -> DataFrame:
    """(query_id, row_id, score): for each query its k best rows, or several lists that hold them (see _Best)."""
    q = _rows(queries, "query_id", "query_vector")
    n = q.limit(FEW_QUERIES + 1).count()
    if n <= FEW_QUERIES:
        held = q.toArrow().combine_chunks()
        known = [(dim, ids, _unit_rows(v)) for b in held.to_batches() for dim, ids, v in _arrays(b.column(0), b.column(1))]

        def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Best(ids, k, digits, floor, tie) for _, ids, _ in known]
            for b in batches:
                for dim, ids, v in _arrays(b.column(0), b.column(1)):
                    for z in range(0, len(ids), BLOCK_ROWS):
                        r, u = ids[z : z + BLOCK_ROWS], _unit_rows(v[z : z + BLOCK_ROWS]).T
                        for (d, qs, x), best_ in zip(known, best):
                            for at in range(0, len(qs) if d == dim else 0, TILE):
                                best_.add(at, x[at : at + TILE] @ u, r)
            for best_ in best:
                yield from best_.rows()

        return _rows(base, key, vector).mapInArrow(few, _FOUND)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        best: dict[int, tuple[np.ndarray, _Best]] = {}
        for _, kind, _, dim, ids, v in _opened(batches):
            if kind == 0:
                own.setdefault(dim, []).append((ids, v))
                continue
            if dim not in best and dim in own:
                parts = own.pop(dim)
                best[dim] = np.concatenate([x for _, x in parts]), _Best(np.concatenate([i for i, _ in parts]), k, digits, floor, tie)
            if dim in best:
                x, b = best[dim]
                for at in range(0, len(x), TILE):
                    b.add(at, x[at : at + TILE] @ v.T, ids)
        for _, b in best.values():
            yield from b.rows()

    g = _groups(base.sparkSession, q.count())
    to = F.sequence(F.lit(0), F.lit(g - 1))
    return _dealt(_pieces(queries, "query_id", "query_vector", g), _pieces(base, key, vector, 1), to, g).mapInArrow(many, _FOUND)


def top_k(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, row_id, score, rank): the k nearest rows of each query (query_id, query_vector), ties by id.

    What is shuffled is each group's queries, all rows once a group, and k rows a query; with few queries, only the latter.
    """
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "row_id")
    return _nearest(queries, base, k, key, vector).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pair_hash(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(least, greatest) of two ids."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(q), 42, np.uint64)
    with np.errstate(over="ignore"):
        for x in (np.minimum(q, r), np.maximum(q, r)):
            h = h + p5 + np.uint64(8)
            h = turn(h ^ (turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def first_pairs(vectors: DataFrame, threshold: float, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(i, j, sim), i < j: of all pairs with cosine >= threshold those that are among the first k of i or of j, by sim of 6 digits, then by xxhash64(i, j).

    No more than k rows a vector and group are shuffled, however many pairs there are.
    """
    found = _nearest(vectors.select(F.col(key).alias("query_id"), F.col(vector).alias("query_vector")), vectors, k, key, vector, 6, threshold, _pair_hash)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), F.xxhash64(F.least("query_id", "row_id"), F.greatest("query_id", "row_id")))
    found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return found.groupBy(F.least("query_id", "row_id").alias("i"), F.greatest("query_id", "row_id").alias("j")).agg(F.max("score").alias("sim"))


def _all_pairs(vectors: DataFrame, threshold: float, key: str, vector: str) -> DataFrame:
    """pairs_above without groups of rows: each pair of pieces meets once, in one of the two pieces' tasks."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for grp, kind, src, dim, ids, v in _opened(batches):
            if kind == 0:
                own.setdefault(dim, []).append((ids, v))
                continue
            for q, x in own.get(dim, []):
                for at in range(0, len(q), TILE):
                    s = x[at : at + TILE] @ v.T
                    i, j = np.nonzero(s >= threshold - 1e-11)
                    sim, a, b = np.round(s[i, j], 12) + 0.0, q[at + i], ids[j]
                    ok = (sim >= threshold) & ((a < b) if src == grp else (a != b))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(sim[ok])], ["i", "j", "sim"])

    g = _groups(vectors.sparkSession, _rows(vectors, key, vector).count())
    pieces = _pieces(vectors, key, vector, g)
    ahead = lambda x: F.pmod(F.col("src") - x, F.lit(g)) * 2
    to = F.filter(F.sequence(F.lit(0), F.lit(g - 1)), lambda x: (ahead(x) < g) | ((ahead(x) == g) & (x < F.col("src"))))
    return _dealt(pieces, pieces, to, g).mapInArrow(close, "i bigint, j bigint, sim double")


def pairs_above(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", by: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, sim) of all pairs i < j (of one group, with ``by``) with cosine >= threshold."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, q, r, s in _tiles(batches):
            i, j = np.nonzero((s >= threshold) & ((q[:, None] < r) if same else (q[:, None] != r)))
            a, b = np.minimum(q[i], r[j]), np.maximum(q[i], r[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s[i, j])], ["i", "j", "sim"])

    if not by:
        return _all_pairs(vectors, threshold, key, vector)
    rows, sizes = _blocks(vectors, key, vector, by)
    return _meet(rows, rows, sizes, by, True).mapInArrow(close, "i bigint, j bigint, sim double")


def pairs_in_runs(rows: DataFrame, threshold: float, by: str, key: str = "id", vector: str = "embedding") -> DataFrame:
    """pairs_above within groups whose rows stand together in one partition: nothing is shuffled. A group's vectors are held by a task."""

    def within(held: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, (k for k, _ in held))) < 2:
            return
        for _, ids, v in _arrays(pa.concat_arrays([k for k, _ in held]), pa.concat_arrays([v for _, v in held])):
            x = _unit_rows(v)
            for at in range(0, len(x), TILE):
                for z in range(at, len(x), BLOCK_ROWS):
                    i, j = np.nonzero((s := x[at : at + TILE] @ x[z : z + BLOCK_ROWS].T) >= threshold - 1e-11)
                    sim = np.round(s[i, j], 12) + 0.0
                    i, j = i + at, j + z
                    ok = (i < j) & (sim >= threshold) & (ids[i] != ids[j])
                    a, b = ids[i[ok]], ids[j[ok]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim[ok])], ["i", "j", "sim"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            g = pc.fill_null(pc.dictionary_encode(b.column(0)).indices, -1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    group = b.column(0)[a].as_py()
                    if group != now:
                        yield from within(held)
                        now, held = group, []
                    held.append((b.column(1).slice(a, z - a), b.column(2).slice(a, z - a)))
        yield from within(held)

    r = rows.select(F.col(by).alias("g"), F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).where("g is not null and k is not null and size(v) > 0")
    return r.mapInArrow(close, "i bigint, j bigint, sim double")
