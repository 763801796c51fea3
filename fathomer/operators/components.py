"""Connected components: forests within partitions first, then star contraction of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: So many edges (16 bytes each) fit one task; with more, the contraction goes on distributed. The result is the same.
TASK_EDGES = 1 << 20
_EDGE = "hi bigint, lo bigint"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node of the edges (a, b)."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    up = np.arange(len(nodes))
    while True:
        px, py = up[x], up[y]
        open_ = px != py
        if not open_.any():
            return nodes, nodes[up]
        x, y, px, py = x[open_], y[open_], px[open_], py[open_]
        np.minimum.at(up, np.maximum(px, py), np.minimum(px, py))
        while (up != up[up]).any():
            up = up[up]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars (node, least node); what is held grows with its nodes, not with its edges."""
    hi, lo = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        node, root = forest(np.concatenate([hi, *(h for h, _ in held)]), np.concatenate([lo, *(x for _, x in held)]))
        return node[node != root], root[node != root]

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > TASK_EDGES:
            (hi, lo), held, size = fold(), [], 0
    hi, lo = fold()
    for at in range(0, len(hi), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(hi[at : at + (1 << 18)]), pa.array(lo[at : at + (1 << 18)])], ["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, of nodes that have edges (a, b) with a <> b.

    Each partition replaces its edges by stars. If few are left, one task ends the work; else large-star and
    small-star rounds contract the rest until they no longer change it. A round is checkpointed.
    """
    pairs = edges.selectExpr("cast(greatest(a, b) AS bigint) AS hi", "cast(least(a, b) AS bigint) AS lo").where("lo < hi")
    e, last = cut(pairs.mapInArrow(_local, _EDGE)), None
    while True:
        n, mark = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if n <= TASK_EDGES:
            e = e.coalesce(1).mapInArrow(_local, _EDGE)
            break
        if (n, mark) == last:
            break
        last = (n, mark)
        both = e.selectExpr("hi AS u", "lo AS v").union(e.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(least, "u").where("v > u").selectExpr("v AS hi", "m AS lo").where("lo < hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        step = large.join(low, "hi")
        e = cut(step.selectExpr("lo AS hi", "m AS lo").union(step.selectExpr("hi", "m AS lo")).where("lo < hi").distinct())
    return e.selectExpr("hi AS node", "lo AS root").union(e.selectExpr("lo AS node", "lo AS root").distinct())
