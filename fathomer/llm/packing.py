"""Packing by optimal length buckets.

Lengths (in tokens, rounded up to ``ALIGN``) are counted over all documents; a dynamic programme over that
histogram chooses at most ``BUCKETS`` bucket boundaries with the least total padding (each document is padded
to its bucket's boundary). Within a bucket documents are numbered in a fixed shuffled order and cut into batches
of as many as the token budget holds (at least one).

Numbering is distributed: a document's place is its rank within its (bucket, stripe) plus the sizes of the earlier
stripes, where the stripe is a function of doc_id; no bucket is ever sorted in one task.

Defined results: a null or empty text has length 0, is padded to ``ALIGN`` like the shortest documents; a document longer than the
budget is alone in its batch; null doc_ids are in stripe 0 and come first; repeated rows each get a slot (in no
order among themselves that matters: they are equal); of equally good boundaries the smaller are
chosen. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .mixing import tokens

ALIGN = 8
BUCKETS = 12
BUDGET = 16_384
STRIPES = 4096


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries of the buckets that minimise sum(count * (boundary - length)); lengths ascending, distinct.

    Exact dynamic programme; the cost has the Monge property, so each layer is solved by divide and conquer over
    monotone split points, breadth first: O(n log n) per layer.
    """
    n = len(lengths)
    if n == 0:
        return []
    c = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    best = c[1:] * lengths.astype(np.int64)
    split = [np.zeros(n, np.int64)]
    length = lengths.astype(np.int64)
    costs = [best]
    for _ in range(1, min(buckets, n)):
        now, arg = np.empty(n, np.int64), np.zeros(n, np.int64)
        prev = np.concatenate([[0], best])  # prev[j]: j lengths in earlier buckets
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            j = np.arange(a, min(mid, b) + 1)
            value = prev[j] + (c[mid + 1] - c[j]) * length[mid]
            k = int(np.argmin(value))
            now[mid], arg[mid] = value[k], j[k]
            todo += [(lo, mid - 1, a, int(j[k])), (mid + 1, hi, int(j[k]), b)]
        best = now
        costs.append(best)
        split.append(arg)
    used = min(range(len(costs)), key=lambda k: (costs[k][-1], k))
    out, end = [], n
    for k in range(used, -1, -1):
        out.append(int(lengths[end - 1]))
        end = int(split[k][end - 1])
        if end == 0:
            break
    return sorted(out)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, align: int = ALIGN) -> DataFrame:
    """doc_id, n_tokens, bucket_length, batch (within the bucket), slot (within the batch)."""
    spark = docs.sparkSession
    n = tokens(F.col("text"))
    padded = F.greatest(F.ceil(F.col("n_tokens") / F.lit(align)), F.lit(1)).cast("long") * align
    stripe = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) * F.lit(2654435761).cast("decimal(20,0)"), F.lit(STRIPES).cast("decimal(20,0)")).cast("int")
    sized = docs.select(F.col("doc_id"), n.alias("n_tokens")).withColumns({"padded": padded, "stripe": stripe})
    sized = frames.written(sized, "sized")
    histogram = sized.groupBy("padded").count().toArrow()  # one row per aligned length: bounded by the longest text, not by the corpus
    length = np.asarray(histogram.column("padded"), np.int64)
    order = np.argsort(length)
    ends = boundaries(length[order], np.asarray(histogram.column("count"), np.int64)[order], buckets)
    if not ends:
        return spark.createDataFrame([], sized.select("doc_id", "n_tokens").schema.add("bucket_length", "long").add("batch", "long").add("slot", "long"))
    bucket = F.array_min(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e >= F.col("padded")))
    rows = sized.select("doc_id", "n_tokens", "stripe", bucket.alias("bucket_length"))
    sizes = rows.groupBy("bucket_length", "stripe").count()
    before = Window.partitionBy("bucket_length").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    offset = frames.written(sizes.select("bucket_length", "stripe", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "stripes")
    rank = F.row_number().over(Window.partitionBy("bucket_length", "stripe").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens"))
    offset = F.broadcast(offset)  # at most BUCKETS * STRIPES rows, whatever the corpus
    place = F.col("offset") + rank - 1
    per = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1)).cast("long")
    placed = rows.join(offset, ["bucket_length", "stripe"]).select("doc_id", "n_tokens", "bucket_length", place.alias("place"), per.alias("per"))
    return placed.select("doc_id", "n_tokens", "bucket_length", F.floor(F.col("place") / F.col("per")).cast("long").alias("batch"), F.pmod(F.col("place"), F.col("per")).cast("long").alias("slot"))


SQL = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS n_tokens FROM documents),
sized AS (SELECT *, greatest((n_tokens + {ALIGN - 1}) // {ALIGN}, 1) * {ALIGN} AS padded,
    ((coalesce(doc_id, 0)::HUGEINT * 2654435761) % {STRIPES})::INTEGER AS stripe FROM doc),
hist AS (SELECT padded, count(*) AS n FROM sized GROUP BY padded),
cum AS (SELECT padded AS len, row_number() OVER (ORDER BY padded) AS i, sum(n) OVER (ORDER BY padded)::BIGINT AS c FROM hist),
point AS (SELECT i, len, c FROM cum UNION ALL SELECT 0, 0, 0),
dp AS (
    SELECT 1 AS k, i, c * len AS cost, [len] AS ends FROM cum
    UNION ALL
    SELECT k, i, cost, ends FROM (
        SELECT dp.k + 1 AS k, b.i, dp.cost + (b.c - a.c) * b.len AS cost, list_append(dp.ends, b.len) AS ends,
            row_number() OVER (PARTITION BY b.i ORDER BY dp.cost + (b.c - a.c) * b.len, a.i) AS r
        FROM dp JOIN point a ON a.i = dp.i JOIN cum b ON b.i > a.i WHERE dp.k < {BUCKETS}) WHERE r = 1),
best AS (SELECT ends FROM dp WHERE i = (SELECT max(i) FROM cum) ORDER BY cost, k LIMIT 1),
bucketed AS (SELECT doc_id, n_tokens, stripe, (SELECT min(e) FROM (SELECT unnest(ends) AS e FROM best) WHERE e >= padded) AS bucket_length FROM sized),
placed AS (SELECT *, row_number() OVER (PARTITION BY bucket_length ORDER BY stripe, doc_id NULLS FIRST, n_tokens) - 1 AS place,
    greatest({BUDGET} // bucket_length, 1) AS per FROM bucketed)
SELECT doc_id, n_tokens, bucket_length::BIGINT AS bucket_length, place // per AS batch, place % per AS slot FROM placed
"""
