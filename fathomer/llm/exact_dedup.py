"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is its length and two polynomial hashes modulo 31-bit primes. A text is
hashed in chunks of ``CHUNK`` bytes, all chunks of a batch at once by one exact float64 matrix product, and
chunk hashes combine by length-shifted arithmetic: H(xy) = H(x) * B**len(y) + H(y). So a huge document can be
hashed in parts anywhere, even when it is stored as several rows (``fingerprint_parts``). Texts of equal
fingerprint are then compared chunk by chunk; a fingerprint alone never removes anything.

Defined results: a null text equals nothing and is always kept; empty texts equal each other; rows repeated
in full, even under one doc_id, are copies of each other; the kept row of a group is the one with the least
doc_id (nulls last). Extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, kernels

CHUNK = 4096
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 69069069)
#: Copies of one text that one task compares at most; larger groups are compared in a tree.
FANIN = 2000

_FP = ["_fx_h1", "_fx_h2", "_fx_n"]


def _weights(n: int) -> np.ndarray:
    """Row i: B**(n-1-i) for both moduli, as exact floats."""
    out = np.empty((n, 2))
    for j, (p, b) in enumerate(zip(PRIMES, BASES)):
        x = 1
        for i in range(n - 1, -1, -1):
            out[i, j] = x
            x = x * b % p
    return out


_W = _weights(CHUNK)


def combine(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of a concatenation from those of its parts."""
    return (
        (x[0] * pow(BASES[0], y[2], PRIMES[0]) + y[0]) % PRIMES[0],
        (x[1] * pow(BASES[1], y[2], PRIMES[1]) + y[1]) % PRIMES[1],
        x[2] + y[2],
    )


def fingerprints(col: pa.Array) -> np.ndarray:
    """(n, 3) fingerprints of the texts of a batch; bytes count as 1..256 so that no text is all zeros."""
    data, off = kernels.buffers(col)
    size = np.diff(off)
    chunks = np.maximum(1, -(-size // CHUNK))
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]]).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), chunks)
    # The first chunk of a text is the short one, so that every later one shifts by exactly CHUNK.
    end = off[1:][doc] - (chunks[doc] - 1 - (np.arange(len(doc)) - first[doc])) * CHUNK
    begin = np.maximum(end - CHUNK, off[:-1][doc])
    h = np.empty((len(doc), 2), np.int64)
    step = 256
    for a in range(0, len(doc), step):
        m = np.zeros((min(step, len(doc) - a), CHUNK))
        for i, (lo, hi) in enumerate(zip(begin[a : a + step].tolist(), end[a : a + step].tolist())):
            m[i, CHUNK - (hi - lo) :] = data[lo:hi]
            m[i, CHUNK - (hi - lo) :] += 1
        h[a : a + step] = (m @ _W).astype(np.int64) % np.array(PRIMES)
    out = np.empty((len(size), 3), np.int64)
    out[:, 2] = size
    for j, p in enumerate(PRIMES):
        shift = pow(BASES[j], CHUNK, p)
        acc = h[first, j].copy() if len(size) else np.zeros(0, np.int64)
        for k in range(1, int(chunks.max()) if len(chunks) else 0):
            more = np.flatnonzero(chunks > k)
            acc[more] = (acc[more] * shift + h[first[more] + k, j]) % p
        out[:, j] = acc
    return out


def _add(schema: pa.Schema | None, batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the fingerprint columns _fx_h1, _fx_h2, _fx_n (null for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in kernels.slices(batch, text):
                col = b.column(b.schema.get_field_index(text))
                fp = fingerprints(col)
                null = np.asarray(col.is_null())
                yield _add(None, b, _FP, [pa.array(fp[:, j], pa.int64(), mask=null) for j in range(3)])

    return df.mapInArrow(run, frames.with_fields(df.schema, *((c, "bigint") for c in _FP)))


def fingerprint_parts(parts: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """(key, h1, h2, n_bytes) of documents stored in parts: parts are hashed where they lie and only hashes move."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        acc = (0, 0, 0)
        for row in zip(pdf["_fx_h1"].tolist(), pdf["_fx_h2"].tolist(), pdf["_fx_n"].tolist()):
            acc = combine(acc, row)
        return pd.DataFrame([[pdf["k"].iloc[0], *acc]], columns=["k", "h1", "h2", "n_bytes"])

    kind = parts.schema[key].dataType.simpleString()
    hashed = with_fingerprint(parts.select(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(text).alias("t")).where("t is not null"), "t")
    return hashed.drop("t").groupBy("k").applyInPandas(fold, f"k {kind}, h1 bigint, h2 bigint, n_bytes bigint").withColumnRenamed("k", key)


def _same(a: memoryview, b: memoryview) -> bool:
    """Chunkwise comparison: it ends at the first chunk that differs."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _classes(df: DataFrame, keys: list[str], doc_id: str, text: str) -> DataFrame:
    """Rows, streamed by fingerprint and doc_id: those equal to an earlier one get _fx_first = false; _fx_rep is that one's doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps = None, []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            ids = batch.column(batch.schema.get_field_index(doc_id)).to_pylist()
            data, off = kernels.buffers(batch.column(batch.schema.get_field_index(text)))
            view = memoryview(data.tobytes())
            rep, first = [], []
            for i, key in enumerate(zip(*cols)):
                if key != now:
                    now, reps = key, []
                mine = view[off[i] : off[i + 1]]
                hit = next((r for r, t in reps if _same(t, mine)), reps)
                if hit is reps:
                    reps.append((ids[i], memoryview(bytes(mine))))
                    rep.append(ids[i])
                    first.append(True)
                else:
                    rep.append(hit)
                    first.append(False)
            yield _add(None, batch, ["_fx_rep", "_fx_first"], [pa.array(rep, batch.schema.field(doc_id).type), pa.array(first, pa.bool_())])

    schema = frames.with_fields(df.schema).add("_fx_rep", df.schema[doc_id].dataType).add("_fx_first", "boolean")
    return df.repartition(*keys).sortWithinPartitions(*keys, F.col(doc_id).asc_nulls_last()).mapInArrow(run, schema)


def _split(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose fingerprint is alone, and rows that may have copies (with _fx_salt and _fx_salts)."""
    hashed = with_fingerprint(docs, text)
    alone = with_fingerprint(docs.select(doc_id, text), text)
    groups = frames.written(alone.where("_fx_n is not null").groupBy(*_FP).agg(F.count(F.lit(1)).alias("_fx_count")).where("_fx_count > 1"), "exact-groups")
    groups = frames.small(groups, 64)
    unique = hashed.join(groups, _FP, "left_anti")
    salts = F.ceil(F.col("_fx_count") / FANIN)
    many = hashed.join(groups, _FP).withColumn("_fx_salts", salts).withColumn("_fx_salt", F.pmod(F.xxhash64(doc_id), F.col("_fx_salts"))).drop("_fx_count")
    return unique, many


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per removed copy: doc_id, duplicate_of (the kept row's doc_id), n_bytes."""
    _, many = _split(_narrow(docs, doc_id, text), "doc_id", "text")
    local = frames.written(_classes(many, [*_FP, "_fx_salt"], "doc_id", "text"), "exact-classes")
    tops = local.where("_fx_first and _fx_salts > 1").drop("_fx_rep", "_fx_first")
    top = frames.written(_classes(tops, _FP, "doc_id", "text").select(*_FP, "_fx_salt", "doc_id", "_fx_rep", "_fx_first"), "exact-tops")
    moved = top.select(*[F.col(c).alias(f"t{c}") for c in [*_FP, "_fx_salt"]], F.col("doc_id").alias("t_id"), F.col("_fx_rep").alias("t_rep"))
    on = [F.col(c) == F.col(f"t{c}") for c in [*_FP, "_fx_salt"]] + [F.col("_fx_rep").eqNullSafe(F.col("t_id"))]
    below = local.where("not _fx_first").drop("text").join(moved.dropDuplicates(), on, "left")
    below = below.select("doc_id", F.when(F.col("_fx_salts") > 1, F.col("t_rep")).otherwise(F.col("_fx_rep")).alias("duplicate_of"), F.col("_fx_n").alias("n_bytes"))
    return below.union(top.where("not _fx_first").selectExpr("doc_id", "_fx_rep", "_fx_n"))


@frames.shielded
def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the later copies of any text; columns as they were."""
    unique, many = _split(docs, doc_id, text)
    local = _classes(many, [*_FP, "_fx_salt"], doc_id, text).where("_fx_first").drop("_fx_rep", "_fx_first")
    local = frames.written(local, "exact-local")
    top = _classes(local.where("_fx_salts > 1"), _FP, doc_id, text).where("_fx_first")
    return unique.select(*docs.columns).union(local.where("_fx_salts = 1").select(*docs.columns)).union(top.select(*docs.columns))
