"""Near-duplicate detection by b-bit MinHash.

Each document's word 3-grams are hashed under ``PERMS`` functions; the minima form ``BANDS`` bands of ``ROWS``
values that find candidates, and only the lowest ``BITS`` bits of each minimum are kept, packed, as the
signature. Two documents of one band bucket are compared by counting equal slots with bit operations and
correcting for chance agreement: J = (m - c) / (1 - c) with c = 2**-BITS. Documents of equal signature and
bands are first collapsed, so that thousands of copies cost one entry. Within a bucket every document is
compared with every one that is not yet linked, and a spanning forest of the matches is kept, which has the
same connected components as all matching pairs. A document's group is its component; the least doc_id stays.

Defined results: a text of one or two words has one shingle of all its words; a text without words, a null text and a
null doc_id match nothing and stay; rows of one doc_id are one document, and its rows of equal text are
collapsed to one; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import frames, kernels

SHINGLE, PERMS, BANDS, ROWS, BITS = 3, 128, 32, 4, 2
THRESHOLD = 0.5
LANES = PERMS * BITS // 64

_rng = np.random.default_rng(20260101)
_A = (_rng.integers(0, 1 << 32, PERMS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)
_RECORD = np.dtype([("key", "<u8"), ("id", "<i8"), ("sig", "<u8", (LANES,))])
_CHANCE = 2.0**-BITS


def shingles(w: kernels.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the word n-grams and their bounds by document."""
    count = np.diff(w.bounds)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(grams)])
    doc = np.repeat(np.arange(len(count)), grams)
    at = w.bounds[:-1][doc] + (np.arange(len(doc)) - bounds[:-1][doc])
    have = count[doc]
    h = np.zeros(len(doc), np.uint64)
    last = max(len(w.hashes) - 1, 0)
    for j in range(n):
        term = kernels.mix64(w.hashes[np.minimum(at + j, last)] + np.uint64(j * 0x9E37)) if len(doc) else h
        h += np.where(have > j, term, np.uint64(0)) * np.uint64(2 * j + 1)
    return (kernels.mix64(h) >> np.uint64(32)).astype(np.uint32), bounds


def minima(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, PERMS) minima; rows of documents without shingles are all ones."""
    out = np.full((len(bounds) - 1, PERMS), 0xFFFFFFFF, np.uint32)
    for i in np.flatnonzero(np.diff(bounds)):
        for a in range(bounds[i], bounds[i + 1], 1024):
            x = h[a : min(a + 1024, bounds[i + 1]), None] * _A
            x += _B
            x ^= x >> np.uint32(15)
            np.minimum(out[i], x.min(axis=0), out=out[i])
    return out


def pack(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each row's minima in 64-bit lanes."""
    low = (m & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(m), m.shape[1] * bits // 64, 64 // bits)
    return (low << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64)


def mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots in which packed signatures differ (BITS = 2)."""
    x = a ^ b
    x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def similarity(miss: np.ndarray) -> np.ndarray:
    """Collision-corrected estimate of the Jaccard similarity."""
    return np.maximum(0.0, (1 - miss / PERMS - _CHANCE) / (1 - _CHANCE))


def most_mismatches(threshold: float) -> int:
    miss = np.arange(PERMS + 1)
    return int(miss[similarity(miss) >= threshold].max(initial=0))


def band_keys(m: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket keys."""
    part = m[:, : BANDS * ROWS].astype(np.uint64).reshape(len(m), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(ROWS):
        key = kernels.mix64(key * np.uint64(0x100000001B3) + part[:, :, r])
    return key


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, whole, sig, keys) of each document that has words; whole is a 128-bit digest of all minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in kernels.slices(batch, "text", kernels.SMALL_SLICE_BYTES):
                h, bounds = shingles(kernels.words_of(b.column(1)))
                m = minima(h, bounds)
                ok = (np.diff(bounds) > 0) & ~np.asarray(b.column(0).is_null())
                m = m[ok]
                ids = b.column(0).filter(pa.array(ok))
                keys, sig = band_keys(m), pack(m)
                whole = np.stack([kernels.mix64(np.cumsum(keys, axis=1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64), np.bitwise_xor.reduce(kernels.mix64(np.concatenate([keys, sig], axis=1) * (np.arange(BANDS + LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))), axis=1)], axis=1)
                blob = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), blob(whole), blob(sig), blob(keys)], ["id", "whole", "sig", "keys"])

    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "id bigint, whole binary, sig binary, keys binary")


def link(ids: np.ndarray, sigs: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the matches within one bucket (ids ascending)."""
    out, rest, queue = [], np.arange(len(ids)), []
    while len(rest):
        if queue:
            now = queue.pop()
        else:
            now, rest = rest[0], rest[1:]
        hit = mismatches(sigs[rest], sigs[now]) <= most
        if hit.any():
            found = rest[hit]
            out.append((np.full(len(found), ids[now]), ids[found]))
            queue.extend(found.tolist())
            rest = rest[~hit]
    return out


def edges(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): matches that link documents of one band bucket. sigs: one row per distinct signature."""
    n = frames.partitions(sigs.sparkSession)
    most = most_mismatches(threshold)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64)
            rec = np.empty(len(keys), _RECORD)
            rec["key"] = keys
            rec["id"] = np.repeat(b.column(0).to_numpy(), BANDS)
            rec["sig"] = np.repeat(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, LANES), BANDS, axis=0)
            yield kernels.scatter((rec["key"] % np.uint64(n)).astype(np.int64), rec, n)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec = kernels.gather(batches, _RECORD)
        rec = rec[np.lexsort((rec["id"], rec["key"]))]
        at, size = kernels.runs(rec["key"])
        two = at[size == 2]
        ok = mismatches(rec["sig"][two], rec["sig"][two + 1]) <= most
        found = [(rec["id"][two][ok], rec["id"][two + 1][ok])]
        for a, s in zip(at[size > 2], size[size > 2]):
            found += link(rec["id"][a : a + s], rec["sig"][a : a + s], most)
        a, b = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sent = sigs.select("id", "sig", "keys").mapInArrow(emit, "pid int, blob binary")
    return frames.by_id(sent, n).mapInArrow(match, "a bigint, b bigint").where("a <> b").distinct()


def _decide(docs: DataFrame, threshold: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The signature table, and (node, root) of every document in a group of two or more."""
    sigs = frames.written(signatures(docs, doc_id, text), "minhash")
    same = sigs.groupBy("whole").agg(F.min("id").alias("root"), F.min_by("sig", "id").alias("sig"), F.min_by("keys", "id").alias("keys"), F.count(F.lit(1)).alias("n"))
    same = frames.written(same, "minhash-distinct")
    near = edges(same.selectExpr("root AS id", "sig", "keys"), threshold)
    copies = sigs.select("id", "whole").join(same.where("n > 1").select("whole", "root"), "whole").where("id <> root").selectExpr("root AS a", "id AS b")
    return sigs, components(near.union(copies))


def duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per removed document: doc_id, duplicate_of (the kept document of its group), similarity (estimate for the two)."""
    sigs, groups = _decide(docs, threshold, doc_id, text)
    sig = sigs.groupBy("id").agg(F.min("sig").alias("sig"))
    pairs = groups.where("node <> root").join(sig.selectExpr("id AS node", "sig"), "node").join(sig.selectExpr("id AS root", "sig AS root_sig"), "root")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, LANES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(similarity(mismatches(x, y)), 6))], ["doc_id", "duplicate_of", "similarity"])

    return pairs.select("node", "root", "sig", "root_sig").mapInArrow(estimate, "doc_id bigint, duplicate_of bigint, similarity double")


@frames.shielded
def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group; columns as they were."""
    sigs, groups = _decide(docs, threshold, doc_id, text)
    gone = groups.where("node <> root").select(F.col("node").alias("_fx_id"), F.lit(True).alias("_fx_gone"))
    again = sigs.groupBy("id").count().where("count > 1").select(F.col("id").alias("_fx_id"))
    marks = frames.written(again.join(gone, "_fx_id", "full").select("_fx_id", F.coalesce("_fx_gone", F.lit(False)).alias("_fx_gone")), "minhash-marks")
    out = docs.join(frames.small(marks, 40), docs[doc_id].cast("bigint") == F.col("_fx_id"), "left")
    plain = out.where("_fx_id is null").select(*docs.columns)
    repeated = out.where("_fx_id is not null and not _fx_gone").select(*docs.columns)
    return plain.union(repeated.dropDuplicates([doc_id, text]))
