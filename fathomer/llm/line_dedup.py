r"""Line deduplication by an exact set-similarity join.

A line (split at \n) is the set of its words; lines of equal sets form a class, which its earliest line (by doc_id, then line
number) represents. A link is a pair of sets with a Jaccard similarity >= t; sets that hang together by links are a group.
``linked_lines`` returns one row per line that has a copy or a link, with its group and its number of links, so its size follows the lines
and not the links. ``similar_lines`` spells the links out: each further line of a class with its representative (jaccard 1), and each pair
of representatives, later line first. A line is removed if any earlier line is similar; ``removed_lines`` gives one earlier line of each.

Tokens are put in one global order, rare ones first, by counts over all documents in ``BUCKETS``
hashed counters (any fixed total order keeps the join exact; collisions only cost speed). Similar lines share a token
within their prefixes, so only prefix tokens are posted. Postings meet by token; lines of a class are collapsed to their
representative; pairs are cut by length, by position and by a bound on
the symmetric difference from 128-bit parity bitmaps, and the rest are verified on full token sets. Nothing else is left out.

The links within a large group of near copies grow with its square. ``linked_lines`` therefore moves no pairs: each partition of postings replaces its candidate
pairs by a spanning forest, and each component of those gathers its full sets in one place, where all its pairs are verified and counted.
A component of more than ``BLOCK`` sets is compared by prefix token instead, each pair at the first token that both hold.

Which line ``removed_lines`` names: the first line with the same words, if an earlier one exists; else the earliest similar line.

No more than ``BLOCK`` postings of a token, or sets of one place, are compared in one task: pairs of blocks are spread over all tasks.

Defined results: lines without words are never removed and remove nothing; documents with null text or null doc_id
likewise; rows of one doc_id are one document, so its equal line numbers don't match each other (where they hold different texts, a line number may
have a row for each of its sets); an empty table gives no rows; other columns are not read.
Tokens and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, forest
from . import frames, kernels

THRESHOLD = 0.85
BUCKETS = 1 << 18
_RANGES = 64

#: Tokens are cut to 32 bits within postings: a false meeting only costs a check. Sets keep 64 bits, as members of a class aren't verified.
_POSTING = np.dtype([("key", "<u4"), ("sid", "<u8"), ("bits", "<u8", (2,)), ("doc", "<i8"), ("line", "<u4"), ("n", "<u4"), ("pos", "<u4")])
_SEED = np.random.default_rng(3).integers(1 << 62, 1 << 63, dtype=np.uint64) | np.uint64(1)
#: Distinct postings of one token that are compared within its task. A token with more is cut into blocks of this size; pairs of blocks
#: whose lengths allow a match are dealt to all tasks. PASS_BYTES of postings are sorted at a time.
BLOCK, PASS_BYTES = 20_000, 256 << 20
_COLUMNS = "doc bigint, line int, sid bigint, match_doc bigint, match_line int, match_sid bigint, same boolean"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
_NAMES = ["doc", "line", "sid", "match_doc", "match_line", "match_sid", "same"]
_UNIT = "pid int, x binary, y binary"
#: Sets to compare: those of one gid with each other. alone: no other line has this set; pos: the place of the token that gid stands for, or -1.
_SETS = "gid bigint, sid bigint, doc bigint, line int, alone boolean, pos int, tokens array<bigint>"
_SET_FIELDS = pa.schema([("gid", pa.int64()), ("sid", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("alone", pa.bool_()), ("pos", pa.int32()), ("tokens", pa.list_(pa.int64()))])
_LINKS = "sid bigint, root bigint, doc bigint, line int, links bigint, match_doc bigint, match_line int, jaccard double"
_LINK_FIELDS = pa.schema([("sid", pa.int64()), ("root", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("links", pa.int64()), ("match_doc", pa.int64()), ("match_line", pa.int32()), ("jaccard", pa.float64())])
#: Rows of small groups that are compared in one step, and cells of a table of counts.
_TOGETHER, _CELLS, _FOLD = 256, 1 << 22, 1 << 20


def _lines(w: kernels.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and line number of each word, and a number that grows with every line of the batch."""
    row = w.docs()
    nl = np.zeros(len(w.data) + 1, np.int32)
    np.cumsum(w.data == 10, out=nl[1:])
    at = nl[w.starts]
    return row, at - nl[w.off[:-1]][row], at + row


def _tokens(b: pa.RecordBatch, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens by line in global order: key, row, line number and hash of each."""
    w = kernels.words_of(b.column(1))
    row, line, whole = _lines(w)
    key = _order_key(w.hashes, count)
    order = np.argsort(key)
    part = whole[order]
    order = order[np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")]
    key, whole = key[order], whole[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    keep = order[new]
    return key[new], row[keep], line[keep], w.hashes[keep]


def _order_key(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    seen = np.minimum(count[(h % np.uint64(BUCKETS)).astype(np.int64)], (1 << 20) - 1).astype(np.uint64)
    return (seen << np.uint64(44)) | (h >> np.uint64(20))


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _pid(key: np.ndarray, n: int) -> np.ndarray:
    return (kernels.mix64(key) % np.uint64(n)).astype(np.int64)  # mixed again: independent of the key's own bits


def _pairs(x: np.ndarray, y: np.ndarray, same: bool) -> pa.RecordBatch:
    swap = _before(x, y)
    late, early = np.where(swap, y, x), np.where(swap, x, y)
    ok = (late["doc"] != early["doc"]) | (late["line"] != early["line"])
    late, early = late[ok], early[ok]
    sides = [c for r in (late, early) for c in (pa.array(r["doc"]), pa.array(r["line"].astype(np.int32)), pa.array(r["sid"].astype(np.int64)))]
    return pa.RecordBatch.from_arrays([*sides, pa.array(np.full(len(late), same))], _NAMES)


def _before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x["doc"] < y["doc"]) | ((x["doc"] == y["doc"]) & (x["line"] < y["line"]))


def _again(rec: np.ndarray) -> np.ndarray:
    """Records with the key, size and set of the one before."""
    out = np.zeros(len(rec), bool)
    out[1:] = (rec["key"][1:] == rec["key"][:-1]) & (rec["n"][1:] == rec["n"][:-1]) & (rec["sid"][1:] == rec["sid"][:-1])
    out[1:] &= (rec["bits"][1:] == rec["bits"][:-1]).all(axis=1)
    return out


def _set_ids(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each line's distinct words."""
    return np.add.reduceat(kernels.mix64(h ^ _SEED), start)


def word_counts(docs: DataFrame) -> np.ndarray:
    """The counts of words over all documents, in BUCKETS hashed counters."""
    n_parts = frames.partitions(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in kernels.slices(batch, "text"):
                total += np.bincount((kernels.words_of(b.column(1)).hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        r = np.arange(_RANGES, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(r % n_parts), pa.array(r), pa.array([p.tobytes() for p in total.reshape(_RANGES, -1)], pa.binary())], ["pid", "r", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            for r, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                sums[r] = sums.get(r, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["r", "c"])

    sent = docs.mapInArrow(emit, "pid int, r int, c binary")
    got = frames.by_id(sent, n_parts).mapInArrow(add, "r int, c binary").toArrow()  # BUCKETS numbers
    out = np.zeros((_RANGES, BUCKETS // _RANGES), np.int64)
    for r, c in zip(got.column("r").to_pylist(), got.column("c").to_pylist()):
        out[r] = np.frombuffer(c, np.int64)
    return out.reshape(-1)


def _shared(rec: np.ndarray) -> np.ndarray:
    """Records whose key occurs more than once."""
    key = np.sort(rec["key"])
    more = np.unique(key[1:][key[1:] == key[:-1]])
    if len(more) == 0:
        return rec[:0]
    at = np.minimum(np.searchsorted(more, rec["key"]), len(more) - 1)
    return rec[more[at] == rec["key"]]


def _met(docs: DataFrame, sent: Broadcast, t: float, stars: bool) -> DataFrame:
    """Members of classes with their representatives (same), and pairs of representatives that may be similar; with stars, not the pairs
    but each representative that has any, with one of its component, by partition."""
    n_parts, block = frames.partitions(docs.sparkSession), BLOCK

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in kernels.slices(batch, "text"):
                key, row, line, h = _tokens(b, sent.value)
                if len(key) == 0:
                    continue
                start, n = kernels.runs(row * np.int64(1 << 32) + line)
                p = prefix_length(n, t)
                of = np.repeat(np.arange(len(n)), p)
                pos = np.arange(len(of)) - np.repeat(np.cumsum(p) - p, p)
                at = start[of] + pos
                rec = np.empty(len(of), _POSTING)
                bit = np.uint64(1) << (h & np.uint64(63))
                upper = (h & np.uint64(64)) != 0
                for half in (0, 1):
                    rec["bits"][:, half] = np.bitwise_xor.reduceat(np.where(upper == bool(half), bit, np.uint64(0)), start)[of]
                mixed = kernels.mix64(key[at])
                rec["key"], rec["sid"] = mixed >> np.uint64(32), _set_ids(h, start)[of]
                rec["doc"], rec["line"] = b.column(0).to_numpy()[row[at]], line[at]
                rec["n"], rec["pos"] = n[of], pos
                yield kernels.scatter(_pid(mixed, n_parts), rec, n_parts)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [blob for b in batches for blob in b.column(1).to_pylist()]
        passes = 1 + sum(map(len, blobs)) // PASS_BYTES
        for i in range(passes):
            parts = [np.zeros(0, _POSTING), *(r if passes == 1 else r[r["key"] % passes == i] for r in (kernels.unpack(x, _POSTING) for x in blobs))]
            if i + 1 == passes:
                blobs.clear()
            rec = np.concatenate(parts)
            del parts
            found = _joined(rec, t, n_parts, block)
            yield from _stars(found) if stars else found

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    one = kernels.unpack(x, _POSTING)
                    yield from map(_full, _block_pairs(one, one if y is None else kernels.unpack(y, _POSTING), y is None, t))

        for b in _stars(found()) if stars else found():
            yield b.select(_NAMES)

    postings = docs.mapInArrow(emit, "pid int, blob binary")
    met = frames.written(frames.by_id(postings, n_parts).mapInArrow(pair, f"{_COLUMNS}, {_UNIT}"), "line-met")
    hot = frames.by_id(met.where("pid is not null").select("pid", "x", "y"), n_parts).mapInArrow(across, _COLUMNS)
    return met.where("pid is null").drop("pid", "x", "y").union(hot)


def join_pairs(docs: DataFrame, count: np.ndarray, t: float) -> DataFrame:
    """Members of classes with their representatives (same), and pairs of representatives that may be similar."""
    return _met(docs, docs.sparkSession.sparkContext.broadcast(count), t, False).distinct()  # the broadcast is of fixed size


def _full(p: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*p.columns, pa.nulls(p.num_rows, pa.int32()), pa.nulls(p.num_rows, pa.binary()), pa.nulls(p.num_rows, pa.binary())], [*p.schema.names, "pid", "x", "y"])


def _stars(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_joined`` gives, with its pairs replaced by stars: each set with the least one of its component, itself included. Sets, not pairs, are held."""
    sid, root, doc, line = (np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int32))
    held, size = [], 0

    def fold() -> tuple[np.ndarray, ...]:
        a, b = (np.concatenate([x, *(p.column(c).to_numpy() for p in held)]) for x, c in ((sid, 2), (root, 5)))
        node, least = forest(a, b)
        where = [np.concatenate([x, *(p.column(c).to_numpy() for p in held), *(p.column(c + 3).to_numpy() for p in held)]) for x, c in ((doc, 0), (line, 1))]
        _, at = np.unique(np.concatenate([a, *(p.column(5).to_numpy() for p in held)]), return_index=True)
        return node, least, where[0][at], where[1][at]

    for p in found:
        if p.column(0).null_count or (p.num_rows and p.column(6)[0].as_py()):
            yield p
            continue
        held.append(p)
        size += p.num_rows
        if size > _FOLD:
            (sid, root, doc, line), held, size = fold(), [], 0
    sid, root, doc, line = fold()
    none = pa.nulls(len(sid), pa.int64()), pa.nulls(len(sid), pa.int32())
    yield _full(pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line), pa.array(sid), *none, pa.array(root), pa.array(np.zeros(len(sid), bool))], _NAMES))


def _joined(rec: np.ndarray, t: float, n_parts: int, block: int) -> Iterator[pa.RecordBatch]:
    """Members of classes and candidate pairs of the postings of some tokens; of tokens with more than ``block`` distinct postings, pairs of blocks (pid, x, y)."""
    rec = _shared(rec)
    rec = rec[np.lexsort((rec["line"], rec["doc"], rec["sid"], rec["n"], rec["key"]))]
    if len(rec) == 0:
        return
    again = _again(rec)
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(rec))))
    repeat = np.zeros(len(rec), bool)  # a row of documents that is there twice
    repeat[1:] = (rec["doc"][1:] == rec["doc"][:-1]) & (rec["line"][1:] == rec["line"][:-1])
    copy = np.flatnonzero(again & ~repeat & (rec["pos"] == 0))
    yield _full(_pairs(rec[copy], rec[first[copy]], True))
    rec = rec[~again]
    at, size = kernels.runs(rec["key"])
    for a, s in zip(at[size > block].tolist(), size[size > block].tolist()):
        yield from _units(rec[a : a + s], t, n_parts, block)
    rec = rec[np.repeat(size <= block, size)]
    key, n, pos = rec["key"], rec["n"].astype(np.int64), rec["pos"].astype(np.int64)
    act, d = np.arange(max(0, len(rec) - 1)), 1
    while len(act):
        j = act + d
        near = (key[act] == key[j]) & (n[act] >= t * n[j] - 1e-9)
        act, j = act[near], j[near]
        a, b = act, j
        most = np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b])
        ok = most * (1 + t) >= t * (n[a] + n[b]) - 1e-6
        a, b = a[ok], b[ok]
        differ = np.bitwise_count(rec["bits"][a] ^ rec["bits"][b]).sum(axis=1, dtype=np.int64)
        ok = differ * (1 + t) <= (1 - t) * (n[a] + n[b]) + 1e-6
        if ok.any():
            yield _full(_pairs(rec[a[ok]], rec[b[ok]], False))
        d += 1
        act = act[act + d < len(rec)]


def _units(rec: np.ndarray, t: float, n_parts: int, block: int) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of one token's postings (by length), without those whose lengths rule a match out."""
    blocks = [rec[a : a + block] for a in range(0, len(rec), block)]
    blobs = [np.ascontiguousarray(b.view(np.uint8).reshape(len(b), -1).T).tobytes() for b in blocks]
    none = [pa.nulls(1, k) for k in _TYPES]
    for i in range(len(blocks)):
        for j in range(i, len(blocks)):
            if blocks[i]["n"][-1] < t * blocks[j]["n"][0] - 1e-9:
                break
            pid = int(kernels.mix64(np.array([(int(rec["key"][0]) << 24) + (i << 12) + j], np.uint64))[0] % np.uint64(n_parts))
            pair = [pa.array([pid], pa.int32()), pa.array([blobs[i]]), pa.array([None if i == j else blobs[j]], pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, *pair], [*_NAMES, "pid", "x", "y"])


def _block_pairs(x: np.ndarray, y: np.ndarray, same: bool, t: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs between two blocks of one token's postings, in tiles."""
    n, pos = y["n"].astype(np.int64), y["pos"].astype(np.int64)
    for at in range(0, len(x), 64):
        tile = x[at : at + 64]
        m, p = tile["n"].astype(np.int64)[:, None], tile["pos"].astype(np.int64)[:, None]
        most = np.minimum(p, pos) + np.minimum(m - p, n - pos)
        ok = (m >= t * n - 1e-9) & (most * (1 + t) >= t * (m + n) - 1e-6)
        if same:
            ok &= np.arange(len(y)) > np.arange(at, at + len(tile))[:, None]
        i, j = np.nonzero(ok)
        a, b = tile[i], y[j]
        differ = np.bitwise_count(a["bits"] ^ b["bits"]).sum(axis=1, dtype=np.int64)
        ok = differ * (1 + t) <= (1 - t) * (a["n"].astype(np.int64) + b["n"]) + 1e-6
        if ok.any():
            yield _pairs(a[ok], b[ok], False)


def _sets(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(sid, tokens) of the lines that refs names."""
    wanted = frames.written(refs.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines")), "line-refs")
    some = docs.join(frames.small(wanted, 80), docs["doc_id"] == F.col("doc")).select("doc", "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in kernels.slices(batch, "text"):
                _, row, line, h = _tokens(b, none)
                start, n = kernels.runs(row * np.int64(1 << 32) + line)
                lines = b.column(2)
                code = row[start] * np.int64(1 << 32) + line[start]
                ask = np.repeat(np.arange(b.num_rows), np.diff(lines.offsets.to_numpy())) * np.int64(1 << 32) + lines.flatten().to_numpy().astype(np.int64)
                hit = np.flatnonzero(np.isin(code, ask))
                size = n[hit]
                ends = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(start[hit] - ends[:-1], size) + np.arange(ends[-1])
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[at].astype(np.int64)))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(_set_ids(h, start)[hit].astype(np.int64)), sets], ["sid", "tokens"])

    return some.mapInArrow(run, "sid bigint, tokens array<bigint>").dropDuplicates(["sid"])


def _verified(docs: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """Pairs with jaccard >= t."""
    sets = frames.written(_sets(docs, pairs.select("doc", "line").union(pairs.select("match_doc", "match_line"))), "line-sets")
    a, b = sets.selectExpr("sid", "tokens AS x"), sets.selectExpr("sid AS match_sid", "tokens AS y")
    common = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(a, "sid").join(b, "match_sid").withColumn("common", common)
    joined = joined.withColumn("jaccard", F.col("common") / (F.size("x") + F.size("y") - F.col("common"))).where(F.col("jaccard") >= t - 1e-12)
    return joined.select("doc", "line", "match_doc", "match_line", "jaccard")


def similar_lines(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per link: doc_id, line_no (from 0), match_doc_id, match_line_no, jaccard."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    met = frames.written(join_pairs(narrow, word_counts(narrow), threshold), "line-pairs")
    members = met.where("same").selectExpr("doc", "line", "match_doc", "match_line", "cast(1 as double) AS jaccard")
    every = members.union(_verified(narrow, met.where("not same"), threshold))
    links = every.groupBy("doc", "line", "match_doc", "match_line").agg(F.max("jaccard").alias("jaccard"))  # rows of one doc_id are one document
    return links.select(F.col("doc").alias("doc_id"), F.col("line").alias("line_no"), F.col("match_doc").alias("match_doc_id"), F.col("match_line").alias("match_line_no"), F.round("jaccard", 6).alias("jaccard"))


def _group_sets(docs: DataFrame, groups: DataFrame, sent: Broadcast, t: float) -> DataFrame:
    """The full sets of ``groups`` (sid, doc, line, root, alone, big) in global order, to the place where they are compared: root, or, if that is big, each token of the prefix."""
    asks = F.collect_list(F.struct("line", "sid", "root", "alone", "big"))
    wanted = frames.written(groups.groupBy("doc").agg(asks.alias("asks")), "line-asks")
    some = docs.join(frames.small(wanted, 120), docs["doc_id"] == F.col("doc")).select("doc", "text", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in kernels.slices(batch, "text"):
                key, row, line, h = _tokens(b, sent.value)
                start, n = kernels.runs(row * np.int64(1 << 32) + line)
                if len(n) == 0:
                    continue
                asks = b.column(2)
                of = np.repeat(np.arange(b.num_rows), np.diff(asks.offsets.to_numpy()))
                ask_line, ask_sid, root, alone, big = (c.to_numpy(zero_copy_only=False) for c in asks.flatten().flatten())
                # a line of the number and the set that are asked for
                want = kernels.mix64((of * np.int64(1 << 32) + ask_line).view(np.uint64)) + ask_sid.view(np.uint64)
                order = np.argsort(want)
                sid = _set_ids(h, start)
                have = kernels.mix64((row[start] * np.int64(1 << 32) + line[start]).view(np.uint64)) + sid
                at = order[np.minimum(np.searchsorted(want[order], have), len(want) - 1)]
                hit = np.flatnonzero(want[at] == have)
                at = at[hit]
                p = np.where(big[at], prefix_length(n[hit], t), 1)
                each = np.repeat(np.arange(len(hit)), p)
                pos = np.arange(len(each)) - np.repeat(np.cumsum(p) - p, p)
                hit, at = hit[each], at[each]
                by_token = kernels.mix64(key[start[hit] + pos] + kernels.mix64(root[at].view(np.uint64))).view(np.int64)
                size = n[hit]
                ends = np.concatenate([[0], np.cumsum(size)])
                tokens = h[np.repeat(start[hit] - ends[:-1], size) + np.arange(ends[-1])].view(np.int64)
                columns = [np.where(big[at], by_token, root[at]), sid[hit].view(np.int64), b.column(0).to_numpy()[row[start[hit]]], line[start[hit]].astype(np.int32), alone[at], np.where(big[at], pos, -1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens))], schema=_SET_FIELDS)

    return some.mapInArrow(run, _SETS)


@dataclass
class _Sets:
    """Rows of _SETS as arrays; tokens of different gids differ."""

    gid: np.ndarray
    sid: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    alone: np.ndarray
    pos: np.ndarray
    n: np.ndarray
    row: np.ndarray
    token: np.ndarray
    early: np.ndarray

    @staticmethod
    def of(b: pa.RecordBatch) -> _Sets:
        gid, sid, doc, line, alone, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        off = b.column(6).offsets.to_numpy()
        n = np.diff(off).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        token = kernels.mix64(b.column(6).flatten().to_numpy().view(np.uint64) + kernels.mix64(gid.view(np.uint64))[row])
        early = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < pos[row]  # before the token that gid stands for
        return _Sets(gid, sid, doc, line, alone, pos, n, row, token, early)


def _common(x: _Sets, y: _Sets, early: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of tokens that rows of x share with all rows of y, as (first row of x, table)."""
    xr, xt, yr, yt = (a[s.early] if early else a for s in (x, y) for a in (s.row, s.token))
    token, code = np.unique(yt, return_inverse=True)
    rows = yr[np.argsort(code, kind="stable")]
    size = np.bincount(code, minlength=len(token) + 1)
    begin = np.cumsum(size) - size
    at = np.searchsorted(token, xt)
    at[at < len(token)] = np.where(token[at[at < len(token)]] == xt[at < len(token)], at[at < len(token)], len(token))  # the last has no rows
    m, step = len(y.n), max(1, _CELLS // max(1, len(y.n)))
    for lo in range(0, len(x.n), step):
        hi = min(lo + step, len(x.n))
        a, b = np.searchsorted(xr, [lo, hi])
        table = np.zeros((hi - lo) * m, np.int64)
        while a < b:
            ends = np.cumsum(size[at[a:b]])
            c = a + max(1, int(np.searchsorted(ends, 2 * _CELLS, "right")))
            s = size[at[a:c]]
            which = np.repeat(begin[at[a:c]] - np.cumsum(s) + s, s) + np.arange(s.sum())
            table += np.bincount(np.repeat((xr[a:c] - lo) * m, s) + rows[which], minlength=len(table))
            a = c
        yield lo, table.reshape(hi - lo, m)


def _hits(x: _Sets, y: _Sets, same: bool, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of x, row of y and Jaccard similarity of each pair at or above t; pairs that meet at an earlier token are left to that one."""
    before = _common(x, y, True) if (x.pos >= 0).any() else None
    for lo, table in _common(x, y):
        ok = table * (1 + t) >= t * (x.n[lo : lo + len(table), None] + y.n) - 1e-6
        if before is not None:
            ok &= next(before)[1] == 0
        if same:
            ok &= np.arange(len(y.n)) > np.arange(lo, lo + len(table))[:, None]
        i, j = np.nonzero(ok)
        common = table[i, j]
        i += lo
        jaccard = common / (x.n[i] + y.n[j] - common)
        ok = jaccard >= t - 1e-12
        yield i[ok], j[ok], jaccard[ok]


def _linked(x: _Sets, y: _Sets | None, t: float) -> pa.RecordBatch:
    """The rows of x (and of y: links between the two) that have links, as rows of _LINKS: their number, the earliest earlier line, and the least set of those that hang together."""
    sid, doc, line, alone = (a if y is None else np.concatenate([a, b]) for a, b in ((getattr(x, k), y and getattr(y, k)) for k in ("sid", "doc", "line", "alone")))
    rank = np.empty(len(sid), np.int64)
    rank[np.lexsort((sid, line, doc))] = np.arange(len(sid))
    links, best, jaccard = np.zeros(len(sid), np.int64), np.full(len(sid), len(sid)), np.zeros(len(sid))
    node, root, held, size = np.arange(len(sid)), np.arange(len(sid)), [], 0
    for i, j, jac in _hits(x, x if y is None else y, y is None, t):
        j = j + (0 if y is None else len(x.sid))
        level = (doc[i] == doc[j]) & (line[i] == line[j])
        ok = ~(level & alone[i] & alone[j])  # one line of one document
        i, j, jac, level = i[ok], j[ok], jac[ok], level[ok]
        links += np.bincount(i, minlength=len(sid)) + np.bincount(j, minlength=len(sid))
        held.append((i, j))
        size += len(i)
        if size > _FOLD:
            (node, root), held, size = forest(*(np.concatenate([a, *b]) for a, b in zip((node, root), zip(*held)))), [], 0
        i, j, jac = i[~level], j[~level], jac[~level]
        late, early = np.where(rank[i] > rank[j], i, j), np.minimum(rank[i], rank[j])
        order = np.lexsort((early, late))
        late, early, jac = late[order], early[order], jac[order]
        at, _ = kernels.runs(late)
        at = at[early[at] < best[late[at]]]
        best[late[at]], jaccard[late[at]] = early[at], jac[at]
    if held:
        node, root = forest(*(np.concatenate([a, *b]) for a, b in zip((node, root), zip(*held))))
    has = links > 0
    by_rank = np.append(np.argsort(rank), 0)
    none = best[has] == len(sid)
    match = by_rank[best[has]]
    columns = [pa.array(a) for a in (sid[has], sid[root][has], doc[has], line[has], links[has])] + [pa.array(a, mask=none) for a in (doc[match], line[match], jaccard[has])]
    return pa.RecordBatch.from_arrays(columns, schema=_LINK_FIELDS)


def _links(sets: DataFrame, t: float) -> DataFrame:
    """Rows of _LINKS for the sets that have links; one that is compared in several places has a row of each."""
    n_parts, block = frames.partitions(sets.sparkSession), BLOCK
    units = pa.schema([*_LINK_FIELDS, ("pid", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = pa.concat_tables([_SET_FIELDS.empty_table(), *(pa.Table.from_batches([b]).cast(_SET_FIELDS) for b in batches)]).combine_chunks()
        if all_.num_rows == 0:
            return
        gid, sid = (all_.column(c).to_numpy() for c in ("gid", "sid"))
        n = np.diff(all_.column("tokens").chunk(0).offsets.to_numpy())
        order = np.lexsort((sid, n, gid))
        new = np.ones(len(order), bool)
        new[1:] = (gid[order][1:] != gid[order][:-1]) | (sid[order][1:] != sid[order][:-1])
        order = order[new]
        whole = all_.take(pa.array(order)).combine_chunks().to_batches()[0]
        gid, n = gid[order], n[order]
        at, size = kernels.runs(gid)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(at + size, at[lo] + min(_TOGETHER, block), "right")))
            a, b = int(at[lo]), int(at[hi - 1] + size[hi - 1])
            if b - a <= max(block, 1):
                got = _linked(_Sets.of(whole.slice(a, b - a)), None, t)
                yield pa.RecordBatch.from_arrays([*got.columns, *(pa.nulls(got.num_rows, k) for k in units.types[-3:])], schema=units)
            else:
                parts = [(c, min(c + block, b)) for c in range(a, b, block)]
                blobs = [whole.slice(c, d - c).serialize().to_pybytes() for c, d in parts]
                for i in range(len(parts)):
                    for j in range(i, len(parts)):
                        if n[parts[i][1] - 1] < t * n[parts[j][0]] - 1e-9:
                            break
                        pid = int(kernels.mix64(gid[a : a + 1].view(np.uint64) + np.uint64((i << 20) + j))[0] % np.uint64(n_parts))
                        pair = [pa.array([pid], pa.int32()), pa.array([blobs[i]], pa.binary()), pa.array([None if i == j else blobs[j]], pa.binary())]
                        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in _LINK_FIELDS.types), *pair], schema=units)
            lo = hi

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: _Sets.of(pa.ipc.read_record_batch(pa.py_buffer(x), _SET_FIELDS))
        for b in batches:
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                yield _linked(read(x), None if y is None else read(y), t)

    met = frames.written(sets.repartition(n_parts, "gid").mapInArrow(compare, f"{_LINKS}, {_UNIT}"), "line-links")
    hot = frames.by_id(met.where("pid is not null").select("pid", "x", "y"), n_parts).mapInArrow(across, _LINKS)
    return met.where("pid is null").drop("pid", "x", "y").union(hot)


def linked_lines(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line that has a copy or a link: doc_id, line_no (from 0); set_doc_id, set_line_no: the first line of the same set of words; copies:
    the number of other lines of that set; group_doc_id, group_line_no: the first line of its group; links: the number of other sets that are similar;
    match_doc_id, match_line_no, jaccard: the line for which it is removed, if it is."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    sent = docs.sparkSession.sparkContext.broadcast(word_counts(narrow))  # of fixed size
    met = frames.written(_met(narrow, sent, threshold, True), "line-stars")
    members = met.where("same").selectExpr("sid", "doc", "line", "match_doc AS set_doc", "match_line AS set_line")
    copies = members.groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("set_doc").alias("copy_doc"), F.min("set_line").alias("copy_line"))
    stars = met.where("not same").select("sid", "match_sid", "doc", "line")
    roots = frames.written(components(stars.selectExpr("sid AS a", "match_sid AS b")).withColumnRenamed("node", "sid"), "line-roots")
    big = roots.groupBy("root").count().where(F.col("count") > BLOCK).select("root", F.lit(True).alias("big"))
    groups = stars.groupBy("sid").agg(F.min(F.struct("doc", "line")).alias("at")).select("sid", "at.doc", "at.line").join(roots, "sid").join(big, "root", "left").join(copies, "sid", "left")
    groups = groups.select("sid", "doc", "line", "root", F.col("copies").isNull().alias("alone"), F.coalesce("big", F.lit(False)).alias("big"))
    found = frames.written(_links(_group_sets(narrow, groups, sent, threshold), threshold), "line-found")
    match = F.min(F.when(F.col("match_doc").isNotNull(), F.struct("match_doc", "match_line", "jaccard"))).alias("m")
    each = found.groupBy("sid").agg(F.min("doc").alias("doc"), F.min("line").alias("line"), F.sum("links").alias("links"), match)
    each = each.join(components(found.selectExpr("sid AS a", "root AS b")).withColumnRenamed("node", "sid"), "sid")
    heads = each.groupBy("root").agg(F.min(F.struct("doc", "line")).alias("head"))
    sets = each.join(heads, "root").join(copies, "sid", "full")
    doc, line = F.coalesce("doc", "copy_doc"), F.coalesce("line", "copy_line")
    sets = sets.select("sid", doc.alias("set_doc_id"), line.alias("set_line_no"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("head.doc", doc).alias("group_doc_id"), F.coalesce("head.line", line).alias("group_line_no"), F.coalesce("links", F.lit(0)).alias("links"), "m")
    sets = frames.written(sets, "line-sets")
    common = ["set_doc_id", "set_line_no", "copies", "group_doc_id", "group_line_no", "links"]
    first = sets.select(F.col("set_doc_id").alias("doc_id"), F.col("set_line_no").alias("line_no"), *common, F.col("m.match_doc").alias("match_doc_id"), F.col("m.match_line").alias("match_line_no"), F.round("m.jaccard", 6).alias("jaccard"))
    rest = members.select("sid", "doc", "line").join(sets.drop("m"), "sid")
    rest = rest.select(F.col("doc").alias("doc_id"), F.col("line").alias("line_no"), *common, F.col("set_doc_id").alias("match_doc_id"), F.col("set_line_no").alias("match_line_no"), F.lit(1.0).alias("jaccard"))
    return first.union(rest)


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per removed line: doc_id, line_no (from 0), match_doc_id, match_line_no, jaccard."""
    link = F.struct((F.col("jaccard") < 1).alias("other"), "match_doc_id", "match_line_no", "jaccard")
    best = linked_lines(docs, threshold, doc_id, text).where("match_doc_id is not null").groupBy("doc_id", "line_no").agg(F.min(link).alias("m"))
    return best.select("doc_id", "line_no", "m.match_doc_id", "m.match_line_no", "m.jaccard")


@frames.shielded
def without_lines(docs: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed lines cut from their texts; columns as they were."""
    gone = removed.groupBy(F.col("doc_id").alias("_fx_id")).agg(F.collect_set("line_no").alias("_fx_lines"))
    out = docs.join(gone, docs[doc_id].cast("bigint") == F.col("_fx_id"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_fx_lines", i)), "\n")
    return out.withColumn(text, F.when(F.col("_fx_lines").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
