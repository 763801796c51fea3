"""Vectorised text kernels shared by the operators of this package.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the text, lower-cased for ASCII
and for the two-byte letters U+00C0..U+00DE. Unicode spaces and punctuation (Latin-1, general, CJK and full-width) are gaps like ASCII
ones, and each character of a script that is written without spaces (Han, Kana, Thai, Lao, Khmer, Burmese) is a word of its own, so that word
n-grams there are character n-grams. All hashing runs on the Arrow
buffer of a whole batch, so no Python object is made per word. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
SLICE_BYTES = 4 << 20
#: For operators that hold many numbers for each word.
SMALL_SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Three-byte leads of which every character is a word of its own or a gap.
_LEAD = np.zeros(256, bool)
_LEAD[0xE3:0xEA] = True
_GAPS = "\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u3004\u3008-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_SOLO = "\u3005-\u3007\u3040-\u9fff\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff"
_powers: dict[str, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        if size <= 1 << 22:
            _powers[str(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S29)
    x = x * _M2
    return x ^ (x >> _S33)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n+1 offsets of its values; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0 or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    if col.null_count:
        col = col.fill_null("" if "string" in str(col.type) else b"")
        if col.buffers()[2] is None:
            return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of at most ``most`` bytes of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    if len(low) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        nxt = data[lead]
        lead = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)]
        low[lead] += 32
    return low


def _wide(part: np.ndarray, w: np.ndarray, first: np.ndarray) -> None:
    """Unmark gaps beyond ASCII in w; mark in first where characters of unsegmented scripts begin and end."""
    at = np.flatnonzero(part >= 0xC2)
    lead = part[at]
    two = at[lead == 0xC2]
    nxt = part[two + 1]
    two = two[(nxt >= 0xA0) & (nxt != 0xAA) & (nxt != 0xB5) & (nxt != 0xBA)]
    w[two] = w[two + 1] = False
    at = at[(lead >= 0xE0) & (lead <= 0xEF)]
    if len(at) == 0:
        return
    lead, nxt, last = part[at], part[at + 1], part[at + 2]
    gap = (lead == 0xE2) & ((nxt == 0x80) | ((nxt == 0x81) & (last <= 0xAF)))
    gap |= (lead == 0xE3) & (nxt == 0x80) & ((last < 0x85) | (last > 0x87))
    gap |= (lead == 0xEF) & (nxt == 0xBC) & (((last >= 0x81) & (last <= 0x8F)) | ((last >= 0x9A) & (last <= 0xA0)) | (last >= 0xBB))
    gap |= (lead == 0xEF) & (nxt == 0xBD) & ((last == 0x80) | ((last >= 0x9B) & (last <= 0xA5)))
    none = at[gap]
    w[none] = w[none + 1] = w[none + 2] = False
    solo = (_LEAD[lead] & ~gap) | ((lead == 0xE0) & (nxt >= 0xB8) & (nxt <= 0xBB))
    solo |= (lead == 0xE1) & ((nxt <= 0x81) | ((nxt == 0x82) & (last < 0xC0)) | (nxt == 0x9E) | (nxt == 0x9F))
    alone = at[solo]
    first[alone] = first[alone + 3] = True


@dataclass
class Piece:
    """Words of one stretch of a batch: byte spans (within the stretch) and prefix sums for hashes."""

    base: int
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * _pow(_INV, len(self.sums))[lo])

    def words(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def prefixes(self, k: int) -> np.ndarray:
        return self.span_hash(self.starts, np.minimum(self.starts + k, self.ends))

    def suffixes(self, k: int) -> np.ndarray:
        return self.span_hash(np.maximum(self.ends - k, self.starts), self.ends)


def pieces(data: np.ndarray, off: np.ndarray, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut the bytes of a batch into stretches that never split a word, whatever a text's length."""
    n, lo = len(data), 0
    while lo < n:
        hi = min(n, lo + most)
        if hi < n:
            k = int(np.searchsorted(off, hi, "right")) - 1
            if off[k] > lo:
                hi = int(off[k])
            else:
                end = int(off[k + 1])
                cuts = np.flatnonzero(_LEAD[data[lo + 1 : hi]] | ~_WORD[data[lo : hi - 1]])  # after a gap, before a lead
                if len(cuts):
                    hi = lo + int(cuts[-1]) + 1
                else:
                    more = np.flatnonzero(_LEAD[data[hi:end]] | ~_WORD[data[hi:end]])
                    hi = hi + int(more[0]) if len(more) else end
        part = data[lo:hi]
        w = _WORD[part]
        first = np.zeros(len(part) + 1, bool)
        a, b = np.searchsorted(off, [lo, hi])
        first[off[a:b] - lo] = True
        _wide(part, w, first)
        start = w.copy()
        start[1:] &= ~w[:-1] | first[1:-1]
        end_ = w.copy()
        end_[:-1] &= ~w[1:] | first[1:-1]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((lowered(part).astype(np.uint64) + np.uint64(1)) * _pow(_BASE, len(part)), out=sums[1:])
        yield Piece(lo, np.flatnonzero(start), np.flatnonzero(end_) + 1, sums)
        lo = hi


@dataclass
class Words:
    """Hash and absolute byte start of every word; text i has words bounds[i]:bounds[i+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    off: np.ndarray

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(col: pa.Array) -> Words:
    data, off = buffers(col)
    hs, ss = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for p in pieces(data, off):
        hs.append(p.words())
        ss.append(p.starts + p.base)
    starts = np.concatenate(ss)
    return Words(np.concatenate(hs), starts, np.searchsorted(starts, off), data, off)


def word_list(text: str | None) -> list[bytes]:
    """The words of one text, one at a time: what ``words_of`` hashes (for tests and set-up)."""
    import re

    low = lowered(np.frombuffer((text or "").encode(), np.uint8)).tobytes().decode()
    return [w.encode() for w in re.findall(f"[{_SOLO}]|(?:[0-9a-z]|[^\x00-\x7f{_GAPS}{_SOLO}])+", low)]


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``words_of`` gives them."""
    return words_of(pa.array(words, pa.string())).hashes


def unique_pairs(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value) pairs, by group, then by value."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    if len(g) == 0:
        return g, v
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return g[new], v[new]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal neighbours."""
    if len(keys) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return at, np.diff(np.append(at, len(keys)))


def scatter(part: np.ndarray, rec: np.ndarray, n: int) -> pa.RecordBatch | None:
    """Records grouped by target partition as (pid, blob) rows: one shuffled row per partition, not per record."""
    if len(rec) == 0:
        return None
    order = np.argsort(part.astype(np.uint16) if n <= 1 << 16 else part, kind="stable")  # 16 bits: radix sort
    part, rec = part[order], rec[order]
    at, size = runs(part)
    rows = rec.view(np.uint8).reshape(len(rec), rec.dtype.itemsize)
    blobs = [rows[a : a + s].T.tobytes() for a, s in zip(at, size)]  # byte planes: the zero bytes of small numbers compress away
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["pid", "blob"])


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    """The records of a blob of ``scatter``."""
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)


def gather(batches, dtype: np.dtype) -> np.ndarray:
    """All records of the blobs of a partition."""
    got = [unpack(b, dtype) for batch in batches for b in batch.column("blob").to_pylist()]
    return np.concatenate(got) if got else np.zeros(0, dtype)
