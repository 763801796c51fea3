"""Refinement with exact offsets: an Arrow UDF where text-only expressions don't do."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .slices import sliced

_SPACE = r"[ \t]+"
_PROSE, _CODE = (re.compile(rf"{_SPACE}(?=\n|\Z)|{rest}") for rest in (rf"\n[ \t\n]*|{_SPACE}", r"\n+"))
_LINE_END = re.compile(r"\r\n?")


def _composed(text: str) -> tuple[str, np.ndarray]:
    """NFC by clusters of a character and its combining marks; offsets of the clusters."""
    at = np.arange(len(text), dtype=np.int32)
    if text.isascii():
        return text, at
    seen, code = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    mark = np.array([unicodedata.combining(chr(c)) > 0 for c in seen])[code]
    mark[0] = False  # the first character begins a cluster, whatever it is
    begin = np.flatnonzero(~mark)
    at = np.repeat(begin, np.diff(np.append(begin, len(text)))).astype(np.int32)
    if unicodedata.is_normalized("NFC", text):
        return text, at
    end = np.append(begin[1:], len(text))
    moved = np.array([unicodedata.normalize("NFC", chr(c)) != chr(c) for c in seen])[code]
    out, where, last = [], [], 0
    for i, j in zip(begin, end):
        if j > i + 1 or moved[i]:
            cluster = unicodedata.normalize("NFC", text[i:j])
            out += [text[last:i], cluster]
            where += [at[last:i], np.full(len(cluster), i, np.int32)]
            last = j
    return "".join([*out, text[last:]]), np.concatenate([*where, at[last:]])


def _rewrite(text: str, at: np.ndarray, pattern: re.Pattern, by) -> tuple[str, np.ndarray]:
    """Replace each match by the characters that by(match) picks: (character, index) pairs."""
    out, where, last = [], [], 0
    for m in pattern.finditer(text):
        picked = by(m)
        if "".join(ch for ch, _ in picked) == m.group():
            continue
        out += [text[last : m.start()], *(ch for ch, _ in picked)]
        where += [at[last : m.start()], *(at[i : i + 1] for _, i in picked)]
        last = m.end()
    return "".join([*out, text[last:]]), np.concatenate([*where, at[last:]])


def refine(text: str | None, code: bool = False) -> tuple[str, list[int]]:
    """Cleaned text, and for each of its characters the index in the source."""
    s, at = _refine(text, code)
    return s, at.tolist()


def _refine(text: str | None, code: bool) -> tuple[str, np.ndarray]:
    if not text:
        return "", np.zeros(0, np.int32)
    s, at = _composed(text)
    s, at = _rewrite(s, at, _LINE_END, lambda m: [("\n", m.start())])

    def pick(m: re.Match) -> list[tuple[str, int]]:
        run = m.group()
        if run[0] == "\n":
            return [("\n", m.start() + i) for i, c in enumerate(run) if c == "\n"][:2]
        return [] if m.end() == len(s) or s[m.end()] == "\n" else [(" ", m.start())]

    s, at = _rewrite(s, at, _CODE if code else _PROSE, pick)
    body = s.strip(" \t\n")
    lead = len(s) - len(s.lstrip(" \t\n"))
    return body, at[lead : lead + len(body)]


def source_offset(offset_map: Column, i: Column) -> Column:
    """The source index of refined character i: before the first -> first, beyond the last -> last + 1, empty map -> i."""
    n = F.size(offset_map)
    return F.when(n <= 0, i).when(i < 0, F.try_element_at(offset_map, F.lit(1))).when(i >= n, F.try_element_at(offset_map, F.lit(-1)) + 1).otherwise(F.try_element_at(offset_map, (i + 1).cast("int")))


def _refined(text: pa.Array, code: pa.Array) -> pa.Array:
    out = [_refine(t, bool(c)) for t, c in zip(text.to_pylist(), code.to_pylist())]
    ends = np.cumsum([0, *(len(at) for _, at in out)], dtype=np.int32)
    maps = pa.ListArray.from_arrays(ends, np.concatenate([at for _, at in out]))
    return pa.StructArray.from_arrays([pa.array([s for s, _ in out], pa.string()), maps], ["text", "offset_map"])


def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def refined(text: Column, code: Column) -> Column:
    """STRUCT<text, offset_map> of a column, as an Arrow UDF."""
    return sliced(_refined, "text string, offset_map array<int>")(text, code)


def nfc(text: Column | str) -> Column:
    return sliced(_nfc, "string")(text)
