"""Splitters. All return spans of the source, so that chunk text == source[start:end] by construction."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, SUFFIX_LANGUAGE
from .embed import hashed_vector
from .slices import sliced

Span = tuple[int, int]
CHUNKS = "array<struct<ordinal:int,text:string,start:int,end:int>>"

_TAIL = ["\n\n+", "\n", " "]
_ACCESS = "\n[ \t]*(?:%s)[^\n]*"
_REST = "[^\n]*"
_FUNCTION = rf"\n\w{_REST}\({_REST}\)" + "[ \t]*[{]"


def _starts(*words: str) -> list[str]:
    return [f"\n{w} " for w in words]


SEPARATORS: dict[str, list[str]] = {
    "html": ["<(?:p|footer|header|article|section|div)\\b", *_TAIL],
    "markdown": ["\n#{1,6} ", *_TAIL],
    "ruby": [f"\n[ \t]*{w} " for w in ("class", "def", "module")] + _TAIL,
    "csharp": [_ACCESS % "internal|protected|private|public" + end for end in ("class ", r"\(")] + _TAIL,
    "java": [_ACCESS % "protected|private|public" + end for end in ("class ", r"\(")] + _starts("class") + _TAIL,
    "cpp": _starts("class", "struct") + [_FUNCTION, *_TAIL],
    "c": [_FUNCTION, *_TAIL],
    "go": _starts("func", "type", "var", "const") + _TAIL,
    "rust": _starts("pub fn", "fn", "impl", "struct", "enum", "trait", "mod") + _TAIL,
    "typescript": _starts("class", "interface", "function", "const", "let", "var", "type") + _TAIL,
    "javascript": _starts("class", "function", "const", "let", "var") + _TAIL,
    "python": ["\nclass ", "\n[ \t]*def ", "\n[ \t]*async def ", *_TAIL],
}
GENERIC = [_TAIL[0], "(?<=[.!?])" + r"\s+", *_TAIL[1:]]


def separators_for(language: str | None, custom: dict[str, list[str]] | None = None) -> list[str]:
    """Separators of a language name, alias or file suffix; "" (hard cuts) always comes last and is left out here."""
    if not language:
        return GENERIC
    key = language.lower().lstrip(".")
    if custom and key in custom:
        own = [s for s in custom[key] if s]
        return own if custom[key][-1:] == [""] else [*own, " "]
    return SEPARATORS.get(SUFFIX_LANGUAGE.get(key, key), GENERIC)


def windows(begin: int, end: int, size: int) -> list[Span]:
    step = size if size > 0 else max(1, end - begin)
    return [(i, min(i + step, end)) for i in range(begin, end, step)]


def merged(text: str, spans: list[Span], size: int, overlap: int) -> list[Span]:
    """Neighbouring spans joined up to size; each join starts again with up to overlap characters of the one before."""
    out, first = [], 0

    def close(last: int) -> None:
        if last > first and text[spans[first][0] : spans[last - 1][1]].strip():
            out.append((spans[first][0], spans[last - 1][1]))

    for k, (a, b) in enumerate(spans):
        if k > first and b - spans[first][0] > size:
            close(k)
            while first < k and (a - spans[first][0] > overlap or b - spans[first][0] > size):
                first += 1
    close(len(spans))
    return out


def recursive_spans(text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = GENERIC) -> list[Span]:
    """Cut at the coarsest separator that occurs, keep separators with what follows, and go finer in pieces beyond size."""
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if not text:
        return []
    overlap = min(max(overlap, 0), size - 1)

    def cut(begin: int, end: int, level: int) -> list[Span]:
        part = text[begin:end]
        while level < len(separators):
            found = [m.start() for m in re.finditer(separators[level], part)]
            level += 1
            inner = sorted({i for i in found if 0 < i < len(part)})
            if inner or (found and level == len(separators)):
                break
        else:
            return walk(windows(begin, end, size), len(separators))
        edges = [0, *inner, len(part)]
        return walk([(begin + a, begin + b) for a, b in zip(edges, edges[1:])], level)

    def walk(spans: list[Span], level: int) -> list[Span]:
        out, run = [], []
        for a, b in [*spans, (0, 0)]:
            if 0 < b - a <= size:
                run.append((a, b))
                continue
            out += merged(text, run, size, overlap) if run else []
            run = []
            if b > a:
                out += cut(a, b, level) if level < len(separators) else merged(text, windows(a, b, size), size, overlap)
        return out

    return cut(0, len(text), 0)


def separator_spans(text: str, patterns: Sequence[str], keep: str | None = None, include_empty: bool = False, trim: bool = True) -> list[Span]:
    """Cut at every non-empty match of any pattern; the match goes left, right or away."""
    if not patterns:
        raise ValueError("at least one separator is needed")
    if keep not in (None, "left", "right"):
        raise ValueError("keep is 'left', 'right' or None")
    out, last = [], 0
    if not text:
        return out
    hits = [m.span() for m in re.finditer("|".join(f"(?:{p})" for p in patterns), text) if m.end() > m.start()]
    for a, b in [*hits, (len(text), len(text))]:
        out.append((last, b if keep == "left" else a))
        last = a if keep == "right" else b
    if trim:
        tight = []
        for a, b in out:
            s = text[a:b]
            lead = len(s) - len(s.lstrip())
            tight.append((a + lead, a + max(lead, len(s.rstrip()))))
        out = tight
    return [(a, b) for a, b in out if b > a or include_empty]


def sentence_spans(text: str) -> list[Span]:
    """Sentences with what follows them up to the next one; blank ones dropped."""
    cuts = [0, *(m.end() for m in re.finditer(SENTENCE_END, text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]


def semantic_spans(text: str, encode: Callable[[list[str]], np.ndarray] | None, threshold: float = 0.7, least: int = 200, most: int = 2000, language: str | None = None) -> list[Span]:
    """Sentence groups cut where neighbouring sentences differ; small groups joined, large ones split again."""
    plain = lambda: recursive_spans(text, 1000, 200, separators_for(language))
    spans = sentence_spans(text) if text else []
    if encode is None or len(spans) <= 1:
        return plain()
    try:
        v = np.asarray(encode([text[a:b].strip() for a, b in spans]), np.float64)
    except Exception:  # a model's failure degrades to plain splitting
        return plain()
    norm = np.linalg.norm(v, axis=1)
    dots = (v[1:] * v[:-1]).sum(axis=1)
    scale = norm[1:] * norm[:-1]
    alike = np.where((norm[1:] < 1e-9) | (norm[:-1] < 1e-9), 1.0, dots / np.where(scale > 0, scale, 1))
    starts = [0, *(np.flatnonzero(alike < threshold) + 1).tolist(), len(spans)]
    out: list[Span] = []
    for i, j in zip(starts, starts[1:]):
        a, b = spans[i][0], spans[j - 1][1]
        if out and out[-1][1] - out[-1][0] + b - a <= least:
            out[-1] = (out[-1][0], b)
        elif b - a > most:
            out += [(a + s, a + e) for s, e in recursive_spans(text[a:b])]
        else:
            out.append((a, b))
    return out or plain()


def _rows(text: list[str | None], spans: list[list[Span]]) -> pa.Array:
    """The chunks of each text as lists of (ordinal, text, start, end)."""
    cut = [t[a:b] for t, s in zip(text, spans) for a, b in s]
    ends = np.cumsum([0, *map(len, spans)], dtype=np.int32)
    at = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
    ordinal = (np.arange(len(at)) - np.repeat(ends[:-1], np.diff(ends))).astype(np.int32)
    parts = [pa.array(ordinal), pa.array(cut, pa.string()), pa.array(at[:, 0]), pa.array(at[:, 1])]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["ordinal", "text", "start", "end"]))


def splitter(kind: str, **options) -> Callable[..., Column]:
    """A column function text [, language] -> array of chunks. kind: recursive, separator, sentence or semantic."""
    custom = options.pop("custom", None)

    def spans(t: str, lang: str | None) -> list[Span]:
        if kind == "recursive":
            return recursive_spans(t, options.get("size", 1000), options.get("overlap", 200), separators_for(lang, custom))
        if kind == "separator":
            return separator_spans(t, options["patterns"], options.get("keep"), options.get("include_empty", False), options.get("trim", True))
        if kind == "sentence":
            return sentence_spans(t)
        return semantic_spans(t, lambda s: np.array([hashed_vector(x) for x in s]), options.get("threshold", 0.7), options.get("least", 200), options.get("most", 2000), lang)

    def rows(text: pa.Array, language: pa.Array) -> pa.Array:
        t = text.to_pylist()
        return _rows(t, [spans(x, lang) if x else [] for x, lang in zip(t, language.to_pylist())])

    split = sliced(rows, CHUNKS)
    return lambda text, language=None: split(text, F.lit(None).cast("string") if language is None else language)


def chunks(df: DataFrame, split: Callable[..., Column], text: str = "text", language: Column | None = None) -> DataFrame:
    """One row per chunk: df's other columns, ordinal, chunk, start, end."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.inline(split(F.col(text), language))).withColumnRenamed("text", "chunk")


def fixed_chunks(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Fixed windows, without Python: ordinal, chunk, start, end."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    out = df.select(*[c for c in df.columns if c != text], F.col(text).alias("_t"), F.posexplode(starts).alias("ordinal", "start"))
    return out.withColumns({"chunk": F.substring("_t", F.col("start") + 1, F.lit(size)), "end": F.least(F.col("start") + size, F.length("_t"))}).drop("_t")
