"""Main-content extraction by a maximum-scoring subsequence.

A page is a sequence of words (positive scores) and tags (negative scores); the contiguous region of the highest
total is its content, found by one linear scan. Scripts, styles and comments count as one tag each.

Weights come from labelled pages: pages that mark their content with an ``article`` element. A word scores
its log-odds of lying in content; a tag name scores the log-odds of its tags, shifted so that every tag is negative, times a factor
that is chosen to maximise the words' F1 on the labelled pages. At most ``LABELLED_PAGES`` labelled pages are used for this
(least md5 of url and page_id); every page is then scanned whole.

Defined results: null or empty html gives empty text; a page without a positive region gives empty text; of equally good
regions the one that ends first wins, of those the shortest; unclosed scripts and comments run to the end; text without tags is content as a whole;
without any labelled page the ``DEFAULT`` weights hold. Entities are decoded, white space within
a block is one space, blocks are lines. Repeated rows and null page_ids give a row each; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

LABELLED_PAGES = 2000
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<([/!?]?[a-zA-Z][a-zA-Z0-9]*)[^>]*>?|</?>", re.S | re.I)
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "section", "article", "blockquote", "pre", "header", "footer", "nav", "main", "aside", "dd", "dt"}


@dataclass
class Weights:
    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -4.0


DEFAULT = Weights(1.0, {"p": -0.5, "/p": -0.5, "br": -0.5, "b": -0.5, "/b": -0.5, "i": -0.5, "/i": -0.5, "em": -0.5, "/em": -0.5, "strong": -0.5, "/strong": -0.5}, -4.0)


def parse(page: str) -> tuple[list[str], list[str]]:
    """Alternating runs: texts[i] precedes tags[i]; one more text than tags."""
    texts, tags, at = [], [], 0
    for m in _TAG.finditer(page):
        texts.append(page[at : m.start()])
        tags.append((m.group(1) or m.group(2) or "!--").lower())
        at = m.end()
    texts.append(page[at:])
    return texts, tags


def best_region(words: list[int], tags: list[str], w: Weights) -> tuple[int, int]:
    """Runs [i, j) of texts with the highest total of words and of the tags between them; (0, 0) if none is positive."""
    best, at, now, start = 0.0, (0, 0), 0.0, 0
    for k, n in enumerate(words):
        if now <= 0:
            now, start = 0.0, k
        now += w.word * n
        if now > best + 1e-12:
            best, at = now, (start, k + 1)
        if k < len(tags):
            now += w.tags.get(tags[k], w.other)
    return at


def extract(page: str | None, w: Weights) -> tuple[str, int, float]:
    """The content of a page, its words, and the share of the page's words that it holds."""
    if not page:
        return "", 0, 0.0
    texts, tags = parse(page)
    words = [len(t.split()) for t in texts]
    i, j = best_region(words, tags, w)
    while i < j and not words[i]:
        i += 1
    lines, line = [], []
    for k in range(i, j):
        line.append(texts[k])
        if k + 1 == j or tags[k].lstrip("/") in _BLOCK:
            one = " ".join(_html.unescape("".join(line)).split())
            if one:
                lines.append(one)
            line = []
    n = sum(words[i:j])
    return "\n".join(lines), n, n / max(1, sum(words))


def _labelled(page: str) -> tuple[list[int], list[str], list[bool], list[bool]] | None:
    """Words and tags of a labelled page, and which of each lie within its content."""
    texts, tags = parse(page)
    if "article" not in tags:
        return None
    a = tags.index("article")
    b = tags.index("/article", a) if "/article" in tags[a:] else len(tags)
    return [len(t.split()) for t in texts], tags, [a < k <= b for k in range(len(texts))], [a < k < b for k in range(len(tags))]


def learn(pages: list[str]) -> Weights:
    """Weights from the labelled ones of the given pages."""
    known = [x for x in map(_labelled, pages) if x]
    if not known:
        return DEFAULT
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    win = wout = 0
    for words, tags, wl, tl in known:
        win += sum(n for n, y in zip(words, wl) if y)
        wout += sum(n for n, y in zip(words, wl) if not y)
        for t, y in zip(tags, tl):
            side = inside if y else outside
            side[t] = side.get(t, 0) + 1
    word = max(0.1, float(np.log((win + 1) / (wout + 1))))
    odds = {t: float(np.log((inside.get(t, 0) + 0.5) / (outside.get(t, 0) + 0.5))) for t in {*inside, *outside}}
    top = max(odds.values())
    best, found = -1.0, DEFAULT
    for s in SCALES:
        w = Weights(word, {t: s * (min(0.0, o - top) - 0.05) for t, o in odds.items()}, s * (min(odds.values()) - top))
        hit = got = want = 0
        for words, tags, wl, _ in known:
            i, j = best_region(words, tags, w)
            hit += sum(n for n, y in zip(words[i:j], wl[i:j]) if y)
            got += sum(words[i:j])
            want += sum(n for n, y in zip(words, wl) if y)
        f1 = 2 * hit / max(1, got + want)
        if f1 > best + 1e-9:
            best, found = f1, w
    return found


def fit(pages: DataFrame) -> Weights:
    ranked = pages.where(F.lower("html").contains("<article")).withColumn("_fx_k", F.md5(F.concat_ws("|", F.coalesce("url", F.lit("")), F.col("page_id").cast("string")).cast("binary")))
    keys = frames.written(ranked.select("_fx_k", "page_id").orderBy("_fx_k", "page_id").limit(LABELLED_PAGES), "labelled-pages")
    rows = ranked.join(F.broadcast(keys.select("_fx_k").distinct()), "_fx_k").select("_fx_k", "html").toArrow()  # LABELLED_PAGES rows at most, but for repeats
    got = sorted(zip(rows.column("_fx_k").to_pylist(), rows.column("html").to_pylist()))[:LABELLED_PAGES]
    return learn([h for _, h in got])


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_words, share (of the page's words)."""
    narrow = pages.select("page_id", "url", "html")
    w = weights or fit(narrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                out = [extract(p, w) for p in part.column(2).to_pylist()]
                cols = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([round(o[2], 6) for o in out], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["page_id", "url", "text", "n_words", "share"])

    kind = dict(narrow.dtypes)["page_id"]
    return narrow.mapInArrow(run, f"page_id {kind}, url string, text string, n_words bigint, share double")
