"""Licence scan with a positional rare-token index.

Templates (licence notices and texts) are indexed by word: postings of (template, position). Document frequencies of all
template words are counted over all documents; a template's ``ANCHORS`` highest-IDF words are its anchors, and
a file's highest-IDF licence words are those at least as rare as the least rare anchor of any template. Their postings are
intersected by relative position: occurrences whose document position minus template position lies within
``SLACK`` of the first one's form an alignment. An alignment that holds ``LEAST_SHARE`` of a template's anchor IDF is a candidate, and it
counts only if every mandatory key phrase of the template occurs, word for word, within the aligned stretch (widened by SLACK words).

Of overlapping finds of one licence in a document, the one with the highest coverage is kept (ties: the earliest, then the template listed first).
No cap is set on words, postings or candidates.

Defined results: a null or empty text has no finds; rows with null or repeated doc_id are scanned like any other, so repeated
rows give repeated finds; an empty table gives none; positions count words from 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

ANCHORS, SLACK, LEAST_SHARE = 4, 3, 0.6

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer."
)
#: Names with an SPDX identifier, and what the identifier has besides the name.
SPDX = (("MIT", ""), ("Apache-2.0", ""), ("GPL-3.0", "-only"), ("GPL-2.0", "-only"), ("GPL-3.0-or-later", ""), ("LGPL-3.0", "-only"), ("AGPL-3.0", "-only"), ("MPL-2.0", ""), ("CC-BY-4.0", ""), ("CC-BY-SA-4.0", ""), ("CC-BY-NC-4.0", ""), ("CC0-1.0", ""), ("Unlicense", ""))
#: (licence, template text, mandatory key phrases)
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "Released under the MIT License.", ("mit license",)),
    ("MIT", "Licensed under the MIT License.", ("mit license",)),
    ("MIT", _MIT, ("permission is hereby granted free of charge", "without restriction")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license", "version 2 0")),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2 0",)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license", "version 2")),
    ("GPL-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3", "any later version")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", ("gnu lesser general public license", "version 3")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.", ("gnu affero general public license", "version 3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license", "v 2 0")),
    ("BSD", _BSD, ("redistribution and use in source and binary forms", "are permitted provided that")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal.", ("cc0 1 0",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
    ("All-rights-reserved", "All rights reserved.", ("all rights reserved",)),
    ("MIT", "MIT License", ("mit license",)),
    ("Apache-2.0", "Apache License 2.0", ("apache license 2 0",)),
    ("Apache-2.0", "Apache License v2.0", ("apache license v2 0",)),
    ("GPL-3.0", "GNU GPL v3", ("gnu gpl v3",)),
    ("GPL-3.0", "GNU GPLv3", ("gnu gplv3",)),
    ("GPL-2.0", "GNU GPL v2", ("gnu gpl v2",)),
    ("GPL-2.0", "GNU GPLv2", ("gnu gplv2",)),
    *((name, f"SPDX-License-Identifier: {name}{only}", ("spdx license identifier " + (name + only).lower().replace("-", " ").replace(".", " "),)) for name, only in SPDX),
)


@dataclass
class Index:
    vocab: np.ndarray  # sorted word hashes
    idf: np.ndarray
    words: list[np.ndarray]  # template -> vocabulary index by position
    phrases: list[list[np.ndarray]]  # template -> key phrases as hashes
    anchors: list[np.ndarray]  # template -> anchor vocabulary indices
    first: np.ndarray  # CSR of postings by vocabulary index
    template: np.ndarray
    pos: np.ndarray
    rare: np.ndarray  # vocabulary index -> looked up in files
    weight: np.ndarray  # (template, vocabulary index): the share of a template's anchor IDF

    def share(self, t: int, found: np.ndarray) -> float:
        a = self.anchors[t]
        return float(self.idf[a[np.isin(a, found)]].sum() / max(self.idf[a].sum(), 1e-12))


def _hashes(text: str) -> np.ndarray:
    return kernels.words_of(pa.array([text])).hashes


def vocabulary(templates=TEMPLATES) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for _, t, _ in templates]))


def build(n_docs: int, df: np.ndarray, templates=TEMPLATES) -> Index:
    vocab = vocabulary(templates)
    idf = np.log((n_docs + 1) / (df + 0.5))
    words = [np.searchsorted(vocab, _hashes(t)) for _, t, _ in templates]
    phrases = [[_hashes(p) for p in ps] for _, _, ps in templates]
    anchors = []
    for w in words:
        u = np.unique(w)
        anchors.append(u[np.lexsort((u, -idf[u]))][:ANCHORS])
    flat = np.concatenate(words)
    order = np.argsort(flat, kind="stable")
    template = np.repeat(np.arange(len(words)), [len(w) for w in words])[order]
    pos = np.concatenate([np.arange(len(w)) for w in words])[order]
    floor = min(idf[a].min() for a in anchors)
    weight = np.zeros((len(words), len(vocab)))
    for t, a in enumerate(anchors):
        weight[t, a] = idf[a] / max(idf[a].sum(), 1e-12)
    return Index(vocab, idf, words, phrases, anchors, np.searchsorted(flat[order], np.arange(len(vocab) + 1)), template, pos, idf >= floor, weight)


def in_vocab(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted vocabulary, or -1; a small filter spares most searches."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(h), -1, np.int64)
    some = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocab, h[some]), len(vocab) - 1)
    out[some] = np.where(vocab[at] == h[some], at, -1)
    return out


def _holds(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return False
    hit = words[:n] == phrase[0]
    for j in range(1, len(phrase)):
        hit &= words[j : j + n] == phrase[j]
    return bool(hit.any())


def finds(w: kernels.Words, index: Index, templates=TEMPLATES) -> list[tuple[int, str, int, int, float]]:
    """(document, licence, first word, end word, coverage) within a batch."""
    v = in_vocab(w.hashes, index.vocab)
    at = np.flatnonzero(v >= 0)
    at = at[index.rare[v[at]]]
    if len(at) == 0:
        return []
    doc = np.searchsorted(w.bounds, at, "right") - 1
    size = index.first[v[at] + 1] - index.first[v[at]]
    of = np.repeat(np.arange(len(at)), size)
    post = index.first[v[at]][of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    template, word = index.template[post], v[at][of]
    diag = at[of] - index.pos[post]
    d = doc[of]
    order = np.lexsort((diag, template, d))
    d, template, diag, word = d[order], template[order], diag[order], word[order]
    # Alignments: the occurrences within SLACK of each relative position that occurs, if their weights can reach the least share.
    group = np.concatenate([[0], np.cumsum((d[1:] != d[:-1]) | (template[1:] != template[:-1]))])
    place = group * (int(diag.max() - diag.min()) + SLACK + 2) + diag - diag.min()
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    after = np.searchsorted(place, place[begin] + SLACK, "right")
    sums = np.concatenate([[0.0], np.cumsum(index.weight[template, word])])
    ok = sums[after] - sums[begin] >= LEAST_SHARE - 1e-9
    got = []
    for a, b in zip(begin[ok], after[ok]):
        t = int(template[a])
        if index.share(t, word[a:b]) < LEAST_SHARE - 1e-12:
            continue
        lo, hi = w.bounds[d[a]], w.bounds[d[a] + 1]
        stretch = w.hashes[max(lo, diag[a] - SLACK) : min(hi, diag[b - 1] + len(index.words[t]) + SLACK)]
        if not all(_holds(stretch, p) for p in index.phrases[t]):
            continue
        u = np.unique(index.words[t])
        cover = round(float(np.isin(index.vocab[u], stretch).mean()), 6)
        got.append((int(d[a]), templates[t][0], int(max(lo, diag[a]) - lo), int(min(hi, diag[b - 1] + len(index.words[t])) - lo), cover, t))
    out, last = [], []
    for doc_i, name, s, e, cover, _ in sorted(got, key=lambda x: (x[0], x[1], -x[4], x[2], x[5])):
        if not last or last[0][:2] != (doc_i, name):
            last = []
        if not any(s < o[3] and o[2] < e for o in last):
            last.append((doc_i, name, s, e, cover))
            out.append(last[-1])
    return out


def frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[int, np.ndarray]:
    """Documents, and how many hold each template word."""
    vocab = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocab) + 1, np.int64), 0
        for batch in batches:
            for b in kernels.slices(batch, "text"):
                w = kernels.words_of(b.column(b.schema.get_field_index("text")))
                v = in_vocab(w.hashes, vocab)
                at = np.flatnonzero(v >= 0)
                _, u = kernels.unique_pairs(np.searchsorted(w.bounds, at, "right"), v[at])
                total[: len(vocab)] += np.bincount(u, minlength=len(vocab))
                n += b.num_rows
        total[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "n"])

    got = docs.select("text").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()  # one row per template word
    out = np.zeros(len(vocab) + 1, np.int64)
    for r in got:
        out[r.i] = r.n
    return int(out[-1]), out[:-1]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per find: doc_id, license, start_word, end_word, coverage (share of the template's distinct words that occur there)."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    index = build(*frequencies(narrow))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in kernels.slices(batch, "text"):
                got = finds(kernels.words_of(b.column(1)), index)
                if got:
                    i, name, s, e, c = zip(*got)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(name), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(c)], ["doc_id", "license", "start_word", "end_word", "coverage"])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, license string, start_word bigint, end_word bigint, coverage double")
