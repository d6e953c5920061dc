"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts are normalised to lower-case words of letters and digits. Templates are
taken by size, rounded up to L words; windows of L + ceil(L / 2) - 1 words start
every ceil(L / 2) words, so that any L consecutive words lie in one window. A
window that contains 80 % of a template's five-word shingles has at least a known
Jaccard similarity to it; the number of bands follows from it so that the two
share a band with a probability of ``1 - MISS`` or more. Windows' bands are
looked up in a table of the templates' ones, so the cost does not grow with the
number of templates of a size, and the exact share of shingles decides.

Null, empty and short texts (under five words) match nothing; very long texts are
scanned in whole, a window at a time. Templates that match a text alike are all given. Repeated rows give
repeated rows; an empty table gives an empty result. Only the id and the text are
read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from spanforge.llm.common import map_rows, text_of

SHINGLE = 5
CONTAINMENT = 0.8
#: Most probability that a match at the threshold shares no band.
MISS = 1e-6
#: Minima of a band. One tells enough, as unrelated texts rarely have a five-word shingle in common, and needs the fewest hashes.
ROWS = 1
#: Words whose hashes a task remembers, and shingles that are hashed at a time.
MEMO_WORDS, AT_ONCE = 300_000, 200_000

#: Short notices and opening paragraphs of well-known licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-as-is": 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.',
    "bsd-as-is": 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
}

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def shingle_hashes(word_hashes: np.ndarray) -> np.ndarray:
    n = len(word_hashes) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : i + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def permutation(hashes: np.ndarray, p: int) -> np.ndarray:
    a = np.uint64((0xD6E8FEB86659FD93 * (2 * p + 1)) & (1 << 64) - 1 | 1)
    x = hashes * a
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


@dataclass
class Template:
    name: str
    shingles: frozenset[int]
    hashes: np.ndarray
    words: int  #: the template's size, rounded up
    bands: int  #: bands of ROWS minima that it needs

    @property
    def stride(self) -> int:
        return ceil(self.words / 2)

    @property
    def window(self) -> int:
        return self.words + self.stride - 1


def rounded(words: int) -> int:
    """The least of 8, 12, 18, 27, ... (each half as much again) that is ``words`` or more."""
    size = 8
    while size < words:
        size = ceil(1.5 * size)
    return size


def prepare(name: str, text: str, *, containment: float = CONTAINMENT, miss: float = MISS) -> Template:
    words = words_of(text)
    if len(words) < SHINGLE:
        raise ValueError(f"template {name} has fewer than {SHINGLE} words")
    hashes = shingle_hashes(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
    made = Template(name, frozenset(map(int, hashes)), hashes, rounded(len(words)), 1)
    common = ceil(containment * len(made.shingles))
    least = common / (made.window - SHINGLE + 1 + len(made.shingles) - common)
    if least < 1:
        made.bands = ceil(log(miss) / log(1 - least**ROWS))
    return made


@dataclass
class BandTable:
    """Templates of one size by their bands: for each band the sorted keys and whose they are."""

    window: int  #: in words
    stride: int
    keys: list[np.ndarray]
    owners: list[np.ndarray]


def key_of(band: int, minimum: Callable[[int], np.ndarray]) -> np.ndarray:
    """A band's key: its ROWS minima, mixed."""
    key = minimum(band * ROWS)
    for r in range(1, ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + minimum(band * ROWS + r)
    return key


def band_tables(templates: list[Template]) -> list[BandTable]:
    """One table a size of templates; all templates of a size have the bands that its neediest one needs."""
    tables = []
    for size in sorted({t.words for t in templates}):
        own = [k for k, t in enumerate(templates) if t.words == size]
        keys, owners = [], []
        for band in range(max(templates[k].bands for k in own)):
            found = np.array([key_of(band, lambda p, h=templates[k].hashes: permutation(h, p).min(keepdims=True))[0] for k in own], np.uint64)
            order = found.argsort(kind="stable")
            keys.append(found[order])
            owners.append(np.array(own)[order])
        tables.append(BandTable(templates[own[0]].window, templates[own[0]].stride, keys, owners))
    return tables


def retrieve(hashes: np.ndarray, bounds: np.ndarray, tables: list[BandTable]) -> list[tuple[int, int, int, int]]:
    """(template, document, first, last) of windows that share a band; first and last of the window's shingles.

    bounds: where each document's shingles begin in ``hashes``, and the end.
    Windows' keys are looked up in the sorted keys of a band, so the work follows
    the text and the sizes of templates, not their number.
    """
    if not len(hashes):
        return []
    places, edges = [], []
    for t in tables:
        width, first, last, owner = t.window - SHINGLE + 1, [], [], []
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b > a:
                starts = np.arange(a, max(a + 1, b - width + t.stride), t.stride)
                first.append(starts)
                last.append(np.minimum(starts + width, b))
                owner.append(np.full(len(starts), d))
        places.append(tuple(map(np.concatenate, (first, last, owner))))
        edges.append(np.stack(places[-1][:2], axis=1).ravel())
    found: list[list[np.ndarray]] = [[] for _ in tables]
    for band in range(max(len(t.keys) for t in tables)):
        mixed = [np.append(permutation(hashes, band * ROWS + r), np.uint64((1 << 64) - 1)) for r in range(ROWS)]
        for k, t in enumerate(tables):
            if band >= len(t.keys):
                continue
            keys = key_of(band, lambda p: np.minimum.reduceat(mixed[p % ROWS], edges[k])[::2])
            begin = np.searchsorted(t.keys[band], keys, "left")
            near = np.flatnonzero(t.keys[band][np.minimum(begin, len(t.keys[band]) - 1)] == keys)
            if len(near):
                times = np.searchsorted(t.keys[band], keys[near], "right") - begin[near]
                at = np.repeat(begin[near], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                found[k].append(np.stack([t.owners[band][at], np.repeat(near, times)], axis=1))
    out = []
    for (first, last, owner), parts in zip(places, found):
        if parts:
            out += [(int(t), int(owner[i]), int(first[i]), int(last[i])) for t, i in np.unique(np.concatenate(parts), axis=0)]
    return out


def scan_texts(texts: list[str | None], templates: list[Template], tables: list[BandTable], memo: WordHashes, containment: float = CONTAINMENT) -> list[list[dict]]:
    """For each text its matches: template, containment and the window's words (first, end), the best window of each template."""
    parts, bounds = [], [0]
    for text in texts:
        h = shingle_hashes(np.fromiter(map(memo.__getitem__, words_of(text)), np.uint64))
        parts.append(h)
        bounds.append(bounds[-1] + len(h))
    hashes, edges = np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(bounds)
    best: list[dict[int, dict]] = [{} for _ in texts]
    for k, d, first, last in retrieve(hashes, edges, tables):
        share = len(templates[k].shingles.intersection(map(int, hashes[first:last]))) / len(templates[k].shingles)
        if share >= containment and share > best[d].get(k, {"containment": 0.0})["containment"]:
            best[d][k] = {"template": templates[k].name, "containment": share, "first_word": int(first - edges[d]), "end_word": int(last - edges[d]) + SHINGLE - 1}
    return [[b[k] for k in sorted(b)] for b in best]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, licenses (names, sorted) and matches."""

    def make():
        prepared, memo = [prepare(n, t, containment=containment) for n, t in sorted(templates.items())], WordHashes()
        tables = band_tables(prepared)

        def work(cols):
            texts, found, sizes = cols["text"], [], []
            at, held = 0, 0
            for i, text in enumerate(texts):
                sizes.append(len(words_of(text)))
                held += sizes[-1]
                if held >= AT_ONCE or i == len(texts) - 1:
                    found += scan_texts(texts[at : i + 1], prepared, tables, memo, containment)
                    at, held = i + 1, 0
            return {"doc_id": cols["doc_id"], "n_words": sizes, "licenses": [sorted(m["template"] for m in x) for x in found], "matches": found}

        return work

    return map_rows(text_of(docs, id_col, text_col), make, "doc_id long, n_words long, licenses array<string>, matches array<struct<template:string,containment:double,first_word:long,end_word:long>>")
