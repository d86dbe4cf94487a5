"""License scans by patience alignment.

A text is compared with license templates word by word: words that are unique in both are anchors,
the longest increasing subsequence of them is kept, and the gaps between anchors are aligned in the
same way.  A gap without anchors, which is no longer than a window, is aligned by its longest common
subsequence.  Coverage is the share of the template's words that are aligned.

A template is looked for in overlapping windows of the whole text, so that words repeated elsewhere in
it do not spoil the anchors and every occurrence is found.  Texts and windows that hold too few of
the template's words to reach the least coverage are passed over: the count bounds the coverage.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablemend.llm.words import pieces, split_words, text_column

LEAST = 0.8
_AROUND = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Wording of licenses and of the usual notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

#: Phrases that tell a template from its siblings: each must stand in the text without a gap.
NAMED = {
    "MIT notice": ["MIT"],
    "Apache-2.0": ["Apache", "2.0"],
    "Apache-2.0 notice": ["Apache", "2.0"],
    "GPL-3.0": ["GNU General Public License", "version 3"],
    "GPL-3.0 notice": ["GNU General Public License", "3"],
    "MPL-2.0": ["Mozilla", "2.0"],
    "CC-BY-4.0": ["Attribution 4.0"],
    "CC-BY-NC-4.0 notice": ["BY-NC", "4.0"],
}


def _longest_increasing(values: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        below[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def _common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    other = np.array(b)
    for i in range(len(a) - 1, -1, -1):
        met = np.where(other == a[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(met[::-1])[::-1]
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def align(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing in both."""
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        s, e, t, f = todo.pop()
        while s < e and t < f and text[s] == template[t]:
            pairs.append((s, t))
            s, t = s + 1, t + 1
        while s < e and t < f and text[e - 1] == template[f - 1]:
            e, f = e - 1, f - 1
            pairs.append((e, f))
        if s == e or t == f:
            continue
        ours, theirs = Counter(text[s:e]), Counter(template[t:f])
        where = {w: k for k, w in enumerate(text[s:e], s) if ours[w] == 1}
        anchors = [(where[w], k) for k, w in enumerate(template[t:f], t) if theirs[w] == 1 and w in where]
        anchors = [anchors[k] for k in _longest_increasing([a for a, _ in anchors])]
        if not anchors:
            pairs += [(s + i, t + j) for i, j in _common(text[s:e], template[t:f])]
            continue
        for (a, b), (c, d) in zip([(s - 1, t - 1), *anchors], [*anchors, (e, f)], strict=True):
            todo.append((a + 1, c, b + 1, d))
        pairs += anchors
    return sorted(pairs)


def _places(phrase: list[int], template: list[int]) -> list[range]:
    """Where the phrase stands in the template."""
    n = len(phrase)
    return [range(i, i + n) for i in range(len(template) - n + 1) if template[i : i + n] == phrase]


def _is_named(pairs: list[tuple[int, int]], named: list[list[range]]) -> bool:
    at = {t: s for s, t in pairs}
    return all(any(all(t in at and at[t] - at[r[0]] == t - r[0] for t in r) if r[0] in at else False for r in places) for places in named)


def _hits(codes: np.ndarray, template: list[int], least: float, named: list[list[range]]) -> list[tuple[int, int, int, frozenset[int]]]:
    """(start, end, words aligned, their places) of each place in a text where enough of the template
    is found, with all that names it."""
    m = len(template)
    need, size = int(np.ceil(least * m - 1e-9)), 2 * m
    often = Counter(template)
    found = []
    held = np.isin(codes, list(often))
    sums = np.concatenate([[0], np.cumsum(held)])
    starts = np.arange(0, max(1, len(codes) - m + 1), max(1, m // 2))
    for s in starts[sums[np.minimum(starts + size, len(codes))] - sums[starts] >= need]:
        part = codes[s : s + size].tolist()
        here = Counter(part)
        if sum(min(n, here[w]) for w, n in often.items()) < need:
            continue
        pairs = align(part, template)
        if len(pairs) >= need and _is_named(pairs, named):
            found.append((-len(pairs), pairs[-1][0] - pairs[0][0], int(s) + pairs[0][0], int(s) + pairs[-1][0] + 1, frozenset(int(s) + a for a, _ in pairs)))
    out: list[tuple[int, int, int, frozenset[int]]] = []
    for n, _, s, e, used in sorted(found, key=lambda f: f[:4]):  # most words first, then the tightest; no two overlap
        if all(e <= a or s >= b for a, b, _, _ in out):
            out.append((s, e, -n, used))
    return sorted(out, key=lambda f: f[:3])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST, named: Mapping[str, Sequence[str]] = NAMED) -> DataFrame:
    """One row per place in ``docs`` (doc_id, text) where a template is covered by ``least`` or more:
    doc_id, license, start and end (in words of the text), n_matched, coverage.

    Words are compared in lower case (A-Z), without punctuation around them; what is only punctuation is
    not a word here, but counts in start and end.  Missing and empty texts have no hits; repeated rows
    repeat theirs.  Places of one template do not overlap; of overlapping ones the best covered stays.
    Of places of several templates that share words the best covered stays, then the one with most
    words.  A place needs each phrase of ``named`` that stands in its template.
    Other columns are not looked at.
    """

    def words_of(text: str) -> list[bytes]:
        words, _ = split_words(text_column(pa.array([text])), lower=True)
        return [w.strip(_AROUND) for w in words.to_pylist() if w.strip(_AROUND)]

    names = list(templates)
    written = [words_of(templates[k]) for k in names]
    number = {w: k for k, w in enumerate(sorted({w for t in written for w in t}))}
    coded = [[number[w] for w in t] for t in written]
    asked = [[found for p in named.get(k, ()) if (found := _places([number.get(w, -1) for w in words_of(p)], t))] for k, t in zip(names, coded, strict=True)]
    weight = np.zeros((len(number), len(names)), np.int64)
    for k, t in enumerate(coded):
        np.add.at(weight, (t, k), 1)
    needed = np.array([np.ceil(least * len(t) - 1e-9) for t in coded])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            words, counts = split_words(text_column(b["text"]), lower=True)
            own = words.dictionary_encode()
            stripped = [w.strip(_AROUND) for w in own.dictionary.to_pylist()]
            codes = np.array([number.get(w, -1) if w else -2 for w in stripped] or [-1], np.int64)[np.asarray(own.indices, np.int64)]
            row = np.repeat(np.arange(b.num_rows), counts)
            known = codes >= 0
            pairs = np.unique(row[known] * len(number) + codes[known])
            sums = np.zeros((b.num_rows, len(names)), np.int64)
            np.add.at(sums, pairs // len(number), weight[pairs % len(number)])
            ends = np.cumsum(counts)
            out = []
            enough = sums >= needed
            for r in np.flatnonzero(enough.any(axis=1)):
                text = codes[ends[r] - counts[r] : ends[r]]
                place = np.flatnonzero(text != -2)  # without mere punctuation
                hits = [(-h[2] / len(coded[k]), -h[2], int(k), *h) for k in np.flatnonzero(enough[r]) for h in _hits(text[place], coded[k], least, asked[k])]
                taken: set[int] = set()
                for cover, _, k, start, end, n, used in sorted(hits, key=lambda h: h[:5]):
                    if taken.isdisjoint(used):
                        taken |= used
                        out.append((int(r), names[k], int(place[start]), int(place[end - 1]) + 1, n, -cover))
            if out:
                rows, *rest = (list(c) for c in zip(*out, strict=True))
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.record_batch([b["doc_id"].take(pa.array(rows)), *[pa.array(c, t) for c, t in zip(rest, types, strict=True)]], ["doc_id", "license", "start", "end", "n_matched", "coverage"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, start long, end long, n_matched long, coverage double")
