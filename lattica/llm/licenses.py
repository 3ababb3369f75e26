"""License scans: an inverted index of template runs, then banded sequence alignment.

All runs of GRAM words of the templates, of SHORT_GRAM words of those with fewer than SHORT words,
enter an inverted index. Runs of a document found in the index propose places (document position less
template position); places of one template closer than its band are one candidate. A candidate
is aligned by a longest common subsequence inside a band around the proposed diagonal, and
reported if at least COVERAGE of the template's words match. Of matches that overlap in a
document the one with most matched words stays (ties: the earlier start, then the name); the others
are aligned again with the words it leaves, so copies that follow each other are all found.

Words are lower-case runs of ASCII letters, digits and non-ASCII characters. The index depends
on the templates alone (a parameter; the ones here make under 1 MB), so one pass without a
shuffle scans all documents.

Null and empty texts give no row, as do documents without a match; a repeated or null doc_id is
reported for each row. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Words of an indexed run; of templates of fewer than SHORT words.
GRAM, SHORT_GRAM, SHORT = 3, 2, 8
COVERAGE = 0.8
SCHEMA = "doc_id long, license string, coverage double, matched_words int, start_word long, end_word long, start_byte long, end_byte long"

#: Public license notices and headers by SPDX name and kind.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT/line": "Released under the MIT License.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSL-1.0/line": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
}


class Index:
    """Templates as word fingerprints, and an inverted index of all their runs for each length of
    run. With a fifth of its words changed or gone a template of n words has a run of at least
    0.8 n / (0.2 n + 1) words left, which is 3 at least from 6 words on and 2 for 5."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        data, offsets = T.text_buffers(pa.array([templates[n] for n in self.names]))
        _, _, first, (h,) = T.words(data, offsets, T.ALNUM, lower=True)
        self.words = [h[first[i] : first[i + 1]] for i in range(len(self.names))]
        self.runs = {}
        for gram in (SHORT_GRAM, GRAM):
            entries = []
            for i, w in enumerate(self.words):
                if len(w) >= gram and (SHORT_GRAM if len(w) < SHORT else GRAM) == gram:
                    entries += [(int(x), i, k) for k, x in enumerate(T.window_hash(w, gram))]
            entries.sort()
            self.runs[gram] = np.array([e[0] for e in entries], np.uint64), *(np.array([e[c] for e in entries], np.int64) for c in (1, 2))

    def lookup(self, runs: np.ndarray, gram: int):
        """(position in runs, template, place in it) of all runs of so many words in the index."""
        key, template, place = self.runs[gram]
        if not len(key):
            return (np.zeros(0, np.int64),) * 3
        a = np.searchsorted(key, runs)
        hit = np.flatnonzero(key[np.minimum(a, len(key) - 1)] == runs)
        many = np.searchsorted(key, runs[hit], "right") - a[hit]
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a[hit], many)
        return np.repeat(hit, many), template[entry], place[entry]


def _longest(template: np.ndarray, text: np.ndarray, offset: int, band: int) -> tuple[int, int]:
    """(matched words, least end in text) of a longest common subsequence within `band` of the diagonal
    text = template + offset. Only a row of the band's 2 * band + 2 borders is held: entry k of row i is
    border i + offset - band + k of the text. A value is count * many - end, so that more words come
    first and then the earlier end."""
    n, many = len(text), len(text) + 2
    place = np.arange(2 * band + 1) + offset - band
    row = np.zeros(2 * band + 2, np.int64)
    for i in range(len(template)):
        at = place + i
        inside = np.flatnonzero((at >= 0) & (at < n))
        inside = inside[text[at[inside]] == template[i]]
        new = np.append(row[1:], row[-1])
        new[0] = max(new[0], row[0])
        # The border after a matched word has the same place, as the next row counts from one further.
        new[inside] = np.maximum(new[inside], ((row[inside] + many - 1) // many + 1) * many - (at[inside] + 1))
        row = np.maximum.accumulate(new)
    best = int(row[-1])
    matched = -(-best // many)
    return matched, matched * many - best


def align(template: np.ndarray, text: np.ndarray, offset: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1 in text) of a longest common subsequence inside the band, of
    those the one that ends first and then starts last. (0, n, 0) if nothing matches."""
    matched, last = _longest(template, text, offset, band)
    if not matched:
        return 0, len(text), 0
    # The same from behind, of the text up to there.
    _, back = _longest(template[::-1], text[:last][::-1], last - len(template) - offset, band)
    return matched, last - back, last


def matches(index: Index, h: np.ndarray, hits: list[tuple[int, int, int]], coverage: float) -> list[tuple]:
    """Non-overlapping (license, coverage, matched, start, end) of one document, the one with most
    matched words first; one that overlaps those is aligned again with what they leave free."""
    queue: list[tuple] = []

    def propose(t: int, mid: int, lo: int, hi: int) -> None:
        w = index.words[t]
        band = max(3, len(w) // 5)
        lo, hi = max(0, mid - band, lo), min(len(h), mid + len(w) + band, hi)
        if hi - lo < coverage * len(w):
            return
        matched, first, last = align(w, h[lo:hi], mid - lo, band)
        if matched and matched >= coverage * len(w):
            heapq.heappush(queue, (-matched, lo + first, index.names[t], lo + last, t, mid))

    for t in sorted({x[1] for x in hits}):
        band = max(3, len(index.words[t]) // 5)
        places = sorted(p - q for p, k, q in hits if k == t)
        groups = [[places[0]]]
        for p in places[1:]:
            if p - groups[-1][0] <= band:
                groups[-1].append(p)
            else:
                groups.append([p])
        for g in groups:
            propose(t, g[len(g) // 2], 0, len(h))
    kept: list[tuple] = []
    while queue:
        matched, start, name, end, t, mid = heapq.heappop(queue)
        if all(end <= a or z <= start for a, z, *_ in kept):
            kept.append((start, end, name, -matched, t))
            continue
        free = 0
        for a, z, *_ in [*sorted(kept), (len(h), len(h))]:
            propose(t, mid, free, a)
            free = z
    return sorted(((name, matched / len(index.words[t]), matched, start, end) for start, end, name, matched, t in kept), key=lambda x: (x[3], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each reported match, as SCHEMA; spans are half open, bytes are UTF-8."""
    index = Index(TEMPLATES if templates is None else templates)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            data, offsets = T.text_buffers(batch.column(1))
            for lo, hi in T.slices(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first, (h,) = T.words(data[offsets[lo] : offsets[hi]], own, T.ALNUM, lower=True)
                by: dict[int, list] = {}
                for gram in index.runs:
                    at, template, place = index.lookup(T.window_hash(h, gram), gram)
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + gram <= first[doc + 1] if len(doc) else np.zeros(0, bool)
                    for d, p, t, q in zip(doc[inside].tolist(), at[inside].tolist(), template[inside].tolist(), place[inside].tolist()):
                        by.setdefault(d, []).append((p - int(first[d]), t, q))
                for d, hits in sorted(by.items()):
                    base = int(first[d])
                    for name, share, matched, a, b in matches(index, h[base : first[d + 1]], hits, coverage):
                        rows.append((ids[lo + d], name, share, matched, a, b, int(starts[base + a] - own[d]), int(ends[base + b - 1] - own[d])))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), *[pa.int64()] * 4]
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    T.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(T.table(spark, sf_dir, "documents"))
