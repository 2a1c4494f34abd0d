"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text is a sequence of word shingles. For each size class of templates it is cut into windows of `width` shingles
that overlap by half, `width` being at least twice a template's, so that every run of a template's length lies in some
window. A window and a template share a band when their least hash value under one function is equal; there are as
many functions per class as make the chance to miss a window that holds CONTAINED of a template MISS at most. A
retrieved template is a hit if the window holds CONTAINED of its shingles exactly.

The templates are a parameter; the default ones are public notices. Their number bounds the search tables.

Defined results: a null or empty text has no hit; a text shorter than a shingle is one shingle of all its words, and so
is a template; the whole text is scanned; hits of one template that overlap become one; repeated rows give repeated
results; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tenuis.llm.common import share, with_text_columns

WORDS = 5
CONTAINED = 0.75
MISS = 1e-5

# Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        ' to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF'
        " ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under"
        " the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,'
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}

#: Bytes outside letters, digits and non-ASCII characters separate words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles in order."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], dtype=np.uint64)
    hashed = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    count = len(words) - WORDS + 1
    out = np.zeros(count, dtype=np.uint64)
    for at in range(WORDS):
        out = (out ^ hashed[at : at + count]) * _MIX[at]
        out ^= out >> np.uint64(29)
    return out


def half_width(size: int) -> int:
    """Half a window for templates of `size` shingles: the next of 1, 2, 3, 4, 6, 8, 12, 16, 24 ..."""
    power = 1 << max(0, size - 1).bit_length()
    return power * 3 // 4 if power >= 4 and power * 3 // 4 >= size else power


def bands_for(size: int) -> int:
    """Functions needed for a template of `size` distinct shingles: the least similarity of a window to be found is
    the contained part over the window and the rest of the template."""
    part = math.ceil(CONTAINED * size)
    similarity = part / (2 * half_width(size) + size - part)
    return max(1, math.ceil(math.log(MISS) / math.log1p(-similarity))) if similarity < 1 else 1


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.sets = [], []
        for name, texts in templates.items():
            for text in texts:
                self.names.append(name)
                self.sets.append(frozenset(shingles(text).tolist()))
        widths: dict[int, list[int]] = {}
        for number, own in enumerate(self.sets):
            if own:
                widths.setdefault(half_width(len(own)), []).append(number)
        rng = np.random.default_rng(23)
        self.classes = []
        for half, members in sorted(widths.items()):
            count = max(bands_for(len(self.sets[n])) for n in members)
            factors = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            table: dict[int, set[int]] = {}
            for number in members:
                for key in self._least(np.array(sorted(self.sets[number]), dtype=np.uint64), factors).min(axis=1).tolist():
                    table.setdefault(key, set()).add(number)
            keys = np.array(sorted(table), dtype=np.uint64)
            self.classes.append((half, factors, keys, [sorted(table[k]) for k in keys.tolist()]))

    @staticmethod
    def _least(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Values of all functions; the function's number is part of a value's last bits, so bands don't meet."""
        mixed = hashes[None, :] * factors[:, None]
        mixed ^= mixed >> np.uint64(32)
        return (mixed & ~np.uint64(1023)) | (np.arange(len(factors), dtype=np.uint64) % np.uint64(1024))[:, None]

    def windows(self, half: int, factors: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Least values of the windows that start at multiples of `half`, by function and window."""
        blocks = np.minimum.reduceat(self._least(hashes, factors), np.arange(0, len(hashes), half), axis=1)
        return np.minimum(blocks, np.concatenate([blocks[:, 1:], blocks[:, -1:]], axis=1))

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first and last word (exclusive), contained part) of the hits, by place."""
        hashes = shingles(text)
        if not len(hashes):
            return []
        found: set[tuple[int, int, int]] = set()
        for half, factors, keys, owners in self.classes:
            least = self.windows(half, factors, hashes)
            at = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
            functions, windows = np.nonzero(keys[at] == least)
            for function, window in zip(functions.tolist(), windows.tolist(), strict=True):
                found.update((number, window * half, 2 * half) for number in owners[at[function, window]])
        return self.verified(hashes, found)

    def verified(self, hashes: np.ndarray, windows) -> list[tuple[str, int, int, float]]:
        hits: dict[str, list[tuple[int, int, float]]] = {}
        for number, start, width in windows:
            own = self.sets[number]
            part = hashes[start : start + width].tolist()
            places = [i for i, h in enumerate(part) if h in own]
            contained = len({part[i] for i in places}) / len(own)
            if contained >= CONTAINED:
                hits.setdefault(self.names[number], []).append((start + places[0], start + places[-1] + WORDS, contained))
        out = []
        for name, spans in hits.items():
            merged: list[list] = []
            for start, end, contained in sorted(spans):
                if merged and start < merged[-1][1]:
                    merged[-1][1:] = [max(merged[-1][1], end), max(merged[-1][2], contained)]
                else:
                    merged.append([start, end, contained])
            out += [(name, *m) for m in merged]
        return sorted(out, key=lambda h: (h[1], h[2], h[0]))


_HIT = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("contained", T.DoubleType()),
]))


def scanned(documents: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Per row: `key` and hits (license, first and last word, contained part)."""
    shared = share(documents.sparkSession, templates or TEMPLATES)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("contained", pa.float64())]))

    def work():
        scanner = Scanner(shared.value)

        def compute(texts):
            return [pa.array([[dict(zip(("license", "start", "end", "contained"), h, strict=True)) for h in scanner.scan(t)] for t in texts], kind)]

        return compute

    return with_text_columns(documents, [key], text, [T.StructField("hits", _HIT)], work)


def report(documents: DataFrame) -> DataFrame:
    found = scanned(documents)
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h.license)))
    return found.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.array_join(names, ",").alias("licenses"), "hits")
