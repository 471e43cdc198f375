"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

Templates are cut into overlapping word 3-grams; of every window of 3-grams the one of
smallest hash is kept in an inverted index from 3-gram to its places.  All 3-grams of
a text are looked up; hits of one template that lie on nearly the same diagonal make a
candidate, which is aligned word by word inside a band around that diagonal.  Any run of
``GRAM + WINDOW - 1`` words that a text shares with a template is hit at least once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import received, shipped, slices

GRAM = 3
WINDOW = 3
BAND = 8
COVERAGE = 0.8
#: The most template words that are sent to the executors.
MAX_TEMPLATE_WORDS = 2_000_000

#: Wordings of public licenses, by name.
TEMPLATES = [
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

#: Whole license texts stand after the short notices and openings.
TEMPLATES += [(p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda p: p.name)
              if p.name.endswith(".txt")]

#: ASCII marks become blanks, letters lower case; other bytes stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


class Index:
    """Vocabulary of the templates and the inverted index from 3-gram to (template, place)."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        texts = [words(text.encode("utf-8")) for _, text in templates]
        if sum(map(len, texts)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates have over {MAX_TEMPLATE_WORDS} words")
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.templates = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        entries = sorted({(gram, t, p) for t, ids in enumerate(self.templates) for gram, p in self.winnowed(ids)})
        self.grams = np.array([e[0] for e in entries], np.int64)
        self.places = np.array([e[1:] for e in entries], np.int64).reshape(-1, 2)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        base = len(self.vocabulary) + 1
        out = np.zeros(max(0, len(ids) - GRAM + 1), np.int64)
        for k in range(GRAM):
            out = out * base + ids[k:len(ids) - GRAM + 1 + k] if len(out) else out
        return out

    def winnowed(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """The 3-grams of smallest hash in every window, the last of equal ones; all of a template shorter than a window."""
        codes = self.codes(ids).tolist()
        order = [int.from_bytes(hashlib.blake2b(c.to_bytes(8, "little"), digest_size=8).digest(), "little") for c in codes]
        picked = set()
        for start in range(max(1, len(codes) - WINDOW + 1)):
            window = range(start, min(start + WINDOW, len(codes)))
            if window:
                best = min(window, key=lambda i: (order[i], -i))
                picked.add((codes[best], best))
        return picked

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Rows (template, diagonal, word) of the 3-grams of a text that the index holds."""
        none = np.zeros((0, 3), np.int64)
        if len(ids) < GRAM or not len(self.grams):
            return none
        known = ids > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        if not len(at):
            return none
        base = len(self.vocabulary) + 1
        code = (ids[at] * base + ids[at + 1]) * base + ids[at + 2]
        first, last = np.searchsorted(self.grams, code, "left"), np.searchsorted(self.grams, code, "right")
        n = last - first
        if not n.any():
            return none
        word = np.repeat(at, n)
        entry = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = self.places[entry]
        return np.column_stack((found[:, 0], word - found[:, 1], word))

    def possible(self, t: int, ids: np.ndarray, low: int, high: int) -> int:
        """Words that an alignment of the template on diagonals ``low`` to ``high`` can match at most, whatever their order."""
        template = self.templates[t]
        near = ids[max(0, low):max(0, high + len(template))]
        size = len(self.vocabulary) + 1
        return int(np.minimum(np.bincount(template, minlength=size), np.bincount(near, minlength=size))[1:].sum())

    def scan(self, ids: np.ndarray, coverage: float) -> list[tuple[int, float, int, int]]:
        """(template, coverage, first word, end word) of all confirmed matches.

        Of overlapping ones the one of more matched words stays, then the fuller, so a whole
        notice goes before the short one that it begins with.
        """
        found = self.hits(ids)
        matches = []
        for t in np.unique(found[:, 0]).tolist():
            diagonals = np.unique(found[found[:, 0] == t, 1]).tolist()
            band = min(BAND, len(self.templates[t]) // 2)  # a short template may follow upon itself
            group: list[int] = []
            for d in [*diagonals, None]:
                if group and (d is None or d - group[0] > band):
                    low, high = group[0] - band, group[-1] + band
                    matched = align(self.templates[t], ids, low, high) if self.possible(t, ids, low, high) >= coverage * len(self.templates[t]) else None
                    if matched and matched[0] >= coverage * len(self.templates[t]):
                        matches.append((t, matched[0] / len(self.templates[t]), matched[1], matched[2], matched[0]))
                    group = []
                group.append(d)
        taken: list[tuple] = []
        held = np.zeros(len(ids), bool)
        for m in sorted(matches, key=lambda m: (-m[4], -m[1], m[3] - m[2], m[2], m[0])):
            if not held[m[2]:m[3]].any():
                held[m[2]:m[3]] = True
                taken.append(m[:4])
        return sorted(taken, key=lambda m: m[2])


def align(template: np.ndarray, ids: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """Local alignment with words of the text on diagonals ``low`` to ``high``: matched words, first word, end word.

    A match scores 2, a word replaced, left out or put in costs 1.  A cell keeps where
    its alignment began and how many words matched, so no way back is needed.
    """
    width = high - low + 1
    nothing = (0, 0, -1)  # score, matched, first word
    best, ends = nothing, 0
    above = [nothing] * (width + 2)
    for i, word in enumerate(template.tolist()):
        line = [nothing] * (width + 2)
        for k in range(max(0, -(low + i)), min(width, len(ids) - low - i)):
            j = low + i + k
            same = ids[j] == word
            score, matched, first = above[k + 1]
            cell = (score + 2, matched + 1, j if first < 0 else first) if same else (score - 1, matched, first)
            for other in (above[k + 2], line[k]):  # a template word without partner, a text word without partner
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] <= 0:
                continue
            line[k + 1] = cell
            if cell[0] > best[0]:
                best, ends = cell, j + 1
        above = line
    return (best[1], best[2], ends) if best[0] > 0 else None


def scan(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match: ``doc_id, license, template, coverage, first_word, end_word, first_char, end_char``.

    Every whole text is scanned; words are runs of letters, digits and non-ASCII
    characters whatever their case.  ``coverage`` is the share of the template's words that the text
    holds in order, ``template`` its place in the list; the spans end before
    ``end_word`` and ``end_char``.  Texts without a match, null and empty ones give no
    row, repeated rows give repeated matches; other columns are not read.
    """
    index = shipped(spark, Index(TEMPLATES if templates is None else templates))
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, license string, template int, coverage double, first_word bigint, end_word bigint, first_char bigint, end_char bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(index)
        known = own.vocabulary.get
        names = ["doc_id", "license", "template", "coverage", "first_word", "end_word", "first_char", "end_char"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.float64()] + [pa.int64()] * 4
        for batch in slices(batches, "text"):
            rows = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not t:
                    continue
                raw = t.encode("utf-8")
                found = own.scan(np.array([known(w, 0) for w in words(raw)], np.int64), coverage)
                if found:
                    spans = [m.span() for m in _RUN.finditer(raw.translate(_PLAIN))]
                    for place, share, first, end in found:
                        a = len(raw[:spans[first][0]].decode("utf-8"))
                        b = a + len(raw[spans[first][0]:spans[end - 1][1]].decode("utf-8"))
                        rows.append((doc, own.names[place], place, share, first, end, a, b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), types)], names)

    return source.mapInArrow(run, schema)
