"""License scan: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates are cut into words and into grams of ``GRAM`` words; of each ``WINDOW`` consecutive grams the one with the smallest hash is kept in an
inverted index from gram to (template, place). A document is looked up with all its grams, so any run of ``GRAM + WINDOW - 1`` words that
it shares with a template finds an entry. Matches of one template near one diagonal make a candidate; the template is then
aligned with the words around that diagonal (local alignment, at most ``band`` words off it), which gives the matched words, their share of the
template and the span in characters. Spans of at least ``coverage`` are reported, unless they lie inside a longer one.

The index is part of the tasks; templates of more than ``MOST_TEMPLATE_BYTES`` in all are refused. Documents are read once and nothing is
shuffled, so hot templates and long documents are linear work for the task that has them. Null and empty texts have no spans; rows that repeat
are scanned each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

GRAM = 3
WINDOW = 2
COVERAGE = 0.8
MOST_TEMPLATE_BYTES = 32 << 20

WORD = re.compile(r"[^\W_]+")

# Wording of public licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def winnow(hashes: Sequence[int], window: int = WINDOW) -> list[int]:
    """Places of the smallest hash of each window, the last of equal ones; of a shorter sequence the smallest of all."""
    kept = set()
    for start in range(max(len(hashes) - window, 0) + 1 if hashes else 0):
        part = range(start, min(start + window, len(hashes)))
        kept.add(min(part, key=lambda i: (hashes[i], -i)))
    return sorted(kept)


class Index:
    """Words of the templates, and where their winnowed grams occur."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        size = sum(len(text.encode("utf-8", "surrogatepass")) for _, text in templates)
        if size > MOST_TEMPLATE_BYTES:
            raise ValueError(f"templates of {size} bytes; at most {MOST_TEMPLATE_BYTES} are sent with a task")
        self.names = [name for name, _ in templates]
        self.words = [words_of(text) for _, text in templates]
        self.ids: dict[str, int] = {}
        for words in self.words:
            for word in words:
                self.ids.setdefault(word, len(self.ids) + 1)
        self.base = len(self.ids) + 1
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            # a template shorter than a gram is one gram, padded with the number of no word
            coded = [self.ids[w] for w in words]
            grams = self.grams(np.array(coded + [0] * (GRAM - len(coded)) if coded else []))
            for place in winnow([xxhash.xxh64_intdigest(int(g).to_bytes(16, "little")) for g in grams]):
                found[int(grams[place])].append((t, place))
        self.places = dict(found)
        self.keys = np.array(sorted(found), dtype=np.int64)

    def grams(self, coded: np.ndarray) -> np.ndarray:
        """A number for each gram of word numbers, different for different grams."""
        n = len(coded) - GRAM + 1
        total = np.zeros(max(n, 0), dtype=np.int64)
        for k in range(GRAM):
            total = total * self.base + coded[k : k + n].astype(np.int64) if n > 0 else total
        return total

    def scan(self, text: str, coverage: float) -> list[tuple[str, int, int, int, float]]:
        """(template, start, stop, matched words, coverage) of what is found, by place."""
        get = self.ids.get
        words = words_of(text)
        coded = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        if not coded.any():
            return []
        if len(coded) < GRAM:
            coded = np.concatenate([coded, np.zeros(GRAM - len(coded), dtype=np.int64)])
        grams = self.grams(coded)
        near = np.flatnonzero(np.isin(grams, self.keys))
        if not near.size:
            return []
        diagonals: dict[int, list[int]] = defaultdict(list)
        for at in near.tolist():
            for t, place in self.places[int(grams[at])]:
                diagonals[t].append(at - place)
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        found = []
        for t, starts in diagonals.items():
            m = len(self.words[t])
            band = max(4, m // 8)
            # a template whose first words are missing at the start of the text has its diagonal below zero
            done = min(starts) - 1
            for start in sorted(set(starts)):
                if start <= done:
                    continue
                low = max(start - band, 0)
                part = words[low : start + m + band]
                matched, first, last = align(self.words[t], part, start - low, band)
                if matched and matched >= coverage * m:
                    found.append((t, spans[low + first][0], spans[low + last][1], matched, matched / m))
                    done = low + last
        inside = lambda x: any(y is not x and y[1] <= x[1] and x[2] <= y[2] and (y[2] - y[1], y[3]) > (x[2] - x[1], x[3]) for y in found)
        return sorted((self.names[x[0]], *x[1:]) for x in found if not inside(x))


def align(template: Sequence[str], part: Sequence[str], offset: int, band: int) -> tuple[int, int, int]:
    """Best local alignment of ``template`` and ``part`` at most ``band`` words off the diagonal that starts at ``offset``: matched words, first
    and last matched place in ``part``."""
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + offset - band), min(len(part), i + offset + band + 1)):
            score, matched, first = above.get(j - 1, (0, 0, j))
            if part[j] == word:
                here = (score + 1, matched + 1, first if matched else j)
                if here[0] > best[0]:
                    best = (here[0], here[1], here[2], j)
            else:
                options = [(score - 1, matched, first)]
                for other in (above.get(j), row.get(j - 1)):
                    if other:
                        options.append((other[0] - 1, other[1], other[2]))
                here = max(options, key=lambda x: (x[0], x[1]))
            if here[0] > 0:
                row[j] = here
        above = row
    return best[1], best[2], best[3]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license_id, start, stop, matched, coverage), a row for each span of each row of ``docs``; start and stop count characters."""
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                rows += [(i, *found) for found in index.scan(text or "", coverage)]
            columns = list(zip(*rows)) or [[]] * 6
            made = [pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            taken = ids.take(pa.array(columns[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([taken, *made], names=["doc_id", "license_id", "start", "stop", "matched", "coverage"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, license_id string, start int, stop int, matched int, coverage double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
