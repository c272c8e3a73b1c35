"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts are sequences of words (letters and digits, lower case). Every GRAM words in a row have
a hash; of each WINDOW hashes in a row the least is a fingerprint, so any match of GRAM + WINDOW - 1 words
shares one. Templates shorter than that keep all their hashes. An inverted index of the templates'
fingerprints gives, for a text's fingerprints, candidate templates with the diagonals (text position minus
template position) at which they match. Around each group of near diagonals a banded alignment of the
words is worked out; it reports the share of the template's words that it matches and the span of the text.

Defined results: null and empty texts match nothing; a template may match several times in a text (spans
do not overlap); a text may match several templates; templates with fewer
than GRAM words are refused. Spans are in characters of the text, the end excluded.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, texts_of

GRAM, WINDOW, BAND = 3, 4, 8
#: Share of a template's words that must match.
LEAST_COVERAGE = 0.8
#: Words of all templates, which go to every task, at most.
MOST_WORDS = 5_000_000
WORD = re.compile(r"[^\W_]+")

#: Notices by which texts commonly state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-reference": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0-reference": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of GRAM words in a row, from the words' hashes (unsigned 64 bits)."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the rightmost least hash of every WINDOW in a row."""
    if len(grams) <= WINDOW:
        return np.arange(len(grams))
    rows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(len(rows)) + WINDOW - 1 - rows[:, ::-1].argmin(1))


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    start: int
    end: int


def banded(text: list[str | None], template: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(words matched, first, last) of the best alignment of a template with the words of a text.

    Template word i may stand against text words shift + i - band to shift + i + band; among alignments
    with most matches the one of the shortest span is taken.
    """
    width = 2 * band + 1
    before = [(0, 0, -1, -1)] * width  # (matches, -length, first, last) of alignments that end in the row before
    best = (0, 0, -1, -1)
    for i, w in enumerate(template):
        now = [(0, 0, -1, -1)] * width
        for d in range(width):
            j = shift + i + d - band
            options = [now[d - 1]] if d else []
            if d + 1 < width:
                options.append(before[d + 1])
            got = max(options, default=(0, 0, -1, -1))
            if 0 <= j < len(text) and text[j] == w:
                m, _, first, _ = before[d]
                first = j if first < 0 else first
                got = max(got, (m + 1, first - j, first, j))
            else:
                got = max(got, before[d])
            now[d] = got
        before = now
        best = max(best, *now)
    return best[0], best[2], best[3]


class TemplateIndex:
    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: [w.lower() for w in WORD.findall(t)] for name, t in sorted(templates.items())}
        if short := [n for n, w in self.words.items() if len(w) < GRAM]:
            raise ValueError(f"templates of fewer than {GRAM} words: {short}")
        if sum(map(len, self.words.values())) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words")
        self.names = list(self.words)
        self.hash = {w: word_hash(w) for ws in self.words.values() for w in ws}
        self.filed: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, name in enumerate(self.names):
            grams = gram_hashes(np.array([self.hash[w] for w in self.words[name]], np.uint64))
            for at in winnowed(grams) if len(grams) >= 4 * WINDOW else range(len(grams)):
                self.filed[int(grams[at])].append((k, int(at)))
        self.keys = np.array(sorted(self.filed), np.uint64)
        #: Templates whose fingerprints are sparse are found by a text's fingerprints; the short ones' hashes all are filed.
        self.dense = any(len(w) < GRAM + 4 * WINDOW - 1 for w in self.words.values())

    def scan(self, text: str, least: float = LEAST_COVERAGE) -> list[Match]:
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        known = self.hash
        hashes = np.fromiter((known.get(w, 0) for w in words), np.uint64, len(words))
        if not hashes.any():
            return []
        unknown = np.flatnonzero(hashes == 0)  # each a word of its own, in no template
        hashes[unknown] = unknown.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
        grams = gram_hashes(hashes)
        at = np.arange(len(grams)) if self.dense else winnowed(grams)
        at = at[np.isin(grams[at], self.keys)]
        diagonals: dict[int, list[int]] = defaultdict(list)
        for p in at.tolist():
            for k, q in self.filed[int(grams[p])]:
                diagonals[k].append(p - q)
        found: list[Match] = []
        for k, shifts in diagonals.items():
            name, template = self.names[k], self.words[self.names[k]]
            shifts.sort()
            groups = [[shifts[0]]]
            for s in shifts[1:]:
                if s - groups[-1][0] <= BAND:
                    groups[-1].append(s)
                else:
                    groups.append([s])
            own: list[tuple[int, int, int]] = []
            open_: list[str | None] = list(words)  # words of a match take no part in the next
            for g in groups:
                for shift in dict.fromkeys(g):
                    matched, first, last = banded(open_, template, shift)
                    if matched >= least * len(template):
                        own.append((matched, first, last))
                        open_[first : last + 1] = [None] * (last + 1 - first)
            found += [Match(name, m / len(template), spans[a][0], spans[b][1]) for m, a, b in own]
        return sorted(found, key=lambda m: (m.start, m.license))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COVERAGE) -> DataFrame:
    """[id, license, coverage, span_start, span_end]: a row for every match; texts without one have none."""
    index = TemplateIndex(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found = [], []
            for i, text in enumerate(texts_of(batch)):
                for m in index.scan(text, least):
                    place.append(i)
                    found.append(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(place, pa.int64())), pa.array([m.license for m in found], pa.string()), pa.array([m.coverage for m in found], pa.float64()), pa.array([m.start for m in found], pa.int64()), pa.array([m.end for m in found], pa.int64())],
                names=["id", "license", "coverage", "span_start", "span_end"],
            )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return map_batches(slim, run, f"id {kind}, license string, coverage double, span_start bigint, span_end bigint").withColumnRenamed("id", id_col)
