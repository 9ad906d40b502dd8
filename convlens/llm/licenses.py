"""Licence scans by patience alignment.

A template is found in a text where its words line up: words that occur once in both are anchors,
the longest increasing subsequence of their positions is kept, and the gaps between anchors are
aligned in the same way. Coverage is the share of the template's words that are aligned; from
``COVERAGE`` on, the passage is a find.

Texts are not aligned from end to end, where hardly a word is unique: a find has at least a fifth of
its words among any ``m // 5 + 1`` words of a template of m words, so only the surroundings of the rarest
that many are aligned. That is a bound, not a heuristic. Where these hold words of the template more
often than it does (copies of a notice side by side), the words nearest to the rare one are aligned,
exactly. Where finds overlap, the one with more aligned words stays (then the higher coverage, the
name and the narrower one).

One task reads a text, whole; nothing is shuffled.

Defined results: null and empty texts hold no licence; a text may hold several, and one several times;
a text of any length is read; null ids are passed through; repeated rows give repeated finds; an empty
table gives none; only id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm.words import hashed_words, marks

COVERAGE_PERCENT = 80

# Wording of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
    " compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the Software), to deal in the Software without restriction",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
    " General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first number, whose second numbers rise."""
    tops: list[int] = []  # second number of the last pair of a subsequence of each length
    last: list[int] = []
    back: list[int] = []
    for i, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(last[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [j]
        last[pile : pile + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = rising([(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def nearest(words: list[int], places: list[int], template: list[int]) -> list[int]:
    """For each number of template words that can be aligned in order: the least distance it takes.
    places: how far each word is, rising."""
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    out, before = [0], [-1] * (len(template) + 1)
    while True:
        # ends[j]: the first word by which one more is aligned with the first j words of the template
        ends = [len(words)]
        for j, w in enumerate(template):
            own = at.get(w, [])
            k = bisect_right(own, before[j]) if before[j] < len(words) else len(own)
            ends.append(min(ends[-1], own[k] if k < len(own) else len(words)))
        if ends[-1] == len(words):
            return out
        out.append(places[ends[-1]])
        before = ends


class Scanner:
    def __init__(self, templates: dict[str, str], percent: int = COVERAGE_PERCENT):
        self.names, self.percent = list(templates), percent
        words, at = hashed_words([t.encode() for t in templates.values()], lower=True, gaps=marks)
        self.vocabulary = np.unique(words)
        ids = np.searchsorted(self.vocabulary, words)
        self.templates = [ids[at[i] : at[i + 1]].tolist() for i in range(len(self.names))]
        self.has = np.zeros((len(self.vocabulary), len(self.names)), np.int32)
        for t, own in enumerate(self.templates):
            self.has[own, t] = 1

    def needed(self, t: int) -> int:
        return -(-self.percent * len(self.templates[t]) // 100)

    def find(self, place: np.ndarray, word: np.ndarray, t: int) -> list[tuple[int, int, int, int, int]]:
        """Finds of template t in the known words of a text: (aligned, -template, template length, first, last)."""
        template = self.templates[t]
        m = len(template)
        times = Counter(word.tolist())
        # words the text lacks count as the rarest: they cannot be part of a find
        rarest = sorted(set(template), key=lambda w: (times[w], w))
        missed = m - self.needed(t)
        chosen, weight = [], 0
        for w in rarest:  # a find misses at most ``missed`` words, so it has one of these
            chosen.append(w)
            weight += template.count(w)
            if weight > missed:
                break
        where = np.sort(place[np.isin(word, chosen)])
        if not len(where):
            return []
        # surroundings that overlap are looked at one by one, each from its own centre
        finds: set[tuple[int, int, int, int, int]] = set()
        usual = Counter(template)
        for centre in where.tolist():
            low, high = np.searchsorted(place, [centre - 2 * m, centre + 2 * m + 1])
            words, places = word[low:high].tolist(), place[low:high].tolist()
            found = None
            if all(n <= usual[w] for w, n in Counter(words).items() if w in usual):
                pairs = self.dense([(places[i], j) for i, j in patience(words, template)], m)
                if len(pairs) >= self.needed(t):
                    found = len(pairs), pairs[0][0], pairs[-1][0]
            # several copies, or stray words of the template: what lies nearest to the centre
            found = found or self.around(words, places, places.index(centre), t)
            if found:
                finds.add((found[0], -t, m, found[1], found[2]))
        return sorted(finds)

    def around(self, words: list[int], places: list[int], centre: int, t: int) -> tuple[int, int, int] | None:
        """(aligned, first, last) of the find that holds the word at the centre, if any: on each side as
        many words as are worth their distance, or else as few as are needed in the least width."""
        template, needed, best = self.templates[t], self.needed(t), None
        mid = places[centre]
        for j in (j for j, w in enumerate(template) if w == words[centre]):
            left = nearest(words[:centre][::-1], [mid - p for p in places[:centre][::-1]], template[:j][::-1])
            right = nearest(words[centre + 1 :], [p - mid for p in places[centre + 1 :]], template[j + 1 :])
            n, k = (max(range(len(x)), key=lambda i: (2 * i - x[i], i)) for x in (left, right))
            if n + k + 1 < needed:
                both = [(left[n] + right[needed - 1 - n], n) for n in range(len(left)) if 0 <= needed - 1 - n < len(right)]
                if not both:
                    continue
                n = min(both)[1]
                k = needed - 1 - n
            own = (n + k + 1, -left[n] - right[k], mid - left[n], mid + right[k])
            best = max(best or own, own)
        return best and (best[0], best[2], best[3])

    @staticmethod
    def dense(pairs: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
        """Aligned words without the ones at the ends that lie far from the rest."""
        while len(pairs) > 1 and pairs[1][0] - pairs[0][0] > m // 2 + 1:
            pairs = pairs[1:]
        while len(pairs) > 1 and pairs[-1][0] - pairs[-2][0] > m // 2 + 1:
            pairs = pairs[:-1]
        return pairs

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, float, int, int]]]:
        """(name, coverage, first word, end word) of the finds of each text."""
        words, at = hashed_words(texts, lower=True, gaps=marks)
        ids = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[ids] == words) if len(words) else np.zeros(0, np.int64)
        word = ids[known]
        text = np.searchsorted(at, known, side="right") - 1
        cut = np.searchsorted(known, at)
        present = np.zeros((len(texts), len(self.vocabulary)), bool)
        present[text, word] = True
        count = present.astype(np.int32) @ self.has
        least = np.array([len(set(t)) - (len(t) - self.needed(i)) for i, t in enumerate(self.templates)])
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        for i, t in zip(*np.nonzero(count >= np.maximum(1, least))):
            own = slice(cut[i], cut[i + 1])
            out[i] += self.find(known[own] - at[i], word[own], int(t))
        return [self._best(x) for x in out]

    def _best(self, finds: list[tuple[int, int, int, int, int]]) -> list[tuple[str, float, int, int]]:
        kept: list[tuple[int, int, int, int, int]] = []
        for x in sorted(finds, key=lambda f: (-f[0], -f[0] / f[2], self.names[-f[1]], f[4] - f[3], f[3])):
            if all(x[4] < k[3] or x[3] > k[4] for k in kept):
                kept.append(x)
        return [(self.names[-t], n / m, first, last + 1) for n, t, m, first, last in sorted(kept, key=lambda f: f[3])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = COVERAGE_PERCENT) -> DataFrame:
    """doc_id, license, coverage, begin_word, end_word (excluded): one row per find."""
    templates = templates or TEMPLATES
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, percent)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = scanner.scan([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()])
                rows = [(i, *f) for i, own in enumerate(found) for f in own]
                if rows:
                    i, name, coverage, begin, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(i)), pa.array(name), pa.array(coverage, pa.float64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                        names=["doc_id", "license", "coverage", "begin_word", "end_word"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, begin_word long, end_word long")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
