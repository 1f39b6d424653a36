"""License scans: an exact set-similarity join of text blocks with license templates.

A block of a template is any run of words of the whole text, across lines, of at
most ``length`` words: the template's own number of words over the threshold.  A
template matches it when the block holds at least ``threshold`` of the template's
distinct words.  Words are ordered by how often documents hold them, counted over
all documents, rarest first.

- Length filter: a text with fewer distinct template words than needed has no block.
- Prefix filter: a block that reaches the threshold must hold one of the template's
  first words in that order (its size minus the need, plus one), so only the
  surroundings of those places are looked at.
- Positional filter: going through the template's words in that order, a surrounding
  is given up as soon as more words are missing than may be.

What passes is compared in full: of every block that starts and ends with a template
word the distinct words are counted.  None of the filters loses a match.  Of
different labels whose blocks overlap the one with the larger share stays.

Phrases are found as well, word by word, and give labels of their own.

Defined results: a null text is the empty text without labels; repeated rows
repeat their result; equal shares in one place all stay; an empty table gives an
empty result; only the id and the text column are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks

#: Phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices of well-known licenses (fixed values).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
}
#: Longer texts by which licenses are granted, usually over many lines (fixed values).
TEXTS = {
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
THRESHOLD = 0.9
#: What is not 0-9, a-z, A-Z or beyond ASCII separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z in lower case."""
    return raw.translate(_TABLE).split()


def all_templates() -> list[tuple[str, str]]:
    """Short notices and longer texts, with their labels."""
    return [*TEMPLATES.items(), *TEXTS.items()]


def needs(text: str, threshold: float = THRESHOLD) -> tuple[frozenset[bytes], int, int]:
    """A template's distinct words, how many of them a block needs, and the longest block."""
    words = words_of(text.encode())
    return frozenset(words), ceil(round(threshold * len(set(words)), 9)), ceil(round(len(words) / threshold, 9))


def word_order(docs: DataFrame, words: frozenset[bytes], text_col: str = "text") -> list[bytes]:
    """Template words by the number of documents that hold them, rarest first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                sums.update(words.intersection(words_of(text.encode())))
        if sums:
            yield pd.DataFrame({"word": [w.decode() for w in sums], "n": list(sums.values())})

    # one row per template word at most
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = {r["word"].encode(): r["n"] for r in rows}
    return sorted(words, key=lambda w: (seen.get(w, 0), w))


class Templates:
    """Templates with their words in global order, and the blocks of a text that match them."""

    def __init__(self, templates: list[tuple[str, str]], order: list[bytes], threshold: float = THRESHOLD):
        rank = {w: k for k, w in enumerate(order)}
        self.all = []
        for label, text in templates:
            own, need, length = needs(text, threshold)
            if own:
                ranked = sorted(own, key=rank.__getitem__)
                self.all.append((label, own, ranked, frozenset(ranked[: len(own) - need + 1]), need, length))
        self.prefix_words = frozenset(w for t in self.all for w in t[3])

    def blocks(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """Label, share, first and last word of each block that reaches its template's need, one for each last word."""
        found: list[tuple[str, float, int, int]] = []
        have = set(words)
        if self.prefix_words.isdisjoint(have):
            return found
        for label, own, ranked, prefix, need, length in self.all:
            if prefix.isdisjoint(have) or len(own & have) < need:
                continue
            places = [(k, w) for k, w in enumerate(words) if w in own]
            for first, last in surroundings(places, prefix, length):
                part = places[first:last]
                if suffices({w for _, w in part}, ranked, need):
                    found += [(label, n / len(own), a, b) for n, a, b in counted(part, need, length)]
        return found

    def match(self, words: list[bytes]) -> dict[str, tuple[float, int]]:
        """Best share and its first word for each label; of labels that overlap the larger share stays."""
        by_label: dict[str, list[tuple[float, int, int]]] = {}
        for label, share, a, b in self.blocks(words):
            by_label.setdefault(label, []).append((share, a, b))
        if len(by_label) < 2:
            return {label: (share, a) for label, own in by_label.items() for share, a, _ in [min(own, key=lambda x: (-x[0], x[1], x[2]))]}
        columns = {label: tuple(map(np.array, zip(*own, strict=True))) for label, own in by_label.items()}
        tops = {label: painted(*own, len(words)) for label, own in columns.items()}
        best: dict[str, tuple[float, int]] = {}
        for label, (share, a, b) in columns.items():
            others = np.maximum.reduce([t for x, t in tops.items() if x != label])
            seen = np.flatnonzero(range_max(others, a, b) <= share)
            if len(seen):
                k = seen[np.lexsort((b[seen], a[seen], -share[seen]))[0]]
                best[label] = (float(share[k]), int(a[k]))
        return best


def painted(share: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` words the largest share of a block over it, from first words, last words and shares."""
    out = np.zeros(n)
    for s in np.unique(share):
        # larger shares are painted over smaller ones
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, a[share == s], 1)
        np.add.at(edge, b[share == s] + 1, -1)
        out[np.cumsum(edge[:-1]) > 0] = s
    return out


def range_max(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest value from each a up to its b, by maxima over powers of two."""
    out, width = np.empty(len(a)), b - a + 1
    level, size = values, 1
    while True:
        own = (width >= size) & (width < 2 * size)
        out[own] = np.maximum(level[a[own]], level[b[own] - size + 1])
        if 2 * size > width.max():
            return out
        level, size = np.maximum(level[:-size], level[size:]), 2 * size


def surroundings(places: list[tuple[int, bytes]], prefix: frozenset[bytes], length: int) -> list[tuple[int, int]]:
    """Runs of places around prefix words that hold every block of at most ``length`` words with such a word."""
    out: list[tuple[int, int]] = []
    spots = [k for k, w in places if w in prefix]
    at = [k for k, _ in places]
    for spot in spots:
        first, last = bisect_right(at, spot - length), bisect_right(at, spot + length - 1)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def suffices(have: set[bytes], ranked: list[bytes], need: int) -> bool:
    """Whether enough template words are there; given up when too many of the rarest are missing."""
    may = len(ranked) - need
    for word in ranked:
        if word not in have:
            may -= 1
            if may < 0:
                return False
    return True


def counted(places: list[tuple[int, bytes]], need: int, length: int) -> Iterator[tuple[int, int, int]]:
    """Distinct words, first and last word of each block that ends in one of the places and has enough."""
    inside: Counter = Counter()
    first = 0
    for last, (k, w) in enumerate(places):
        inside[w] += 1
        while places[first][0] <= k - length:
            gone = places[first][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            first += 1
        if len(inside) >= need:
            yield len(inside), places[first][0], places[last][0]


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """Start word and label of each place where a phrase stands."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        at, before, word = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", before, at)
            before = at
            found.append((word, label))
            at = joined.find(phrase, at + 1)
    return found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Phrases and template matches, with the first word of the first matching block, for each whole text."""
    own_templates = all_templates() if templates is None else templates
    order = word_order(docs, frozenset(w for _, text in own_templates for w in words_of(text.encode())), text_col)
    known = Templates(own_templates, order, threshold)
    phrases = {b" " + p.encode() + b" ": label for p, label in PHRASES.items()}
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(text: str) -> tuple:
        words = words_of(text.encode())
        base = phrase_places(words, phrases)
        found = known.match(words)
        own = {label for _, label in base}
        starts = [k for k, _ in base]
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
            ",".join(sorted(own | set(found))), max([1.0 * bool(base), *(s for s, _ in found.values())]), min((a for _, a in found.values()), default=None),
        )

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "block_word"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for part in blocks(texts):
                out = pd.DataFrame([scan(t) for t in texts[part]], columns=names)
                for name in ("first_word", "last_word", "block_word"):
                    out[name] = out[name].astype("Int64")
                out["score"] = out["score"].astype(np.float64)
                out.insert(0, "id", frame["id"].iloc[part].to_numpy())
                yield out

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = own.mapInPandas(
        run,
        f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, block_word long",
    )
    return out.withColumnRenamed("id", id_col)
