"""Licences in texts by a positional index of rare licence words.

The templates' words are indexed by template and position. In a text, the licence words of the highest inverse document frequency
(counted over all texts) are looked up; each occurrence at word p and posting at position q votes for the template at place
p - q. Where enough of a template's rare words agree on a place, up to words put in or left out (an eighth of the template's length,
two at least), the share of all its words that stand there in the template's order is its score, and the template's label counts if
the score is high enough and its mandatory phrase stands there in full.

Base places, whole phrases, are found the same way: a phrase's rarest word is looked up and the others are checked around it.

A notice cut short, or with a few words changed, left out or put in, scores the share of its words that are left in order.

Cases: a null or empty text has no words, no labels and score 0. Very long texts are read in whole. Repeated rows are judged alike. An empty table gives an empty
result. Other columns of the input aren't read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.common import map_texts

# Phrases whose places are the base, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of common licences: label, notice, mandatory phrase.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "permission is granted to anyone to use this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "any person or organization obtaining a copy"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "licensed under a creative commons attribution license", "creative commons attribution license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
]
#: Of every byte: what a word keeps of it (A-Z in lower case, digits, all beyond ASCII), a space for the rest.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def slack(notice: list[bytes]) -> int:
    """How far the place of a template's word may lie from those that its rare words vote for."""
    return max(2, len(notice) // 8)


def in_order(notice: dict[bytes, list[int]], ws: list[bytes], low: int, high: int, end: int) -> int:
    """The longest chain of words of a notice (each with its positions, the last first) that stand in ``ws`` in order, at places from ``low`` to ``high``.

    Words of the text come one by one; tails[k] is the least position at which a chain of k + 1 ends.
    """
    tails: list[int] = []
    for p in range(max(0, low), min(len(ws), end)):
        for q in notice.get(ws[p], ()):
            if low <= p - q <= high:
                k = bisect_left(tails, q)
                tails[k : k + 1] = [q]
    return len(tails)


class Index:
    """Postings of templates and base phrases; rarity: inverse document frequency of each licence word."""

    def __init__(self, rarity: dict[bytes, float], rare: int = 4):
        self.templates = [(label, notice.encode().split(), phrase.encode().split()) for label, notice, phrase in TEMPLATES]
        self.positions = []
        for _, notice, _ in self.templates:
            at = defaultdict(list)
            for q in reversed(range(len(notice))):
                at[notice[q]].append(q)
            self.positions.append(dict(at))
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for t, (_, notice, _) in enumerate(self.templates):
            ranked = sorted(range(len(notice)), key=lambda q: (-rarity.get(notice[q], 0.0), q))[:rare]
            self.need.append(max(2, len(ranked) // 2))
            for q in ranked:
                self.postings[notice[q]].append((t, q))
        self.base: dict[bytes, list[tuple[list[bytes], int, str]]] = defaultdict(list)
        for phrase, label in BASE.items():
            parts = phrase.encode().split()
            q = min(range(len(parts)), key=lambda k: (-rarity.get(parts[k], 0.0), k))
            self.base[parts[q]].append((parts, q, label))
        self.looked_up = frozenset(self.postings) | frozenset(self.base)

    def find(self, ws: list[bytes], least: float) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """(start, label) of every base place, and the best score of each label."""
        base, votes = [], defaultdict(lambda: defaultdict(set))
        if self.looked_up.isdisjoint(ws):
            return base, {}
        wanted = self.looked_up
        for p, w in [(p, w) for p, w in enumerate(ws) if w in wanted]:
            for parts, q, label in self.base.get(w, ()):
                if p >= q and ws[p - q : p - q + len(parts)] == parts:
                    base.append((p - q, label))
            for t, q in self.postings.get(w, ()):
                votes[t][p - q].add(q)
        scores: dict[str, float] = {}
        for t, at in votes.items():
            label, notice, phrase = self.templates[t]
            for low, high in self._bands(t, at):
                end = high + len(notice)
                near = ws[max(0, low) : max(0, end)]
                if scores.get(label, 0.0) == 1.0 or not any(near[k : k + len(phrase)] == phrase for k in range(len(near) - len(phrase) + 1)):
                    continue
                share = in_order(self.positions[t], ws, low, high, end) / len(notice)
                if share >= least and share > scores.get(label, 0.0):
                    scores[label] = share
        return base, scores

    def _bands(self, t: int, at: dict[int, set[int]]) -> Iterator[tuple[int, int]]:
        """(lowest, highest place) of the words that may belong together: those at most ``slack`` from every place of a run for which enough rare words vote."""
        places, wide, first = sorted(at), slack(self.templates[t][1]), 0
        counts: Counter = Counter()
        for k, high in enumerate(places):
            counts.update(at[high])
            while high - places[first] > wide:
                for q in at[places[first]]:
                    counts[q] -= 1
                    if not counts[q]:
                        del counts[q]
                first += 1
            # Only a run that the next place wouldn't widen.
            if (k + 1 == len(places) or places[k + 1] - places[first] > wide) and len(counts) >= self.need[t]:
                yield high - wide, places[first] + wide


def rarities(docs: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency, over all texts, of each word of the templates (a row for each is gathered)."""
    vocabulary = frozenset(w for _, notice, _ in TEMPLATES for w in notice.encode().split()) | frozenset(w for p in BASE for w in p.encode().split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in seen)], "n": [n, *seen.values()]}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    counts = {r.word.encode(): r.n for r in map_texts(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = counts.pop(b"", 0)
    return {w: float(np.log((n + 1) / (counts.get(w, 0) + 1))) for w in vocabulary}


def find_licenses(docs: DataFrame, rare: int = 4, least: float = 0.7) -> DataFrame:
    """FOUND of every row of ``docs`` (doc_id, text). score: the best template's, 1 for a base place, else 0."""
    rarity = rarities(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rarity, rare)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ws = words(text)
                base, scores = index.find(ws, least)
                starts, labels = [s for s, _ in base], {label for _, label in base}
                rows.append((len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(scores))), max([1.0 if base else 0.0, *scores.values()])))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in FOUND.split(", ")])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, FOUND)
