"""Operator 4: licence scan by a positional index of rare words.

First, the documents that hold each licence word are counted over all documents, which gives the words' IDF. Each
template is indexed by its highest-IDF words and those of its key phrases, with their positions. All of these that a file holds are then looked up
(bounded by the templates); a template is a candidate where postings of several words agree on one relative position (within ``SLACK``), and it
counts when a mandatory key phrase stands there and enough of its IDF-weighted words do, in its order.

Base: exact places of the phrases in BASE_PHRASES; their labels always stay.

Edge cases: null and empty texts have no words and no labels; a phrase repeated in a text counts at every place;
repeated documents give equal rows; an empty table gives no rows; clashing extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.common import small_batches, table, texts
from feira.llm.toxicity import FOLD

#: Phrase and label of the base scan.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label, sentence or clause of its notice as commonly written, mandatory key phrases (any of them suffices).
#: A notice's clauses are templates of their own, so that one with changed lines is known by those that are left.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice shall be included in all copies",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law or agreed to in writing",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ("permission notice appear in all copies",)),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see", ("copy of the gnu general public license",)),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see", ("copy of the gnu lesser general public license",)),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", ("copy of the mpl was not distributed",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish use compile sell or distribute",)),
)

SLACK = 2
#: Words of a template that are indexed, those of highest IDF; VOTES of each key phrase go with them.
ANCHORS = 6
#: IDF-weighted share of a template's words that must stand around the place, in the template's order.
LEAST_COVER = 0.5
#: A file's words looked up for a template must agree on a place this often, or as often as it has anchors.
VOTES = 2

SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _words(phrase: str) -> list[bytes]:
    return phrase.encode().split()


def vocabulary() -> set[bytes]:
    return {w for _, notice, _ in TEMPLATES for w in _words(notice)}


def word_idf(docs: DataFrame) -> dict[bytes, float]:
    """IDF of every licence word over all documents (as many numbers as the templates have words)."""
    words = vocabulary()

    def count(batches):
        import pyarrow as pa

        n: dict[bytes, int] = {}
        rows = 0
        for b in batches:
            for t in texts(b):
                rows += 1
                for w in words.intersection(t.translate(FOLD).split()):
                    n[w] = n.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *n], pa.binary()), "n": pa.array([rows, *n.values()], pa.int64())})

    sums = {bytes(r.word): r.n for r in docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: math.log((sums.get(b"", 0) + 1) / (sums.get(w, 0) + 1)) + 1.0 for w in words}


def in_order(notice: list[bytes], near: list[bytes], weight: dict[bytes, float]) -> float:
    """The most weight of words of ``notice`` that stand in ``near`` in the same order."""
    known = [w for w in near if w in weight]
    row = [0.0] * (len(known) + 1)
    for w in notice:
        before = 0.0
        for j, x in enumerate(known, 1):
            above = row[j]
            row[j] = before + weight[w] if x == w else max(above, row[j - 1])
            before = above
    return row[-1]


class Scanner:
    def __init__(self, idf: dict[bytes, float]):
        self.idf = idf
        self.templates = [(label, _words(notice), [_words(k) for k in keys]) for label, notice, keys in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        for t, (_, words, _) in enumerate(self.templates):
            best = self.anchors(words, self.templates[t][2])
            self.needed.append(min(VOTES, len(best)))
            for w in best:
                for q, x in enumerate(words):
                    if x == w:
                        self.postings.setdefault(w, []).append((t, q))
        self.base = [(_words(p), label) for p, label in BASE_PHRASES]
        # each base phrase is looked for at its rarest word
        self.base_at = [max(range(len(p)), key=lambda k, p=p: (idf.get(p[k], 0.0), k)) for p, _ in self.base]
        self.seek = frozenset(self.postings) | {p[k] for (p, _), k in zip(self.base, self.base_at, strict=True)}

    def anchors(self, words: list[bytes], keys: list[list[bytes]]) -> list[bytes]:
        """The highest-IDF words of a notice and those of each key phrase: as a phrase must stand, its words always agree."""
        best = lambda of, n: sorted(set(of), key=lambda w: (-self.idf[w], w))[:n]
        return list(dict.fromkeys(best(words, ANCHORS) + [w for key in keys for w in best(key, VOTES)]))

    def scan(self, text: bytes) -> tuple:
        """The columns of SCANNED after doc_id."""
        words = text.translate(FOLD).split()
        found = self.seek.intersection(words)
        if not found:
            return (len(words), 0, None, None, "", "", 0.0)
        at: dict[bytes, list[int]] = {w: [] for w in found}
        for j, w in enumerate(words):
            if w in found:
                at[w].append(j)
        places, base = [], set()
        for (phrase, label), k in zip(self.base, self.base_at, strict=True):
            starts = [j - k for j in at.get(phrase[k], ()) if j >= k and words[j - k : j - k + len(phrase)] == phrase]
            places += starts
            base |= {label} if starts else set()
        labels, score = set(base), 1.0 if base else 0.0
        votes: dict[int, list[tuple[int, bytes]]] = {}
        for w in found & self.postings.keys():
            for t, q in self.postings[w]:
                votes.setdefault(t, []).extend((j - q, w) for j in at[w])
        for t, cast in votes.items():
            if len({w for _, w in cast}) >= self.needed[t]:
                cover = self._verified(t, sorted(cast), words)
                if cover >= LEAST_COVER:
                    labels.add(self.templates[t][0])
                    score = max(score, cover)
        first, last = (min(places), max(places)) if places else (None, None)
        return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(min(score, 1.0), 6))

    def _verified(self, t: int, cast: list[tuple[int, bytes]], words: list[bytes]) -> float:
        """Best cover of template ``t`` at a place where enough words agree and a key phrase stands; 0 without one."""
        _, notice, keys = self.templates[t]
        weight = {w: self.idf[w] for w in notice}
        total, best, starts = sum(weight[w] for w in notice), 0.0, [s for s, _ in cast]
        k = 0
        while k < len(cast):
            start = starts[k]
            end = bisect_left(starts, start + SLACK + 1, k)
            if len({w for _, w in cast[k:end]}) >= self.needed[t]:
                near = words[max(0, start - SLACK) : start + len(notice) + 2 * SLACK]
                if any(key == near[i : i + len(key)] for key in keys for i in range(len(near) - len(key) + 1)):
                    best = max(best, in_order(notice, near, weight) / total)
                k = end
            else:
                k += 1
        return best


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document, as SCANNED."""
    spark = docs.sparkSession
    small_batches(spark)
    idf = word_idf(docs)

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(idf)
        names = [c.split()[0] for c in SCANNED.split(", ")]
        kinds = (pa.int64(),) * 5 + (pa.string(), pa.string(), pa.float64())
        for b in batches:
            rows = [(d, *scanner.scan(t)) for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)


def op4_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
