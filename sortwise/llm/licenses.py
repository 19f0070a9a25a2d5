"""License scan over a positional index of licence words.

A-Z count as a-z; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A template is a
notice (or a short phrase) as a list of words, a label, the share of it that a file must
show, and key phrases.

1. One pass counts in how many texts each template word stands (a fixed list of words,
   so the table is bounded); that gives every word its inverse document frequency (IDF).
2. A template's *anchors* are its words of highest IDF, as many as it takes that the rest
   weigh less than the share it needs.  So every match holds an anchor, and nothing is
   lost by looking up anchors only.  The index maps an anchor to (template, place in it).
3. A second pass looks up each file's words.  A posting and a word's place in the file
   give the places where the template would begin (a word may be ``drift`` words off);
   equal ones are one candidate.
4. A candidate's share is the IDF weight of the template words that stand where they
   should, give or take ``drift`` words.
5. Candidates that reach their template's share are verified: every key phrase must
   stand, word by word, within the candidate.

Base phrases are templates with share 1 and no drift, so each place of one is a match.
Of the other templates the best match per text is kept (greatest share, then first).

Words are looked up by 64-bit hashes; key phrases, and so base phrases, are compared by
their bytes.
A word that is in no text has the IDF of one in none.  Null, empty and wordless texts
have no matches.  Repeated rows count and are scanned each; an empty table gives an
empty result.  A very long text is a slice of its own, its candidates are weighed in
blocks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import LOWER, runs, slices, span_hashes

_INK = np.zeros(256, dtype=bool)
_INK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Share of a notice's weight that a file must show, and words it may be off its place.
SHARE, DRIFT = 0.6, 2
#: Candidates weighed at a time.
BLOCK = 4096

# FIXED VALUES: base phrases with their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# FIXED VALUES: opening words of public licence notices: label, notice, key phrases.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
     ["in compliance with the license", "as is"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ["permission is hereby granted", "without restriction"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", ["redistribution and use", "with or without modification"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies",
     ["with or without fee"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any "
     "later version", ["free software", "general public license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License v2.0", ["eclipse public license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ["creative commons attribution"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
     "work", ["waived all copyright"]),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
     "held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...]
    share: float = SHARE
    drift: int = DRIFT
    base: bool = False


def default_templates() -> list[Template]:
    phrases = [Template(label, tuple(words_of(p)), (tuple(words_of(p)),), 1.0, 0, True) for p, label in BASE]
    return phrases + [Template(label, tuple(words_of(t)), tuple(tuple(words_of(k)) for k in keys)) for label, t, keys in NOTICES]


def _hash_words(data: np.ndarray, offsets: np.ndarray):
    """Start, end (bytes), text and hash of every word of lower-cased bytes."""
    start, end, doc = runs(_INK[data], offsets)
    return start, end, doc, span_hashes(data, start, end)


class Vocabulary:
    """The templates' words: numbers by word, and by the hash of a text's word."""

    def __init__(self, templates: list[Template]):
        self.words = sorted({w for t in templates for w in t.words} | {w for t in templates for k in t.keys for w in k})
        self.number = {w: i for i, w in enumerate(self.words)}
        raw = [w.encode() for w in self.words]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        hashes = span_hashes(data, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those of no template."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        good = self.hashes[at] == hashes[some]
        out[some[good]] = self.order[at[good]]
        return out


def _count_texts(vocabulary: Vocabulary):
    def run(batches):
        total, held = 0, np.zeros(len(vocabulary.words), dtype=np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, _, data, offsets in slices(batch.column(0)):
                _, _, doc, hashes = _hash_words(LOWER[data], offsets)
                number = vocabulary.numbers(hashes)
                some = np.flatnonzero(number >= 0)
                pairs = np.unique(doc[some] * len(held) + number[some])
                held += np.bincount(pairs % len(held), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], total))],
                                         names=["number", "n"])
    return run


def idf_of(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> np.ndarray:
    """IDF of every template word over all rows; the table has a row a word at most."""
    rows = (docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
            .mapInArrow(_count_texts(vocabulary), "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect())
    found = {r[0]: r[1] for r in rows}
    total = found.get(-1, 0)
    return np.array([math.log((total + 2) / (found.get(i, 0) + 1)) for i in range(len(vocabulary.words))])


class Index:
    """Templates as numbers and weights, and the postings of their anchors."""

    def __init__(self, templates: list[Template], vocabulary: Vocabulary, idf: np.ndarray):
        self.templates, self.vocabulary = templates, vocabulary
        self.numbers = [np.array([vocabulary.number[w] for w in t.words], dtype=np.int32) for t in templates]
        self.weights = [idf[n] / idf[n].sum() for n in self.numbers]
        postings: dict[int, list[tuple[int, int]]] = {}
        for k, (t, number, weight) in enumerate(zip(templates, self.numbers, self.weights, strict=True)):
            rest = 1.0
            for i in np.lexsort((np.arange(len(number)), -weight)).tolist():
                if rest < t.share - 1e-9:
                    break
                postings.setdefault(int(number[i]), []).extend((k, i + d) for d in range(-t.drift, t.drift + 1))
                rest -= weight[i]
        self.first = np.zeros(len(vocabulary.words) + 1, dtype=np.int64)
        flat = []
        for w in range(len(vocabulary.words)):
            flat += postings.get(w, [])
            self.first[w + 1] = len(flat)
        self.posting = np.array(flat, dtype=np.int64).reshape(-1, 2)

    def candidates(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, place of its first word) of every hit of an anchor, each once."""
        hits = np.flatnonzero(number >= 0)
        word = number[hits]
        count = self.first[word + 1] - self.first[word]
        hits, word, count = hits[count > 0], word[count > 0], count[count > 0]
        if not len(hits):
            z = np.zeros(0, dtype=np.int64)
            return z, z
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        post = self.posting[np.repeat(self.first[word], count) + step]
        place = np.repeat(hits, count) - post[:, 1]
        pair = np.unique(np.stack([post[:, 0], place]), axis=1)
        return pair[0], pair[1]

    def shares(self, k: int, places: np.ndarray, number: np.ndarray, doc: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Weight of template k's words that stand near where they should, in the text ``own``."""
        t, out = self.templates[k], np.empty(len(places))
        for a in range(0, len(places), BLOCK):
            at = places[a: a + BLOCK, None] + np.arange(len(t.words))
            seen = np.zeros(at.shape, dtype=bool)
            for d in range(-t.drift, t.drift + 1):
                x = np.clip(at + d, 0, len(number) - 1)
                seen |= (x == at + d) & (number[x] == self.numbers[k]) & (doc[x] == own[a: a + BLOCK, None])
            out[a: a + BLOCK] = np.where(seen.all(axis=1), 1.0, seen @ self.weights[k])
        return out

    def has_keys(self, k: int, place: int, words) -> bool:
        """Whether all key phrases stand in the candidate; ``words(i)`` is the word at i or None."""
        t = self.templates[k]
        for key in t.keys:
            last = place + len(t.words) + t.drift - len(key)
            if not any(all(words(p + j) == w for j, w in enumerate(key)) for p in range(place - t.drift, last + 1)):
                return False
        return True


_MATCH = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()),
                    ("share", pa.float64())])
_OUT = ("doc_id long, n_words long, "
        "matches array<struct<label:string,base:boolean,start:long,length:long,share:double>>")


def match_texts(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple]]]:
    """Per text: its number of words, and (label, base, first word, words, share) of its matches."""
    low = LOWER[data]
    start, end, doc, hashes = _hash_words(low, offsets)
    n = len(offsets) - 1
    count, out = np.bincount(doc, minlength=n), [[] for _ in range(n)]
    number = index.vocabulary.numbers(hashes)
    template, place = index.candidates(number)
    first = np.searchsorted(doc, np.arange(n + 1))
    raw = low.tobytes()
    for k in np.unique(template).tolist():
        t, places = index.templates[k], place[template == k]
        # the text of a candidate is that of any of its anchors; one that reaches into
        # neighbouring texts is a candidate of each
        own = doc[np.clip(places, 0, len(doc) - 1)]
        after = doc[np.clip(places + len(t.words) - 1 + t.drift, 0, len(doc) - 1)]
        ahead = doc[np.clip(places - t.drift, 0, len(doc) - 1)]
        reach = np.maximum(after, own) - np.minimum(ahead, own) + 1
        places, own = np.repeat(places, reach), np.repeat(np.minimum(ahead, own), reach) + (
            np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
        share = index.shares(k, places, number, doc, own)
        good = np.flatnonzero(share >= t.share - 1e-9)
        best: set[int] = set()
        for i in good[np.lexsort((places[good], -share[good], own[good]))].tolist():
            d, p = int(own[i]), int(places[i])
            if not t.base and d in best:
                continue

            def word(x: int, d=d):
                return raw[start[x]: end[x]].decode() if first[d] <= x < first[d + 1] else None

            if index.has_keys(k, p, word):
                best.add(d)
                out[d].append((t.label, t.base, p - int(first[d]), len(t.words), float(share[i])))
    return count, [sorted(x, key=lambda m: (m[2], m[0], m[1], m[3])) for x in out]


def _scan(index):
    def run(batches):
        names = [f.name for f in _MATCH]
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                count, found = match_texts(index.value, data, offsets)
                rows = [[dict(zip(names, m, strict=True)) for m in x] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(rows, pa.list_(_MATCH))],
                    names=["doc_id", "n_words", "matches"])
    return run


def scan(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and matches (label, base, first word, words, share; by place) of every row."""
    templates = default_templates() if templates is None else templates
    vocabulary = Vocabulary(templates)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, vocabulary, idf_of(docs, vocabulary, text_col)))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_scan(index), _OUT)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, the base places, labels, and the greatest share as score (0: no match)."""
    base = F.filter("matches", lambda m: m["base"])
    places = F.transform(base, lambda m: m["start"])

    def labels(column):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))
