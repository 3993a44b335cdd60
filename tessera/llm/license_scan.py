"""Licence scans: exact phrases, and templates found by a positional index of their rare words.

Each template is a list of words with positions. Document frequencies of all template words, counted over the whole
corpus, give their IDF. For a file, the licence words it holds are taken from the rarest down; each is looked up in the
postings (template, position) and gives the alignments ``position in file - position in template``. A template's words
that the file lacks and those looked up so far are added up: once an alignment could not lack them all, no further word
of the template needs to be looked up, and a template of which the file lacks too much is not looked up at all. Alignments
are verified by the template's mandatory phrases near them and by the IDF of the words that stand in their places.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_column, bound_batches, keyed_text

# Phrases whose presence is a label by itself.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Fixed values: (label, notice text, mandatory phrases), as the licences' authors publish them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ["apache license version 2"]),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu general public license", "version 3"]),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]

#: Share of a template's IDF that an alignment must carry, and how far a word may stand from its place in it.
MIN_COVERAGE = 0.6
SLACK = 2
#: A word may stand this far from its place, so its alignments are those of all these places.
SHIFTS = range(-SLACK, SLACK + 1)

#: Bytes that are not part of a word become spaces; A-Z become lower case.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def starts_of(norm: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which a phrase starts in ``norm``, words with a space before and after each."""
    found, at, word, last = [], norm.find(phrase), 0, 0
    while at >= 0:
        word += norm.count(b" ", last, at)
        last = at
        found.append(word)
        at = norm.find(phrase, at + 1)
    return found


def _phrase(text: str) -> bytes:
    return b" " + text.encode() + b" "


class LicenseIndex:
    """Postings of template words by IDF, built once per worker from document frequencies."""

    def __init__(self, frequencies: dict[str, int], n_docs: int, templates: list = TEMPLATES, phrases: dict = PHRASES) -> None:
        self.phrases = [(_phrase(p), label) for p, label in phrases.items()]
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.idf: dict[bytes, float] = {}
        for t, (label, text, keys) in enumerate(templates):
            words = words_of(text)
            for pos, word in enumerate(words):
                self.postings[word].append((t, pos))
                # A word that most documents hold still has a small weight, so that short templates can be aligned.
                self.idf[word] = math.log((n_docs + 1) / (frequencies.get(word.decode(), 0) + 1)) + 0.1
            self.templates.append((label, words, [_phrase(k) for k in keys]))
        self.totals = [sum(self.idf[w] for w in words) for _, words, _ in self.templates]
        #: What a template's word weighs, wherever it stands in it; and what a covered template can lack.
        self.weights: dict[bytes, dict[int, float]] = {w: defaultdict(float) for w in self.postings}
        for word, places in self.postings.items():
            for t, _ in places:
                self.weights[word][t] += self.idf[word]
        self.spare = [(1 - MIN_COVERAGE) * total + 1e-9 for total in self.totals]
        self.vocabulary = frozenset(self.postings)

    def scan(self, text: str) -> dict[str, Any]:
        words = words_of(text)
        norm = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.phrases:
            if hits := starts_of(norm, phrase):
                starts += hits
                base.add(label)
        found: dict[str, float] = dict.fromkeys(base, 1.0)
        for label, coverage in self._aligned(words, norm):
            found[label] = max(found.get(label, 0.0), coverage)
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(found)), "score": max(found.values(), default=0.0),
        }

    def _looked_up(self, held: set[bytes]) -> dict[int, list[tuple[bytes, int]]]:
        """For each template that a file with these licence words can cover: the words that fix its alignments."""
        missed = list(self.totals)
        for word in held:
            for t, weight in self.weights[word].items():
                missed[t] -= weight
        out: dict[int, list[tuple[bytes, int]]] = {t: [] for t, lacking in enumerate(missed) if lacking <= self.spare[t]}
        if not out:
            return out
        for word in sorted(held, key=lambda w: (-self.idf[w], w)):
            open_ones = {t for t in self.weights[word] if t in out and missed[t] <= self.spare[t]}
            out_of = [(t, pos) for t, pos in self.postings[word] if t in open_ones]
            for t, pos in out_of:
                out[t].append((word, pos))
            for t in open_ones:
                missed[t] += self.weights[word][t]
        return out

    def _aligned(self, words: list[bytes], norm: bytes) -> list[tuple[str, float]]:
        looked_up = self._looked_up(self.vocabulary.intersection(words))
        if not looked_up:
            return []
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            if word in self.vocabulary:
                places[word].append(i)
        offsets: dict[int, set[int]] = defaultdict(set)
        for t, found in looked_up.items():
            if all(k in norm for k in self.templates[t][2]):
                for word, pos in found:
                    offsets[t].update(i - pos + s for i in places[word] for s in SHIFTS)
        out = []
        for t, found in offsets.items():
            label, template, keys = self.templates[t]
            key_places = [starts_of(norm, k) for k in keys]
            best = 0.0
            for offset in found:
                if all(self._close(at, offset, len(template) + SLACK) for at in key_places):
                    best = max(best, sum(self.idf[w] for pos, w in enumerate(template) if self._close(places.get(w), offset + pos, SLACK)) / self.totals[t])
            if best >= MIN_COVERAGE:
                out.append((label, min(1.0, best)))
        return out

    @staticmethod
    def _close(at: list[int] | None, want: int, slack: int) -> bool:
        if not at:
            return False
        i = bisect_left(at, want - slack)
        return i < len(at) and at[i] <= want + slack


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def word_frequencies(rows: DataFrame, templates: list = TEMPLATES) -> tuple[dict[str, int], int]:
    """Documents that hold each template word, and all documents. One row per task and word reaches the shuffle."""
    vocabulary = frozenset(w for _, text, _ in templates for w in words_of(text))

    def count(batches: Any) -> Any:
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in vocabulary.intersection(words_of(text)):
                    seen[word] += 1
                seen[b""] += 1
        if seen:
            yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen], "n": list(seen.values())})

    found = rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {r["word"]: r["n"] for r in found}
    return by_word, by_word.pop("", 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list = TEMPLATES, phrases: dict = PHRASES) -> DataFrame:
    """One row per document: word count, phrase hits and their first and last word, base labels, all labels, score.

    A null or empty text has no words, empty labels and score 0; without a phrase hit first_word and last_word are
    null. Repeated rows and ids each keep a row; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    frequencies, n_docs = word_frequencies(rows, templates)
    held: list[LicenseIndex] = []

    def scan(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(LicenseIndex(frequencies, n_docs, templates, phrases))
        return pa.array([held[0].scan(t) for t in texts.to_pylist()], _ARROW)

    return rows.select("doc_id", arrow_column(scan, SCHEMA, F.col("text")).alias("found")).select("doc_id", "found.*")
