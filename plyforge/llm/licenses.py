"""Licence scans with a generalised suffix automaton over the words of licence templates.

Texts stream through the automaton word by word; the matching statistic of a position is the length of the longest run of
words ending there that occurs in a template. Where a longest run cannot grow in a template, it is a match of that one, and
so is every template that stands whole within a run; those of one template are chained in the order of both sides, with at most MOST_GAP words skipped
between them, and the words a chain covers are a span of the template. Every disjoint chain from COVER of its words on is a
span, or the best one where none has as much. A template counts from COVER of its words on. Words are lower-cased in A-Z.

``score`` says how much of a licence stands in the text: the largest product of a template's cover and its weight, which is its
words over FULL, and 1 from there on. So a whole notice scores 1, the name of a licence or a few words of one little.

Base phrases are templates too, counted at every place: a phrase stands at a position when its state is on the suffix path
of the state reached there. A phrase is a name and says nothing about a text being there, so phrases have no part in the score.

Handling of odd input: a null text counts as empty; without words all counts are 0, places null, labels empty, score 0;
repeated rows are scanned each; a null doc_id stays; an empty table gives an empty result; other columns are ignored.
Texts are scanned whole.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plyforge.llm import common
from plyforge.llm.licence_texts import WHOLE

COVER, MOST_GAP = 0.8, 8
#: Words of a template that weighs 1.
FULL = 20

#: Base phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices of public licences, in the words of the licences themselves (fixed values), and short licences whole.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD 3-Clause License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)
TEMPLATES = NOTICES + WHOLE

#: A-Z to a-z; every other byte below 128 that is no digit or small letter to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for s, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._grow(last, word)
                ends.append((last, s, at))
        #: Where a state's strings end: (sequence, place of the last word).
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for state, s, at in ends:
            while state > 0:
                self.ends[state].add((s, at))
                state = self.link[state]

    def _state(self, length: int, to: dict[int, int], link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """A copy of ``to`` that holds only its strings as short as those reached from ``state``."""
        copy = self._state(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _grow(self, last: int, word: int) -> int:
        if word in self.next[last]:
            to = self.next[last][word]
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            to = self.next[state][word]
            self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The matching statistic after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (to, length + 1) if to is not None else (0, 0)

    def find(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, cover: float = COVER, most_gap: int = MOST_GAP):
        self.cover, self.most_gap = cover, most_gap
        named = [(label, text) for text, label in phrases] + list(templates)
        self.labels = [label for label, _ in named]
        self.ids: dict[bytes, int] = {}
        sequences = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)] for _, text in named]
        self.sizes = list(map(len, sequences))
        self.weights = [0.0] * len(phrases) + [min(1.0, n / FULL) for n in self.sizes[len(phrases) :]]
        self.sam = Automaton(sequences)
        #: Of each state: the phrases on its suffix path, with their lengths.
        self.phrase_at: list[list[tuple[int, int]]] = [[] for _ in self.sam.next]
        at = {self.sam.find(sequences[p]): p for p in range(len(phrases))}
        for state in range(len(self.sam.next)):
            up = state
            while up > 0:
                if up in at:
                    self.phrase_at[state].append((at[up], self.sizes[at[up]]))
                up = self.sam.link[up]
        #: Of each state: where its strings stand, as (template, place, 0, next word, -1 at the end), and the whole templates that
        #: are shorter ends of them, as (template, place, length, -1).
        self.tails: list[list[tuple[int, int, int, int]]] = [[] for _ in self.sam.next]
        for state in range(1, len(self.sam.next)):
            self.tails[state] = [(s, at, 0, sequences[s][at + 1] if at + 1 < self.sizes[s] else -1) for s, at in self.sam.ends[state]]
            up = state
            while (up := self.sam.link[up]) > 0:
                for s, at in self.sam.ends[up] - self.sam.ends[state]:
                    if at + 1 == self.sizes[s] == self.sam.length[up]:
                        self.tails[state].append((s, at, at + 1, -1))
        #: Two words in a row that some template has; without them no statistic goes over 1, and no template is one word.
        self.pairs = np.zeros((len(self.ids) + 1) ** 2, bool)
        for sequence in sequences:
            for a, b in zip(sequence, sequence[1:]):
                self.pairs[a * (len(self.ids) + 1) + b] = True

    def scan(self, text: str) -> tuple[int, list[int], list[str], list[str], float, list[tuple[str, int, int, float]]]:
        """(words, starts of phrases, their labels, all labels, score, spans as (label, first word, last word, cover))."""
        words = words_of(text)
        n = len(words)
        get = self.ids.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, n)
        known = np.flatnonzero(self.pairs[codes[:-1] * (len(self.ids) + 1) + codes[1:]]) if n > 1 else np.zeros(0, np.int64)
        if not len(known):
            return n, [], [], [], 0.0, []
        starts, base = [], set()
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
            first, last = int(run[0]), int(run[-1]) + 1
            state = length = 0
            for i in range(first, last + 1):
                state, length = self.sam.step(state, length, int(codes[i]))
                for phrase, size in self.phrase_at[state]:
                    if length >= size:
                        starts.append(i - size + 1)
                        base.add(self.labels[phrase])
                # A template's match is over where the next word is not the template's.
                if length > 1:
                    following = int(codes[i + 1]) if i < last else -2
                    for s, at, size, word in self.tails[state]:
                        if word != following:
                            size = size or length
                            matches[s].append((i - size + 1, at - size + 1, size))
        by_template = {s: self._spans(s, found) for s, found in matches.items()}
        spans = [span for found in by_template.values() for span in found]
        labels = base | {label for label, *_, cover in spans if cover >= self.cover}
        score = max([cover * self.weights[s] for s, found in by_template.items() for *_, cover in found], default=0.0)
        return n, sorted(starts), sorted(base), sorted(labels), min(1.0, score), spans

    def _spans(self, s: int, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """All disjoint chains that cover enough of template ``s``, or the best chain if none does."""
        found, size = sorted(set(found)), self.sizes[s]
        taken: list[tuple[int, int, int]] = []  # covered words, first and last word
        # Whole templates first; between them the best chain of a part, and then what is left on both sides of it.
        for at, _, n in found:
            if n == size and (not taken or at > taken[-1][2]):
                taken.append((n, at, at + n - 1))
        bounds = [-1, *(x for _, a, b in taken for x in (a, b)), found[-1][0] + found[-1][2] + size]
        parts, k = [], 0
        for low, high in zip(bounds[::2], bounds[1::2]):
            part = []
            while k < len(found) and found[k][0] < high:
                part.append(found[k])
                k += 1
            # A run that ends beyond the lower bound may begin before it.
            parts.append((low + 1, high, part))
        while parts:
            low, high, part = parts.pop()
            part = [(at + cut, of + cut, min(n, high - at) - cut) for at, of, n in part if (cut := max(0, low - at)) < min(n, high - at)]
            best = self._chain(part, (low + high) // 2) if sum(n for *_, n in part) >= self.cover * size else None
            if best is None or best[0] < self.cover * size:
                continue
            taken.append(best)
            parts += [(low, best[1], [m for m in part if m[0] < best[1]]), (best[2] + 1, high, [m for m in part if m[0] + m[2] > best[2] + 1])]
        if not taken and (best := self._chain(found, 0)):
            taken = [best]
        return [(self.labels[s], a, b, n / size) for n, a, b in sorted(taken, key=lambda t: t[1])]

    def _chain(self, found: list[tuple[int, int, int]], middle: int) -> tuple[int, int, int] | None:
        """The chain of matches that covers most, in order on both sides, gaps bounded; of equal ones that nearest ``middle``."""
        best: tuple[int, int, int] | None = None
        chains: list[tuple[int, int, int, int]] = []  # covered words, end in the text, end in the template, first word
        for at, of, size in sorted(found):
            covered, first = size, at
            for had, end, of_end, began in reversed(chains):
                if end <= at - self.most_gap - 1:
                    if at - end > self.most_gap + max(self.sizes):
                        break
                    continue
                if end <= at and of_end <= of and had + size > covered:
                    covered, first = had + size, began
            chains.append((covered, at + size, of + size, first))
            if best is None or covered > best[0] or covered == best[0] and abs(first - middle) < abs(best[1] - middle):
                best = (covered, first, at + size - 1)
        return best


_ROWS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """The digest columns of each row; with ``spans`` also the covered spans (label, first and last word, cover)."""

    @common.task("licenses")
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for part in common.slices(batch, "text"):
                made = list(map(scanner.scan, part.column("text").to_pylist()))
                columns = [
                    part.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([len(m[1]) for m in made], pa.int64()),
                    pa.array([m[1][0] if m[1] else None for m in made], pa.int64()), pa.array([m[1][-1] if m[1] else None for m in made], pa.int64()),
                    pa.array([",".join(m[2]) for m in made]), pa.array([",".join(m[3]) for m in made]), pa.array([m[4] for m in made], pa.float64()),
                ]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
                if spans:
                    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))
                    columns.append(pa.array([[dict(zip(("label", "first", "last", "cover"), x, strict=True)) for x in m[5]] for m in made], kind))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", spans array<struct<label: string, first: long, last: long, cover: double>>" if spans else ""
    return common.id_text(docs, id_col, text_col).mapInArrow(run, _ROWS + more)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.documents(spark, sf_dir))
