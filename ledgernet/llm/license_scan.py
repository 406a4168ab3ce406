"""License scan by matching statistics against a generalised suffix automaton.

The words of all license templates and of the base phrases make one suffix
automaton.  A text streams through it: at each word the automaton tells the
longest run of words that ends there and stands in some template (the matching
statistics).  A base phrase stands where its words are a suffix of that run.
Maximal runs of ``LEAST`` words or more are matches; matches that follow each
other in the text and in a template are chained, by dynamic programming over
the chains that ended at most ``GAP`` words before.  A chain that covers
``SHARE`` of its template is a license span; of spans that overlap the one that
covers most words stays.

Two neighbouring words that stand so in no template end every match of more
than one word, so only runs of known word pairs go through the automaton, word
by word; the pairs are found by hashes on whole batches, the automaton compares
the words themselves.  The automaton grows with the templates, not with the
texts, and each text is read once, without a shuffle.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
Defined results: null or wordless texts have no places, no labels and score 0;
rows are scanned each, also those that share an id; an empty table has no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgernet.llm import rolling
from ledgernet.llm.common import list_array, steps, text_batches, text_buffer

#: Words of a match; words that may stand between chained matches; share of a
#: template that a span covers.
LEAST, GAP, SHARE = 3, 12, 0.9

#: Base labels and their phrases (fixed values).
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices of public licenses (fixed values).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
            "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = np.ones(256, bool)
_BREAK[0x30:0x3A] = _BREAK[0x61:0x7B] = _BREAK[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(_LOWER.tobytes()))


class SuffixAutomaton:
    """All runs of words of several sequences.  State 0 is the empty run;
    ``longest`` is a state's longest run, ``link`` the state of its longest
    suffix that ends in more places, ``ends`` the (sequence, last place) where
    its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        direct: list[list[tuple[int, int]]] = [[]]
        for s, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                direct.extend([] for _ in range(len(self.next) - len(direct)))
                direct[last].append((s, at))
        self.ends = [set(d) for d in direct]
        for state in sorted(range(1, len(self.next)), key=self.longest.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, longest: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word: int) -> int:
        """The state that ``word`` leads to from ``at``, cut to the run of
        ``at`` and the word."""
        to = self.next[at][word]
        if self.longest[to] == self.longest[at] + 1:
            return to
        twin = self._state(self.longest[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = twin
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another sequence has the run already
            return self._split(last, word)
        new = self._state(self.longest[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def match(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """``(state, length)`` of the longest known run that ends at each word."""
        state = length = 0
        for word in run:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


@dataclass
class Chain:
    template: int
    first: int   # first and last word in the text
    last: int
    at: int      # last covered word of the template
    covered: int
    extended: bool = False


@dataclass
class Found:
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: set[str] = field(default_factory=set)
    best: float = 0.0
    chains: list[Chain] = field(default_factory=list)


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=None, least: int = LEAST, gap: int = GAP, share: float = SHARE):
        phrases = PHRASES if phrases is None else phrases
        self.least, self.gap, self.share = least, gap, share
        self.label = [label for label, _ in templates]
        self.phrase = list(phrases)
        split = [words(text) for _, text in templates] + [words(text) for text in phrases.values()]
        if any(len(s) < 2 for s in split):
            raise ValueError("templates and phrases have two words or more")
        self.size = [len(s) for s in split]
        known = sorted({w for s in split for w in s})
        self.known = {w: k for k, w in enumerate(known)}
        sequences = [[self.known[w] for w in s] for s in split]
        self.automaton = SuffixAutomaton(sequences)
        n = len(self.label)
        # a phrase is a suffix of the runs of its own state and of those that link to it
        self.phrases_at: list[list[tuple[int, str]]] = [[] for _ in self.automaton.next]
        for s, label in enumerate(self.phrase, n):
            self.phrases_at[list(self.automaton.match(sequences[s]))[-1][0]].append((self.size[s], label))
        for state in sorted(range(1, len(self.phrases_at)), key=self.automaton.longest.__getitem__):
            self.phrases_at[state] += self.phrases_at[self.automaton.link[state]]
        #: Template places that end with a state's runs.
        self.places_at = [sorted((s, at) for s, at in e if s < n) for e in self.automaton.ends]
        # pre-filter by hashes: known words, known pairs
        flat = np.frombuffer(b"".join(known), np.uint8)
        end = np.cumsum([len(w) for w in known])
        hashes = rolling.word_hashes(flat, end - [len(w) for w in known], end)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.pairs = np.unique([a * len(known) + b for s in sequences for a, b in zip(s, s[1:])])
        self.short = np.array([self.known[p[0]] * len(known) + self.known[p[1]] for p in split[n:] if len(p) == 2], np.int64)

    def runs(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of every run of known pairs that can hold a
        phrase or a match (a run of one pair only if the pair is a phrase)."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == hashes, self.order[at], -1)
        left, right = ids[:-1], ids[1:]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        code = left[both] * len(self.known) + right[both]
        inside = np.isin(code, self.pairs)
        borders = np.zeros(len(ids) + 1, bool)
        borders[bounds] = True
        inside &= ~borders[both + 1]
        both, code = both[inside], code[inside]
        if not len(both):
            return both, both
        start = np.flatnonzero(np.insert(both[1:] != both[:-1] + 1, 0, True))
        size = np.diff(np.append(start, len(both)))
        keep = (size > 1) | np.isin(code[start], self.short)
        return both[start[keep]], both[start[keep]] + size[keep]

    def scan(self, found: Found, run: list[bytes], first: int, open_: list[Chain]) -> list[Chain]:
        """Adds a run of words that begins at word ``first`` of the text;
        ``open_`` are the chains so far that may go on."""
        ids = [self.known.get(w, -1) for w in run]
        stats = list(self.automaton.match(ids))
        for k, (state, length) in enumerate(stats):
            for size, label in self.phrases_at[state]:
                if size <= length:
                    start = first + k - size + 1
                    found.n_base += 1
                    found.first = start if found.first is None else min(found.first, start)
                    found.last = start if found.last is None else max(found.last, start)
                    found.base.add(label)
                    found.best = 1.0
            grows = k + 1 < len(stats) and stats[k + 1][1] == length + 1
            if length >= self.least and not grows:
                open_ = self._chain(found, open_, first + k, length, state)
        return open_

    def _chain(self, found: Found, open_: list[Chain], last: int, length: int, state: int) -> list[Chain]:
        start = last - length + 1
        open_ = [c for c in open_ if start - c.last - 1 <= self.gap]
        new = []
        for template, at in self.places_at[state]:
            best = Chain(template, start, last, at, length)
            before = None
            for c in open_:
                more = min(length, at - c.at, last - c.last)
                if c.template == template and more > 0 and c.covered + more > best.covered:
                    best, before = Chain(template, c.first, last, at, c.covered + more), c
            if before is not None:
                before.extended = True
            new.append(best)
            share = best.covered / self.size[template]
            found.best = max(found.best, share)
            if share >= self.share:
                found.chains.append(best)
        return open_ + new

    def spans(self, found: Found) -> list[Chain]:
        """Chains that overlap no chain that covers more words."""
        out: list[Chain] = []
        taken: list[tuple[int, int]] = []
        ranked = sorted((c for c in found.chains if not c.extended), key=lambda c: (
            -c.covered, -c.covered / self.size[c.template], c.last - c.first, c.first, self.label[c.template]))
        for c in ranked:
            k = bisect_right(taken, (c.last, 1 << 62))
            if k and taken[k - 1][1] >= c.first:
                continue
            insort(taken, (c.first, c.last))
            out.append(c)
        return sorted(out, key=lambda c: c.first)


_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, spans array<struct<label: string, first_word: long, n_words: long, covered: long, "
           "share: double>>")


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_buffer(b.column("text"))
            for i, j in steps(offsets):
                lo = int(offsets[i])
                low = _LOWER[buf[lo:int(offsets[j])]]
                start, end, bounds = rolling.word_spans(low, offsets[i:j + 1] - lo, _BREAK)
                found = [Found() for _ in range(j - i)]
                if len(start) > 1:
                    a, z = scanner.runs(rolling.word_hashes(low, start, end), bounds)
                    rows = np.searchsorted(bounds, a, side="right") - 1
                    now, chains = -1, []
                    for row, x, y in zip(rows.tolist(), a.tolist(), z.tolist()):
                        if row != now:
                            now, chains = row, []
                        some = [low[start[k]:end[k]].tobytes() for k in range(x, y + 1)]
                        chains = scanner.scan(found[row], some, x - int(bounds[row]), chains)
                yield _rows(scanner, b.column("doc_id").slice(i, j - i), np.diff(bounds), found)
    return run


def _rows(scanner: Scanner, doc_id: pa.Array, n_words: np.ndarray, found: list[Found]) -> pa.RecordBatch:
    spans = [scanner.spans(f) for f in found]
    labels = [",".join(sorted(f.base | {scanner.label[c.template] for c in s})) for f, s in zip(found, spans)]
    flat = [c for s in spans for c in s]
    body = pa.StructArray.from_arrays(
        [pa.array([scanner.label[c.template] for c in flat], pa.string()), pa.array([c.first for c in flat], pa.int64()),
         pa.array([c.last - c.first + 1 for c in flat], pa.int64()), pa.array([c.covered for c in flat], pa.int64()),
         pa.array([c.covered / scanner.size[c.template] for c in flat], pa.float64())],
        names=["label", "first_word", "n_words", "covered", "share"])
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(n_words, pa.int64()), pa.array([f.n_base for f in found], pa.int64()),
         pa.array([f.first for f in found], pa.int64()), pa.array([f.last for f in found], pa.int64()),
         pa.array([",".join(sorted(f.base)) for f in found], pa.string()), pa.array(labels, pa.string()),
         pa.array([f.best for f in found], pa.float64()), list_array(body, np.array([len(s) for s in spans]))],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] | None = None, least: int = LEAST,
                 gap: int = GAP, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words``; the base
    phrases' ``n_base`` places, ``first_word, last_word`` (smallest and largest
    start) and ``base_labels``; ``labels`` with those of the license spans;
    ``score``, the largest covered share of a template or phrase; and ``spans``
    (label, first word, words from first to last, covered words, share)."""
    text_batches(docs.sparkSession)
    scanner = Scanner(templates, phrases, least, gap, share)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan(scanner), _SCHEMA)
