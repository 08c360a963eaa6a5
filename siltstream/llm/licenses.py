"""License scans with a generalised suffix automaton of template tokens (operator 5).

One automaton holds the word sequences of all templates. Texts stream through it: at each word it
gives the longest suffix that some template contains (matching statistics). Maximal matches of at
least three words are placed in the templates that have them and chained, in rising order of both
text and template; a template of which a chain covers enough is a label, and each such chain that
overlaps no better one is a span. Base phrases are found by the same walk, as suffixes of the
current match, and count as wholes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstream.llm.license_texts import BODIES
from siltstream.llm.rows import ALNUM, LOWER, blocks, word_hashes, word_spans

# Base phrases with their labels, as the contract of the query has them.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Sentences of public licenses and notices; their bodies are in license_texts.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
LONG, ENOUGH = 3, 0.6
#: Words from which a base phrase is chained as templates are; shorter ones count where they stand as a whole.
WHOLE = 8
#: Covered words that a word between the matches of a chain counts for.
GAP = 0.25


class Automaton:
    """The suffix automaton of several token sequences; state 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Of each state: (sequence, place of its last token) of one occurrence at least.
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((k, at))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, q: int, token: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return new

    def walk(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each token the state and length of the longest suffix read so far that a sequence contains."""
        state, n = 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state = self.next[state].get(t, 0)
            n = n + 1 if state else 0
            yield state, n


#: Templates that a table may hold, as the automaton goes to every task.
MOST_TEMPLATES = 20_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Scanner:
    """The automaton over word numbers, and what texts need to be looked up fast."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases, self.templates = phrases, templates
        sequences = [_words(t) for t, _ in phrases] + [_words(t) for _, t in templates]
        vocabulary = sorted({w for s in sequences for w in s})
        number = {w: i for i, w in enumerate(vocabulary)}
        numbered = [[number[w] for w in s] for s in sequences]
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        self.sizes = [len(s) for s in sequences]
        #: Words of the shortest run worth a look: a base phrase counts however short it is.
        self.least = min([LONG, *(len(_words(p)) for p, _ in phrases)])
        self.automaton = Automaton(numbered)
        self.members = [frozenset(k for k, _ in ends) for ends in self.automaton.ends]
        raw = np.frombuffer("".join(vocabulary).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in vocabulary])
        hashes = word_hashes(raw, np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        pairs = {a * len(vocabulary) + b for s in numbered for a, b in zip(s, s[1:], strict=False)}
        self.pairs, self.base = np.array(sorted(pairs)), len(vocabulary)
        # of each state: the phrases that are suffixes of its strings, with their lengths
        whole = {}
        for k in range(len(phrases)):
            state = 0
            for t in numbered[k]:
                state = self.automaton.next[state][t]
            whole.setdefault(state, []).append((self.sizes[k], k))
        self.suffixes: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.link)):
            found, s = [], state
            while s > 0:
                found += whole.get(s, [])
                s = self.automaton.link[s]
            self.suffixes.append(found)

    def candidates(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers (-1: in no template), and the runs of words (from, to) of which all pairs are in templates."""
        h = word_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        number = np.where(self.hashes[at] == h, self.numbers[at], -1)
        joint = number[:-1] * self.base + number[1:]
        ok = (number[:-1] >= 0) & (number[1:] >= 0) & np.isin(joint, self.pairs)
        edge = first[1:-1]
        ok[edge[(edge > 0) & (edge < len(number))] - 1] = False
        step = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
        begin, end = np.flatnonzero(step > 0), np.flatnonzero(step < 0) + 1
        if self.least == 1:  # words on their own
            alone = np.flatnonzero((number >= 0) & ~np.append(False, ok) & ~np.append(ok, False))
            begin, end = np.concatenate((begin, alone)), np.concatenate((end, alone + 1))
        long = end - begin >= self.least
        return number, begin[long], end[long]

    def run(self, tokens: list[int], at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base phrases (phrase, first word) and maximal matches (state, first word, words) of a run that begins at word ``at``."""
        base, found, before = [], [], (0, 0)
        for i, (state, n) in enumerate(self.automaton.walk(tokens)):
            # a match ends where it goes on in no sequence, or where one of its sequences ends or differs
            if before[1] >= LONG and (n != before[1] + 1 or not self.members[before[0]] <= self.members[state]):
                found.append((before[0], at + i - before[1], before[1]))
            for size, k in self.suffixes[state]:
                if size <= n:
                    base.append((k, at + i + 1 - size))
            before = (state, n)
        if before[1] >= LONG:
            found.append((before[0], at + len(tokens) - before[1], before[1]))
        return base, found

    def chains(self, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """For each template the words that its best chain covers, and (first word, end) of all chains that cover enough.

        A template's spans don't overlap. They are taken best first, first as chains of which gaps are
        counted against what they cover, so that none runs from one notice into the next, then
        without that. A chain starts anew where the text moves on by more than two template lengths.
        Base phrases of fewer than ``WHOLE`` words aren't chained, as parts of them say nothing.
        """
        placed: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for state, at, n in found:
            for k, end in self.automaton.ends[state]:
                if end + 1 >= n and (k >= len(self.phrases) or self.sizes[k] >= WHOLE):
                    placed[k].append((at, end + 1 - n, n))
        for k, matches in placed.items():
            matches.sort()
            best = max(covered for _, covered, _, _ in self._ends(matches, k, 0))
            spans: list[tuple[int, int]] = []
            for price in (GAP, 0) if best / self.sizes[k] >= ENOUGH else ():
                parts, more = _between(matches, spans), True
                while more:
                    more = False
                    ranked = sorted((-value, first, end) for part in parts for value, covered, first, end in self._ends(part, k, price) if covered / self.sizes[k] >= ENOUGH)
                    for _, first, end in ranked:
                        if _free(spans, first, end):
                            insort(spans, (first, end))
                            more = True
                    # what lies between the spans may hold more of them
                    parts = [rest for part in parts for rest in _between(part, spans)]
            yield k, best, spans

    def _ends(self, matches: list[tuple[int, int, int]], k: int, price: float) -> Iterator[tuple[float, int, int, int]]:
        """(value, covered, first word, end) of the best chain that ends with each of the sorted matches; a word between matches costs ``price``."""
        window: list[tuple[int, int, float, int, int]] = []  # text end, template end, value, covered, first
        for at, place, n in matches:
            window = [w for w in window if at - w[0] <= 2 * self.sizes[k]]
            value, first, covered = float(n), at, n
            for text_end, template_end, before, sum_, begin in window:
                if text_end <= at and template_end <= place:
                    value, first, covered = max((value, first, covered), (before + n - price * (at - text_end), begin, sum_ + n))
            window.append((at + n, place + n, value, covered, first))
            yield value, covered, first, at + n


def _free(spans: list[tuple[int, int]], first: int, end: int) -> bool:
    """Whether (first, end) overlaps none of the sorted spans, which don't overlap."""
    i = bisect_left(spans, (first + 1,))
    return (i == 0 or spans[i - 1][1] <= first) and (i == len(spans) or end <= spans[i][0])


def _between(matches: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """The sorted matches that lie outside the sorted spans, by the gap that they stand in."""
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for m in matches:
        if _free(spans, m[0], m[0] + m[2]):
            gaps[bisect_left(spans, m[:1])].append(m)
    return list(gaps.values())


def _result(scanner: Scanner, base: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> tuple:
    starts = [at for _, at in base]
    base_labels = {scanner.labels[k] for k, _ in base}
    labels, score, spans = set(base_labels), 1.0 if base else 0.0, []
    for k, covered, own in scanner.chains(found):
        score = max(score, covered / scanner.sizes[k])
        spans += [(first, end, scanner.labels[k]) for first, end in own]
    # of two licenses of which one contains the other, a notice is the longer one's
    spans = [x for x in spans if not any(y is not x and y[0] <= x[0] and x[1] <= y[1] and (y[1] - y[0] > x[1] - x[0] or y[2] == x[2] and y > x) for y in spans)]
    labels |= {x for _, _, x in spans}
    said = ";".join(f"{a},{b},{x}" for a, b, x in sorted(spans))
    return len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(score, 1.0), said


_NOTHING = (0, None, None, "", "", 0.0, "")
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"


def template_rows(table: DataFrame) -> list[tuple[str, str]]:
    """(label, text) of a table of templates with these columns, in order; rows with a null or without words don't count. At most ``MOST_TEMPLATES``."""
    rows = table.where(table["label"].isNotNull() & table["text"].isNotNull()).select(table["label"].alias("label"), table["text"].alias("text"))
    held = sorted(tuple(r) for r in rows.distinct().limit(MOST_TEMPLATES + 1).collect())
    if len(held) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return [r for r in held if _words(r[1])]


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates: list | DataFrame = TEMPLATES + BODIES, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (and spans): one row per row of ``docs``.

    templates: (label, text) in a list, or a table with these columns. score: the largest share of a
    template that a chain covers, 1 where a base phrase stands. Spans read "first word,end,label", separated
    by semicolons; one within a longer one is left out, and so is its label. A null text has no words.
    Rows don't depend on one another, so repeated rows and null doc_ids come out as they are. Words are
    looked up by 64-bit hashes of the templates' vocabulary.
    """
    if isinstance(templates, DataFrame):
        templates = template_rows(templates)
    scanner = Scanner(phrases, templates)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in blocks(batches):
            raw = LOWER[raw]
            starts, ends, first = word_spans(raw, off, ALNUM)
            n = np.diff(first)
            out = [_NOTHING] * len(n)
            if len(starts):
                number, begin, end = scanner.candidates(raw, starts, ends, first)
                row = np.searchsorted(first, begin, side="right") - 1
                held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
                edges = first.tolist()
                for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):
                    base, found = scanner.run(number[a:b].tolist(), a - edges[r])
                    held[r][0].extend(base)
                    held[r][1].extend(found)
                for r, (base, found) in held.items():
                    if base or found:
                        out[r] = _result(scanner, base, found)
            columns = [rows.column("doc_id"), pa.array(n)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
            columns += [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    found = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, SCHEMA.replace("doc_id bigint", f"doc_id {kind}"))
    return found if spans else found.drop("spans")
