"""Removal of repeated passages by relative Lempel-Ziv parsing (operator 10).

The corpus is the reference. Its blocks are indexed by anchors (see ``repeats``): a block holds the
contexts of its anchors, and its index their suffixes in sorted order, in which a suffix's
longest match is one of its neighbours. A document's contexts are dealt to the blocks that can match them and
parsed there greedily: at the first window that isn't decided, the longest match with any other
place is looked up. A match of at least a window is a factor, and the next look-up is at the first window
that runs across its end; otherwise the parse moves on by a word. Matches are verified word by word.
Factors of a document that go on in the same reference are joined, and what they cover is removed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from siltstream.llm.repeats import CROWD, CROWD_WINDOWS, Contexts, Kind, Layout, heads, inner, make_marks, repeated_windows
from siltstream.llm.rows import SPACED, prefix_hash, with_key, with_uid, word_hashes, word_spans
from siltstream.llm.suffix_sort import sorted_suffixes

WINDOW, GRAM = 35, 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _layout(raw: np.ndarray, off: np.ndarray) -> Layout:
    """The words with one space after each."""
    starts, ends, first = word_spans(raw, off, SPACED)
    size = ends - starts
    edge = np.concatenate(([0], np.cumsum(size + 1))).astype(np.int64)
    data = np.full(edge[-1], 32, np.uint8)
    data[np.repeat(edge[:-1] - starts, size) + np.flatnonzero(SPACED[raw])] = raw[SPACED[raw]]
    return Layout(data, first, edge, 1)


def _values(layout: Layout, a: int, b: int) -> np.ndarray:
    lo, edge = int(layout.edge[a]), layout.edge[a : b + 1]
    return word_hashes(layout.data[lo : edge[-1]], edge[:-1] - lo, edge[1:] - 1 - lo)


def longest_matches(layout: Layout, places: np.ndarray, group: np.ndarray, limit: np.ndarray, sort=sorted_suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(words, with): each suffix's longest match with another of its group, and which one that is (-1: it is alone).

    The group's suffixes are sorted; the longest match is with a neighbour.
    """
    words, other = np.zeros(len(places), np.int64), np.full(len(places), -1, np.int64)
    size = np.bincount(group, minlength=1)
    own = np.flatnonzero(size[group] > 1)
    if not len(own):
        return words, other
    values = _values(layout, 0, len(layout.edge) - 1)
    data, edge = layout.data.tobytes(), layout.edge
    read = lambda p, n: data[edge[p] : edge[p + n]]
    order, common = sort(values, prefix_hash(values), places[own], group[own], limit[own], read)
    before, after = common, np.append(common[1:], -1)
    use = np.where(after > before, 1, -1)
    at = own[order]
    words[at] = np.maximum(before, after)
    other[at] = at[np.clip(np.arange(len(at)) + use, 0, len(at) - 1)]
    return words, other


def classes(c: Contexts) -> tuple[np.ndarray, Contexts]:
    """Factors of the contexts that match another one as a whole, and one context of each class, told if its windows are marked."""
    by = np.lexsort((c.start, c.uid, c.n, c.left, c.key))
    layout = _layout(c.raw, c.off)
    group = np.cumsum(heads(c.key[by], c.left[by], c.n[by])) - 1
    whole = c.n[by] + WINDOW - 1
    words, other = longest_matches(layout, layout.off[:-1][by], group, whole)
    full = (words >= whole) & (other >= 0)
    own, ref = by[full], by[other[full]]
    new = ~c.told[own]
    marks = make_marks(c.uid[own[new]], c.start[own[new]], c.n[own[new]], c.uid[ref[new]], c.start[ref[new]])
    # the first of each class stays: what is equal as a whole has equal bytes, and the group says the rest
    seen: dict[tuple, int] = {}
    raw, off = c.raw.tobytes(), c.off.tolist()
    keep = np.ones(len(c), bool)
    for i, g in zip(own.tolist(), group[full].tolist(), strict=True):
        keep[i] = seen.setdefault((g, raw[off[i] : off[i + 1]]), i) == i
    told = c.told.copy()
    told[own] = True
    return marks, Contexts(c.key, c.uid, c.start, c.n, c.left, told, c.raw, c.off).take(np.flatnonzero(keep))


def windows(c: Contexts) -> np.ndarray:
    """Factors of contexts, parsed greedily against the others of their anchor."""
    layout = _layout(c.raw, c.off)
    k = inner(c.n)
    row = np.repeat(np.arange(len(c)), c.n)
    key, side, place = c.key[row], c.left[row] - k, layout.off[:-1][row] + k
    by = np.lexsort((side, key))
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(heads(key[by], side[by])) - 1
    order = np.argsort(group, kind="stable")
    words, other = np.zeros(len(by), np.int64), np.full(len(by), -1, np.int64)
    found, with_ = longest_matches(layout, place[order], group[order], (c.n[row] - k + WINDOW - 1)[order])
    words[order], other[order] = found, np.where(with_ >= 0, order[with_], -1)
    begin = np.cumsum(c.n) - c.n
    at = np.where(c.told, c.n, 0)  # the window that is looked up next
    out = []
    while (open_ := np.flatnonzero(at < c.n)).size:
        i = begin[open_] + at[open_]
        factor = words[i] >= WINDOW
        j, r = i[factor], open_[factor]
        decided = words[j] - WINDOW + 1
        out.append(make_marks(c.uid[r], c.start[r] + at[r], decided, c.uid[row[other[j]]], c.start[row[other[j]]] + k[other[j]]))
        at[open_] += np.where(factor, words[i] - WINDOW + 1, 1)
    return np.concatenate(out) if out else make_marks([], [], [], [], [])


KIND = Kind(WINDOW, GRAM, _layout, _values, classes, windows)


def factors(marks: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(first word, words, reference document, first word there) in order; pieces that go on in the same reference are one."""
    out: list[list[int]] = []
    for start, n, ref, at in sorted(zip(marks["start"].tolist(), marks["n"].tolist(), marks["ref"].tolist(), marks["at"].tolist(), strict=True)):
        if out and out[-1][2] == ref and out[-1][0] - out[-1][3] == start - at and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n - 1 + window - out[-1][0])
        else:
            out.append([start, n - 1 + window, ref, at])
    return [tuple(x) for x in out]


def _finish(uid: int, text: bytes, marks: np.ndarray) -> tuple:
    words = _WORD.findall(text)
    if not len(marks):
        return uid, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), ""
    found = factors(marks)
    kept, at, removed = [], 0, 0
    for first, n, _, _ in found:
        kept += words[at:first]
        removed += max(0, first + n - max(at, first))
        at = max(at, first + n)
    kept += words[at:]
    return uid, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), ";".join(",".join(map(str, f)) for f in found)


def remove_repeated_passages(docs: DataFrame, with_factors: bool = False, crowd: tuple[int, int] = (CROWD, CROWD_WINDOWS)) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and factors): one row per row of ``docs``.

    A word goes if it is in a window of 35 words that also starts anywhere else, its own document
    included; all occurrences go. Null texts have no words; shorter texts stay whole. Repeated rows
    are different documents with equal texts. Factors read "first word, words, reference uid, first
    word there", separated by semicolons; uids are doc_ids where these are unique.
    """
    texts, same = with_uid(docs)
    found = repeated_windows(texts, KIND, _finish, "uid bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors string", crowd)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return with_key(found, texts, same).select(*names, *(["factors"] if with_factors else []))
