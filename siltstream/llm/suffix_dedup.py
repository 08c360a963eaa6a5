"""Byte-level removal of repeats by a hash-compared suffix sort (operator 6).

Suffixes of the texts that begin at equal anchors (see ``repeats``) are brought together and sorted:
mergesort, in which two suffixes are compared by a binary search over polynomial prefix hashes for
their common extension (see ``suffix_sort``). Neighbours with a common extension of a whole window are
repeats, after their bytes have been compared. First whole contexts are sorted, then, where those of
an anchor differ, the suffixes at each of their windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from siltstream.llm.repeats import CROWD, CROWD_WINDOWS, Contexts, Kind, Layout, heads, inner, make_marks, repeated_windows
from siltstream.llm.rows import BYTE, prefix_hash, with_key, with_uid
from siltstream.llm.suffix_sort import sorted_suffixes

WINDOW, GRAM = 100, 50


def _layout(raw: np.ndarray, off: np.ndarray) -> Layout:
    return Layout(raw, off)


def _values(layout: Layout, a: int, b: int) -> np.ndarray:
    return BYTE[layout.data[a:b]]


def equal_suffixes(raw: np.ndarray, places: np.ndarray, group: np.ndarray, limit: np.ndarray, sort=sorted_suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): suffixes sorted within their groups, and for each in that order the first of those equal to it.

    Groups of one are left as they are. Equal suffixes keep the order in which they came.
    """
    order = np.arange(len(places))
    first = order.copy()
    size = np.bincount(group, minlength=1)
    own = np.flatnonzero(size[group] > 1)
    if len(own):
        values = BYTE[raw]
        data = raw.tobytes()
        found, common = sort(values, prefix_hash(values), places[own], group[own], limit[own], lambda p, n: data[p : p + n])
        order[own] = own[found]
        same = common >= limit[own][found]
        at = np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))
        first[own] = order[own][at]
    return order, first


def classes(c: Contexts) -> tuple[np.ndarray, Contexts]:
    """Marks of the contexts that equal an earlier one, and the first of each class. They come sorted by key and place."""
    by = np.lexsort((c.start, c.uid, c.n, c.left, c.key))
    group = np.cumsum(heads(c.key[by], c.left[by], c.n[by])) - 1
    order, first = equal_suffixes(c.raw, c.off[:-1][by], group, c.n[by] + WINDOW - 1)
    own, ref = by[order], by[first]
    again = own != ref
    marks = make_marks(c.uid[own[again]], c.start[own[again]], c.n[own[again]], c.uid[ref[again]], c.start[ref[again]])
    return marks, c.take(np.sort(own[~again]))


def windows(c: Contexts) -> np.ndarray:
    """Marks of the windows that equal an earlier one among contexts of one anchor."""
    k = inner(c.n)
    row = np.repeat(np.arange(len(c)), c.n)
    key, side, uid, start, place = c.key[row], c.left[row] - k, c.uid[row], c.start[row] + k, c.off[:-1][row] + k
    by = np.lexsort((start, uid, side, key))
    group = np.cumsum(heads(key[by], side[by])) - 1
    order, first = equal_suffixes(c.raw, place[by], group, np.full(len(by), WINDOW))
    own, ref = by[order], by[first]
    again = own != ref
    own, ref = own[again], ref[again]
    return make_marks(uid[own], start[own], np.ones(len(own)), uid[ref], start[ref])


KIND = Kind(WINDOW, GRAM, _layout, _values, classes, windows)


def covered(marks: np.ndarray, length: int) -> np.ndarray:
    """True for each byte of a text that a marked window covers."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, marks["start"], 1)
    np.add.at(step, marks["start"] + marks["n"] - 1 + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def _finish(uid: int, text: bytes, marks: np.ndarray) -> tuple:
    if not len(marks):
        return uid, len(text), 0, 0, hashlib.sha256(text).hexdigest(), ""
    gone = covered(marks, len(text))
    spans = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(spans > 0), np.flatnonzero(spans < 0)
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    said = ",".join(f"{a}-{b}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return uid, len(text), int(gone.sum()), len(starts), hashlib.sha256(kept).hexdigest(), said


def remove_repeated_bytes(docs: DataFrame, spans: bool = False, crowd: tuple[int, int] = (CROWD, CROWD_WINDOWS)) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans as "from-to,…"): one row per row of ``docs``.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a smaller doc_id or
    before in the same text. Null texts are empty; texts under 100 bytes stay whole. Of rows with one
    doc_id the one with the smaller text hash is the earlier; null doc_ids come first.
    """
    texts, same = with_uid(docs)
    found = repeated_windows(texts, KIND, _finish, "uid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string", crowd)
    found = with_key(found, texts, same)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return found.select(*names, *(["spans"] if spans else []))

