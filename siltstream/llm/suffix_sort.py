"""Hash-compared suffix sort: common extensions by binary search, mergesort, verification.

A suffix is a place in a sequence of 64-bit units, read for at most ``limit`` units. Two are compared
in a number of steps that grows with the logarithm of the limit: a binary search over polynomial
prefix hashes finds their common extension, and the unit after it decides. As hashes may collide, every
pair of neighbours of the result is compared in full; a group in which one is wrong is sorted again
by what its suffixes really hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from siltstream.llm.rows import span_hash


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Units, up to ``limit``, that the suffixes at a and b have in common, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.broadcast_to(limit, len(a)).astype(np.int64)
    whole = span_hash(prefix, a, a + high) == span_hash(prefix, b, b + high)
    low[whole] = high[whole]
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        same = span_hash(prefix, x, x + mid) == span_hash(prefix, y, y + mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
        # the search ends with the first unit that differs
    return low


def _less(values: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether the suffix at a (of la units) sorts before the one at b; equal ones don't."""
    limit = np.minimum(la, lb)
    n = common_extension(prefix, a, b, limit)
    end = np.minimum(n, limit - 1)
    return np.where(n == limit, la < lb, values[a + end] < values[b + end])


def merge_sort(values: np.ndarray, prefix: np.ndarray, places: np.ndarray, group: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """A stable order of ``places`` (sorted by group) in which each group's suffixes are sorted.

    Bottom-up: runs of 1, 2, 4 ... merge in pairs, all pairs of all groups at once. An element's
    place in the merged run is its own rank plus its rank in the partner run, by binary search.
    """
    limit = np.broadcast_to(limit, len(places)).astype(np.int64)
    order = np.arange(len(places))
    begin = np.searchsorted(group, group)
    end = np.searchsorted(group, group, side="right")
    width = 1
    active = np.flatnonzero(end - begin > 1)
    while active.size:
        rank = active - begin[active]
        run = rank // width
        mine = begin[active] + run * width
        other = begin[active] + (run ^ 1) * width
        has = other < end[active]
        low, high = other.copy(), np.where(has, np.minimum(other + width, end[active]), other)
        left = run % 2 == 0  # ties: the left run's first
        own = order[active]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            theirs, ours, first = order[mid], own[open_], left[open_]
            # their suffix goes before ours: from the right run only if it is less, from the left one unless ours is
            a, b = np.where(first, theirs, ours), np.where(first, ours, theirs)
            less = _less(values, prefix, places[a], places[b], limit[a], limit[b])
            before = np.where(first, less, ~less)
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        to = np.minimum(mine, np.where(has, other, mine)) + (active - mine) + (low - other)
        new = order.copy()
        new[to] = own
        order = new
        width *= 2
        active = active[end[active] - begin[active] > width]
    return order


def sorted_suffixes(values: np.ndarray, prefix: np.ndarray, places: np.ndarray, group: np.ndarray, limit: np.ndarray, read: Callable[[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of each group sorted, and the units that each shares with the one before it.

    ``common`` is -1 for the first of a group. ``read(place, units)`` gives what a suffix really
    holds: neighbours are verified with it, and a group that hashes have sorted wrongly is sorted
    by it. Ties keep the order in which they came.
    """
    limit = np.broadcast_to(limit, len(places)).astype(np.int64)
    order = merge_sort(values, prefix, places, group, limit)
    common = np.full(len(places), -1, np.int64)
    later = np.flatnonzero(group[1:] == group[:-1]) + 1
    if not len(later):
        return order, common
    a, b = order[later - 1], order[later]
    most = np.minimum(limit[a], limit[b])
    n = common_extension(prefix, places[a], places[b], most)
    common[later] = n
    # in full: n units are equal, and the next ones stand in the order that was found
    end = np.minimum(n, most - 1)
    x, y = values[places[a] + end], values[places[b] + end]
    right = np.where(n == most, limit[a] <= limit[b], x < y)
    for i, p, q, k in zip(range(len(n)), places[a].tolist(), places[b].tolist(), n.tolist(), strict=True):
        if read(p, k) != read(q, k):
            right[i] = False
    for g in np.unique(group[later[~right]]):
        own = np.arange(*np.searchsorted(group, [g, g + 1]))
        held = {int(i): read(int(places[i]), int(limit[i])) for i in own}
        order[own] = sorted(own.tolist(), key=lambda i: (held[i], i))
        for before, at in zip(own, own[1:], strict=False):
            p, q = order[before], order[at]
            low, high = 0, int(min(limit[p], limit[q]))
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if read(int(places[p]), mid) == read(int(places[q]), mid) else (low, mid - 1)
            common[at] = low
    return order, common
