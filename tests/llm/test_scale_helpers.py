"""Parts of the operators on their own."""

import random

import numpy as np
import pyarrow as pa
import pytest

from siltstream.llm import simhash, suffix_sort, suffix_tree
from siltstream.llm.rows import BYTE, prefix_hash
from siltstream.llm.sharding import equal_capacities, min_cost_flow
from siltstream.llm.suffix_tree import Tree


def test_common_extension_and_sort():
    r = random.Random(1)
    raw = np.array([r.choice([97, 98]) for _ in range(400)], np.uint8)
    values = BYTE[raw]
    prefix = prefix_hash(values)
    places = np.array(r.sample(range(300), 120))
    group = np.sort(np.array([r.randrange(7) for _ in places]))
    order = suffix_sort.merge_sort(values, prefix, places, group, np.full(120, 100))
    assert sorted(order.tolist()) == list(range(len(places)))
    rank = {int(v): i for i, v in enumerate(sorted(set(values.tolist())))}
    text = lambda p: [rank[int(v)] for v in values[p : p + 100]]
    for g in set(group.tolist()):
        own = [text(places[i]) for i in order[group[order] == g]]
        assert own == sorted(own)
    a, b = places[:60], places[60:]
    for x, y, n in zip(a, b, suffix_sort.common_extension(prefix, a, b, np.full(60, 100)), strict=True):
        assert n == next((i for i in range(100) if raw[x + i] != raw[y + i]), 100)


def test_anchors_cover_all_links():
    """Whatever bits differ, up to four, one of the two meets the other at its home."""
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 3000, dtype=np.uint64)
    flips = np.zeros(3000, np.uint64)
    for i in range(3000):
        for b in r.choice(64, r.integers(1, 5), replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    y = x ^ flips
    met = np.zeros(3000, bool)
    for which, (_, reach) in enumerate(simhash.HALVES):
        home, other = simhash._home(simhash._halves(x)[which]), simhash._halves(y)[which]
        masks = simhash._masks(reach)
        met |= np.array([home[i] in (other[i] ^ masks[int(s)]) for i, s in enumerate(simhash._syndrome(other))])
    assert met.all()


def test_dense_anchor_links():
    r = np.random.default_rng(4)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)))
    found = {tuple(sorted((int(a), int(b)))) for x, y in simhash._dense(fps) for a, b in zip(x, y, strict=True)}
    assert found == {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 4}


def test_min_cost_flow():
    supply, capacity = [100, 10, 40, 0], equal_capacities(150, 4)
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(4)] for i in range(4)])
    assert [sum(x) for x in flow] == supply and [sum(x) for x in zip(*flow, strict=True)] == [38, 38, 37, 37]
    assert sum(flow[i][i] for i in range(4)) == sum(map(min, supply, capacity))
    # a detour through a residual arc is cheaper than either greedy choice
    assert min_cost_flow([1, 1], [1, 1], [[1, 2], [1, 5]]) == [[0, 1], [1, 0]]
    with pytest.raises(ValueError):
        min_cost_flow([3], [1], [[0]])


def test_tree_distributions_sum_to_one():
    """Root and states, explicit words and the shared rest."""
    hashes, counts = np.arange(1, 6, dtype=np.uint64), np.array([500, 300, 100, 60, 40])
    tree = Tree(hashes, counts, 1000, 5)
    tree.keys.append(np.array([0, 1]))
    tree.grow(tree.keys[0], np.array([500.0, 300.0]), np.array([-1, -1]), np.array([0, 0, 1, 1]), np.array([1, 0, 0, 2]), np.array([450.0, 50.0, 10.0, 280.0]))
    assert (tree.states[0] >= 0).all()
    rest = 0.5 / tree.floor  # the unknown word
    for s in (-1, 0, 1):
        p = tree.prob(np.full(5, s), np.arange(5)).sum()
        p += rest if s < 0 else tree.beta[s] * rest
        assert p == pytest.approx(1)


def test_dealt_tokens_are_narrow_and_known_ones_skip_the_count():
    """What is packed comes back, whatever its values; a token of which all counts are known is dealt by its context at once, in few bytes."""
    r = np.random.default_rng(4)
    n, top = 3000, np.iinfo(np.int64)
    t = {f: r.integers(0, 9, n) for f in suffix_tree.FIELDS[suffix_tree.TOKENS]}
    t |= {"uid": np.sort(r.integers(top.min, top.max, n)), "w": np.where(r.random(n) < 0.3, r.integers(1 << 63, (1 << 64) - 1, n, np.uint64), r.integers(0, 1 << 40, n).astype(np.uint64)), "n1": r.integers(-1, 1 << 50, n)}
    t |= {b: t[b].astype(np.uint64) for b in suffix_tree.BEFORE}
    bucket = r.integers(0, 70, n)
    order = np.argsort(bucket, kind="stable")
    for kind, columns in ((suffix_tree.TOKENS, t), (suffix_tree.SUMMED, {"uid": np.append([top.min], t["uid"][1:]), "n_known": t["n2"], "base": r.random(n), "score": r.random(n)})):
        back = suffix_tree._unpack(suffix_tree._pack(kind, columns, bucket), kind)
        assert all((back[f] == x[order]).all() for f, x in columns.items())
    tree = Tree(np.arange(1, 501, dtype=np.uint64), np.full(500, 40), 20_000, 500)
    place = r.integers(0, 500, 20_000).astype(np.int32)
    texts = np.arange(200).tobytes() + np.full(200, 100).tobytes() + np.ones(200, np.uint8).tobytes()
    row = [pa.array([200], pa.int32()), pa.array([20_000], pa.int32()), *(pa.array([pa.compress(x, codec="zstd", asbytes=True)], pa.binary()) for x in (texts, place.tobytes(), b""))]
    stored = pa.RecordBatch.from_arrays(row, [f.split()[0] for f in suffix_tree.NUMBERED.split(", ")])
    shared = type("Shared", (), {"value": tree})
    dealt = pa.Table.from_batches(suffix_tree._deal(shared, 0, 1, 4)(iter([stored])))
    assert set(dealt["kind"].to_pylist()) == {suffix_tree.COUNTED}
    assert len(suffix_tree._unpack(dealt, suffix_tree.COUNTED)["w"]) == 20_000
    assert sum(len(x) for x in dealt["data"].to_pylist()) < 10 * 20_000
