"""Crowded anchors in operators 6 and 10, and hashes beyond the tables of powers."""

import random
import resource
import time

import numpy as np
import pytest

from siltstream.llm import repeats, rows, suffix_dedup
from siltstream.llm.rlz import remove_repeated_passages
from siltstream.llm.suffix_dedup import remove_repeated_bytes

from . import brute
from .conftest import got, want

BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def crowd_rows():
    """A line in most documents, in many neighbourhoods of which some are copies, some are in one text, and some repeat in part."""
    r = random.Random(8)
    line = " ".join(f"word{j}" for j in range(24))
    around = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(n))
    out = [f"{around(20)} {line} {around(20)}" for _ in range(120)]
    out += r.choices(out, k=40) + [f"{a} {b}" for a, b in zip(out[:10], out[20:30], strict=True)]
    out += [f"{out[i][-90:]} {around(3)} {line} {out[i][:90]}" for i in range(20)]
    out += ["", line, line, None]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("crowd", [(3, 10_000), (10_000, 60), (1, 1)])
def test_crowded_anchors(spark, crowd):
    """Contexts go on as windows, beyond either bound: the same rows as plain loops give."""
    table = crowd_rows()
    df = spark.createDataFrame(table, "doc_id bigint, text string").repartition(5)
    assert got(remove_repeated_bytes(df, crowd=crowd), *BYTES) == want(brute.first_repeats(table))
    assert got(remove_repeated_passages(df, crowd=crowd), *WORDS) == want(brute.all_repeats(table))


def hot(n, seed=1):
    """Contexts of one anchor: a line of 50 bytes between neighbours that differ."""
    r = np.random.default_rng(seed)
    raw = r.integers(97, 123, (n, 150)).astype(np.uint8)
    raw[:, 50:100] = raw[0, 50:100]
    c = repeats.Contexts(np.full(n, 12345 << 20, np.uint64), np.arange(n), np.zeros(n, np.int64), np.full(n, 51), np.full(n, 50), np.zeros(n, bool), raw.ravel(), np.arange(n + 1) * 150)
    for a in range(0, n, 2000):
        yield repeats._batch(repeats._context_rows(c.take(np.arange(a, min(n, a + 2000))), 8))


def test_hot_anchor_is_a_stream():
    """All windows of 200,000 different contexts go on, in bounded time and memory."""
    begin, n = time.time(), 0
    for batch in repeats._meet(suffix_dedup.KIND, 8, 8, False)(hot(200_000)):
        own = zip(batch.column("what").to_pylist(), batch.column("blob").to_pylist(), strict=True)
        n += sum(int(np.frombuffer(blob, np.uint32, 1)[0]) for what, blob in own if what == 0)
    assert n == 200_000 * 51
    assert time.time() - begin < 180  # some 45 s alone
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2_000_000


def test_late_contexts_of_a_crowded_anchor(monkeypatch):
    """Streamed in small batches: what comes after an anchor is known to be crowded goes on too, equal ones marked."""
    monkeypatch.setattr(repeats, "BATCH_BYTES", 20_000)
    n = marks = 0
    twice = [*hot(1000), *hot(1000)]
    for batch in repeats._meet(suffix_dedup.KIND, 8, 8, False, (100, 10_000))(iter(twice)):
        for what, blob in zip(batch.column("what").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if what == 0:
                n += int(np.frombuffer(blob, np.uint32, 1)[0])
            else:
                marks += len(np.frombuffer(repeats.expand(blob), repeats.MARK))
    assert n == 2000 * 51 - 51 * marks


@pytest.mark.parametrize("n", [1, 5, 65_535, 65_536, 65_537, 200_000])
def test_powers(n):
    r = np.random.default_rng(n)
    own = rows.powers(rows.BASE, n)
    assert len(own) == n
    some = np.unique(np.concatenate((r.integers(0, n, 50), [0, n - 1])))
    expected = [pow(int(rows.BASE), int(i), 1 << 64) for i in some]
    assert own[some].tolist() == expected and rows.power_at(rows.BASE, some, n).tolist() == expected


def test_spans_far_along():
    """Equal spans have equal hashes beyond the blocks that texts usually come in."""
    raw = np.random.default_rng(2).integers(0, 256, 9_000_000).astype(np.uint8)
    raw[8_500_000:8_500_100] = raw[100:200]
    prefix = rows.prefix_hash(rows.BYTE[raw])
    begin = time.time()
    for _ in range(200):
        a, b, c = rows.span_hash(prefix, np.array([100, 8_500_000, 8_500_001]), np.array([200, 8_500_100, 8_500_101]))
        assert a == b != c
    assert time.time() - begin < 2
