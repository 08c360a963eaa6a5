"""Where passages repeat across a corpus: which places have to be compared, and bringing them together.

Texts are sequences of units (bytes or words); a window is a fixed number of them. Of the grams of
half a window's length that a window holds, the one with the smallest hash is its anchor, so equal
windows have equal anchors at equal places, and a run of consecutive windows shares one.

1. Anchors meet by their hash. A run whose anchor stands nowhere else can't repeat and is done with.
2. The other runs are cut out of their texts with all units that their windows touch: contexts.
   Contexts meet by anchor, and there the operator compares what they really hold
   (``Kind.classes``, ``Kind.windows``): operator 6 by a suffix sort, operator 10 by factors.
3. Where an anchor has more than ``CROWD`` different contexts, or ``CROWD_WINDOWS`` windows in them,
   these go on as single windows that meet by the hash of their contents. A crowded anchor's contexts
   pass through one task as a stream, of which no more is held than those numbers.

Equal contexts of a batch of texts are merged before they travel, and those that meet are merged as
they arrive. Work is dealt in buckets, of which the number follows from measured bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.rows import blocks, mix, prefix_hash, span_hash
from siltstream.plans.shared import drop, put, scratch

#: Bits of a place among ``SLICE`` units, below the hash bits that choose the anchor.
PLACE = np.uint64((1 << 24) - 1)
#: Units of one text that are hashed at once; longer texts are cut, with a window's overlap.
SLICE = 4_000_000
#: Text that a bucket holds; bytes of contexts that a bucket holds, and that a task compares at once.
DOCUMENT_BYTES, CONTEXT_BYTES, BATCH_BYTES = 16_000_000, 6_000_000, 3_000_000
#: Runs that a bucket of anchors holds.
ANCHOR_ROWS = 500_000
#: Different contexts of an anchor, and windows in them, beyond which they go on as windows: that takes some fifty times
#: their bytes, so it begins where an anchor's windows are many for one sort. Windows of several anchors that are sorted at once.
CROWD, CROWD_WINDOWS, WINDOWS_AT_ONCE = 20_000, 1_200_000, 300_000


@dataclass(frozen=True)
class Layout:
    """Texts as units: unit i is data[edge[i] : edge[i + 1] - gap], and row r has the units off[r] to off[r + 1]."""

    data: np.ndarray
    off: np.ndarray
    edge: np.ndarray | None = None  # None: units are bytes
    gap: int = 0

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the units from a up to b, of which there are some."""
        return (a, b) if self.edge is None else (self.edge[a], self.edge[b] - self.gap)


@dataclass(frozen=True)
class Contexts:
    """Runs of windows with what they touch. ``left``: units from the first window's start to the anchor."""

    key: np.ndarray
    uid: np.ndarray
    start: np.ndarray
    n: np.ndarray
    left: np.ndarray
    told: np.ndarray  # known to be repeated, and marked so
    raw: np.ndarray  # all bytes
    off: np.ndarray

    def take(self, i: np.ndarray) -> Contexts:
        return Contexts(*(getattr(self, f.name)[i] for f in fields(self)[:6]), *cut(self.raw, self.off[i], self.off[i + 1]))

    def __add__(self, other: Contexts) -> Contexts:
        columns = [np.concatenate((getattr(self, f.name), getattr(other, f.name))) for f in fields(self)[:7]]
        return Contexts(*columns, np.concatenate((self.off, other.off[1:] + self.off[-1])))

    def __len__(self) -> int:
        return len(self.key)


MARK = np.dtype([("uid", "<i8"), ("start", "<i4"), ("n", "<i4"), ("ref", "<i8"), ("at", "<i4")])
RUN = np.dtype([("uid", "<i8"), ("start", "<i4"), ("n", "<u2"), ("left", "<u2"), ("key", "<u8")])


@dataclass(frozen=True)
class Kind:
    """How texts become units, and how contexts are compared."""

    window: int
    gram: int
    #: (bytes, offsets) -> Layout
    layout: Callable[[np.ndarray, np.ndarray], Layout]
    #: (Layout, from, to) -> a hash for each of these units
    values: Callable[[Layout, int, int], np.ndarray]
    #: Contexts -> (marks of those equal to another one, one context of each class)
    classes: Callable[[Contexts], tuple[np.ndarray, Contexts]]
    #: Contexts that differ -> marks of what their windows share; they come in full groups by key
    windows: Callable[[Contexts], np.ndarray]


def cut(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each a up to b, one after the other, and their offsets."""
    off = np.concatenate(([0], np.cumsum(b - a))).astype(np.int64)
    return raw[np.repeat(a - off[:-1], b - a) + np.arange(off[-1])], off


def heads(*columns: np.ndarray) -> np.ndarray:
    """Of sorted columns: True where any differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def inner(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def make_marks(uid, start, n, ref, at) -> np.ndarray:
    out = np.zeros(len(uid), MARK)
    out["uid"], out["start"], out["n"], out["ref"], out["at"] = uid, start, n, ref, at
    return out


def _runs(values: np.ndarray, off: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor less first window, and anchor hash of each run."""
    size, gram = kind.window, kind.gram
    counts = np.maximum(np.diff(off) - size + 1, 0)
    if not counts.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    prefix = prefix_hash(values)
    at = np.arange(len(values) - gram + 1)
    grams = mix(span_hash(prefix, at, at + gram))
    key = (grams & ~PLACE) | (PLACE - at.astype(np.uint64))
    width, have = size - gram + 1, 1
    low = key
    while have < width:  # minima of ever wider runs of grams
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    first = np.repeat(off[:-1], counts) + inner(counts)
    anchor = (PLACE - (low[first] & PLACE)).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    head = np.flatnonzero(heads(anchor, row))
    n = np.diff(np.concatenate((head, [len(anchor)])))
    start, row, anchor = first[head], row[head], anchor[head]
    return row, start - off[row], n, anchor - start, grams[anchor]


def runs(layout: Layout, kind: Kind) -> tuple[np.ndarray, ...]:
    """As :func:`_runs`; a text of more than ``SLICE`` units is taken in pieces that overlap by a window less one."""
    off = layout.off
    if off[-1] <= SLICE:
        return _runs(kind.values(layout, 0, int(off[-1])), off, kind)
    parts = []
    for r in range(len(off) - 1):
        for a in range(int(off[r]), int(off[r + 1]), SLICE):
            b = min(a + SLICE + kind.window - 1, int(off[r + 1]))
            _, *rest = _runs(kind.values(layout, a, b), np.array([0, b - a]), kind)
            rest[0] = rest[0] + (a - int(off[r]))
            parts.append((np.full(len(rest[0]), r), *rest))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(5))


_tools: list = []


def squeeze(data: bytes) -> bytes:
    if not _tools:  # one of each for a worker
        _tools[:] = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _tools[0].compress(data)


def expand(data: bytes) -> bytes:
    if not _tools:
        squeeze(b"")
    return _tools[1].decompress(data)


# ---- blobs dealt by bucket -----------------------------------------------------------------------------------------

#: what: 0 runs or contexts, 1 marks. weight: bytes of the contexts that marks of step 1 lead to.
BLOB = "bucket int, what int, weight bigint, blob binary"


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _doc_bucket(uid: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(mix(uid.astype(np.int64).view(np.uint64)), buckets)


def _split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Of sorted bucket numbers: each with its rows."""
    edge = np.flatnonzero(heads(bucket))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), slice(a, b)


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "what", "weight", "blob"])


def _dealt(found: np.ndarray, buckets: int, extra: int = 0) -> list[tuple[int, int, int, bytes]]:
    """Marks (or runs to be cut out) by document."""
    if not len(found):
        return []
    where = _doc_bucket(found["uid"], buckets)
    order = np.lexsort((found["start"], found["uid"], where))
    found, where = found[order], where[order]
    return [(b, 1, int((found["n"][s].astype(np.int64) + extra).sum()), squeeze(found[s].tobytes())) for b, s in _split(where, buckets)]


class Gather:
    """Marks of many buckets together, so that a task deals few, large blobs."""

    def __init__(self, buckets: int, extra: int = 0, limit: int = 300_000):
        self.buckets, self.extra, self.limit, self.held, self.n = buckets, extra, limit, [], 0

    def add(self, marks: np.ndarray) -> list:
        self.held.append(marks)
        self.n += len(marks)
        return self.flush() if self.n > self.limit else []

    def flush(self) -> list:
        found, self.held, self.n = self.held, [], 0
        return _dealt(np.concatenate(found), self.buckets, self.extra) if found else []


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """The blobs of each bucket, one at a time, from batches sorted by bucket; each bucket has to be read to its end."""
    rows = ((int(bucket), blob) for batch in batches for bucket, blob in zip(batch.column("bucket").to_numpy().tolist(), batch.column("blob"), strict=True))
    ahead = next(rows, None)

    def own(bucket: int) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None and ahead[0] == bucket:
            blob, ahead = ahead[1].as_py(), next(rows, None)
            yield blob

    while ahead is not None:
        yield ahead[0], own(ahead[0])


# ---- step 1: anchors that stand twice ----------------------------------------------------------------------------------


def _find(kind: Kind, buckets: int, doc_buckets: int):
    """Texts to runs dealt by anchor, and (of anchors that stand twice in a block) runs to be cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Gather(doc_buckets, kind.window)
        for rows, raw, off in blocks(batches):
            row, start, n, left, key = runs(kind.layout(raw, off), kind)
            if not len(row):
                continue
            found = np.zeros(len(row), RUN)
            found["uid"] = rows.column("uid").to_numpy(zero_copy_only=False)[row]
            found["start"], found["n"], found["left"], found["key"] = start, n, left, key
            bucket = _bucket(key, buckets)
            order = np.lexsort((key, bucket))
            found, bucket = found[order], bucket[order]
            head = heads(found["key"])
            more = np.diff(np.concatenate((np.flatnonzero(head), [len(head)]))) > 1
            out = twice.add(found[~head])
            found, bucket = found[head], bucket[head]
            for b, s in _split(bucket, buckets):
                own = found[s]
                rest = squeeze(b"".join(own[c].tobytes() for c in ("uid", "start", "n", "left")) + more[s].tobytes())
                out.append((b, 0, 0, np.uint32(len(own)).tobytes() + own["key"].tobytes() + rest))
            yield _batch(out)
        if out := twice.flush():
            yield _batch(out)

    return run


def _run_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    found, at, rest = np.zeros(n, RUN), 0, expand(blob[4 + 8 * n :])
    found["key"] = np.frombuffer(blob, np.uint64, n, 4)
    for c in ("uid", "start", "n", "left"):
        found[c] = np.frombuffer(rest, RUN[c], n, at)
        at += n * RUN[c].itemsize
    return found, np.frombuffer(rest, bool, n, at)


def _twice(kind: Kind, doc_buckets: int):
    """Runs that meet at an anchor to runs to be cut out. Of an anchor only the first run is kept while others arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Gather(doc_buckets, kind.window)
        for _, blobs in _groups(batches):
            held, more, parts, n = np.zeros(0, RUN), np.zeros(0, bool), [], 0
            told = np.zeros(0, bool)

            def fold(parts, held, more, told):
                found = np.concatenate([held, *(p[0] for p in parts)])
                more = np.concatenate([more, *(p[1] for p in parts)])
                told = np.concatenate([told, np.zeros(len(found) - len(told), bool)])
                order = np.argsort(found["key"], kind="stable")
                found, more, told = found[order], more[order], told[order]
                first = np.flatnonzero(heads(found["key"]))
                size = np.diff(np.concatenate((first, [len(found)])))
                again = (size > 1) | np.logical_or.reduceat(more | told, first)
                out = found[np.repeat(again, size) & ~told]
                return out, found[first], more[first], again

            for blob in blobs:
                parts.append(_run_blob(blob))
                n += len(parts[-1][0])
                if n > 2 * ANCHOR_ROWS:
                    out, held, more, told = fold(parts, held, more, told)
                    parts, n = [], 0
                    if rows := twice.add(out):
                        yield _batch(rows)
            if parts:
                out, *_ = fold(parts, held, more, told)
                if rows := twice.add(out):
                    yield _batch(rows)
        if rows := twice.flush():
            yield _batch(rows)

    return run


# ---- texts and what is known about them --------------------------------------------------------------------------------


def packed_texts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, what, uid, blob): texts, compressed one by one, dealt by uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in blocks(batches):
            uid = rows.column("uid").to_numpy(zero_copy_only=False)
            blobs = [squeeze(raw[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_doc_bucket(uid, buckets).astype(np.int32)), pa.array(np.full(len(blobs), 2, np.int32)), pa.array(uid), pa.array(blobs, pa.binary())], ["bucket", "what", "uid", "blob"])

    return texts.select("uid", "text").mapInArrow(run, "bucket int, what int, uid bigint, blob binary")


def _together(marks: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Marks, then texts, of each bucket: one shuffle of both, sorted within partitions."""
    marks = marks.where("what = 1").select("bucket", "what", F.lit(0).cast("long").alias("uid"), "blob")
    return marks.unionByName(texts).repartition(parts, "bucket").sortWithinPartitions("bucket", "what")


def _documents(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, Callable[[], bytes], np.ndarray]]:
    """(uid, its text when asked for, its marks) from what :func:`_together` made."""
    held, blobs, marks, known = None, [], None, None
    for batch in batches:
        bucket, what, uid = (batch.column(c).to_numpy().tolist() for c in ("bucket", "what", "uid"))
        for i in range(batch.num_rows):
            if bucket[i] != held:
                held, blobs, marks = bucket[i], [], None
            if what[i] == 1:
                blobs.append(batch.column("blob")[i].as_py())
                continue
            if marks is None:
                marks = np.concatenate([np.zeros(0, kind), *(np.frombuffer(expand(b), kind) for b in blobs)])
                marks = marks[np.argsort(marks["uid"], kind="stable")]
                known = np.ascontiguousarray(marks["uid"])  # a field of the marks would be copied by every search
                blobs = []
            lo, hi = np.searchsorted(known, uid[i]), np.searchsorted(known, uid[i], side="right")
            yield uid[i], lambda b=batch, i=i: expand(b.column("blob")[i].as_py()), marks[lo:hi]


# ---- step 2: contexts --------------------------------------------------------------------------------------------------


def _context_rows(c: Contexts, buckets: int) -> list[tuple[int, int, int, bytes]]:
    """Contexts dealt by key."""
    bucket = _bucket(c.key, buckets)
    c, out = c.take(np.argsort(bucket, kind="stable")), []
    for b, s in _split(np.sort(bucket), buckets):
        own = b"".join(np.ascontiguousarray(x[s]).tobytes() for x in (c.uid, c.start, c.n, c.left, c.told, np.diff(c.off)))
        body = squeeze(own + c.raw[c.off[s.start] : c.off[s.stop]].tobytes())
        out.append((b, 0, 0, np.uint32(s.stop - s.start).tobytes() + c.key[s].tobytes() + body))
    return out


def _context_blob(blob: bytes) -> Contexts:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    rest, at, columns = expand(blob[4 + 8 * n :]), 0, []
    for t in (np.int64, np.int64, np.int64, np.int64, np.bool_, np.int64):
        columns.append(np.frombuffer(rest, t, n, at))
        at += n * np.dtype(t).itemsize
    return Contexts(np.frombuffer(blob, np.uint64, n, 4), *columns[:5], np.frombuffer(rest, np.uint8, offset=at), np.concatenate(([0], np.cumsum(columns[5]))))


def contexts(layout: Layout, uids: np.ndarray, row: np.ndarray, found: np.ndarray, window: int) -> Contexts:
    """Runs cut out of their texts. Equal keys stand together, then by place."""
    order = np.lexsort((found["start"], found["uid"], found["key"]))
    found, row = found[order], row[order]
    n = found["n"].astype(np.int64)
    a = layout.off[row] + found["start"].astype(np.int64)
    lo, hi = layout.span(a, a + n - 1 + window)
    columns = (found["key"], uids[row], found["start"].astype(np.int64), n, found["left"].astype(np.int64), np.zeros(len(n), bool))
    return Contexts(*columns, *cut(layout.data, lo, hi))


def _cut_out(kind: Kind, buckets: int, doc_buckets: int):
    """Texts and their runs to contexts dealt by anchor; equal ones of a batch of texts are merged first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(doc_buckets)

        def done(texts, uids, found):
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            layout = kind.layout(np.frombuffer(b"".join(texts), np.uint8), off)
            row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            every = np.concatenate(found)
            step = max(1, int(BATCH_BYTES / (2 * kind.window)))  # one very long text may have very many runs
            for at in range(0, len(every), step):
                c = contexts(layout, np.array(uids, np.int64), row[at : at + step], every[at : at + step], kind.window)
                marks, firsts = kind.classes(c)
                yield _batch(gather.add(marks) + _context_rows(firsts, buckets))

        texts, uids, found, held = [], [], [], 0
        for uid, text, own in _documents(batches, RUN):
            if not len(own):
                continue
            texts.append(text())
            uids.append(uid)
            found.append(own)
            held += len(texts[-1]) + 2 * kind.window * len(own)
            if held > BATCH_BYTES:
                yield from done(texts, uids, found)
                texts, uids, found, held = [], [], [], 0
        if texts:
            yield from done(texts, uids, found)
        if rows := gather.flush():
            yield _batch(rows)

    return run


# ---- step 3: contexts meet ---------------------------------------------------------------------------------------------


def _single_windows(c: Contexts, kind: Kind) -> Contexts:
    """Every window of the contexts as a context of its own, with a key from its contents."""
    layout = kind.layout(c.raw, c.off)
    k = inner(c.n)
    row = np.repeat(np.arange(len(c)), c.n)
    at = layout.off[:-1][row] + k
    prefix = prefix_hash(kind.values(layout, 0, int(layout.off[-1])))
    key = mix(span_hash(prefix, at, at + kind.window) ^ np.uint64(0x5DEECE66D))
    one = np.ones(len(k), np.int64)
    return Contexts(key, c.uid[row], c.start[row] + k, one, 0 * one, np.zeros(len(k), bool), *cut(layout.data, *layout.span(at, at + kind.window)))


def _crowded(c: Contexts, crowd: tuple[int, int]) -> np.ndarray:
    """Of contexts sorted by key: True where a key has more of them, or more windows in them, than ``crowd`` says."""
    if not len(c):
        return np.zeros(0, bool)
    first = np.flatnonzero(heads(c.key))
    size = np.diff(np.concatenate((first, [len(c)])))
    return np.repeat((size > crowd[0]) | ((size > 1) & (np.add.reduceat(c.n, first) > crowd[1])), size)


def _meet(kind: Kind, buckets: int, doc_buckets: int, last: bool, crowd: tuple[int, int] = (CROWD, CROWD_WINDOWS)):
    """Contexts to marks (what = 1); those of crowded anchors to single windows (what = 0), unless it is the ``last`` step.

    An anchor is crowded once it has more different contexts, or windows in them, than ``crowd`` says. Its contexts go on at once and
    what comes for it later follows, so that a task holds no more of an anchor than that and the blobs of one batch.
    Windows of the same contents have the same key in the next step, so there only those meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(doc_buckets)
        for _, blobs in _groups(batches):
            held, parts, size = None, [], 0
            gone = np.zeros(0, np.uint64)  # anchors known to be crowded

            def fold(held, parts, gone):
                """What is held of the anchors that are not crowded, crowded anchors, contexts that go on, rows of marks."""
                every = parts[0]
                for p in parts[1:]:
                    every = every + p
                every = every.take(np.lexsort((every.start, every.uid, every.key)))
                away = np.isin(every.key, gone)
                on = []
                if away.any():
                    marks, firsts = kind.classes(every.take(np.flatnonzero(away)))
                    on.append((marks, firsts))
                    every = every.take(np.flatnonzero(~away))
                if held is not None:
                    every = held + every
                    every = every.take(np.lexsort((every.start, every.uid, every.key)))
                marks, firsts = kind.classes(every)
                firsts = firsts.take(np.argsort(firsts.key, kind="stable"))
                if not last and (many := _crowded(firsts, crowd)).any():
                    on.append((marks[:0], firsts.take(np.flatnonzero(many))))
                    gone = np.union1d(gone, on[-1][1].key)
                    firsts = firsts.take(np.flatnonzero(~many))
                return firsts, gone, [c for _, c in on], gather.add(np.concatenate([marks, *(m for m, _ in on)]))

            def done(on, rows):
                if rows:
                    yield _batch(rows)
                for c in on:
                    # few contexts at a time, by what their windows take
                    edge = np.searchsorted(np.cumsum(c.n) * kind.window, np.arange(0, int(c.n.sum()) * kind.window, 2 * BATCH_BYTES))
                    for at, to in zip(edge.tolist(), [*edge[1:].tolist(), len(c)], strict=True):
                        if to > at:
                            yield _batch(_context_rows(_single_windows(c.take(np.arange(at, to)), kind), buckets))

            for blob in blobs:
                parts.append(_context_blob(blob))
                size += len(parts[-1].raw)
                if size > BATCH_BYTES:
                    held, gone, on, rows = fold(held, parts, gone)
                    parts, size = [], 0
                    yield from done(on, rows)
            if parts:
                held, gone, on, rows = fold(held, parts, gone)
                yield from done(on, rows)
            if held is None:
                continue
            # anchors with contexts that differ
            first = np.flatnonzero(heads(held.key))
            many = np.diff(np.concatenate((first, [len(held)])))
            open_ = held.take(np.flatnonzero(np.repeat(many, many) > 1))
            # whole anchors, so many that their windows number some hundred thousands
            edge = np.flatnonzero(np.append(heads(open_.key), True)) if len(open_) else np.zeros(1, np.int64)
            total = np.concatenate(([0], np.cumsum(open_.n)))
            at = 0
            while at < len(edge) - 1:
                to = max(at + 1, int(np.searchsorted(total[edge], total[edge[at]] + WINDOWS_AT_ONCE, side="right")) - 1)
                if rows := gather.add(kind.windows(open_.take(np.arange(edge[at], edge[to])))):
                    yield _batch(rows)
                at = to
        if rows := gather.flush():
            yield _batch(rows)

    return run


def _buckets(amount: int, each: int, parts: int) -> int:
    """So many that each holds about ``each``, a multiple of the number of partitions."""
    return parts * max(1, -(-amount // (each * parts)))


def repeated_windows(docs: DataFrame, kind: Kind, finish: Callable[[int, bytes, np.ndarray], tuple], schema: str, crowd: tuple[int, int] = (CROWD, CROWD_WINDOWS)) -> DataFrame:
    """(uid, …) for every row of ``docs`` (uid, text): ``finish`` gets uid, text and the marks of what repeats.

    finish returns the values of ``schema``, which begins with the uid. crowd: different contexts of an anchor, and windows in
    them, beyond which they go on as single windows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    doc_buckets = _buckets(size, DOCUMENT_BYTES, parts)
    anchor_buckets = _buckets(size * 2 // (kind.window - kind.gram), ANCHOR_ROWS, parts)
    dealt = lambda d: d.repartition(parts, "bucket").sortWithinPartitions("bucket")
    paths = {name: scratch(spark, name) for name in ("anchors", "runs", "contexts", "met", "apart")}
    save = lambda d, name: put(d, paths[name], "uncompressed", tidy=True)

    found = save(docs.select("uid", "text").mapInArrow(_find(kind, anchor_buckets, doc_buckets), BLOB), "anchors")
    twice = save(dealt(found.where("what = 0")).mapInArrow(_twice(kind, doc_buckets), BLOB), "runs")
    candidates = found.where("what = 1").unionByName(twice)
    units = candidates.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    buckets = _buckets(units * (1 if kind.window > 50 else 7), CONTEXT_BYTES, parts)

    texts = packed_texts(docs, doc_buckets)
    cut_out = save(_together(candidates, texts, parts).mapInArrow(_cut_out(kind, buckets, doc_buckets), BLOB), "contexts")
    for done in ("anchors", "runs"):  # nothing reads them any more
        drop(spark, paths[done])
    met = save(dealt(cut_out.where("what = 0")).mapInArrow(_meet(kind, buckets, doc_buckets, False, crowd), BLOB), "met")
    apart = save(dealt(met.where("what = 0")).mapInArrow(_meet(kind, buckets, doc_buckets, True), BLOB), "apart")
    marks = cut_out.unionByName(met).unionByName(apart)

    arrow = [pa.field(f.split()[0], {"bigint": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], [f.name for f in arrow])

        held = []
        for uid, text, own in _documents(batches, MARK):
            held.append(finish(uid, text(), own))
            if len(held) >= 1000:
                yield done(held)
                held = []
        if held:
            yield done(held)

    return _together(marks, texts, parts).mapInArrow(run, schema)
