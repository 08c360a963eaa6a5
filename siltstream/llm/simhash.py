"""SimHash near-duplicates by anchor-point covering (operator 7).

Every text gets a 64-bit fingerprint; fingerprints within four bits link. Four differing bits
put at most two into the upper 32 bits or at most one into the lower 32. On either half the
code words of the (31, 26) Hamming code, with one bit appended, are the anchors: every half lies
within distance 1 of one (its home). A fingerprint goes to all anchors within the covering radius
plus the half's threshold (3 and 2), so both of a linked pair meet at the home of either, where
homes are compared with all that came. An anchor emits a spanning forest of its links, not its
pairs; the links' components come from star contraction over a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.rows import LOWER, SPACED, blocks, narrow, with_row, without, word_spans
from siltstream.operators.graph import connected_components
from siltstream.plans.shared import stage

SHINGLE, THRESHOLD = 4, 4
#: (shift, radius plus threshold) of the halves.
HALVES = ((32, 3), (0, 2))
#: Copies of fingerprints that one bucket of anchors holds on average.
BUCKET_ROWS = 500_000
#: Comparisons at one anchor beyond which its members are first dealt by a block they must share.
DENSE = 4_000_000


def _fingerprints(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, off, SPACED)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(starts):
        return out
    # the words again, one space between them
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens + 1)))
    joined = np.full(at[-1], 32, np.uint8)
    inside = SPACED[raw]
    joined[np.repeat(at[:-1] - starts, lens) + np.flatnonzero(inside)] = raw[inside]
    data, words = joined.tobytes(), np.diff(first)
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, (words > 0).astype(np.int64))
    rows = np.flatnonzero(count)
    begin = np.repeat(first[:-1][rows] - np.concatenate(([0], np.cumsum(count[rows])[:-1])), count[rows]) + np.arange(count.sum())
    end = np.minimum(begin + SHINGLE, np.repeat(first[1:][rows], count[rows]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], 42) for s, e in zip(at[begin].tolist(), (at[end] - 1).tolist(), strict=True)), np.uint64, len(begin))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    edges = np.concatenate(([0], np.cumsum(count[rows])))
    sums = np.add.reduceat(bits, edges[:-1], axis=0, dtype=np.int32)
    out[rows] = np.packbits(2 * sums > count[rows][:, None], axis=1).view(">u8").astype(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(_fingerprints(raw, off).view(np.int64))], [key, "fp"])

    docs = narrow(docs, key, text)
    return docs.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, fp bigint")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the lower 31 bits: the xor of the positions (1 to 31) of the bits that are set."""
    out = np.zeros(len(x), np.uint32)
    for i in range(1, 32):
        out ^= ((x >> np.uint32(i - 1)) & np.uint32(1)) * np.uint32(i)
    return out


def _masks(reach: int) -> list[np.ndarray]:
    """For each syndrome, what leads from a half to the anchors within ``reach`` of it."""
    out: list[list[int]] = [[] for _ in range(32)]
    for flip in (0, 1):
        for weight in range(reach - flip + 1):
            for places in combinations(range(1, 32), weight):
                s = m = 0
                for p in places:
                    s, m = s ^ p, m | 1 << (p - 1)
                out[s].append(m | flip << 31)
    return [np.array(x, np.uint32) for x in out]


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(shift)).astype(np.uint32) for shift, _ in HALVES]


def _home(half: np.ndarray) -> np.ndarray:
    s = _syndrome(half)
    return half ^ np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)).astype(np.uint32), np.uint32(0))


def _deal(buckets: int):
    reach = [_masks(r) for _, r in HALVES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for which, masks in enumerate(reach):
                half = _halves(fps)[which]
                s = _syndrome(half)
                anchors, copies = [], []
                for k in np.unique(s):
                    own = np.flatnonzero(s == k)
                    anchors.append((half[own][:, None] ^ masks[k][None, :]).ravel())
                    copies.append(np.repeat(fps[own], len(masks[k])))
                if not anchors:
                    continue
                anchor, fp = np.concatenate(anchors), np.concatenate(copies)
                bucket = ((anchor * np.uint32(2654435761)) >> np.uint32(8)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                anchor, fp, bucket = anchor[order], fp[order], bucket[order]
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                use = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((use + which * buckets).astype(np.int32)), pa.array([anchor[edge[b] : edge[b + 1]].tobytes() for b in use], pa.binary()), pa.array([fp[edge[b] : edge[b + 1]].tobytes() for b in use], pa.binary())],
                    ["bucket", "anchor", "fp"],
                )

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


def _dense(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of an anchor with very many members: these agree in one of five blocks of bits."""
    for i in range(5):
        lo, hi = 64 * i // 5, 64 * (i + 1) // 5
        block = (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        order = np.argsort(block, kind="stable")
        own, block = fp[order], block[order]
        last = np.searchsorted(block, block, side="right")
        step = 1
        while (left := np.flatnonzero(np.arange(len(own)) + step < last)).size:
            ok = _near(own[left], own[left + step])
            yield own[left[ok]], own[left[ok] + step]
            step += 1


def _links(which: int, anchor: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the threshold that meet at an anchor which is home to one of them."""
    home = _home(_halves(fp)[which]) == anchor
    order = np.lexsort((~home, anchor))  # the home's own come first
    anchor, fp, home = anchor[order], fp[order], home[order]
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), [len(anchor)]))
    size, homes = np.diff(edge), np.add.reduceat(home, edge[:-1], dtype=np.int64)
    begin, use = edge[:-1], (homes > 0) & (size > 1)
    dense = use & (homes * size > DENSE)
    for g in np.flatnonzero(dense):
        yield from _dense(np.unique(fp[begin[g] : begin[g] + size[g]]))
    begin, size, homes = (x[use & ~dense] for x in (begin, size, homes))
    work = np.cumsum(homes * size)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + DENSE, side="right")))
        b, n, h = begin[at:to], size[at:to], homes[at:to]
        own = np.repeat(b - np.concatenate(([0], np.cumsum(h)[:-1])), h) + np.arange(h.sum())
        n, b = np.repeat(n, h), np.repeat(b, h)
        other = np.repeat(b - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        x, y = fp[np.repeat(own, n)], fp[other]
        ok = _near(x, y) & (x != y)
        yield x[ok], y[ok]
        at = to


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One link from each node to the smallest it is connected with."""
    x, y = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.uint64)]) for i in (0, 1))
    nodes, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = place[: len(x)], place[len(x) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
        if (label == old).all():
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _meet(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket, anchors, fps):
            links = [p for p in _links(bucket // buckets, np.concatenate(anchors), np.concatenate(fps)) if len(p[0])]
            if links:
                a, b = _forest(links)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held, anchors, fps = None, [], []
        for batch in batches:
            for bucket, anchor, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != held:
                    if anchors:
                        yield from done(held, anchors, fps)
                    held, anchors, fps = bucket, [], []
                anchors.append(np.frombuffer(anchor, np.uint32))
                fps.append(np.frombuffer(fp, np.uint64))
        if anchors:
            yield from done(held, anchors, fps)

    return run


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within the threshold."""
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = sum(len(_masks(r)[1]) for _, r in HALVES)
    buckets = max(1, fps.count() * copies // BUCKET_ROWS // len(HALVES) + 1)
    buckets = -(-buckets // (4 * parts)) * 4 * parts
    dealt = fps.mapInArrow(_deal(buckets), "bucket int, anchor binary, fp binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(buckets), "a bigint, b bigint")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    component_id is the smallest doc_id that links lead to, the document's own included. A null
    or empty text, or one without words, has fingerprint zero and links like any other. Null
    doc_ids get rows but no part in the minimum, which is null where a component has no other.
    Repeated rows come out repeated. An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    first = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    roots = connected_components(links(first.select("fp")))
    named = first.join(roots, first.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The first row of each component of ``docs``: that of the smallest doc_id, null last.

    Of rows that share this doc_id, or have none, one stays too.
    """
    rows = with_row(docs, "text")
    found = simhash_components(rows.select(F.col("uid").alias("doc_id"), "text"))
    return without(rows, found.where("doc_id > component_id").select(F.col("doc_id").alias("uid")))
