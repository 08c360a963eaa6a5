"""Aligning two tokenisations of a text: a byte-level BPE (A) and a sentencepiece BPE (B).

Both tokenise space+text, and whole texts. Byte offsets where tokens of both end cut the tokens into groups; tokens of a
group are linked. A shared end before tokens that both begin with a space is an anchor: anchors split a document into windows
of token ids. Of the windows of a block of texts, each tuple of ids is aligned once. How many documents hold a linked
pair is counted by blocks of documents first, so that neither links nor pairs of documents are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.rows import blocks, mix, with_key, with_uid
from siltstream.llm.tokens import both_ids, bytes_of, forget, part_memo, pieces_of
from siltstream.plans.shared import stage

#: Pairs of a document and a linked pair that make up a block; links of a group that are listed one by one; bytes of text aligned at once.
BLOCK, FEW, TEXT = 1_000_000, 1_000, 1_000_000


class Groups(NamedTuple):
    """Tokens of groups, one group after the other, and how many each has."""

    a: np.ndarray
    b: np.ndarray
    na: np.ndarray
    nb: np.ndarray


@lru_cache(maxsize=4)
def tables(path: str, piece: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a vocabulary: how many bytes each token has, and whether it begins with a space."""
    words = pieces_of(path) if piece else bytes_of(path)
    return np.array([len(w) for w in words]), np.array([w[:1] == b" " for w in words])


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


_DIGITS = np.array([[ord(c) for c in f"{n:<7}"] for n in range(100_000)], np.uint8)
_LENGTH = np.array([len(str(n)) for n in range(100_000)])


def written(groups: Groups) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` over all groups, and where each group begins (n + 1)."""
    a, b, na, nb = groups
    before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    place_a = np.arange(len(a)) + np.repeat(before_b, na)
    place_b = np.arange(len(b)) + np.repeat(before_a + na, nb)
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    last = np.cumsum(na + nb)
    mark[last - nb - 1], mark[last - 1] = ord("|"), ord(";")
    size = _LENGTH[ids]
    end = np.cumsum(size + 1)
    out = np.empty(end[-1] if len(end) else 0, np.uint8)
    at = end - size - 1
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = _DIGITS[ids[some], k]
    out[end - 1] = mark
    return out.tobytes(), np.concatenate(([0], end[last - 1]))


def linked(groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of the links; times exceeds 1 only in large groups, whose ids are counted first."""
    a, b, na, nb = groups
    start_a, start_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    few = na * nb <= FEW
    g = np.flatnonzero(few)
    left = runs(start_a[g], na[g])
    times = np.repeat(nb[g], na[g])
    pair = (np.repeat(a[left], times) << 32) | b[runs(np.repeat(start_b[g], na[g]), times)]
    out = [(np.repeat(g, na[g] * nb[g]), pair, np.ones(len(pair), np.int64))]
    for g in np.flatnonzero(~few).tolist():
        x, n = np.unique(a[start_a[g] : start_a[g] + na[g]], return_counts=True)
        y, m = np.unique(b[start_b[g] : start_b[g] + nb[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y).ravel(), (n[:, None] * m).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def distinct(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows (at: where each begins, n + 1): one of each tuple of ids, and for each window the number of its like.

    Windows of one hash are compared id by id; one that differs from its like (never seen) stands for itself.
    """
    hashes = np.zeros(len(at_a) - 1, np.uint64)
    for side, (ids, at) in enumerate(((a, at_a), (b, at_b))):
        place = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
        hashes += np.add.reduceat(mix((ids | place << 20 | side << 62).astype(np.uint64)), at[:-1])
    _, first, like = np.unique(hashes, return_index=True, return_inverse=True)
    one = first[like]
    differ = (np.diff(at_a)[one] != np.diff(at_a)) | (np.diff(at_b)[one] != np.diff(at_b))
    for ids, at in ((a, at_a), (b, at_b)):
        size = np.where(differ, 0, np.diff(at))
        w = np.repeat(np.arange(len(size)), size)
        bad = ids[runs(at[:-1], size)] != ids[runs(at[:-1][one], size)]
        differ[w[bad]] = True
    like[differ] = len(first) + np.arange(differ.sum())
    return np.concatenate((first, np.flatnonzero(differ))), like


def align_block(ids_a: Sequence[np.ndarray], ids_b: Sequence[np.ndarray], a: str, b: str) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """Of each document: groups, the hash of their text, its distinct linked pairs, and how often each is linked."""
    none = np.zeros(0, np.int64)
    out = [(0, "", none, none)] * len(ids_a)
    have = [i for i, x in enumerate(ids_a) if len(x)]
    if not have:
        return out
    all_a, all_b = (np.concatenate([ids[i] for i in have]) for ids in (ids_a, ids_b))
    (size_a, space_a), (size_b, space_b) = tables(a, False), tables(b, True)
    # both sides of a document have as many bytes, so ends are shared or not also when counted over all documents
    ends_a, ends_b = np.cumsum(size_a[all_a]), np.cumsum(size_b[all_b])
    place = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    to_a = np.flatnonzero(ends_b[place] == ends_a)
    to_b = place[to_a]
    na, nb = np.diff(to_a, prepend=-1), np.diff(to_b, prepend=-1)
    # a group opens a window where its first tokens begin with a space; a document's first ones do
    opens = space_a[all_a[to_a - na + 1]] & space_b[all_b[to_b - nb + 1]]
    first_of = np.flatnonzero(opens)
    at_a, at_b = (np.append((to - n + 1)[first_of], len(ids)) for to, n, ids in ((to_a, na, all_a), (to_b, nb, all_b)))
    one, like = distinct(all_a, all_b, at_a, at_b)

    n_groups = np.diff(np.append(first_of, len(na)))
    of = runs(first_of[one], n_groups[one])  # groups of the distinct windows
    window_of = np.repeat(np.arange(len(one)), n_groups[one])
    some = Groups(all_a[runs((to_a - na + 1)[of], na[of])], all_b[runs((to_b - nb + 1)[of], nb[of])], na[of], nb[of])
    raw, at = written(some)
    edge = at[np.cumsum(np.append(0, n_groups[one]))].tolist()
    said = [raw[s : e - 1] for s, e in zip(edge, edge[1:], strict=False)]
    g, pair, times = linked(some)
    if (np.diff(g) < 0).any():  # links of large groups come last
        order = np.argsort(g, kind="stable")
        g, pair, times = g[order], pair[order], times[order]
    w = window_of[g]
    n_links = np.bincount(w, minlength=len(one))
    link_at = np.cumsum(n_links) - n_links
    pairs, number = np.unique(pair, return_inverse=True)

    doc = np.searchsorted(np.cumsum([len(ids_a[i]) for i in have]), at_a[:-1], side="right")
    used, often = np.unique(doc * len(one) + like, return_counts=True)
    own, w = used // len(one), used % len(one)
    flat = runs(link_at[w], n_links[w])
    held, of_held = np.unique(np.repeat(own, n_links[w]) * len(pairs) + number[flat], return_inverse=True)
    total = np.bincount(of_held, np.repeat(often, n_links[w]) * times[flat], len(held)).astype(np.int64)
    cut = np.searchsorted(held, np.arange(len(have) + 1) * len(pairs))
    of_doc = np.searchsorted(doc, np.arange(len(have) + 1))
    like_list, sizes = like.tolist(), np.add.reduceat(n_groups, of_doc[:-1]).tolist()
    for k, i in enumerate(have):
        text = b";".join([said[n] for n in like_list[of_doc[k] : of_doc[k + 1]]])
        s, e = cut[k], cut[k + 1]
        out[i] = (sizes[k], hashlib.sha256(text).hexdigest(), pairs[held[s:e] - k * len(pairs)], total[s:e])
    return out


#: A document's row: places in the block's list of pairs, and times; a block's own row (uid null): pairs, documents.
STAGED = "block bigint, uid bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, place array<int>, pairs array<bigint>, times array<bigint>"
_COUNTS = ("n_a", "n_b", "n_groups")


def _lists(parts: list[np.ndarray], kind: pa.DataType | None = None) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind or pa.int64()))


def _block(number: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The batches of one block: its documents, which name pairs by their place, then its pairs."""
    pairs, place = np.unique(np.concatenate([d[5] for d in docs]), return_inverse=True)
    held = np.bincount(place, minlength=len(pairs))
    size = np.cumsum([len(d[5]) for d in docs])
    for at in range(0, len(docs), 2000):
        some = docs[at : at + 2000]
        own = np.split(place, size)[at : at + len(some)]
        head = [pa.array([number] * len(some), pa.int64()), *[pa.array([d[i] for d in some], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()])]]
        yield pa.RecordBatch.from_arrays([*head, _lists(own, pa.int32()), pa.nulls(len(some), pa.list_(pa.int64())), _lists([d[6] for d in some])], [c.split()[0] for c in STAGED.split(", ")])
    head = [pa.array([number], pa.int64()), *[pa.array([None], pa.int64())] * 4, pa.array([None], pa.string()), pa.nulls(1, pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays([*head, _lists([pairs]), _lists([held])], [c.split()[0] for c in STAGED.split(", ")])


def _align(a: str, b: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, docs = TaskContext.get().partitionId() << 32, 0, []
        for rows, _, _ in blocks(batches, limit=TEXT):
            ids_a, ids_b = zip(*both_ids(a, b, rows.column("text").to_pylist()), strict=True)
            for uid, x, y, found in zip(rows.column("uid").to_pylist(), ids_a, ids_b, align_block(ids_a, ids_b, a, b), strict=True):
                docs.append((uid, len(x), len(y), *found))
                held += len(found[2]) + 1
            if held >= most:
                yield from _block(number, docs)
                number, held, docs = number + 1, 0, []
        if docs:
            yield from _block(number, docs)
        part_memo.cache_clear()  # a worker that waits for another task holds no memo

    return run


FOUND = "uid bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _finish(rows: pa.Table) -> pa.Table:
    """The documents of a block, from them and the block's counts (2 * count + 1 where it is its A id's highest)."""
    forget()  # a worker that has tokenised before goes on here
    uids = rows.column("uid").to_pylist()
    place, pairs, times = (rows.column(c).combine_chunks() for c in ("place", "pairs", "times"))
    head = uids.index(None) if None in uids else -1  # a block without links has none
    value = pairs[head].values.to_numpy() if head >= 0 else np.zeros(0, np.int64)
    out = []
    for i, (uid, *plain) in enumerate(zip(uids, *[rows.column(c).to_pylist() for c in (*_COUNTS, "groups_sha256")], strict=True)):
        if i == head:
            continue
        v, n = value[place[i].values.to_numpy()], times[i].values.to_numpy()
        out.append((uid, *plain[:3], int(n.sum()), int((n * (v & 1)).sum()), int((n * (v >> 1)).sum()), plain[3]))
    names = [c.split()[0] for c in FOUND.split(", ")]
    columns = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())], names)


def pair_counts(staged: DataFrame) -> DataFrame:
    """(pair, value): pair is A id << 32 | B id, value twice the documents that hold it linked, plus 1 if no pair of the A id has more."""
    own = staged.where("uid is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = stage(own.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    # one row for each id of A's vocabulary at most
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    joined = counts.join(F.broadcast(best), F.shiftright("pair", 32) == F.col("a"))
    return joined.select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("value"))


def align_documents(docs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    ``a`` is a file like byte_bpe_50k.json, ``b`` one like piece_bpe_32k.model; strings of special tokens in a text are plain
    text. Texts that are null or empty, or whose tokens' joined bytes differ from space+text, have no tokens:
    zeros and an empty hash. A pair's count is the number of rows that hold it linked; rows with equal or null doc_ids
    count each on its own; other columns play no part; an empty table gives an empty result.
    """
    texts, same = with_uid(docs)
    staged = stage(texts.select("uid", "text").mapInArrow(_align(a, b, block), STAGED), "aligned")
    own = staged.where("uid is null").select("block", F.posexplode("pairs").alias("place", "pair"))
    valued = own.join(pair_counts(staged), "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    head = valued.select("block", F.lit(None).cast("long").alias("uid"), F.col("v.value").alias("pairs"))
    # a block without links (texts without tokens only) needs no counts; a task holds one block at a time, of BLOCK links and one block of texts
    both = staged.where("uid is not null").unionByName(head, allowMissingColumns=True)
    found = both.groupBy("block").applyInArrow(_finish, FOUND)
    return with_key(found, texts, same).select("doc_id", *[c.split()[0] for c in FOUND.split(", ")][1:])
