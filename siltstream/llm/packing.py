"""Packing token ids into sequences: bounded-space online packing.

A task keeps a fixed number of open windows. A document's full windows are sequences of their own; what is
left of it goes where it fits best. When it fits nowhere and no further window may be opened, the fullest is
emitted. Windows still open at a task's end are leftovers: they are merged by the same rule, as wholes, some tasks'
leftovers at a time, in rounds until one task has the last ones. Only pieces' places travel between tasks, no ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.rows import blocks, with_key, with_uid
from siltstream.llm.tokens import word_ids
from siltstream.plans.shared import stage

#: Tokens of a sequence, windows that a task keeps open, the id that ends a document, tasks whose leftovers meet.
WINDOW, OPEN, END, MEET = 2048, 256, 1, 32

_PIECE = "uid: bigint, start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint, offset: bigint"
SCHEMA = f"sequence_id bigint, leftover boolean, size bigint, pieces array<struct<{_PIECE}>>"
#: Sequence numbers: round of merging, task, number within the task.
_ROUND, _TASK = 58, 32
#: Pieces gathered before a task hands on a batch.
_BATCH = 50_000

Piece = tuple[int, int, int, int, int]


class Windows:
    """At most ``most`` open windows of ``window`` tokens, found by their free tokens."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most, self.count = window, most, 0
        self.free: dict[int, list[list]] = {}
        self.mask = 0  # bit f is set where a window has f free tokens

    def _take(self, f: int) -> list:
        stack = self.free[f]
        found = stack.pop()
        if not stack:
            self.mask ^= 1 << f
        self.count -= 1
        return found

    def put(self, size: int, what: object) -> list[list]:
        """Place ``what``; the windows that this emits."""
        out = []
        fits = self.mask >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            held = self._take(f)
        else:
            if self.count == self.most:
                out.append(self._take((self.mask & -self.mask).bit_length() - 1))
            f, held = self.window, []
        held.append(what)
        if f == size:
            out.append(held)
        else:
            stack = self.free.setdefault(f - size, [])
            stack.append(held)
            self.mask |= 1 << (f - size)
            self.count += 1
        return out

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [held for f in sorted(self.free) for held in self.free[f]]


class _Output:
    """Emitted windows as Arrow batches of one row a window."""

    def __init__(self, round_: int) -> None:
        self.number = (round_ << _ROUND) | (TaskContext.get().partitionId() << _TASK)
        self.rows: list[tuple[int, bool, list[Piece]]] = []
        self.held = 0

    def add(self, window: list[Piece], leftover: bool = False) -> None:
        self.rows.append((self.number, leftover, window))
        self.number += 1
        self.held += len(window)

    def batch(self) -> pa.RecordBatch:
        flat = np.array([p for _, _, w in self.rows for p in w], np.int64).reshape(-1, 5)
        off = np.concatenate(([0], np.cumsum([len(w) for _, _, w in self.rows]))).astype(np.int32)
        before = np.concatenate(([0], np.cumsum(flat[:, 2])))
        size = before[off[1:]] - before[off[:-1]]
        place = before[:-1] - np.repeat(before[off[:-1]], np.diff(off))
        names = ["uid", "start", "length", "ids_crc32", "doc_tokens", "offset"]
        column = pa.StructArray.from_arrays([pa.array(c) for c in (*flat.T, place)], names)
        arrays = [pa.array([n for n, _, _ in self.rows], pa.int64()), pa.array([x for _, x, _ in self.rows], pa.bool_()), pa.array(size)]
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(off), column)], ["sequence_id", "leftover", "size", "pieces"])


def _place(tokenizer: str, window: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out = Windows(window, most), _Output(0)
        for rows, _, _ in blocks(batches):
            for uid, text in zip(rows.column("uid").to_pylist(), rows.column("text").to_pylist(), strict=True):
                ids = np.append(word_ids(tokenizer, text or ""), np.uint32(END)).astype("<u4", copy=False)
                n = len(ids)
                for at in range(0, n, window):
                    size = min(window, n - at)
                    piece = (uid, at, size, zlib.crc32(ids[at : at + size].tobytes()), n)
                    for held in [[piece]] if size == window else open_.put(size, piece):
                        out.add(held)
            if out.held >= _BATCH:
                yield out.batch()
        for held in open_.rest():
            out.add(held, leftover=True)
        if out.rows:
            yield out.batch()

    return run


def _merge(round_: int, last: bool, window: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out = Windows(window, most), _Output(round_)
        for batch in batches:
            for size, pieces in zip(batch.column("size").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                whole = [(p["uid"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces]
                for held in open_.put(size, whole):
                    out.add([p for part in held for p in part])
            if out.held >= _BATCH:
                yield out.batch()
        for held in open_.rest():
            out.add([p for part in held for p in part], leftover=not last)
        if out.rows:
            yield out.batch()

    return run


def packed_windows(texts: DataFrame, tokenizer: str, window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """(sequence_id, size, pieces): one row a sequence, for ``texts`` (uid, text) with unique uids."""
    placed = stage(texts.mapInArrow(_place(tokenizer, window, most), SCHEMA), "packed")
    done = [placed.where("not leftover")]
    left = placed.where("leftover")
    tasks = placed.agg(F.max(F.shiftright("sequence_id", _TASK))).first()[0]
    parts, round_ = (tasks or 0) + 1, 0
    while round_ == 0 or parts > 1:
        parts, round_ = -(-parts // MEET), round_ + 1
        task = F.shiftright("sequence_id", _TASK).bitwiseAND((1 << (_ROUND - _TASK)) - 1)
        dealt = left.repartition(parts, F.floor(task / MEET)).sortWithinPartitions(F.col("size").desc(), "sequence_id")
        merged = stage(dealt.mapInArrow(_merge(round_, parts == 1, window, most), SCHEMA), "merged")
        done.append(merged.where("not leftover"))
        left = merged.where("leftover")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("sequence_id", "size", "pieces")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of a document.

    Ids are those of ``tokenizer`` (a file like word_bpe_49k.json) without special tokens added, then the end id.
    Null and empty texts have the end id alone. A document of more than ``window`` ids is cut into full windows and
    a rest; no rest is cut. Rows with equal or null doc_ids are packed each on its own; other columns play no part; an
    empty table has no pieces.
    """
    texts, same = with_uid(docs)
    found = packed_windows(texts.select("uid", "text"), tokenizer, window, most)
    rows = found.select("sequence_id", F.inline("pieces").alias("uid", "start", "length", "ids_crc32", "doc_tokens", "offset"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return with_key(rows, texts, same).select(*names)
