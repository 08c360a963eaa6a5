"""Language-model scores from a probabilistic suffix tree over words (operator 3).

States are contexts of up to ``DEPTH`` words. Every context of the training texts is a candidate; it is retained
if its next-word counts diverge from its longest retained suffix's distribution by more log-likelihood than
their description costs. All next words of a state have their own probabilities, smoothed towards the suffix's; what is
left goes to the others in the suffix's proportions, so every distribution sums to 1: the probability of a
word with count n after a state with count c is (n + PRIOR * p) / (c + PRIOR), where p is the suffix's. A word is scored
by the longest retained suffix of what stands before it.

The model has no least share and no cap. Tokens are dealt so that what is counted meets: by the first of their grams (the word,
then with ever more of its context) of which the count is unknown, if there is one, and then by the first context that isn't common. Contexts,
next words and words above the ``HOT_`` shares and ``HEAD`` are counted beforehand and broadcast, as one task should not hold all of
theirs; the shares bound what is broadcast and change no result. The words before a token choose its slice, and slices are taken one
after the other, so that only one slice's tokens lie on disk.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.rows import BASE, LOWER, SPACED, blocks, mix, with_key, with_uid, word_hashes, word_spans
from siltstream.plans.shared import drop, put, scratch

DEPTH = 3
#: The model's least shares of contexts, words that contexts tell apart, and transitions: none.
CONTEXT = SYMBOL = TRANSITION = 0.0
#: Shares of training tokens from which on counts are broadcast.
HOT_CONTEXT, HOT_SYMBOL, HOT_TRANSITION, HEAD = 5e-5, 5e-6, 1e-6, 5e-7
#: Pseudo-tokens with which a state's suffix smooths it.
PRIOR = 20.0
END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Codes of words: those in the head have their number there, others their hash with this bit.
FAR = np.uint64(1 << 63)
#: Distinct counts that a task gathers before it passes them on.
GATHER = 2_000_000
#: Tokens of a bucket, which one task handles at once; those from which on there is another slice, and slices at most.
BUCKET, SLICE, SLICES = 250_000, 8_000_000, 4


def _tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each followed by the end, and the n + 1 offsets."""
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, off, SPACED)
    edge = first + np.arange(len(first))
    out = np.full(edge[-1], END, np.uint64)
    body = np.ones(edge[-1], bool)
    body[edge[1:] - 1] = False
    out[body] = word_hashes(raw, starts, ends)
    return out, edge


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of counts by key, in as few rows as ``GATHER`` allows."""
    keys, sums, held = [], [], 0

    def merged():
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(where, np.concatenate(sums)).astype(np.int64)

    for key, n in parts:
        keys.append(key)
        sums.append(n)
        held += len(key)
        if held > GATHER:
            key, n = merged()
            if len(key) > GATHER // 2:
                yield key, n
                keys, sums, held = [], [], 0
            else:
                keys, sums, held = [key], [n], len(key)
    if keys:
        yield merged()


def _rows(parts: Iterator[tuple[np.ndarray, np.ndarray]], step: int = 200_000) -> Iterator[pa.RecordBatch]:
    for key, n in _gathered(parts):
        for at in range(0, len(key), step):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + step].view(np.int64)), pa.array(n[at : at + step])], ["k", "n"])


STORED = "n int, m int, texts binary, tokens binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of blocks of texts, so that texts are cut into words once."""
    for rows, raw, off in blocks(batches):
        tokens, edge = _tokens(raw, off)
        uid, train = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "train"))
        texts = uid.astype(np.int64).tobytes() + np.diff(edge).astype(np.int64).tobytes() + train.astype(np.uint8).tobytes()
        columns = [pa.array([len(uid)], pa.int32()), pa.array([len(tokens)], pa.int32()), *(pa.array([pa.compress(x, codec="zstd", asbytes=True)], pa.binary()) for x in (texts, tokens.tobytes()))]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STORED.split(", ")])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(uid, train, edge, tokens) of each block."""
    for batch in batches:
        for n, m, texts, tokens in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), batch.column("texts"), batch.column("tokens"), strict=True):
            raw = pa.decompress(texts.as_buffer(), 17 * n, codec="zstd")
            edge = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int64, n, 8 * n))))
            yield np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 16 * n), edge, np.frombuffer(pa.decompress(tokens.as_buffer(), 8 * m, codec="zstd"), np.uint64, m)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(np.unique(tokens[np.repeat(train, np.diff(edge)) > 0], return_counts=True) for _, train, edge, tokens in _stored(batches))


NUMBERED = "n int, m int, texts binary, places binary, far binary"


def _number(shared):
    """Stored tokens by their place in the head (-1: none), and apart the hashes of those that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1)
                tokens = next(_stored(iter([row])))[3]
                place = tree.look_up(tokens)
                packed = [pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True)], pa.binary()) for x in (place.astype(np.int32), tokens[place < 0])]
                yield pa.RecordBatch.from_arrays([row.column("n"), row.column("m"), row.column("texts"), *packed], [f.split()[0] for f in NUMBERED.split(", ")])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(uid, train, edge, places, hashes of tokens without a place) of each block."""
    for batch in batches:
        for n, m, texts, places, far in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), *(batch.column(c) for c in ("texts", "places", "far")), strict=True):
            raw = pa.decompress(texts.as_buffer(), 17 * n, codec="zstd")
            edge = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int64, n, 8 * n))))
            place = np.frombuffer(pa.decompress(places.as_buffer(), 4 * m, codec="zstd"), np.int32, m)
            rest = int((place < 0).sum())
            hashes = np.frombuffer(pa.decompress(far.as_buffer(), 8 * rest, codec="zstd"), np.uint64, rest) if rest else np.zeros(0, np.uint64)
            yield np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 16 * n), edge, place, hashes


class Tree:
    """Common contexts with the counts that are known of them, and their states. Words of the head are numbered from the most frequent on, symbols are the first of them; -1 is any other word, state -1 the root."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.lexsort((hashes, -counts))
        self.total, self.distinct = total, distinct
        self.word_count = counts[order]
        #: Hashes of the head in order, and the place of each.
        self.place = np.argsort(hashes[order])
        self.head = hashes[order][self.place]
        self.floor = total + 0.5 * (distinct + 1)
        self.symbols = int((counts >= HOT_SYMBOL * total).sum())
        self.root = (self.word_count[: self.symbols] + 0.5) / self.floor
        #: Of each level: sorted keys of its contexts (first symbol, number of the rest), and their states.
        self.keys: list[np.ndarray] = []
        self.states: list[np.ndarray] = []
        #: Of each level: counts of its contexts, the number of each one's rest in the level above, and counts of transitions by context * symbols + symbol.
        self.counts: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []
        self.listed: list[tuple[np.ndarray, np.ndarray]] = []
        self.parent, self.beta = np.zeros(0, np.int64), np.zeros(0)
        self.edges, self.edge_p = np.zeros(0, np.int64), np.zeros(0)

    def look_up(self, tokens: np.ndarray) -> np.ndarray:
        """Place in the head of each token, -1: none."""
        if not len(self.head):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.head, tokens), len(self.head) - 1)
        return np.where(self.head[at] == tokens, self.place[at], -1)

    def symbol_of(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.symbols, place, -1).astype(np.int64)

    def contexts(self, symbol: np.ndarray, inside: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each level, the number of the context before each token of ``at``, or -1. inside: words before each of those in its text."""
        out, open_, before, size = [], np.arange(len(at)), np.zeros(len(at), np.int64), 1
        for level, keys in enumerate(self.keys, 1):
            left = symbol[at[open_] - level]
            own = (inside[open_] >= level) & (left >= 0)
            open_, before, left = open_[own], before[own], left[own]
            number = np.full(len(at), -1)
            if len(keys) and len(open_):
                if level == 1:
                    dense = np.full(self.symbols, -1)
                    dense[keys] = np.arange(len(keys))
                    before = dense[left]
                else:
                    key = left * size + before
                    where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    before = np.where(keys[where] == key, where, -1)
                number[open_] = before
                open_, before = open_[before >= 0], before[before >= 0]
            else:
                open_ = before = np.zeros(0, np.int64)
            out.append(number)
            size = max(1, len(keys))
        return out

    def known(self, level: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Counts of the transitions that are listed, else -1."""
        keys, n = self.listed[level - 1]
        out = np.full(len(context), -1)
        own = np.flatnonzero((context >= 0) & (symbol >= 0))
        if len(keys) and len(own):
            key = context[own] * self.symbols + symbol[own]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[own] = np.where(keys[at] == key, n[at], -1)
        return out

    def count_of(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Counts of words, n for those that aren't in the head."""
        near = np.flatnonzero(code < FAR)
        out = n.astype(np.int64)
        out[near] = self.word_count[code[near].view(np.int64)]
        return out

    def up(self, context: np.ndarray, depth: np.ndarray, level: int) -> np.ndarray:
        """Of contexts numbered in their own level (depth), their suffixes' numbers in ``level``; depth is at least that."""
        context = context.astype(np.int64)
        for above in range(len(self.rest), level, -1):
            own = depth >= above
            context[own] = self.rest[above - 1][context[own]]
        return context

    def stateless(self) -> Tree:
        """A copy without states and the head's hashes, to be grown."""
        out = copy.copy(self)
        out.states, out.parent, out.beta = [], np.zeros(0, np.int64), np.zeros(0)
        out.edges, out.edge_p = np.zeros(0, np.int64), np.zeros(0)
        out.head = out.place = None
        return out

    def smoothed(self, level: int, context: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """P(word | longest retained suffix) of words with counts n after contexts of a level that has its states; p is that of their suffixes."""
        return np.where(self.states[level - 1][context] >= 0, (n + PRIOR * p) / (self.counts[level - 1][context] + PRIOR), p)

    def prob(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """P(symbol | state) of frequent symbols."""
        out = self.root[symbol].copy()
        own = np.flatnonzero(state >= 0)
        if len(own):
            key = state[own] * self.symbols + symbol[own]
            at = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
            hit = (self.edges[at] == key) if len(self.edges) else np.zeros(len(own), bool)
            out[own[hit]] = self.edge_p[at[hit]]
            miss = own[~hit]
            out[miss] = self.beta[state[miss]] * self.prob(self.parent[state[miss]], symbol[miss])
        return out

    def grow(self, keys: np.ndarray, counts: np.ndarray, suffix: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, others: np.ndarray | None = None) -> None:
        """Add a level: its contexts' keys, counts and longest retained suffixes, and the transitions (context, symbol, n).

        others: of each context the sums over transitions not among these: how many, n, n * log(n / (count * p)) and p.
        """
        more, more_n, more_gain, more_p = np.zeros((4, len(keys))) if others is None else others
        have = np.bincount(context, minlength=len(keys)) + more
        p = self.prob(suffix[context], symbol)
        sums = lambda x: np.bincount(context, x, minlength=len(keys))
        rest, rest_p = counts - sums(n) - more_n, np.maximum(1 - sums(p) - more_p, 1e-12)
        gain = sums(n * np.log(n / (counts[context] * p))) + more_gain
        gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / (counts * rest_p)), 0)
        kept = gain > have * math.log(self.distinct + 1) + 0.5 * np.log(np.maximum(counts, 1))
        state = np.where(kept, len(self.parent) + np.cumsum(kept) - 1, -1)
        own = kept[context]
        context, symbol, n, p = context[own], symbol[own], n[own], p[own]
        smooth = (n + PRIOR * p) / (counts[context] + PRIOR)
        left = np.maximum(1 - np.bincount(context, smooth, minlength=len(keys)) - (more_n + PRIOR * more_p) / (counts + PRIOR), 1e-12)
        beta = left / np.maximum(1 - np.bincount(context, p, minlength=len(keys)) - more_p, 1e-12)
        key = state[context] * self.symbols + symbol
        edges, edge_p = np.concatenate((self.edges, key)), np.concatenate((self.edge_p, smooth))
        order = np.argsort(edges)
        self.edges, self.edge_p = edges[order], edge_p[order]
        self.parent = np.concatenate((self.parent, suffix[kept]))
        self.beta = np.concatenate((self.beta, beta[kept]))
        self.states.append(state)


def _count_level(shared):
    """(context * symbols + symbol) of the deepest level, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value

        def parts():
            for _, train, edge, place, _ in _numbered(batches):
                symbol = tree.symbol_of(place)
                inside = np.arange(len(place)) - np.repeat(edge[:-1], np.diff(edge))
                at = np.flatnonzero((np.repeat(train, np.diff(edge)) > 0) & (symbol >= 0) & (inside >= len(tree.keys)))
                context, symbol = tree.contexts(symbol, inside[at], at)[-1], symbol[at]
                own = context >= 0
                yield np.unique(context[own] * tree.symbols + symbol[own], return_counts=True)

        yield from _rows(parts())

    return run


def common(texts: DataFrame, path: str) -> tuple[Tree, DataFrame, DataFrame]:
    """Common contexts with their counts, the table (k, n) of all word counts, and the numbered tokens, written to path, from what ``_store`` has made of the texts."""
    spark = texts.sparkSession
    words = put(texts.mapInArrow(_count_words, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")), scratch(spark, "words"), "uncompressed", tidy=True)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = words.where(F.col("n") >= HEAD * total).toPandas()
    tree = Tree(head["k"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), int(total), int(distinct))
    shared = spark.sparkContext.broadcast(tree)
    texts = put(texts.mapInArrow(_number(shared), NUMBERED), path, "uncompressed")
    shared.destroy()
    strings = [(s,) for s in np.flatnonzero(tree.word_count[: tree.symbols] >= HOT_CONTEXT * total).tolist()] if total else []
    end = int(tree.look_up(np.array([END]))[0])
    strings = [s for s in strings if s != (end,)]
    number: dict[tuple[int, ...], int] = {(): 0}
    counts = {s: int(tree.word_count[s[0]]) for s in strings}
    for _ in range(DEPTH):
        strings = [s for s in strings if s[1:] in number]
        if not strings:
            break
        size = max(1, len(tree.keys[-1])) if tree.keys else 1
        key = np.array([s[0] * size + number[s[1:]] for s in strings], np.int64)
        order = np.argsort(key)
        strings = [strings[i] for i in order]
        tree.keys.append(key[order])
        tree.rest.append(key[order] % size)
        tree.counts.append(np.array([counts[s] for s in strings], np.float64))
        shared = spark.sparkContext.broadcast(tree)
        found = texts.mapInArrow(_count_level(shared), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TRANSITION * total).toPandas()
        shared.destroy()
        found = found.sort_values("k")
        tree.listed.append((found["k"].to_numpy(np.int64), found["n"].to_numpy(np.int64)))
        context, symbol = np.divmod(tree.listed[-1][0], tree.symbols)
        n = tree.listed[-1][1]
        number = {s: i for i, s in enumerate(strings)}
        longer = n >= HOT_CONTEXT * total
        counts = {(*strings[c], s): int(k) for c, s, k in zip(context[longer].tolist(), symbol[longer].tolist(), n[longer].tolist(), strict=True) if s != end}
        strings = list(counts)
    return tree, words, texts


# --- tokens dealt to buckets: columns of many tokens make one packed value of a row

PACKED = "kind int, bucket int, n int, data binary"
LAID = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
TOKENS, WORDS, GRAMS, SUMMED, COUNTED = 0, 1, 2, 3, 4
COUNTS = [f"n{level}" for level in range(DEPTH + 1)]
BEFORE = [f"t{level}" for level in range(1, DEPTH + 1)]
#: How columns are packed: codes of words, integers, integers in runs, ascending integers, and numbers as they are.
CODE, INT, RUN, UP, FLOAT = range(5)
#: depth: levels of common contexts before the token, of which ``context`` numbers the longest; inside: words before it, DEPTH at most; t: words before
#: it, 0 within the common context; counts are -1 where unknown, n0 counts only words that aren't in the head.
_TOKEN = {"uid": RUN, "train": RUN, "w": CODE, **dict.fromkeys(BEFORE, CODE), "context": INT, "depth": INT, "inside": INT, **dict.fromkeys(COUNTS, INT)}
FIELDS = {
    TOKENS: _TOKEN,
    COUNTED: _TOKEN,
    WORDS: {"k": CODE, "n": INT},
    SUMMED: {"uid": UP, "n_known": INT, "base": FLOAT, "score": FLOAT},
    GRAMS: {"level": INT, "context": INT, **dict.fromkeys(COUNTS, INT)},
}


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(h * BASE + word)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the number of its group, and one member of each group."""
    order = np.argsort(keys)
    keys, head = keys[order], np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(head) - 1
    return where, order[head]


def _fit(x: np.ndarray) -> np.ndarray:
    """Unsigned values in as few bytes as hold them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next((t for t, top in ((np.uint8, 1 << 8), (np.uint16, 1 << 16), (np.uint32, 1 << 32)) if most < top), np.uint64))


def _narrow(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The values less the least of them, and the least."""
    x = x.astype(np.int64, copy=False)
    least = int(x.min()) if len(x) else 0
    return _fit((x - np.int64(least)).view(np.uint64)), least


def _pack(kind: int, columns: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that has some of the tokens: of each array its length, bytes a value and least value, then the arrays."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    cut = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
    arrays = []  # values, least value of each row, ends of rows
    for f, how in FIELDS[kind].items():
        x = columns[f][order]
        if how == CODE:
            far = np.flatnonzero(x >= FAR)
            near = x.view(np.int64) + 1
            near[far] = 0
            arrays += [(*_narrow(near), cut), (x[far], 0, np.searchsorted(far, cut))]
        elif how == RUN:
            head = np.ones(len(x), bool)
            head[1:] = x[1:] != x[:-1]
            head[cut[:-1]] = True
            at = np.flatnonzero(head)
            ends = np.searchsorted(at, cut)
            arrays += [(*_narrow(x[at]), ends), (*_narrow(np.diff(at, append=len(x))), ends)]
        elif how == UP:
            step = np.diff(x, prepend=x[:1])
            step[cut[:-1]] = 0
            arrays.append((_fit(step.view(np.uint64)), x[cut[:-1]], cut))
        elif how == INT:
            arrays.append((*_narrow(x), cut))
        else:
            arrays.append((x.astype(np.float64, copy=False), 0, cut))
    head = np.zeros((len(cut) - 1, len(arrays), 3), np.int64)
    for i, (x, least, ends) in enumerate(arrays):
        head[:, i, 0], head[:, i, 1], head[:, i, 2] = np.diff(ends), x.itemsize, least
    ends = [e.tolist() for _, _, e in arrays]
    data, size = [], []
    for row in range(len(cut) - 1):
        raw = b"".join([head[row].tobytes(), *[x[e[row] : e[row + 1]].tobytes() for (x, _, _), e in zip(arrays, ends, strict=True)]])
        size.append(len(raw))
        data.append(pa.compress(raw, codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(data), kind, np.int32)), pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(size, pa.int32()), pa.array(data, pa.binary())], LAID.names)


def _unpack(table: pa.Table | pa.RecordBatch, kind: int) -> dict[str, np.ndarray]:
    fields = FIELDS[kind]
    kept: dict[str, list[np.ndarray]] = {f: [np.zeros(0, np.uint64 if how == CODE else np.float64 if how == FLOAT else np.int64)] for f, how in fields.items()}
    arrays = sum(2 if how in (CODE, RUN) else 1 for how in fields.values())
    for k, size, data in zip(table.column("kind").to_pylist(), table.column("n").to_pylist(), table.column("data"), strict=True):
        if k != kind:
            continue
        raw = pa.decompress(data.as_buffer(), size, codec="zstd")
        head, at = np.frombuffer(raw, np.int64, 3 * arrays).tolist(), 24 * arrays
        read = []
        for i in range(0, 3 * arrays, 3):
            read.append((np.frombuffer(raw, f"u{head[i + 1]}", head[i], at), head[i + 2]))
            at += head[i] * head[i + 1]
        parts = iter(read)
        for f, how in fields.items():
            x, least = next(parts)
            if how == FLOAT:
                kept[f].append(x.view(np.float64))
                continue
            x = x.astype(np.int64)
            if how == UP:
                x = np.cumsum(x)
            x += least
            if how == RUN:
                times, few = next(parts)
                x = np.repeat(x, times.astype(np.int64) + few)
            elif how == CODE:
                far = x == 0
                x = (x - 1).view(np.uint64)
                x[far] = next(parts)[0]
            kept[f].append(x)
    return {f: np.concatenate(x) for f, x in kept.items()}


def _context_key(context: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """Of common contexts a key that other contexts are chained to."""
    return mix((context.astype(np.int64) * (DEPTH + 1) + depth + 1).view(np.uint64))


def _by_context(t: dict[str, np.ndarray], buckets: int) -> np.ndarray:
    """Buckets by the first context that isn't common; tokens without one can lie anywhere."""
    key = mix(t["uid"][:1].view(np.uint64)) + (np.arange(len(t["w"])) >> 12).view(np.uint64)
    for level, b in enumerate(BEFORE, 1):
        at = np.flatnonzero((t["depth"] + 1 == level) & (t["inside"] >= level))
        key[at] = _chained(_context_key(t["context"][at], level - 1), t[b][at])
    return _bucket(key, buckets)


def _deal(shared, part: int, slices: int, buckets: int):
    """The tokens of a slice, dealt by the first gram of which the count is unknown, or at once by context where there is none."""

    def dealt(held: list[dict[str, np.ndarray]], tree: Tree) -> Iterator[pa.RecordBatch]:
        t = {f: np.concatenate([h[f] for h in held]) for f in held[0]}
        open_ = t["w"] >= FAR
        key = t["w"].copy()
        for level in range(1, DEPTH + 1):
            at = np.flatnonzero((t["depth"] >= level) & (t[f"n{level}"] < 0) & ~open_)
            key[at] = _chained(_context_key(tree.up(t["context"][at], t["depth"][at], level), level), t["w"][at])
            open_[at] = True
        for kind, own in ((TOKENS, np.flatnonzero(open_)), (COUNTED, np.flatnonzero(~open_))):
            if len(own):
                some = {f: x[own] for f, x in t.items()}
                yield _pack(kind, some, _bucket(key[own], buckets) if kind == TOKENS else _by_context(some, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        held, size = [], 0
        for uid, train, edge, place, far in _numbered(batches):
            code = place.astype(np.int64).view(np.uint64)
            code[place < 0] = far | FAR
            first = np.zeros(len(code), bool)
            first[edge[:-1]] = True
            last = np.where(first, np.uint64(0), np.roll(code, 1))
            at = np.flatnonzero(mix(last) % np.uint64(slices) == part)
            if not len(at):
                continue
            row = np.searchsorted(edge, at, side="right") - 1
            own, symbol = np.minimum(at - edge[row], DEPTH), tree.symbol_of(place)
            t = {"uid": uid[row], "train": train[row], "w": code[at], "inside": own.astype(np.uint8), "n0": np.where(place[at] < 0, -1, 0).astype(np.int8)}
            t |= {"context": np.full(len(at), -1, np.int32), "depth": np.zeros(len(at), np.uint8), **dict.fromkeys(COUNTS[1:], np.full(len(at), -1))}
            for level, context in enumerate(tree.contexts(symbol, own, at), 1):
                found = context >= 0
                t["context"][found] = context[found]
                t["depth"][found] = level
                t[f"n{level}"] = tree.known(level, context, symbol[at])
            t |= {b: np.where((own >= level) & (t["depth"] < level), code[at - level], np.uint64(0)) for level, b in enumerate(BEFORE, 1)}
            held.append(t)
            size += len(at)
            if size > 2 * BUCKET:
                yield from dealt(held, tree)
                held, size = [], 0
        if held:
            yield from dealt(held, tree)

    return run


def _deal_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k = batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) | FAR
                yield _pack(WORDS, {"k": k, "n": batch.column("n").to_numpy(zero_copy_only=False)}, _bucket(k, buckets))

    return run


def _count_grams(shared, buckets: int):
    """Fill in the counts that were unknown up to a token's depth, and deal on by the first context that isn't common; and each gram so counted."""

    def run(table: pa.Table) -> pa.Table:
        tree: Tree = shared.value
        t, words = _unpack(table, TOKENS), _unpack(table, WORDS)
        out = []
        if len(t["w"]):
            rare = np.flatnonzero(t["w"] >= FAR)
            t["n0"][rare] = 0
            if len(words["k"]) and len(rare):
                order = np.argsort(words["k"])
                k, n = words["k"][order], words["n"][order]
                at = np.minimum(np.searchsorted(k, t["w"][rare]), len(k) - 1)
                t["n0"][rare] = np.where(k[at] == t["w"][rare], n[at], 0)
            # lone: no other token has this gram, so none has a longer one
            grams, lone = [], np.zeros(len(t["w"]), bool)
            for level in range(1, DEPTH + 1):
                at = np.flatnonzero((t["depth"] >= level) & (t[f"n{level}"] < 0))
                if len(at):
                    one, at = at[lone[at]], at[~lone[at]]
                    where, first = _groups(_chained(_context_key(tree.up(t["context"][at], t["depth"][at], level), level), t["w"][at]))
                    n = np.bincount(where, t["train"][at]).astype(np.int64)
                    t[f"n{level}"][at], t[f"n{level}"][one] = n[where], t["train"][one]
                    lone[at] = np.bincount(where)[where] == 1
                    first = np.concatenate((at[first[n > 0]], one[t["train"][one] > 0]))
                    counts = {c: t[c][first] for c in COUNTS[1:]} | {"n0": tree.count_of(t["w"][first], t["n0"][first])}
                    grams.append({"level": np.full(len(first), level), "context": tree.up(t["context"][first], t["depth"][first], level), **counts})
            out.append(_pack(COUNTED, t, _by_context(t, buckets)))
            if grams:
                grams = {f: np.concatenate([g[f] for g in grams]) for f in FIELDS[GRAMS]}
                out.append(_pack(GRAMS, grams, np.zeros(len(grams["level"]), np.int64)))
        return pa.Table.from_batches(out, LAID)

    return run


SUMS = "k bigint, have double, n double, gain double, p double"


def _sum_grams(shared, level: int):
    """Of each common context of the level the sums over transitions that aren't listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        size = len(tree.keys[level - 1])
        sums, seen = np.zeros((4, size)), False
        for batch in batches:
            g = _unpack(batch, GRAMS)
            own = g["level"] == level
            g = {f: x[own] for f, x in g.items()}
            p = (g["n0"] + 0.5) / tree.floor
            for below in range(1, level):
                p = tree.smoothed(below, tree.up(g["context"], np.full(len(p), level), below), g[f"n{below}"], p)
            n, context = g[f"n{level}"], g["context"]
            for i, x in enumerate((np.ones(len(n)), n, n * np.log(n / (tree.counts[level - 1][context] * p)), p)):
                sums[i] += np.bincount(context, x, minlength=size)
            seen |= len(n) > 0
        if seen:
            k = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(x[k]) for x in sums)], [f.split()[0] for f in SUMS.split(", ")])

    return run


SCORED = "uid bigint, n_tokens bigint, n_known bigint, base double, score double"


def _sum_texts(table: pa.Table) -> pa.Table:
    """Sums of the texts of a bucket over all that was summed of them before."""
    t = _unpack(table, SUMMED)
    row, first = _groups(t["uid"])
    sums = [np.zeros(len(first), np.int64), np.bincount(row, t["n_known"]).astype(np.int64), *(np.bincount(row, t[f]) for f in ("base", "score"))]
    return pa.table([t["uid"][first], *sums], names=[f.split()[0] for f in SCORED.split(", ")])


def _sum_head(shared):
    """Of each text its number of tokens, and what its words of the head make of the base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        value = np.log10(np.append(tree.word_count + 0.5, tree.floor) / tree.floor)  # the last, 0, is that of words not in the head
        for uid, _, edge, place, _ in _numbered(batches):
            row, n = np.repeat(np.arange(len(uid)), np.diff(edge)), len(uid)
            sums = [np.diff(edge), np.bincount(row, place >= 0, n).astype(np.int64), np.bincount(row, value[place], n), np.zeros(n)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, *sums)], [f.split()[0] for f in SCORED.split(", ")])

    return run


def _score(shared, buckets: int):
    """Probabilities of a bucket's tokens, summed by text and dealt by it; contexts that aren't common lie whole in the bucket."""

    def run(table: pa.Table) -> pa.Table:
        tree: Tree = shared.value
        t = _unpack(table, COUNTED)
        train, depth, inside = t["train"], t["depth"], t["inside"]
        base = (tree.count_of(t["w"], t["n0"]) + 0.5) / tree.floor
        p, context = base.copy(), _context_key(t["context"], depth)
        # lone: no other token has this context, so none has a longer one
        lone = np.zeros(len(base), bool)
        for level, b in enumerate(BEFORE, 1):
            hot = np.flatnonzero(depth >= level)
            if len(hot):
                p[hot] = tree.smoothed(level, tree.up(t["context"][hot], depth[hot], level), t[f"n{level}"][hot], p[hot])
            at = np.flatnonzero((depth < level) & (inside >= level))
            many = at[~lone[at]]
            context[many] = _chained(context[many], t[b][many])
            where, _ = _groups(context[many])
            lone[many] = np.bincount(where)[where] == 1
            one = at[lone[at] & (train[at] > 0)]
            own = -np.log(p[one]) > math.log(tree.distinct + 1)
            p[one[own]] = (1 + PRIOR * p[one[own]]) / (1 + PRIOR)
            where, at = where[~lone[many]], many[~lone[many]]
            if not len(at):
                continue
            learnt = train[at].astype(np.float64)
            gram, _ = _groups(_chained(context[at], t["w"][at]))
            n = np.bincount(gram, learnt)[gram]
            c, have = np.bincount(where, learnt), np.rint(np.bincount(where, learnt / np.maximum(n, 1)))
            gain = np.bincount(where, learnt * (np.log(np.maximum(n, 1)) - np.log(p[at]))) - c * np.log(np.maximum(c, 1))
            kept = (c > 0) & (gain > have * math.log(tree.distinct + 1) + 0.5 * np.log(np.maximum(c, 1)))
            p[at] = np.where(kept[where], (n + PRIOR * p[at]) / (c[where] + PRIOR), p[at])
        row, first = _groups(t["uid"])
        uid, rare = t["uid"][first], np.flatnonzero(t["w"] >= FAR)
        of_rare = lambda x: np.bincount(row[rare], x, len(uid))
        out = {"uid": uid, "n_known": of_rare(t["n0"][rare] > 0).astype(np.int64), "base": of_rare(np.log10(base[rare])), "score": np.bincount(row, np.log10(p))}
        return pa.Table.from_batches([_pack(SUMMED, out, _bucket(uid.view(np.uint64), buckets))])

    return run


def _grown(tree: Tree, grams: DataFrame) -> Tree:
    """The common contexts' states; grams are those counted in the slice that has them."""
    sc, tree = grams.sparkSession.sparkContext, tree.stateless()
    suffix = np.full(len(tree.keys[0]) if tree.keys else 0, -1)
    for level, keys in enumerate(tree.keys, 1):
        if level > 1:
            rest = tree.rest[level - 1]
            suffix = np.where(tree.states[-1][rest] >= 0, tree.states[-1][rest], suffix[rest])
        shared = sc.broadcast(tree)
        found = grams.mapInArrow(_sum_grams(shared, level), SUMS).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("have", "n", "gain", "p")]).toPandas()
        shared.destroy()
        others = np.zeros((4, len(keys)))
        others[:, found["k"].to_numpy(np.int64)] = found[["have", "n", "gain", "p"]].to_numpy(np.float64).T
        context, symbol = np.divmod(tree.listed[level - 1][0], max(1, tree.symbols))
        tree.grow(keys, tree.counts[level - 1], suffix, context, symbol, tree.listed[level - 1][1].astype(np.float64), others)
    return tree


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Documents of which crc32 of the doc_id as text has the remainder 1 modulo 5 are held out, the others
    are learnt from; a null doc_id counts as empty text. A null text is empty and has its end as its only
    token. Without training documents every token is unknown, and both scores are those of one
    unknown class. Words and their runs are told apart by 64-bit hashes.
    """
    texts, same = with_uid(docs)
    spark = texts.sparkSession
    sc = spark.sparkContext
    held_out = F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 1
    path, numbered = scratch(spark, "tokens"), scratch(spark, "numbered")
    stored = put(texts.select("uid", "text", held_out.eqNullSafe(False).alias("train")).mapInArrow(_store, STORED), path, "uncompressed")
    tree, words, stored = common(stored, numbered)
    drop(spark, path)
    tokens = stored.agg(F.sum("m")).first()[0] or 0
    slices = min(SLICES, 1 + tokens // SLICE)
    buckets = 1 + tokens // slices // BUCKET
    rare = words.where(F.col("n") < HEAD * tree.total)
    plain = sc.broadcast(tree.stateless())
    parts = [put(stored.mapInArrow(_sum_head(plain), SCORED), scratch(spark, "scores"))]
    for part in range(slices):
        tables = [scratch(spark, "dealt"), scratch(spark, "grams")]
        dealt = put(stored.mapInArrow(_deal(plain, part, slices, buckets), PACKED), tables[0], "uncompressed", "kind")
        of = lambda d, kind: d.where(F.col("kind") == kind)
        unknown = of(dealt, TOKENS).unionByName(rare.mapInArrow(_deal_words(buckets), PACKED))
        counted = put(unknown.groupBy("bucket").applyInArrow(_count_grams(plain, buckets), PACKED), tables[1], "uncompressed", "kind", tidy=True)
        drop(spark, f"{tables[0]}/kind={TOKENS}")
        states = sc.broadcast(_grown(tree, of(counted, GRAMS)))
        scored = of(dealt, COUNTED).unionByName(of(counted, COUNTED)).groupBy("bucket").applyInArrow(_score(states, buckets), PACKED)
        parts.append(put(scored.groupBy("bucket").applyInArrow(_sum_texts, SCORED), scratch(spark, "scores"), tidy=True))
        states.destroy()
        for table in tables:
            drop(spark, table)
    drop(spark, numbered)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("uid").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    out = with_key(out, texts, same).withColumn("train_tokens", F.lit(tree.total).cast("long")).withColumn("held_out", held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
