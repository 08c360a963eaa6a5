"""Row identities and Arrow text blocks for the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.plans.shared import small, stage

#: Bytes of text that a task handles at once; one longer text makes a block of its own.
BLOCK_BYTES = 2_000_000


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; columns that docs has besides them can't clash with ours."""
    return docs.select(*[docs[n].alias(n) for n in names])


def identifies(docs: DataFrame, key: str) -> bool:
    """Whether the key is an integer, without nulls and unique."""
    if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        return False
    n, have, distinct = docs.agg(F.count(F.lit(1)), F.count(docs[key]), F.countDistinct(docs[key])).first()
    return n == have == distinct


def with_row(docs: DataFrame, *names: str, key: str = "doc_id") -> DataFrame:
    """(uid, names, _row): whole rows as one column, with a number that tells rows apart and orders them by key.

    Where the key tells rows apart, it is the uid. Otherwise rows are sorted by key (null last), then
    by a hash of the row, and written once to the shared folder, so that verdicts on a uid
    concern one row, whatever its key is.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    if identifies(docs, key):
        rows = docs.select(docs[key].cast("long").alias("uid"), row)
    else:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tie = F.xxhash64(*[F.col("_row")[c] for c, kind in docs.dtypes if "map<" not in kind])
        order = [F.col("_row")[key].asc_nulls_last(), tie]
        ordered = docs.select(row).repartitionByRange(parts, *order, F.rand(7)).sortWithinPartitions(*order)
        rows = stage(ordered.select(F.monotonically_increasing_id().alias("uid"), "_row"), "rows")
    return rows.select("uid", *[F.col("_row")[n].alias(n) for n in names], "_row")


def repeated(d: DataFrame, times: str, name: str, most: int = 10_000) -> DataFrame:
    """Each row as often as its column ``times`` says, with ``name`` counting from 0.

    Rows that come more than ``most`` times are dealt in pieces first, so none makes one long array or one task's output.
    """
    zero = F.lit(0).cast("long")
    few = d.where(F.col(times).between(1, most)).withColumn(name, F.explode(F.sequence(zero, F.col(times) - 1)))
    pieces = d.where(F.col(times) > most).withColumn("_piece", F.explode(F.sequence(zero, F.floor((F.col(times) - 1) / most))))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = F.least(F.col(times), (F.col("_piece") + 1) * most) - 1
    many = pieces.repartition(parts, "_piece").withColumn(name, F.explode(F.sequence(F.col("_piece") * most, upto))).drop("_piece")
    return few.unionByName(many)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of :func:`with_row` as they were, less those of which the uid is in ``gone`` (uid)."""
    gone = small(gone.select(F.col("uid").alias("_gone")))
    return rows.join(gone, rows["uid"] == gone["_gone"], "left_anti").select("_row.*")


def with_uid(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """(uid, key, text), where uid is unique and orders rows by key; and whether it is the key.

    Where the key is an integer, without nulls and unique, it is the uid itself. Otherwise
    rows are sorted by key (null first), then by text, over range partitions, and written
    once to the shared folder with generated increasing numbers; equal rows get different ones.
    """
    docs = docs.select(docs[key].alias(key), docs[text].alias(text))
    if identifies(docs, key):
        return docs.select(F.col(key).cast("long").alias("uid"), key, text), True
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(text)
    ordered = docs.repartitionByRange(parts, F.col(key), tie, F.rand(7)).sortWithinPartitions(key, tie)
    return stage(ordered.select(F.monotonically_increasing_id().alias("uid"), key, text), "uid"), False


def with_key(found: DataFrame, texts: DataFrame, same: bool, key: str = "doc_id") -> DataFrame:
    """``found`` (uid, …) with the key of :func:`with_uid`'s result."""
    if same:
        return found.withColumn(key, F.col("uid").cast(dict(texts.dtypes)[key]))
    return found.join(texts.select("uid", key), "uid")


def text_block(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = text_block(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between whitespace, and of words of letters, digits and all beyond ASCII (after LOWER).
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def word_spans(raw: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edge = off[:-1][off[:-1] < len(raw)]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = off[1:][off[1:] > 0] - 1
    after[edge] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Powers are the product of one from each of two small tables, so none is as long as the data.
LOW = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0 ... base ** (LOW - 1), and of base ** LOW as many powers as places below ``n`` need."""
    low, high = _powers.get(int(base), (None, None))
    if low is None:
        low = np.full(LOW, base, np.uint64)
        low[0] = 1
        low = np.multiply.accumulate(low)
    if high is None or len(high) * LOW < n:
        high = np.full(max(256, -(-n // LOW)), (low[-1:] * base)[0], np.uint64)
        high[0] = 1
        high = np.multiply.accumulate(high)
        _powers[int(base)] = low, high
    return low, high


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    low, high = _tables(base, n)
    return (high[: -(-n // LOW), None] * low[None, : min(n, LOW)]).ravel()[:n]


def power_at(base: np.uint64, at: np.ndarray, n: int) -> np.ndarray:
    """base ** i for each i of ``at``, all below ``n``."""
    low, high = _tables(base, n)
    if n <= LOW:
        return low[at]
    return low[at & (LOW - 1)] * high[at >> 16]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finisher of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes: entry i covers values[:i]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same value for equal spans wherever they stand; not yet mixed."""
    return (prefix[ends] - prefix[starts]) * power_at(INVERSE, starts, len(prefix))


#: What is left of eight bytes when only the first 0 to 8 belong to a word.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LANED = 64


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the words: XXH3 of long ones, for others eight bytes at a time through :func:`mix`.

    Words of one length up to eight bytes never collide; no sum or product over letters is left
    that structured words (of few letters, or permuted ones) could cancel in.
    """
    size = (ends - starts).astype(np.int64)
    h = mix(size.view(np.uint64) * BASE + np.uint64(0x2545F4914F6CDD1D))
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    open_ = np.flatnonzero((size > 0) & (size <= LANED))
    at, left = starts[open_], size[open_]
    while len(open_):
        h[open_] = mix(h[open_] ^ (lanes[at] & _LANE[np.minimum(left, 8)]))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LANED).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), 42)
    return h
