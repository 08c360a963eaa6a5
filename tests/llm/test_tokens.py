"""Operators 11 to 13 against plain loops."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstream.llm import alignment, tokens
from siltstream.llm.alignment import align_documents
from siltstream.llm.conversations import A, START, U, cheapest, repair_conversations, repair_damaged
from siltstream.llm.packing import Windows, pack
from siltstream.llm.tokens import Memo, word_ids

from . import brute_tokens as brute
from .conftest import got, want

WORD, BYTE, PIECE = (brute.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
STRANGE = [
    "naïve Ünïcode İstanbul ǅ ŉ ſ straße", "日本語のテキスト です 東京", "مرحبا بالعالم 123", "á ë combining ̀x", "emoji 👩‍👩‍👧 x 🙂🙂", "tab\tnew\n\n line\r\n  two  spaces   three",
    "<|endoftext|> and <|startoftext|>x", "low ▁ line ▁▁ x▁ y", "control \x00\x01\x1c\x1d\x85 end", "it's I'LL they've 'S ''", "  leading", "trailing  ", " ", "\n", "  ", "x" * 700 + " y", "½ ² ٣ 12345 1.5e-7",
    "non break  em 　ideographic", "<0x41> <s> </s> <unk>", "ÀÉ ÿ ƀ ȳ ×÷ ÷× ßẞ", "Σίσυφος ΟΔΟΣ", "﻿bom ​zero ‮bidi", "K Å ﬁ", "  two words  and   more ",
]


def packs(found, expected):
    """Pieces that tile each document once and lie in sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in found:
        by_doc.setdefault(doc, []).append((start, length, crc, total))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert sorted(by_doc) == sorted(expected)
    for doc, own in by_doc.items():
        ids, at = expected[doc], 0
        for start, length, crc, total in sorted(own):
            assert (start, total) == (at, len(ids)) and length > 0
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    sizes = []
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        sizes.append(at)
    return sizes


def test_packing(docs, texts, empty):
    expected = {d: brute.packed_ids(t) for d, t, _, _ in texts[0]}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sizes = packs(got(pack(docs, WORD), *names), expected)
    assert max(sizes) <= 2048
    few = packs(got(pack(docs, WORD, window=64, most=4), *names), expected)
    assert max(few) <= 64 and sum(few) == sum(map(len, expected.values()))
    # windows left over by tasks are merged: two of them can't both be half empty
    assert sum(n <= 32 for n in few) <= 1 + 4
    assert pack(empty, WORD).count() == 0


def test_packing_odd(odd):
    """Equal and null doc_ids: each row is packed on its own."""
    df, rows = odd
    found = pack(df, WORD).groupBy("doc_id").agg({"length": "sum"}).collect()
    expected = {}
    for d, t in rows:
        expected[d] = expected.get(d, 0) + len(brute.packed_ids(t))
    assert {r[0]: r[1] for r in found} == expected


def test_packing_merges_many_tasks(spark):
    """More tasks than meet in one round, each with one small leftover."""
    rows = [(i, "word " * (1 + i % 7)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sizes = packs(got(pack(df, WORD, window=16, most=2), *names), {d: brute.packed_ids(t) for d, t in rows})
    assert len(sizes) <= 1.2 * sum(sizes) / 16 + 2


def test_open_windows():
    """At most so many open at once, best fit, the fullest goes first."""
    w = Windows(10, 2)
    assert w.put(6, "a") == [] and w.put(7, "b") == []
    assert w.put(3, "c") == [["b", "c"]]  # three are free beside b, four beside a
    assert w.put(8, "d") == [] and w.put(9, "e") == [["d"]]
    assert w.rest() == [["e"], ["a"]]


@pytest.mark.parametrize("text", STRANGE)
def test_word_ids(text):
    assert [*word_ids(WORD, text).tolist(), 1] == brute.packed_ids(text)


def test_memo_is_bounded():
    m = Memo(lambda new: [k * 2 for k in new], most=10)
    for i in range(100):
        assert m.values([str(i), "a", str(i)]) == [str(i) * 2, "aa", str(i) * 2]
        assert len(m.young) + len(m.old) <= 24
    assert m.values(["x" * 100]) == ["x" * 200] and "x" * 100 not in m.young


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(docs, texts, empty):
    expected = brute.aligned([(d, t) for d, t, _, _ in texts[0]])
    assert got(align_documents(docs, BYTE, PIECE), *ALIGNED) == want(expected)
    assert got(align_documents(docs, BYTE, PIECE, block=50), *ALIGNED) == want(expected)  # many blocks
    assert align_documents(empty, BYTE, PIECE).count() == 0


def test_alignment_strange(spark):
    rows = list(enumerate(STRANGE)) + [(100, "日本 " * 40), (101, None), (102, "")]
    expected = brute.aligned(rows)
    assert any(r[1] == 0 and rows[k][1] for k, r in enumerate(expected)) and sum(r[1] > 0 for r in expected) > 15
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(align_documents(df, BYTE, PIECE), *ALIGNED) == want(expected)
    only = spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")
    assert got(align_documents(only, BYTE, PIECE), *ALIGNED) == want(brute.aligned([(1, None), (2, "▁")]))


def test_alignment_odd(odd):
    df, rows = odd
    assert got(align_documents(df, BYTE, PIECE), *ALIGNED) == want(brute.aligned(rows))


REPAIRED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def talks():
    r = random.Random(8)
    text = ["", " \t", "Yes.", "no", "What?", "Yes.", "so it is", "Ends here!", " x. ", None]
    rows = []
    for conv in range(40):
        for turn in range(r.choice([0, 1, 2, 3, 5, 9, 14])):
            t = None if r.random() < 0.05 else turn + (3 if r.random() < 0.1 else 0)
            tie = any(x[0] == conv and x[1] == t for x in rows)  # the order of ties is ours
            if not tie:
                rows.append((conv, t, r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(text) if r.random() < 0.6 else f"own {conv} {turn}."))
    rows += [(77, i, "user", "Again and again.") for i in range(40)]  # one large group
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "None.")]
    return rows


@pytest.mark.parametrize("segment", [512, 4, 1])
def test_repair(spark, talks, segment):
    df = spark.createDataFrame([(*x, "clash", "clash") for x in talks], "conv_id long, turn long, role string, text string, rows string, segment string").repartition(5)
    assert got(repair_damaged(df, segment), *REPAIRED) == want(brute.repaired(talks))


def test_repair_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair_damaged(spark.createDataFrame([], schema)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"5:{i}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "Hi.")], schema)
    assert got(repair_damaged(df), *REPAIRED) == want(brute.repaired([(5, gone, "user", "Hi.")]))


def test_repeated_rows_and_long_text(spark):
    """Equal rows are duplicates of the first; a very long text is one row as any other."""
    rows = [(1, 2, "user", "Same.")] * 5 + [(1, 3, "assistant", "word " * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(repair_damaged(df), *REPAIRED) == want(brute.repaired(rows))


def test_edits(spark):
    """The operator's own output, without damage."""
    rows = [(1, 1, "system", "S."), (1, 2, "assistant", "A."), (1, 3, "user", "cut"), (2, 1, "user", "Q?"), (2, 2, "assistant", "A.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = repair_conversations(df).orderBy("conv_id", "place").collect()
    said = {c: "".join(r.edit for r in out if r.conv_id == c) for c in (1, 2)}
    assert said == {1: "RKD", 2: "KK"}
    assert [(r.role, r.text) for r in out if r.conv_id == 2] == [("user", "Q?"), ("assistant", "A.")]


def test_search_takes_the_least_of_equal_audits():
    r = random.Random(3)
    for _ in range(300):
        rows = [(r.choice("suax"), r.randrange(4)) for _ in range(r.randint(1, 8))]
        texts = [(i, "", ("", "blank", "duplicate", "truncated")[f]) for i, f in rows]
        cost, audit, _ = brute._cheapest([(i, t, f) for i, t, f in texts])
        found = cheapest(rows, START, {q: 5 * n for q, n in enumerate((0, 2, 1, 0))})
        assert found[0] == cost and audit.startswith(found[1]) and set(audit[len(found[1]) :]) <= {"I"}
    assert cheapest([], U, {A: 0}) is None


def test_alignment_bounded(spark):
    """Documents without links fill a block too, and the last step keeps no tokenizer of the first."""
    df = spark.range(0, 25_000, 1, 1).select("id", F.lit(None).cast("string").alias("text"))
    staged = df.withColumnRenamed("id", "uid").mapInArrow(alignment._align(BYTE, PIECE, 50), alignment.STAGED)
    held = [r["count"] for r in staged.where("uid is not null").groupBy("block").count().collect()]
    assert sum(held) == 25_000 and max(held) <= 10_000  # one batch of rows
    tokens.both_ids(BYTE, PIECE, ["some words"])
    own = pa.table([pa.array(x, t) for x, t in (([7], pa.int64()), ([3], pa.int64()), ([1], pa.int64()), ([1], pa.int64()), ([1], pa.int64()), (["h"], pa.string()), ([[0]], pa.list_(pa.int32())), ([None], pa.list_(pa.int64())), ([[2]], pa.list_(pa.int64())))], [c.split()[0] for c in alignment.STAGED.split(", ")])
    value = pa.table([pa.array(x, f.type) for x, f in zip(([7], [None], [None], [None], [None], [None], [None], [[9]], [None]), own.schema, strict=True)], own.schema.names)
    assert alignment._finish(pa.concat_tables([own, value])).to_pylist() == [{"uid": 3, "n_a": 1, "n_b": 1, "n_groups": 1, "n_links": 2, "n_best": 2, "count_sum": 8, "groups_sha256": "h"}]
    assert tokens.part_memo.cache_info().currsize == tokens.library.cache_info().currsize == 0
