"""Operators 2 to 7 and 10 against plain loops, on ordinary and on odd tables."""

import random

import pytest

from siltstream.llm.decontaminate import decontaminate, keep_clean, near_matches
from siltstream.llm.license_texts import BODIES
from siltstream.llm.licenses import PHRASES, TEMPLATES, Automaton, scan_licenses
from siltstream.llm.quality import SHARES, at_most, judge, quality_rules
from siltstream.llm.rlz import remove_repeated_passages
from siltstream.llm.simhash import keep_first, simhash_components
from siltstream.llm.suffix_dedup import remove_repeated_bytes
from siltstream.llm.suffix_tree import score_documents

from . import brute
from .conftest import got, want


def plain(texts):
    return [(d, t) for d, t, _, _ in texts[0]]


OUT = {
    "decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
    "licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"],
    "bytes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "passages": ["doc_id", "n_words", "n_removed", "kept_sha256"],
}


def test_decontamination(docs, items, texts):
    expected = brute.decontaminate(plain(texts), texts[1])
    assert any(r[5] for r in expected)
    assert got(decontaminate(docs, items), *OUT["decontaminate"]) == want(expected)
    kept = {r.doc_id for r in keep_clean(docs, items).select("doc_id").collect()}
    assert kept == {r[0] for r in expected if not r[5]}


def test_decontamination_odd(odd, items, texts, empty, spark):
    df, rows = odd
    assert got(decontaminate(df, items), *OUT["decontaminate"]) == want(brute.decontaminate(rows, texts[1]))
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r[5] for r in got(decontaminate(df, none), *OUT["decontaminate"]))
    assert decontaminate(empty, items).count() == 0


def test_proximity(spark):
    """Against plain loops: every word of a window within two places of where it should be."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    item = [r.choice(words) for _ in range(16)]
    docs = [(1, "one two three four five"), (2, "one x two three four five"), (3, "five four"), (4, None), (5, "two three four five"), (6, "one two three x y z x y z four five")]
    for i in range(10, 60):
        t = list(item[r.randint(0, 3) :])
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(t))
            t[at : at + r.randint(0, 1)] = [r.choice(words) for _ in range(r.randint(0, 2))]
        docs.append((i, " ".join(r.choice(words) for _ in range(r.randint(0, 5))) + " " + " ".join(t)))
    items = [(7, "one two three four five"), (8, " ".join(item)), (9, None), (None, "one two")]
    expected = set()
    for d, t in docs:
        w = brute.letters(t)
        for i, p in items:
            q = brute.letters(p)
            for win in [q[k : k + 13] for k in range(max(1, len(q) - 12))] if q and i is not None else []:
                near = lambda s, win=win, w=w: all(x in w[max(0, s + o - 2) : max(0, s + o + 3)] for o, x in enumerate(win))
                if any(near(s) for s in range(-2, len(w) + 3)):
                    expected.add((d, str(i)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert len(expected) > 15 and {(1, "7"), (2, "7")} <= expected and (6, "7") not in expected
    assert set(got(near_matches(d, i), "doc_id", "item")) == expected
    assert near_matches(d.limit(0), i).count() == near_matches(d, i.limit(0)).count() == 0


def test_quality(docs, odd, texts, empty, spark):
    labels = spark.createDataFrame([(d, int(i % 5 > 0), 0) for i, (d, _) in enumerate(plain(texts))], "doc_id bigint, quality int, toxic int")
    assert got(quality_rules(docs, labels), *OUT["quality"]) == want(brute.quality(plain(texts)))
    assert got(quality_rules(odd[0], labels), *OUT["quality"]) == want(brute.quality(odd[1]))
    none = labels.limit(0)
    assert [r for r in quality_rules(docs, none).collect() if r.kept == r.base_failed] == []
    assert quality_rules(empty, labels).count() == 0


def test_certified_cutoffs(spark):
    """The whole procedure against plain loops; and a stratum with too few labels has no cutoff."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(1500):
        lang = ["en", "en", "fr", None][i % 4]
        bad = r.random() < 0.25
        text = " ".join(r.choice(words) for _ in range(r.randint(12, 40)))
        if bad:
            text += " ###" * r.randint(1, 9) if r.random() < 0.5 else " " + " ".join("x" * r.randint(20, 60) for _ in range(9))
        elif r.random() < 0.01:
            text += " #"
        rows.append((i, text, lang, "s"))
        if i % 3 and lang != "fr":
            labels.append((i, int(not bad), int(r.random() < 0.05)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = judge(docs, table, risk=0.05, level=0.1).collect()
    expected = brute.kept([(d, t) for d, t, _, _ in rows], {d: x or "" for d, _, x, _ in rows}, labels, SHARES, 0.05, 0.1)
    assert {x.doc_id for x in out if x.kept} == expected
    base = {x.doc_id for x in out if not x.base_failed}
    by_lang = {x: sum(rows[d][2] == x for d in base - expected) for x in ("en", "fr", None)}
    assert by_lang["en"] > 60 and by_lang["fr"] == 0
    assert {x.rejected_by for x in out} >= {"symbols_per_word", "word_length"}


def test_binomial(spark):
    from math import comb

    rows = [(k, n) for n in (1, 10, 300) for k in (0, 1, 2) if k < n * 0.2]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    for r in df.select("k", "n", at_most(df.k, df.n, 0.2).alias("p")).collect():
        exact = sum(comb(r.n, i) * 0.2**i * 0.8 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_licenses(docs, odd, texts, empty):
    assert got(scan_licenses(docs), *OUT["licenses"]) == want(brute.licenses(plain(texts), PHRASES))
    assert got(scan_licenses(odd[0]), *OUT["licenses"]) == want(brute.licenses(odd[1], PHRASES))
    assert scan_licenses(empty).count() == 0


def test_license_templates(spark):
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following XX are met"
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spans=True).first()
    assert row.labels == "bsd-3-clause" and row.base_labels == "" and row.score == 18 / 21 and row.spans.startswith("0,")


def test_parts_of_base_phrases(spark):
    """Three of a phrase's four words name no license."""
    texts = ["GNU General Public License, version 2", "the Mozilla Public License Version 2.0", "not under the MIT one", "Apache License, Version 2"]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["", "", "", "apache-2"]
    assert all(r.score < 0.3 for r in rows[:3]) and rows[3].score == 1


def test_every_notice(spark):
    """Each notice has a span of its own, changed words or not, and no chain runs from one into the next."""
    words = dict(TEMPLATES)["bsd-3-clause"].split()
    changed = [*words[:9], "xx", *words[10:]]
    part = words[:5]
    text = [*changed, *changed, "and", *words, *part, *changed, *["yy"] * 50, *words, *words]
    spans = scan_licenses(spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string"), spans=True).first().spans
    n = len(words)
    starts = [0, n, 2 * n + 1, 3 * n + 6, 4 * n + 56, 5 * n + 56]
    assert spans == ";".join(f"{a},{a + n},bsd-3-clause" for a in starts)
    # parts of both would cover more than either
    late, early = [*words[:15], "xx", *words[16:18], "xx", *words[19:]], ["xx", "xx", *words[2:16], "xx", *words[17:]]
    text = " ".join([*late, *early])
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spans=True).first()
    assert row.score == (15 + 4) / n and row.spans == f"0,15,bsd-3-clause;{n + 2},{2 * n},bsd-3-clause"


def test_matching_statistics():
    sequences = [[1, 2, 3, 1, 2], [2, 3, 4], [1, 1]]
    a = Automaton(sequences)
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    tokens = [1, 2, 3, 4, 1, 1, 2, 9, 3, 1, 2, 3]
    for i, (_, n) in enumerate(a.walk(tokens)):
        assert n == max([k for k in range(1, i + 2) if tuple(tokens[i + 1 - k : i + 1]) in parts], default=0)


def test_bytes(docs, odd, texts, empty):
    expected = brute.first_repeats(sorted(plain(texts)))
    assert sum(r[2] for r in expected) > 1000
    assert got(remove_repeated_bytes(docs), *OUT["bytes"]) == want(expected)
    assert remove_repeated_bytes(empty).count() == 0
    rows = sorted(odd[1], key=lambda r: (r[0] is not None, r[0] or 0))
    out = got(remove_repeated_bytes(odd[0]), *OUT["bytes"])
    # rows of one doc_id may come in either order: what is left of all texts is the same
    assert len(out) == len(rows) and sum(r[1] for r in out) == sum(r[1] for r in brute.first_repeats(rows))


def test_long_hot_group(spark):
    """One passage in most documents, with different neighbours in each: edges are taken apart."""
    passage = " ".join(f"word{j}" for j in range(40))
    rows = [(i, f"{i} intro {i * 7} {passage} outro {i * 13}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert got(remove_repeated_bytes(df), *OUT["bytes"]) == want(brute.first_repeats(rows))
    assert got(remove_repeated_passages(df), *OUT["passages"]) == want(brute.all_repeats(rows))


def test_passages(docs, odd, texts, empty):
    expected = brute.all_repeats(plain(texts))
    assert sum(r[2] for r in expected) > 300
    assert got(remove_repeated_passages(docs), *OUT["passages"]) == want(expected)
    assert got(remove_repeated_passages(odd[0]), *OUT["passages"]) == want(brute.all_repeats(odd[1]))
    assert remove_repeated_passages(empty).count() == 0
    assert "," in remove_repeated_passages(docs, with_factors=True).where("n_removed > 0").first().factors


def test_simhash(docs, odd, texts, empty):
    for df, rows in ((docs, plain(texts)), odd):
        expected = brute.components([(d, brute.fingerprint(t)) for d, t in rows])
        assert got(simhash_components(df), "doc_id", "fingerprint", "component_id") == want([(d, f"{f:016x}", c) for d, f, c in expected])
    assert simhash_components(empty).count() == 0
    kept = sorted(r.doc_id for r in keep_first(docs).collect())
    assert kept == sorted({c for _, _, c in brute.components([(d, brute.fingerprint(t)) for d, t in plain(texts)])})


def test_scores(docs, odd, texts, empty):
    for df, rows in ((docs, plain(texts)), odd):
        out = got(score_documents(df), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
        for a, b in zip(out, want(brute.base_scores(rows)), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert score_documents(empty).count() == 0


def test_tree_scores(spark, docs, texts):
    """The score against a tree in dictionaries, and a gain over the base on held-out texts of a source with memory."""
    from siltstream.llm import suffix_tree as S

    r = random.Random(6)
    follow = {a: [r.choice("abcdefgh") for _ in range(2)] for a in ("".join(x) for x in __import__("itertools").product("abcdefgh", repeat=2))}
    rows = []
    for i in range(120):
        t = ["a", "b"]
        while len(t) < 80:
            t.append(r.choice(follow[t[-2] + t[-1]]) if r.random() < 0.9 else r.choice("abcdefgh"))
        rows.append((i, " ".join(t)))
    memory = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for df, plain_rows, least in ((memory, rows, 10), (docs, plain(texts), 0)):
        expected, states = brute.tree_scores(plain_rows, S.DEPTH, S.CONTEXT, S.SYMBOL, S.TRANSITION, S.PRIOR)
        assert states >= least
        out = {x.doc_id: x for x in score_documents(df).collect()}
        for d, score in expected:
            assert out[d].score == pytest.approx(score, rel=1e-9)
    out = score_documents(memory).where("held_out").collect()
    assert sum(x.score for x in out) > sum(x.base_score for x in out) + 100


def test_tree_has_no_least_share(spark):
    """Contexts and next words that are a smaller part of the corpus than any share have their states and probabilities too."""
    r = random.Random(8)
    rare = [f"r{i}" for i in range(4000)]
    rows = [(i, " ".join(r.choice("abcdefghij") for _ in range(300))) for i in range(250)]
    # each rare word follows another one, twice in the corpus, and is a next word of common ones once
    rows += [(1000 + i, " ".join(f"{r.choice('abc')} {a} {b}" for a, b in zip(rare[4 * i : 4 * i + 4], reversed(rare[4 * i : 4 * i + 4]), strict=True))) for i in range(1000) for _ in range(2)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    expected, states = brute.tree_scores(rows, 3, 0, 0, 0, 20.0)
    assert states > 1000
    out = {x.doc_id: x.score for x in score_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert all(out[d] == pytest.approx(score, rel=1e-9) for d, score in expected)


@pytest.mark.parametrize("share", [0.002, 0.02, 2.0])
def test_tree_is_the_same_however_tokens_are_dealt(spark, monkeypatch, texts, docs, share):
    """Counts broadcast or met in buckets, one slice or several."""
    from siltstream.llm import suffix_tree as S

    for name, value in {"HOT_CONTEXT": share, "HOT_SYMBOL": share / 2, "HOT_TRANSITION": share / 4, "HEAD": share / 8, "BUCKET": 400, "SLICE": 2000, "SLICES": 2}.items():
        monkeypatch.setattr(S, name, value)
    expected, _ = brute.tree_scores(plain(texts), 3, 0, 0, 0, 20.0)
    out = {x.doc_id: x for x in score_documents(docs).collect()}
    for d, score in expected:
        assert out[d].score == pytest.approx(score, rel=1e-9)
    for a in brute.base_scores(plain(texts)):
        assert (out[a[0]].n_tokens, out[a[0]].n_known) == a[2:4] and out[a[0]].base_score == pytest.approx(a[5], rel=1e-9)


def thue_morse(n):
    """The word of n letters a and b, and its complement: sums over letters times powers of two cannot tell them apart."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_structured_words(spark):
    """Words and texts that cancel in polynomial hashes are told apart."""
    long = [thue_morse(n) for n in (1024, 2048, 4096)]
    rows = []
    for i, (a, b) in enumerate(long):
        same = " ".join(f"w{i}x{j}" for j in range(34))
        rows += [(4 * i, f"{same} {a}"), (4 * i + 1, f"{same} {b}"), (4 * i + 2, a + b + a), (4 * i + 3, b + a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(remove_repeated_passages(df), *OUT["passages"]) == want(brute.all_repeats(rows))
    assert got(remove_repeated_bytes(df), *OUT["bytes"]) == want(brute.first_repeats(rows))
    names = ["doc_id", "held_out", "n_tokens", "n_known"]
    assert got(score_documents(df), *names) == want([x[:4] for x in brute.base_scores(rows)])


def test_very_long_texts(spark, monkeypatch):
    """Texts over the bytes that a task handles at once."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    part = " ".join(r.choice(words) for _ in range(20_000))
    long = " ".join(r.choice(words) for _ in range(280_000)) + " " + part
    rows = [(1, long), (2, "short " + part[:3000]), (3, part + " end"), (4, "x" * 300)]
    assert len(long) > 2_000_000
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(remove_repeated_bytes(df), *OUT["bytes"]) == want(brute.first_repeats(rows))
    assert got(remove_repeated_passages(df), *OUT["passages"]) == want(brute.all_repeats(rows))


def test_full_licenses(spark):
    """Whole bodies are one span; a part of one, and two in one file; a license that contains another wins."""
    bodies = dict(BODIES)
    half = " ".join(bodies["mit"].split()[:60])
    texts = ["/* " + bodies["bsd-3-clause"] + " */ code", bodies["bsd-2-clause"], half, bodies["zlib"] + " and also " + bodies["isc"], " ".join(reversed(bodies["mit"].split())), None]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spans=True).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["bsd-3-clause", "bsd-2-clause", "mit", "isc,zlib", "", ""]
    assert [r.score for r in rows][:2] == [1, 1] and rows[4].score < 0.3
    table = spark.createDataFrame([("own", "these five words are mine alone here"), ("own", None), (None, "x"), ("none", "")], "label string, text string")
    found = scan_licenses(spark.createDataFrame([(1, "THESE five words are mine alone, here")], "doc_id int, text string"), templates=table).first()
    assert found.labels == "own" and found.score == 1


def test_short_phrases(spark):
    found = scan_licenses(spark.createDataFrame([(1, "the mit license here"), (2, "gpl"), (3, "mit x license")], "doc_id int, text string"), phrases=[("mit license", "mit"), ("gpl", "gpl")])
    assert got(found, "doc_id", "n_base", "base_labels") == [(1, 1, "mit"), (2, 1, "gpl"), (3, 0, "")]
