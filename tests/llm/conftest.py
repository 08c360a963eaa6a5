import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _words(r, n, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source): copies, near copies, shared passages, repeats, empty, null, long and odd texts."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(1, 8))) for _ in range(400)]
    passage = _words(r, 60, vocabulary)
    benchmark = [(i, _words(r, n, vocabulary)) for i, n in enumerate((40, 20, 13, 6, 1))] + [(9, ""), (10, None)]
    rows = []
    for i in range(60):
        t = _words(r, r.randint(1, 150), vocabulary).capitalize()
        if i % 5 == 0:
            t = f"{t}\n{passage} {_words(r, 30, vocabulary)}"
        if i % 7 == 0:
            t += " " + benchmark[i % 4][1] + "\nUnder the MIT License. Licensed under the Apache License, Version 2.0"
        if i % 11 == 0:
            t += "\nsame line here\nsame line here\n" + "ha " * 60
        if i % 13 == 0:
            t += " ### $$$ ||| CC-BY-NC"
        rows.append(t)
    near = rows[3] + " " + _words(r, 1, vocabulary)
    rows += [rows[3], rows[3], near, rows[10], "", None, " \t\n", "a", "a" * 400, "x y " * 300, _words(r, 4000, vocabulary), None, ""]
    return [(i * 3, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s0"][i % 4]) for i, t in enumerate(rows)], benchmark


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, a, s, len(t or "")) for d, t, a, s in texts[0]], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def items(spark, texts):
    return spark.createDataFrame(texts[1], "item_id bigint, text string")


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Repeated rows, repeated and null doc_ids, and columns with the names that operators use inside."""
    own = [(d, t, a, s) for d, t, a, s in texts[0][:12]]
    rows = own + own[:3] + [(None, own[1][1], "en", "s1"), (None, None, None, None), (None, None, None, None), (own[0][0], "another text under one id", "en", "s1")]
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)
    from pyspark.sql import functions as F

    clash = ["uid", "size", "k", "n", "fp", "bucket", "blob", "words", "w", "m", "stratum", "shard", "slot", "root", "node", "_h", "_size"]
    return df.withColumns({c: F.lit("clash") for c in clash}), [(d, t) for d, t, _, _ in rows]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def want(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))
