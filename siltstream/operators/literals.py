"""A literal index over rules: a command meets only those patterns of which it holds a text that they need.

From each pattern follows a set of literals of which any text that it matches holds at least one. All of them
together make one Aho-Corasick automaton, so a command is read once however many rules there are, in the same
Arrow helper that cuts it into simple commands. Patterns themselves still run in the JVM.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstream.functions.shell import segments

Rule = tuple[str, str, str, str, str]

#: Where Java reads a pattern otherwise than Python's parser does: nested classes, ``[]``, octal escapes, quoting, verbose mode.
_APART = re.compile(r"\[[^\]]*\[|\[\^?\]|\\0|\\Q|&&|\(\?[a-zA-Z]*[xiU]")


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set that fewer texts meet: of the longer shortest literal, then of fewer literals."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _needed(items) -> frozenset[str] | None:
    """Literals of which a match of this sequence of parsed pieces holds one; None if it may do without any."""
    best, word = None, ""
    for op, value in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            word += chr(value)
            continue
        if word:
            best, word = _better(best, frozenset([word])), ""
        if name == "SUBPATTERN":
            best = _better(best, None if value[1] or value[2] else _needed(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            best = _better(best, _needed(value[2]))
        elif name == "BRANCH":
            each = [_needed(b) for b in value[1]]
            best = _better(best, None if None in each else frozenset().union(*each))
        elif name == "ATOMIC_GROUP":
            best = _better(best, _needed(value))
        elif name == "ASSERT":
            best = _better(best, _needed(value[1]))
    return best


def needed_literals(pattern: str) -> frozenset[str] | None:
    """Texts of which whatever matches ``pattern`` holds at least one; None where there is no such set, or the pattern is not read with certainty.

    Patterns that ignore case have none, nor those in a notation that Java and Python read differently.
    """
    if _APART.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # what Python may read otherwise one day is not certain
            return _needed(re._parser.parse(pattern))
    except (re.error, Warning, OverflowError, RecursionError):
        return None


def _index(rules: list[Rule]) -> tuple[dict[str, tuple[list[int], list[int]]], list[list[int]]]:
    """Literal -> numbers of the command rules and of the segment rules that need it; and of both those without one."""
    words: dict[str, tuple[list[int], list[int]]] = {}
    always: list[list[int]] = [[], []]
    for i, (_, _, _, scope, pattern) in enumerate(rules):
        which, needs = int(scope != "command"), needed_literals(pattern)
        if needs is None:
            always[which].append(i)
        for w in needs or ():
            words.setdefault(w, ([], []))[which].append(i)
    return words, always


def read_commands(command: Column, rules: list[Rule]) -> Column:
    """Of each command its simple commands and the numbers of the rules to be tried on it: segments array<string>, tried array<int>.

    A rule that is not among ``tried`` matches neither the command nor (if it is of that scope) any of its segments. The
    index grows with the rules, not with the data.
    """
    words, always = _index(rules)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for w, numbers in words.items():
            automaton.add_word(w, numbers)
        if words:
            automaton.make_automaton()

        def hits(texts: list[str], which: int) -> set[int]:
            out = set(always[which] if texts else ())
            for t in texts if words else ():
                for _, numbers in automaton.iter(t):
                    out.update(numbers[which])
            return out

        for column in columns:
            parts = [[] if c is None else segments(c) for c in column]
            tried = [[] if c is None else sorted(hits([c], 0) | hits(p, 1)) for c, p in zip(column, parts, strict=True)]
            yield pd.DataFrame({"segments": parts, "tried": tried})

    return F.pandas_udf(run, "segments array<string>, tried array<int>")(command)
