"""Literals that every match of a pattern must hold.

A pattern with look-around and wide alternations is tried at every position of a text. Most texts hold none of the words without
which it cannot match, which a plain substring search tells much sooner. The words are derived from the pattern itself, so the two
cannot drift apart: a sequence needs what each of its parts needs, an alternation one word of each branch, an optional part nothing.
"""

from __future__ import annotations

from functools import reduce
from re import _constants as op
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clauses tested before a pattern, and words of one clause.
CLAUSES, WORDS = 2, 8
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def _rank(words: frozenset[str]) -> tuple[int, int]:
    return min(map(len, words)), -len(words)


def _clauses(items) -> list[frozenset[str]]:
    found: list[frozenset[str]] = []
    word = ""
    for kind, arg in items:
        if kind is op.LITERAL and arg < 128:
            word += chr(arg).lower()
            continue
        if kind is op.AT:  # takes no room
            continue
        found += [frozenset({word})] if word else []
        word = ""
        if kind is op.SUBPATTERN:
            found += _clauses(arg[3])
        elif kind is op.ATOMIC_GROUP:
            found += _clauses(arg)
        elif kind in _REPEATS and arg[0] > 0:
            found += _clauses(arg[2])
        elif kind is op.BRANCH:
            each = [_clauses(branch) for branch in arg[1]]
            if all(each):
                found.append(frozenset().union(*(max(clauses, key=_rank) for clauses in each)))
    return found + ([frozenset({word})] if word else [])


def required(pattern: str) -> list[frozenset[str]]:
    """Clauses in lower case, the most telling first: a text that matches ``pattern``, letters' case aside, holds a word of each."""
    short = [c for c in _clauses(_parser.parse(pattern)) if len(c) <= WORDS]
    return sorted(dict.fromkeys(short), key=_rank, reverse=True)[:CLAUSES]


def may_match(low: Column, pattern: str) -> Column:
    """Whether a text in lower case holds what ``pattern`` needs; true where nothing is known."""
    clauses = [reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in sorted(c))) for c in required(pattern)]
    return reduce(Column.__and__, clauses) if clauses else F.lit(True)


def matches(text: Column, low: Column, pattern: str, expression: str) -> Column:
    """``text.rlike(expression)``, run only where the literals of ``pattern``, of which it is the JVM's form, occur; null for a null."""
    return F.when(may_match(low, pattern), text.rlike(expression)).when(text.isNotNull(), F.lit(False))
