"""Literals derived from patterns: sound on texts that match, and the index changes no outcome."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import literals, regexes
from quire.functions import taxonomy as tx
from quire.operators import rules

PATTERNS = [p for p, _ in regexes.context_patterns().values()] + list(tx.HEADINGS.values())


@pytest.mark.parametrize(
    ("pattern", "clauses"),
    [
        ("abc", [{"abc"}]), ("a(?:bx|cy)d", [{"bx", "cy"}, {"a"}]), ("(?:ab)?cd", [{"cd"}]), ("(?:ab)+", [{"ab"}]), ("(?:ab)*+x", [{"x"}]), ("[ab]c", [{"c"}]), (r"\bReceipt\b", [{"receipt"}]),
        (r"x\s+template\b|\btemplate\s+y", [{"template"}]), ("a|", []), ("", []), (".", []), ("abc|abd|xyz", [{"b", "xyz"}]),
    ],
)
def test_clauses(pattern, clauses):
    got = [set(c) for c in literals.required(pattern)]
    if pattern == "abc|abd|xyz":  # the shared start of branches counts too
        assert got and all(any(w in text for w in c) for text in ("abc", "abd", "xyz") for c in got)
    else:
        assert sorted(map(sorted, got)) == sorted(map(sorted, clauses))


def fragments(rng):
    words = sorted({w for p in PATTERNS for w in re.findall(r"[A-Za-z0-9-]+", re.sub(r"\\[a-z]|\(\?", " ", p))})
    glue = [" ", " ", " ", "  ", "\n", "\t", " ", "é", ".", "", "_", "\r\n", " ", "K"]
    return "".join(rng.choice([str.lower, str.upper, str.title, str])(rng.choice(words)) + rng.choice(glue) for _ in range(rng.randint(1, 14)))


def test_every_match_holds_its_literals():
    rng = random.Random(1)
    hits = 0
    for _ in range(6000):
        text = fragments(rng)
        for pattern in PATTERNS:
            if re.search(pattern, text, re.I | re.A):
                hits += 1
                assert all(any(w in text.lower() for w in clause) for clause in literals.required(pattern)), (pattern, text)
    assert hits > 300


def test_index_and_short_boundaries_change_no_match(spark):
    rng = random.Random(2)
    texts = [fragments(rng) for _ in range(1500)] + ["", "tax invoice", "xtax invoice", "tax invoice_", "étax invoice", "please  send me the receipt", "re: tax invoice request", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def plain(pattern, lines=False):
        out = pattern.replace(r"\b", regexes._EDGE).replace(r"\s", f"[{regexes.BLANK}]")
        if lines:
            out = out.replace("^", regexes._LINE_START, 1)
            out = out[:-1] + regexes._LINE_END if out.endswith("$") else out
        return F.col("t").rlike("(?i)" + out)

    want = {k: plain(p, lines) for k, (p, lines) in regexes.context_patterns().items()} | {t: plain(h) for t, h in tx.HEADINGS.items()}
    got = rules.context_matches(F.col("t")) | rules.heading_matches(F.col("t"))
    row = df.select(*(F.count_if(~want[k].eqNullSafe(got[k])).alias(k) for k in want), F.count_if(want["requesting"]).alias("hits")).first()
    assert all(row[k] == 0 for k in want) and row.hits > 3


def test_other_supports_keep_their_meaning(spark):
    texts = ["G1 x 1A", "G11A", "gst total", "GSTtotal", "not paid", "notpaid", "AMIT", "xAMIT", "rent", "rental income", "brent"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in [*tx.SUPPORT.values(), *tx.EXCLUDED.values()]:
        rows = df.select("t", F.col("t").rlike(regexes.jvm(pattern)).alias("m")).collect()
        assert [r.m for r in rows] == [bool(re.search(pattern, r.t, re.I | re.A)) for r in rows]
