import random

import duckdb
import pytest

from quire.llm import sessions as ss

SCHEMA = "key string, at long, batch long, value long, n int, k string, kind string"


def brute(events, gap):
    """Snapshot after snapshot, from the definition."""
    out = []
    for k in sorted({e[0] for e in events}):
        mine, standing = [e for e in events if e[0] == k], {}
        for now in sorted({e[2] for e in mine}):
            sessions = []
            for e in sorted((e for e in mine if e[2] <= now), key=lambda e: e[1]):
                if sessions and e[1] - sessions[-1][-1][1] <= gap:
                    sessions[-1].append(e)
                else:
                    sessions.append([e])
            for s in sessions:
                if not (new := sum(e[2] == now for e in s)):
                    continue
                a, z = s[0][1], s[-1][1]
                inside = [v for v in standing.values() if v["start"] >= a and v["end"] <= z]
                version = {"key": k, "batch": now, "start": a, "end": z, "n_events": len(s), "n_new": new, "n_retracted": len(inside), "value_sum": sum(e[3] or 0 for e in s), "retracted_batch": None, "retracted_start": None}
                for old in inside:
                    old["retracted_batch"], old["retracted_start"] = now, a
                    del standing[(old["batch"], old["start"])]
                standing[(now, a)] = version
                out.append(version)
    return out


def compare(spark, events, gap, bucket):
    got = ss.session_versions(spark.createDataFrame([(*e, 1, "x", "n") for e in events], SCHEMA), gap, bucket=bucket)
    want = brute([e for e in events if None not in e[:3]], gap)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(v[c] for c in got.columns)) for v in want)


@pytest.mark.parametrize(("seed", "n", "span", "late", "gap", "bucket"), [(1, 150, 100, 4, 5, 40), (2, 400, 600, 9, 20, 1), (3, 400, 600, 3, 60, 500), (4, 60, 30, 12, 0, 10)])
def test_versions_by_brute_force(spark, seed, n, span, late, gap, bucket):
    rng = random.Random(seed)
    events = [(rng.choice("abc"), (t := rng.randrange(-span, span)), t // 50 + rng.randrange(late), rng.choice([None, rng.randrange(-9, 99)])) for _ in range(n)]
    compare(spark, events, gap, bucket)


def test_one_key_with_a_long_unbroken_session(spark):
    rng = random.Random(7)
    events = [("hot", 3 * i, i // 40 + rng.choice([0, 0, 0, 1, 2]), i) for i in range(1500)] + [("cold", 5, 0, 1), ("cold", 9, 3, 1)]
    compare(spark, events, 10, 60)


def test_nulls_ties_repeats_and_a_late_bridge(spark):
    events = [("a", 0, 0, 1), ("a", 0, 0, 1), ("a", 0, 5, None), ("a", 20, 0, 1), ("a", 10, 7, 4), ("b", 1, 1, 1), (None, 1, 1, 1), ("a", None, 1, 1), ("a", 1, None, 1), ("c", -5, 2, 1), ("c", -15, 2, 1)]
    compare(spark, events, 10, 8)


def test_empty(spark):
    assert ss.session_versions(spark.createDataFrame([], SCHEMA), 10).count() == 0


def test_conversations_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    want = con.execute(ss.OP13_SQL)
    columns = [d[0] for d in want.description]
    got = ss.conversation_sessions(spark.read.parquet(f"{small}/conversations.parquet"))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_turns_without_number_or_conversation_are_no_events(spark):
    rows = [(1, 0, "user", "x"), (1, None, "user", "x"), (None, 0, "user", None), (1, 0, "user", "x")]
    got = ss.conversation_sessions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.n_events, r.n_new, r.n_retracted, r.retracted_batch) for r in got] == [(2, 2, 0, None)]
