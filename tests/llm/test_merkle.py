import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import merkle as mk

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, k string, pos int, d string"


def digest(data):
    return hashlib.sha256(data).hexdigest().encode()


def leaf(row):
    return digest(b"".join(b"-" if v is None else (lambda b: str(len(b)).encode() + b":" + b)(str(v).encode()) for v in row[:5]))


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(b"".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names, trees, out = sorted(by, key=lambda s: (s is not None, (s or "").encode())), {}, []
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]], fanout)
    top = tree([trees[s][-1][0] for s in names], fanout)
    for at, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = []
            for levels, j in ((trees[s], i), (top, at)):
                for nodes in levels[:-1]:
                    first = j // fanout * fanout
                    path.append((b"".join(nodes[first:j]), b"".join(nodes[j + 1 : first + fanout])))
                    j //= fanout
            node = leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                node = digest(a + node + b)
            out.append((r[0], leaf(r).decode(), trees[s][-1][0].decode(), top[-1][0].decode(), digest(b"".join(a + b for a, b in path)).decode(), node.decode(), node == top[-1][0]))
    return out


@pytest.mark.parametrize(("fanout", "levels", "n", "sources"), [(2, 2, 60, 5), (3, 1, 40, 20), (16, 3, 300, 3), (2, 1, 9, 1)])
def test_proofs_by_brute_force(spark, fanout, levels, n, sources):
    rng = random.Random(n)
    ids = lambda i: rng.choice([None, *range(n)]) if rng.random() < 0.3 else i
    rows = [(ids(i), rng.choice([None, "", "é", *(f"s{j}" for j in range(sources))]), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "ABC déf", "x" * 5000])) for i in range(n)]
    rows += rows[:3]
    docs = spark.createDataFrame([(*r, "k", 1, "d") for r in rows], SCHEMA)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    got = mk.merkle_proofs(docs, tamper={"text": F.when(hit, F.translate("text", mk.UPPER, mk.LOWER)).otherwise(F.col("text"))}, fanout=fanout, levels=levels)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, fanout)))


def test_documents_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute(mk.OP12_SQL)
    columns = [d[0] for d in want.description]
    got = mk.document_proofs(spark.read.parquet(f"{small}/documents.parquet"))
    rows = got.collect()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, want.fetchall()))
    assert any(not r.verified for r in rows) and any(r.verified for r in rows)


def test_empty_and_odd(spark, odd, empty):
    assert mk.document_proofs(empty).count() == 0
    assert mk.document_proofs(odd).count() == odd.count()
