import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm.mixing import OP1_SQL, mix_sources, mixture, source_targets


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect())


def test_matches_sql(spark, documents, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = sorted(tuple(str(v) for v in r) for r in con.execute(f"select doc_id, size, source_size, target, taken from ({OP1_SQL})").fetchall())
    assert rows(mix_sources(documents)) == want
    assert rows(mix_sources(documents, range_rows=3)) == want


def test_takes_come_to_their_targets(documents):
    got = mix_sources(documents).join(documents.select("doc_id", "source"), "doc_id")
    bad = got.where((F.col("taken") < 0) | (F.col("taken") > 2 * F.col("size")))
    assert bad.count() == 0
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 1


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The rule as stated: deal by weight, stop at the limit, deal the excess again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while left > 1e-9 and open_:
        total = sum(w[i] for i in open_)
        for i in list(open_):
            target[i] += left * w[i] / total
        left = 0.0
        for i in list(open_):
            if target[i] >= most * sizes[i]:
                left += target[i] - most * sizes[i]
                target[i] = most * sizes[i]
                open_.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1000, 5, 7], [100], [0, 0], [0, 9, 3, 400, 2, 8, 1]])
def test_targets_match_repeated_dealing(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    got = source_targets(spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes, strict=True)], "source string, source_size long, n long")).orderBy("sid").collect()
    assert [r.target for r in got] == pytest.approx(brute_targets(sizes))


def test_odd_rows(odd, empty):
    got = mix_sources(odd)
    assert got.count() == odd.count() and got.where("taken > 2 * size OR taken < 0").count() == 0
    assert mix_sources(empty).count() == 0 and mixture(empty).count() == 0
    assert set(mixture(odd).columns) == {*odd.columns, "copies", "taken"}


def test_mixture_takes_the_same_documents(documents):
    copies = {r.doc_id: r.copies for r in mixture(documents).collect()}
    for r in mix_sources(documents).where("size > 0").collect():
        assert copies.get(r.doc_id, 0) == -(-r.taken // r.size)
