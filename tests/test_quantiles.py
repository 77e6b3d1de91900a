"""Exact quantiles against percentile, over ties, hot groups and odd values."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate, quantiles


def rows(spark):
    rng = random.Random(4)
    out = [("hot", rng.gauss(0, 1) ** 3) for _ in range(20_000)] + [("ties", float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(5000)]
    out += [("one", 3.5), ("two", 1.0), ("two", 4.0), ("same", 2.0), ("same", 2.0), ("none", None), (None, 1.0), (None, 5.0), (None, None), ("inf", float("inf")), ("inf", -1.0), ("inf", float("-inf"))]
    out += [("skew", 10.0 ** rng.randrange(-200, 200)) for _ in range(3000)]
    return spark.createDataFrame(out, "kind string, v double")


@pytest.mark.parametrize("held", [1, 50, 100_000])
def test_as_percentile(spark, held):
    df = rows(spark).cache()
    wanted = {"q0": 0.0, "q1": 0.013, "mid": 0.5, "q3": 0.97, "q4": 1.0}
    got = {r.kind: r for r in quantiles.exact_quantiles(df, "kind", "v", wanted, held=held).collect()}
    want = {r.kind: r for r in df.groupBy("kind").agg(*(F.percentile("v", q).alias(n) for n, q in wanted.items())).collect()}
    assert set(got) == set(want)
    for kind in want:
        if kind == "inf":  # percentile interpolates infinities to NaN or infinity, as this does
            assert (got[kind].q0, got[kind].mid, got[kind].q4) == (float("-inf"), -1.0, float("inf"))
            continue
        for name in wanted:
            assert got[kind][name] == want[kind][name], (kind, name)


def test_median_of_samples(spark):
    df = rows(spark)
    got = {r.kind: r for r in evaluate.median_ms(df, "kind", "v").collect()}
    assert got["two"].median == 2.5 and (got["two"].least, got["two"].most) == (1.0, 4.0) and got["none"].median is None and got[None].median == 3.0
    assert evaluate.median_ms(df.limit(0), "kind", "v").count() == 0


def test_no_buffer_holds_a_group(spark):
    """The plan has no percentile aggregate; sketches are bounded by their accuracy."""
    df = rows(spark)
    state = quantiles._narrow(df.select(F.struct(F.col("kind").alias("k")).alias("g"), "v"), spark.createDataFrame([(("hot",), 5, 5, None, None)], "g struct<k: string>, rank long, within long, low double, high double"))
    plan = state._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan and "collect_" not in plan
