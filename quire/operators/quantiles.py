"""Exact quantiles of large groups by distributed selection.

``median`` and ``percentile`` hold a group's different values in one buffer. Here a group is never gathered: each round sketches the
values that may still hold a wanted rank on a grid of ``GRID`` cells, takes the two grid values that the rank should lie between, and
counts exactly how many values are below the first, equal to either, and between. So a rank either is one of the two values or lies in
one open interval, which holds about a ``GRID``-th of the values before. Intervals of at most ``HELD`` different values are sorted. The
sketch only steers: counts are exact, so a wrong guess costs a round and never a result.

Every round is two passes with partial aggregation over the rows of groups that are not settled, which meet their few open ranks in
a join (a broadcast where Spark finds the ranks small, else a shuffle that splits hot groups). The driver holds a count a round.

Cases: null and NaN values are left out; a group without values has null quantiles; a null group is a group; ranks between two
values are interpolated as ``percentile`` does; ties, one value only and infinities are fine; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

GRID, HELD, ROUNDS = 256, 10_000, 60


def _between(v: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (v > low)) & (high.isNull() | (v < high))


def _open_rows(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """The values of each open rank's interval: (g, rank, within, low, high, v)."""
    return rows.join(ranks, "g").where(_between(F.col("v"), F.col("low"), F.col("high")))


def _narrow(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """One round: (g, rank, within, low, high, held, value), where ``value`` is set if the rank is settled, else the interval is
    smaller, ``within`` is the rank inside it and ``held`` the number of its values."""
    inside = _open_rows(rows, ranks)
    grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], 20 * GRID)
    sketched = inside.groupBy("g", "rank", "within", "low", "high").agg(grid.alias("grid"), F.count(F.lit(1)).alias("n"))
    spot = F.greatest(F.lit(1), F.least(F.lit(GRID), F.ceil(F.col("within") / F.greatest(F.lit(1), F.col("n") - 1) * GRID).cast("int")))
    # one cell more to either side, as the sketch may be off by part of a cell
    a, b = F.get("grid", F.greatest(F.lit(0), spot - 2)), F.get("grid", F.least(F.lit(GRID), spot + 1))
    cut = written(sketched.select("g", "rank", "within", "low", "high", "n", a.alias("a"), b.alias("b")), "cells")
    v = F.col("v")
    less = F.count_if(v < F.col("a"))
    counted = _open_rows(rows, cut).groupBy("g", "rank", "within", "low", "high", "a", "b", "n").agg(
        less.alias("l"), F.count_if(v == F.col("a")).alias("ea"), F.count_if((v > F.col("a")) & (v < F.col("b"))).alias("m"), F.count_if((v == F.col("b")) & (F.col("b") > F.col("a"))).alias("eb")
    )
    k, l, ea, m, eb = (F.col(c) for c in ("within", "l", "ea", "m", "eb"))  # noqa: E741
    upto_a, upto_m, upto_b = l + ea, l + ea + m, l + ea + m + eb
    value = F.when((k >= l) & (k < upto_a), F.col("a")).when((k >= upto_m) & (k < upto_b), F.col("b"))
    parts = (
        F.when(k < l, F.struct(F.col("low").alias("low"), F.col("a").alias("high"), k.alias("within"), l.alias("held")))
        .when(k < upto_m, F.struct(F.col("a").alias("low"), F.col("b").alias("high"), (k - upto_a).alias("within"), m.alias("held")))
        .otherwise(F.struct(F.col("b").alias("low"), F.col("high").alias("high"), (k - upto_b).alias("within"), (F.col("n") - upto_b).alias("held")))
    )
    return counted.select("g", "rank", value.alias("value"), parts.alias("p")).select("g", "rank", "p.within", "p.low", "p.high", "p.held", "value")


def _sorted(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, rank, value) of ranks whose intervals are small."""
    values = _open_rows(rows, ranks).groupBy("g", "rank", "within", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("upto", upto).where((F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("c"))).select("g", "rank", F.col("v").alias("value"))


def order_statistics(rows: DataFrame, ranks: DataFrame, held: int = HELD) -> DataFrame:
    """(g, rank, value): the values at the places ``rank`` (from 0, by size) of each group, for rows (g, v) and ranks (g, rank) that exist."""
    none = F.lit(None).cast("double")
    left = written(ranks.select("g", "rank", F.col("rank").alias("within"), none.alias("low"), none.alias("high"), F.lit(2**62).alias("held")), "ranks")
    found: list[DataFrame] = []
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        state = written(_narrow(rows, left.drop("held")), "narrowed")
        found.append(state.where("value IS NOT NULL").select("g", "rank", "value"))
        open_ = state.where("value IS NULL")
        found.append(_sorted(rows, open_.where(F.col("held") <= held).drop("held", "value")))
        left = open_.where(F.col("held") > held).drop("value")
    else:
        raise RuntimeError("selection did not settle")
    out = left.select("g", "rank", F.col("low").alias("value")).limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def exact_quantiles(samples: DataFrame, by: str, value: str, quantiles: dict[str, float], held: int = HELD) -> DataFrame:
    """``by`` and one column for each named quantile (0 to 1), as ``percentile`` gives it."""
    v = F.col(value).cast("double")
    rows = samples.select(F.struct(F.col(by).alias("k")).alias("g"), v.alias("v"))
    groups = written(rows.groupBy("g").agg(F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("n")), "groups")
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v"))
    spots = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(q))).alias("at")) for name, q in quantiles.items()))
    wanted = groups.where("n > 0").select("g", F.explode(spots).alias("w")).select("g", "w.name", "w.at", F.floor("w.at").alias("lower"), F.ceil("w.at").alias("upper"))
    ranks = wanted.select("g", F.explode(F.array("lower", "upper")).alias("rank")).distinct()
    got = written(order_statistics(rows, ranks, held), "values")
    pairs = wanted.join(got.select("g", F.col("rank").alias("lower"), F.col("value").alias("low")), ["g", "lower"]).join(got.select("g", F.col("rank").alias("upper"), F.col("value").alias("high")), ["g", "upper"])
    mixed = F.when((F.col("lower") == F.col("upper")) | (F.col("low") == F.col("high")), F.col("low")).otherwise((F.col("upper") - F.col("at")) * F.col("low") + (F.col("at") - F.col("lower")) * F.col("high"))
    per = pairs.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, mixed)).alias(name) for name in quantiles))
    return groups.select("g").join(per, "g", "left").select(F.col("g.k").alias(by), *quantiles)
