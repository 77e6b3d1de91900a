"""Mixing sources to target weights.

Documents get hash-random keys. Within each source they are ordered by key, prefix sums of their sizes are taken, and the
source is cut at its exact budget: whole epochs first, then the documents before the cut, and of the one document on the cut
as many words as are left. The order is never made by one task: keys are uniform, so each source is dealt into ranges of
about ``range_rows`` documents; a range's rows are summed first, the range totals give each range its start, and only rows
of a range are sorted together.

Everything is DataFrame expressions. Cases: a null text has size 0; a null source is a source of its own and comes last; a
source without words has target 0; rows with the same id, size and source are alike and share the words in any order; an
empty table gives an empty result; other columns are ignored (:func:`mixture` keeps them). Targets are set over one row a
source in single-task windows, which is meant for up to some hundred thousand different sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RANGE_ROWS = 4096


def size_of(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: str, seed: str) -> Column:
    """52 uniform bits from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each row (source, source_size): ``share`` of all sizes by weight; what a source's limit leaves over is
    dealt to the others by weight until none is above. With limits sorted by limit / weight this is one pass: the first
    source whose share of the rest stays within its limit fixes the share of all after it."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    named = sources.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", turn.cast("long"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    everyone = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everyone) - F.lit(most) * F.coalesce(F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    leveled = named.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size")
    leveled = leveled.withColumn("level", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.lit(most) * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), F.lit(most) * F.col("source_size")))
    return leveled.select("source", "sid", "source_size", "n", target.alias("target"), F.floor(target + 0.5).cast("long").alias("budget"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), random_key(id_col, seed).alias("key"))


def _prefixed(rows: DataFrame, share: float, most: float, weights: tuple[int, ...], range_rows: int) -> tuple[DataFrame, DataFrame]:
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = cut(source_targets(sources, weights, share, most), "targets")
    t = targets.withColumnRenamed("source", "of")
    dealt = rows.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ranges = F.ceil(F.col("n") / range_rows)
    dealt = dealt.withColumn("range", F.shiftright(F.shiftright("key", 12) * ranges, 40))
    starts = dealt.groupBy("sid", "range").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(starts.select("sid", "range", before.alias("start")), "starts")
    within = Window.partitionBy("sid", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(starts, ["sid", "range"]).withColumn("before", F.col("start") + F.sum("size").over(within) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.withColumn("whole", whole).withColumn("rest", rest).withColumn("part", part), targets


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix:", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, size, source_size, target, taken) of every document; ``taken`` counts the words that the mix takes, with repeats."""
    rows = cut(_sized(docs, id_col, text_col, source_col, seed), "sized")
    placed, _ = _prefixed(rows, share, most, weights, range_rows)
    return placed.select(F.col("doc_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5, most: float = 2.0, seed: str = "mix:", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The documents that the mix takes, all columns, with ``copies`` (how often each is taken, in part or whole) and ``taken``
    (how many of its words, repeats counted): the document on the cut gives just the words that are left, so a source's words
    sum up to its budget. Rows that share that document's id are each cut there. Where ``docs`` has columns of these names they
    stay, and the new ones end in an underscore.

    The cut is one key a source, so the texts are not shuffled: each row is held against its source's key.
    """
    rows = cut(_sized(docs, id_col, text_col, source_col, seed), "sized")
    placed, targets = _prefixed(rows, share, most, weights, range_rows)
    last = placed.where((F.col("part") > 0) & (F.col("before") + F.col("size") >= F.col("rest")))
    last = last.groupBy("sid").agg(F.max(F.struct("key", "doc_id", "part")).alias("last"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    of, key, copies, taken = (unused(docs, c) for c in ("mixed_of", "mix_key", "copies", "taken"))
    cuts = targets.join(last, "sid", "left").select(F.struct(F.col("source").alias("of"), whole.alias("whole"), "last").alias(of))
    keyed = docs.withColumn(key, random_key(id_col, seed)).join(cut(cuts, "cuts"), F.col(source_col).eqNullSafe(F.col(f"{of}.of")))
    limit, size = F.col(f"{of}.last"), size_of(text_col)
    on_cut = (F.col(key) == limit["key"]) & F.col(id_col).eqNullSafe(limit["doc_id"])
    part = F.when(on_cut, F.least(limit["part"], size)).when(F.col(key) <= limit["key"], size).otherwise(F.lit(0))
    once = F.when(F.col(key) <= limit["key"], F.lit(1)).otherwise(F.lit(0))
    keyed = keyed.withColumn(copies, (F.col(f"{of}.whole") + once).cast("long"))
    keyed = keyed.withColumn(taken, (F.col(f"{of}.whole") * size + part).cast("long"))
    return keyed.where(F.col(copies) > 0).select(*docs.columns, copies, taken)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1 AS sid FROM s),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM n),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
        - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM w),
f AS (SELECT lev FROM l WHERE lev * weight <= 2.0::DOUBLE * source_size ORDER BY source_size / weight, sid LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT lev FROM f) * weight, 2.0::DOUBLE * source_size)) AS target FROM l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS bef
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - bef)))::BIGINT AS taken
FROM p
"""
