"""Evaluation: per-category and total metrics, policy transitions, gates. One pass each over predictions, then tiny tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from .quantiles import exact_quantiles
from .rules import is_named
from .validate import InvalidInput


def categories(spark, names=tx.OUTCOMES) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, category string")


def per_category(rows: DataFrame, truth: str = "truth", prediction: str = "prediction", by: tuple[str, ...] = (), names=tx.OUTCOMES) -> DataFrame:
    """(by..., category, cases, proposed, correct, recall, precision) of every category, zero-filled; null where undefined.

    Each row counts once under its truth and once under its prediction, so one aggregation does both sides.
    """
    sides = rows.select(*by, F.explode(F.array(F.struct(F.col(truth).alias("category"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(prediction)).cast("int").alias("c")), F.struct(F.col(prediction).alias("category"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("c")))).alias("s"))
    counted = sides.groupBy(*by, "s.category").agg(F.sum("s.t").alias("cases"), F.sum("s.p").alias("proposed"), F.sum("s.c").alias("correct"))
    every = F.broadcast(categories(rows.sparkSession, names))
    if by:
        every = rows.select(*by).distinct().crossJoin(every)
    filled = every.join(counted, [*by, "category"], "left").na.fill(0, ["cases", "proposed", "correct"])
    return filled.select(*by, "category", "cases", "proposed", "correct", F.try_divide("correct", "cases").alias("recall"), F.try_divide("correct", "proposed").alias("precision"))


def totals(rows: DataFrame, truth: str = "truth", prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates; rates of no rows are null."""
    right, named = F.col(truth) == F.col(prediction), is_named(F.col(prediction))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(right).alias("correct"), F.count_if(is_named(F.col(truth))).alias("knownCases"), F.count_if(named).alias("suggestions"), F.count_if(named & right).alias("rightSuggestions"))
    return out.select(*by, "cases", "correct", F.try_divide("correct", "cases").alias("accuracy"), "knownCases", "suggestions", F.try_divide("suggestions", "cases").alias("suggestionCoverage"), F.try_divide("rightSuggestions", "suggestions").alias("suggestionPrecision"))


def counts(rows: DataFrame, truth: str = "truth", prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """All counts of an evaluation from one pass: a row for each (by..., category) and, with ``whole`` set, one for each (by...).

    A row counts once under its truth and once under its prediction; grouping sets sum both by category and over all."""
    right = (F.col(truth) == F.col(prediction)).cast("int")
    truths = F.struct(F.col(truth).alias("category"), F.lit(1).alias("t"), F.lit(0).alias("p"), right.alias("c"))
    guesses = F.struct(F.col(prediction).alias("category"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("c"))
    sides = rows.select(*by, F.explode(F.array(truths, guesses)).alias("s")).select(*by, "s.*")
    keys = [F.col(c) for c in by]
    named = lambda c: F.sum(F.when(is_named(F.col("category")), F.col(c)).otherwise(0))
    return sides.groupingSets([[*keys, F.col("category")], keys], *keys, F.col("category")).agg(
        (F.grouping("category") == 1).alias("whole"), F.sum("t").alias("cases"), F.sum("p").alias("proposed"), F.coalesce(F.sum("c"), F.lit(0)).alias("correct"),
        named("t").alias("knownCases"), named("p").alias("suggestions"), F.coalesce(named("c"), F.lit(0)).alias("rightSuggestions"),
    )


def totals_of(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`totals`, from :func:`counts`."""
    return counted.where("whole").select(
        *by, "cases", "correct", F.try_divide("correct", "cases").alias("accuracy"), "knownCases", "suggestions", F.try_divide("suggestions", "cases").alias("suggestionCoverage"),
        F.try_divide("rightSuggestions", "suggestions").alias("suggestionPrecision"),
    )


def per_category_of(counted: DataFrame, by: tuple[str, ...] = (), names=tx.OUTCOMES) -> DataFrame:
    """As :func:`per_category`, from :func:`counts`; every category of every group, zero-filled from the list of names."""
    every = counted.where("whole").select(*by, F.explode(F.array(*map(F.lit, names))).alias("category"))
    filled = every.join(counted.where("NOT whole").select(*by, "category", "cases", "proposed", "correct"), [*by, "category"], "left").na.fill(0, ["cases", "proposed", "correct"])
    return filled.select(*by, "category", "cases", "proposed", "correct", F.try_divide("correct", "cases").alias("recall"), F.try_divide("correct", "proposed").alias("precision"))


def errors(rows: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    return rows.where(F.col(truth) != F.col(prediction))


def transitions(cases: DataFrame, truth: Column, rules: Column, policy: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """How a policy changed the rules' outcomes, judged by truth."""
    return cases.groupBy(*by).agg(
        F.count_if(policy == rules).alias("retained"),
        F.count_if((rules != truth) & (policy == truth)).alias("recovered"),
        F.count_if((rules == truth) & (policy != truth)).alias("degraded"),
        F.count_if(~is_named(truth) & is_named(policy)).alias("falseSuggestions"),
    )


def join_policies(cases: DataFrame, rules: DataFrame, policy: DataFrame) -> DataFrame:
    """cases (id, truth) with each one's outcome by rules and by policy; a missing outcome is an error."""
    both = cases.join(rules.select("id", F.col("outcome").alias("rules")), "id", "left").join(policy.select("id", F.col("outcome").alias("policy")), "id", "left")
    if not both.where("rules IS NULL OR policy IS NULL").isEmpty():
        raise InvalidInput("A case has no recorded outcome.")
    return both


def gates(scores: DataFrame, categories_seen: DataFrame) -> DataFrame:
    """(dataset, minimum, cases, correct, missing, passed) for each evaluation set that must pass.

    ``scores`` has (dataset, cases, correct), ``categories_seen`` (dataset, category, cases).
    """
    spark = scores.sparkSession
    need = spark.createDataFrame([(d, n, d in tx.GATE_COMPLETE) for d, n in tx.GATE_CASES.items()], "dataset string, minimum int, complete boolean")
    wanted = need.where("complete").select("dataset").crossJoin(categories(spark, tx.TYPES).select("category"))
    missing = wanted.join(categories_seen.where("cases > 0"), ["dataset", "category"], "left_anti").groupBy("dataset").agg(F.count(F.lit(1)).alias("missing"))
    out = need.join(scores, "dataset", "left").join(missing, "dataset", "left")
    return out.select("dataset", "minimum", "cases", "correct", F.coalesce("missing", F.lit(0)).alias("missing"), (F.coalesce((F.col("cases") >= F.col("minimum")) & (F.col("correct") == F.col("cases")), F.lit(False)) & (F.coalesce("missing", F.lit(0)) == 0)).alias("passed"))


def assert_gates(scores: DataFrame, categories_seen: DataFrame) -> None:
    failed = [r.dataset for r in gates(scores, categories_seen).where("NOT passed").collect()]
    if failed:
        raise InvalidInput(f"Quality gate failed: {', '.join(sorted(failed))}")


def model_metrics(sent: DataFrame, gate: float = tx.GATE, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of raw answers: rows (id, truth, answered, valid, choice, confidence, truncated), one for each page sent."""
    ok = F.col("answered") & F.col("valid")
    right, wrong = ok & (F.col("choice") == F.col("truth")), ok & (F.col("choice") != F.col("truth"))

    def mean(which: Column) -> Column:
        return F.round(F.avg(F.when(which, F.col("confidence"))), 3)

    return sent.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pagesSent"), F.count_if(~F.col("answered")).alias("failed"), F.count_if(F.col("answered") & ~F.col("valid")).alias("invalid"), F.count_if(ok).alias("valid"),
        F.count_if(right).alias("correct"), F.round(F.try_divide(F.count_if(right), F.count_if(ok)), 3).alias("accuracy"), F.count_if(right & (F.col("confidence") >= gate)).alias("correctAtGate"),
        F.count_if(wrong & (F.col("confidence") >= gate)).alias("wrongAtGate"), mean(right).alias("meanConfidenceCorrect"), mean(wrong).alias("meanConfidenceWrong"), F.count_if(ok & F.col("truncated")).alias("truncated"),
    )


def median_ms(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Median, least and most of each group; no group is held in one buffer."""
    ends = samples.groupBy(by).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    middle = exact_quantiles(samples, by, value, {"median": 0.5}).withColumnRenamed(by, "_by")
    return ends.join(middle, ends[by].eqNullSafe(middle["_by"])).select(by, "median", "least", "most")
