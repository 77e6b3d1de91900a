"""Whole evaluation runs over labelled cases (dataset, id, label and a page's columns): the rules beside the keyword baseline, and
the model's policies beside the rules. Reports are written before gates are asserted, so a failing run keeps its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..sources.sinks import publish_all
from ..sources.writers import write_report
from ..tables import written, written_checked
from . import evaluate, model, rules, validate

EVALUATION = "au-evaluation-1"
METHODS = ("rules", "keywordBaseline")
POLICIES = ("compare", "uncertain")


def _as_pages(cases: DataFrame) -> DataFrame:
    return cases.withColumn("doc_id", F.col("id")).withColumn("page", F.lit(1).cast("long"))


def predictions(cases: DataFrame) -> DataFrame:
    """(method, dataset, id, truth, prediction): each case by the rules and by the baseline, classified once."""
    baseline = rules.keyword_baseline(F.col("text"), F.col("extraction"))
    found = rules.classify(_as_pages(cases)).select("dataset", "id", F.col("label").alias("truth"), F.col("documentType").alias("r"), baseline.alias("k"))
    both = F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("prediction")) for m, c in zip(METHODS, "rk", strict=True)))
    rows = written(found, "predictions").select("dataset", "id", "truth", F.explode(both).alias("p"))
    return rows.select("p.method", "dataset", "id", "truth", "p.prediction")


def evaluation(cases: DataFrame) -> dict[str, DataFrame]:
    """Totals, categories and errors by method and dataset, and the gates that the rules must pass. All counts are of one pass."""
    by, rows = ("method", "dataset"), predictions(cases)
    counted = written(evaluate.counts(rows, by=by), "counts")
    totals, categories = evaluate.totals_of(counted, by), evaluate.per_category_of(counted, by)
    seen = counted.where("NOT whole AND method = 'rules'").select("dataset", "category", "cases")
    return {"totals": totals, "categories": categories, "errors": evaluate.errors(rows), "gates": evaluate.gates(totals.where("method = 'rules'").drop("method"), seen)}


def run_evaluation(cases: DataFrame, folder: str, overwrite: bool = False) -> dict[str, DataFrame]:
    """Writes each part of the evaluation to ``folder``, which appears whole or not at all, and then refuses a run whose gates fail."""
    parts = evaluation(cases)
    named = {name: part.withColumn("schema", F.lit(EVALUATION)) for name, part in parts.items()}
    if overwrite:
        for name, part in named.items():
            write_report(part, f"{folder}/{name}", overwrite)
    else:
        publish_all(cases.sparkSession, named, folder)
    failed = sorted(r.dataset for r in parts["gates"].where("NOT passed").collect())
    if failed:
        raise validate.InvalidInput(f"Quality gate failed: {', '.join(failed)}")
    return parts


def policy_evaluation(cases: DataFrame, backend: model.Backend, gate: float = tx.GATE) -> dict[str, DataFrame]:
    """Policies over one shared answer a case: totals and transitions by policy and dataset, and the raw answers' metrics by dataset. A case
    is classified once and meets its answer in one join; all parts are read from one written table, a row a case and policy."""
    classified = rules.classify(_as_pages(cases)).withColumn("_by_rules", F.col("documentType"))
    outcomes, _, _ = model.under_policies(classified, backend, POLICIES, gate)
    rows = outcomes.select(
        "id", "dataset", F.col("label").alias("truth"), F.col("_by_rules").alias("rules"), F.col("documentType").alias("prediction"), "policy",
        "_sent", "answered", F.col("_valid").alias("valid"), "choice", F.col("answer_confidence").alias("confidence"), "truncated",
    )
    recorded = F.col("rules").isNotNull() & F.col("prediction").isNotNull()
    rows = written_checked(rows, "judged", {"A case has no recorded outcome.": recorded}, validate.InvalidInput)
    raw = rows.where(F.col("_sent") & (F.col("policy") == POLICIES[0]))
    return {
        "totals": evaluate.totals(rows, by=("policy", "dataset")),
        "transitions": evaluate.transitions(rows, F.col("truth"), F.col("rules"), F.col("prediction"), ("policy", "dataset")),
        "model": evaluate.model_metrics(raw, gate, by=("dataset",)),
        "outcomes": rows.select("id", "dataset", "truth", "rules", "prediction", "policy"),
    }
