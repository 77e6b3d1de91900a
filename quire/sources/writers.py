"""Sinks. Manifests and reports carry hashes and labels; page texts and file names are never selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import DECISIONS_SCHEMA, MANIFEST_SCHEMA

RESULT_COLUMNS = ["page", "taxonomyVersion", "documentType", "candidates", "method", "confidence", "requiresReview", "reason", "extraction", "ocrEngine", "warnings", "evidence", "textSha256", "calls", "inputTokens"]


def manifest_json(results: DataFrame, with_model: bool = False) -> DataFrame:
    """(doc_id, json): one review manifest a document, its pages in order; a pack has at most 500 pages."""
    named = results.withColumnRenamed("ocr_engine", "ocrEngine") if "ocrEngine" not in results.columns else results
    named = named.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    rows = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*RESULT_COLUMNS))).alias("results"))
    n = F.size("results")
    mode = "local-rules+model" if with_model else "local-rules"
    body = F.struct(F.lit(MANIFEST_SCHEMA).alias("schemaVersion"), F.lit(mode).alias("mode"), F.lit(True).alias("requiresReview"), F.struct(n.alias("pages"), n.alias("review"), F.lit(0).alias("automaticallyFiled")).alias("summary"), F.col("results"))
    return rows.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def template_json(template: DataFrame, manifest_sha256: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., json): a template to fill in, one for each manifest that ``by`` tells apart; a manifest has at most 500 pages."""
    rows = template.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page", "textSha256", "suggested", "decision"))).alias("decisions"))
    body = F.struct(
        F.lit(DECISIONS_SCHEMA).alias("schemaVersion"), F.lit(manifest_sha256).alias("manifestSha256"), F.lit("").alias("reviewer"),
        F.lit("").alias("reviewedAt"), F.col("decisions"),
    )
    return rows.select(*by, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing report is not replaced unless asked. Write before asserting gates, so failing runs keep evidence."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_ordered(df: DataFrame, path: str, *keys: str) -> None:
    """A catalogue in binary key order."""
    df.orderBy(*keys).write.mode("overwrite").json(path)
