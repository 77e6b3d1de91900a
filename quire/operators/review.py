"""Review: decision templates, and decisions measured against a manifest. Joined by page and text hash; texts never appear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from .evaluate import categories, per_category
from .rules import is_named
from .validate import SHA256, InvalidInput

SUMMARY_SCHEMA = "au-review-summary-1"


def decision_template(results: DataFrame, manifest_sha256: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One undecided row a result, with the suggestion beside it; ``by`` names columns that tell manifests apart."""
    import re

    if not re.match(SHA256.replace(r"\z", r"\Z"), manifest_sha256):
        raise InvalidInput("manifestSha256 must be the hex SHA-256 of the manifest file.")
    return results.select(*by, "page", "textSha256", F.col("documentType").alias("suggested"), F.lit(None).cast("string").alias("decision"))


def joined(results: DataFrame, decisions: DataFrame, manifest_sha256: str, decisions_sha256: str) -> DataFrame:
    """Every decision with its result. Decisions for another manifest, page or text refuse the whole input."""
    if manifest_sha256 != decisions_sha256:
        raise InvalidInput("These decisions belong to a different manifest.")
    mine = results.select("page", F.col("textSha256").alias("_sha"), F.col("documentType").alias("suggested"), "method", "confidence", "reason")
    rows = decisions.select("page", "textSha256", "decision").join(mine, "page", "left")
    first = rows.where("_sha IS NULL OR _sha <> textSha256").select("page", F.col("_sha").isNull().alias("lost")).first()
    if first:
        raise InvalidInput(f"Decision for page {first.page} has no page in the manifest." if first.lost else f"Decision for page {first.page} was made on different text.")
    return rows.drop("_sha")


def reviewed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("decision").isNotNull())


def review_counts(results: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of counts over the decided rows; pages without a decision count as not reviewed."""
    s, d = F.col("suggested"), F.col("decision")
    counts = reviewed(rows).agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(d == s).alias("accepted"),
        F.count_if(is_named(s) & ~is_named(d)).alias("falseSuggestions"),
        F.count_if(is_named(s) & is_named(d) & (d != s)).alias("changedCategory"),
        F.count_if(s.isin("unknown", "ambiguous") & is_named(d)).alias("missedByPipeline"),
        F.count_if((s == "unreadable") & is_named(d)).alias("unreadableButNamed"),
    )
    pages = results.agg(F.count(F.lit(1)).alias("pages"))
    return pages.crossJoin(counts).select("pages", "reviewed", (F.col("pages") - F.col("reviewed")).alias("notReviewed"), "accepted", "falseSuggestions", "changedCategory", "missedByPipeline", "unreadableButNamed")


def by_method(rows: DataFrame) -> DataFrame:
    counted = reviewed(rows).groupBy("method").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("decision") == F.col("suggested")).alias("accepted"))
    every = categories(rows.sparkSession, tx.METHODS).withColumnRenamed("category", "method")
    return every.join(counted, "method", "left").na.fill(0, ["pages", "accepted"]).select("method", "pages", "accepted")


def by_category(rows: DataFrame) -> DataFrame:
    found = per_category(reviewed(rows), "decision", "suggested", names=tx.TYPES)
    return found.select("category", F.col("proposed").alias("suggested"), F.col("cases").alias("decided"), "correct", "precision", "recall")


def labels(rows: DataFrame) -> DataFrame:
    return reviewed(rows).select("page", "textSha256", "suggested", "method", "confidence", "reason", "decision")


def summarise(results: DataFrame, decisions: DataFrame, manifest_sha256: str, decisions_sha256: str, reviewer: str | None = None, reviewed_at: str | None = None) -> dict[str, DataFrame | object]:
    """The whole summary: fixed fields, and tables counts, methods, categories and labels."""
    rows = joined(results, decisions, manifest_sha256, decisions_sha256)
    return {
        "schema": SUMMARY_SCHEMA, "manifestSha256": manifest_sha256, "taxonomyVersion": tx.TAXONOMY_VERSION, "reviewer": reviewer or None, "reviewedAt": reviewed_at or None, "suggestionsVisible": True,
        "counts": review_counts(results, rows), "methods": by_method(rows), "categories": by_category(rows), "labels": labels(rows),
    }
