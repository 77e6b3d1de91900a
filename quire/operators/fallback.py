"""Second reading of pages that the first extraction could not read: select, read, merge whole documents or flag them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..tables import written
from .rules import PAGE_SCHEMA, classify, wants_fallback
from .validate import page_valid, require_batch


def select_pages(pages: DataFrame, *also: str) -> DataFrame:
    """(doc_id, page, also) of pages to read again; documents without any do not appear. The classification is written before its
    outcome is tested, as a test on a lazy one would copy the rules."""
    found = written(classify(pages).select("doc_id", "page", *also, "extraction", "documentType"), "classified")
    return found.where(wants_fallback()).select("doc_id", "page", *also)


def align_responses(jobs: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses meet their jobs by position: jobs (pos, doc_id), responses (pos, pages array); a missing response is null."""
    return jobs.join(responses, "pos", "left")


def merge(pages: DataFrame, selected: DataFrame, recovered: DataFrame) -> DataFrame:
    """Original pages with recovered ones in their place. A document whose recovered pages are not exactly the selected ones, each
    valid and once, keeps its pages, and the selected ones get a warning."""
    checked = recovered.withColumn("_ok", page_valid()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page")))
    got = checked.select("doc_id", "page", F.struct("text", "extraction", "warnings", "ocr_engine", "ocr_line_confidence").alias("_new"), (F.col("_ok") & (F.col("_n") == 1)).alias("_fine")).dropDuplicates(["doc_id", "page"])
    wanted = selected.select("doc_id", "page", F.lit(True).alias("_wanted"))
    both = wanted.join(got, ["doc_id", "page"], "full")
    verdict = both.groupBy("doc_id").agg(F.bool_and(F.coalesce("_wanted", F.lit(False)) & F.coalesce("_fine", F.lit(False))).alias("_good"))
    out = pages.join(wanted, ["doc_id", "page"], "left").join(verdict, "doc_id", "left").join(got.drop("_fine"), ["doc_id", "page"], "left")
    swap = F.coalesce("_wanted", F.lit(False)) & F.coalesce("_good", F.lit(False))
    failed = F.coalesce("_wanted", F.lit(False)) & ~F.coalesce("_good", F.lit(False))
    flagged = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(F.lit(tx.FALLBACK_FAILED)))
    fields = {c: F.when(swap, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("text", "extraction", "ocr_engine", "ocr_line_confidence")}
    fields["warnings"] = F.when(swap, F.col("_new.warnings")).when(failed, flagged).otherwise(F.col("warnings"))
    return out.select(*(fields[c].alias(c) if c in fields else F.col(c) for c in pages.columns))


def read_again(selected: DataFrame, reader: Callable[[str, list[int]], list[dict]]) -> DataFrame:
    """Runs ``reader(doc_id, pages)`` once a document, a document to a group; one that fails yields no page, which flags only itself."""
    columns = ["doc_id", "page", "text", "extraction", "warnings", "ocr_engine", "ocr_line_confidence"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        doc, pages = group["doc_id"].iloc[0], sorted(int(p) for p in group["page"])
        try:
            rows = [{**dict.fromkeys(columns), **r, "doc_id": doc} for r in reader(doc, pages)]
        except Exception:  # noqa: BLE001 - an error can echo the document
            rows = []
        return pd.DataFrame(rows, columns=columns)

    return selected.groupBy("doc_id").applyInPandas(run, PAGE_SCHEMA)


def retry(pages: DataFrame, reader: Callable[[str, list[int]], list[dict]], check_batch: bool = False) -> DataFrame:
    """Select, read and merge. Nothing is started where no page is selected. The classification and the pages that were read again
    are written once, so a document is classified and read once, whatever reads the result.

    ``check_batch`` holds the documents to the limits of one interactive batch (:func:`validate.require_batch`)."""
    selected = select_pages(pages)
    if selected.isEmpty():
        return pages
    if check_batch:
        require_batch(selected.select(F.col("doc_id").alias("file")).distinct(), selected)
    return merge(pages, selected, written(read_again(selected, reader), "read_again"))
