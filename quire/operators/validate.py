"""Validators as boolean columns, with two ways to use them: split the input, or refuse it whole."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..functions import text as tf

SAFE = 2**53 - 1
# Formats of identifiers and dates, and limits on pages that are rendered.
SHA256 = r"\A[a-f0-9]{64}\z"
REASON = r"\A[a-z_]{1,64}\z"
ISO_DATE = r"\A\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)?(Z|[+-]\d{2}:\d{2}))?\z"
MANIFEST_SCHEMA = "au-review-1"
DECISIONS_SCHEMA = "au-review-decisions-1"
MAX_PIXELS, MAX_SIDE = 20_000_000, 10_000
MAX_BATCH = 50


class InvalidInput(ValueError):
    """The whole input is refused. The message names no content."""


def split(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows); a null verdict rejects."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def require(df: DataFrame, valid: Column, message: str) -> DataFrame:
    """``df`` itself, after one pass that stops at the first row that is not valid."""
    if not df.where(~F.coalesce(valid, F.lit(False))).isEmpty():
        raise InvalidInput(message)
    return df


def is_page_number(page: Column) -> Column:
    return F.coalesce(page.between(1, SAFE), F.lit(False))


def page_valid() -> Column:
    """A page record: number, bounded text, known extraction and engine, warnings without nulls, line confidences that fit."""
    conf, text = F.col("ocr_line_confidence"), F.col("text")
    conf_ok = (F.col("extraction") == "ocr") & (F.size(conf) == F.size(F.split(text, "\n"))) & F.forall(conf, lambda c: c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0))
    return (
        is_page_number(F.col("page"))
        & F.coalesce(tf.utf16_length(text) <= tx.PAGE_CHARS, F.lit(False))
        & F.coalesce(F.col("extraction").isin(*tx.EXTRACTIONS), F.lit(False))
        & F.coalesce(F.forall("warnings", lambda w: w.isNotNull()), F.lit(True))
        & (conf.isNull() | F.coalesce(conf_ok, F.lit(False)))
        & F.coalesce(F.col("ocr_engine").isin(*tx.ENGINES), F.col("ocr_engine").isNull())
    )


def pack_report(pages: DataFrame, doc: str = "doc_id", pos: str = "pos", page: str = "page") -> DataFrame:
    """(doc, pages, increasing, valid): 1 to 500 pages whose numbers rise strictly in input order."""
    before = F.lag(page).over(Window.partitionBy(doc).orderBy(pos))
    rises = pages.select(doc, F.col(page).alias("p"), before.alias("b"))
    report = rises.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.bool_and(F.coalesce((F.col("p") > F.coalesce("b", F.lit(0))), F.lit(False))).alias("increasing"))
    return report.withColumn("valid", F.col("increasing") & F.col("pages").between(1, tx.MAX_PAGES))


def result_valid() -> Column:
    """A result of a review manifest."""
    return (
        is_page_number(F.col("page"))
        & F.coalesce(F.col("textSha256").rlike(SHA256), F.lit(False))
        & F.coalesce(F.col("documentType").isin(*tx.OUTCOMES), F.lit(False))
        & F.coalesce(F.col("method").isin(*tx.METHODS), F.lit(False))
        & F.coalesce(F.col("reason").rlike(REASON), F.lit(False))
        & F.coalesce(F.col("taxonomyVersion") == tx.TAXONOMY_VERSION, F.lit(False))
    )


def is_iso_date(value: Column) -> Column:
    """A date or date-time in ISO form that exists."""
    day = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")
    hour, minute, second = (F.coalesce(F.try_to_number(F.nullif(F.substring(value, at, 2), F.lit("")), F.lit("99")).cast("int"), F.lit(0)) for at in (12, 15, 18))
    timed = ~F.contains(value, F.lit("T")) | ((hour <= 23) & (minute <= 59))
    return value.rlike(ISO_DATE) & day.isNotNull() & timed & F.when(value.rlike(r"\A.{16}:"), second <= 59).otherwise(True)


def decisions_header_valid() -> Column:
    reviewer, at = F.col("reviewer"), F.col("reviewedAt")
    return (
        F.coalesce(F.col("schemaVersion") == DECISIONS_SCHEMA, F.lit(False))
        & F.coalesce(F.col("manifestSha256").rlike(SHA256), F.lit(False))
        & (reviewer.isNull() | ((tf.utf16_length(reviewer) <= 64) & ~reviewer.rlike(rf"[@{tf.BLANK}]")))
        & (at.isNull() | (at == "") | is_iso_date(at))
    )


def decision_valid() -> Column:
    decided, suggested = F.col("decision"), F.col("suggested")
    return is_page_number(F.col("page")) & F.coalesce(F.col("textSha256").rlike(SHA256), F.lit(False)) & F.coalesce(decided.isin(*tx.OUTCOMES), decided.isNull()) & F.coalesce(suggested.isin(*tx.OUTCOMES), suggested.isNull())


def decisions_report(decisions: DataFrame, by: str = "file") -> DataFrame:
    """(by, decisions, faulty, repeated, valid): each file has 1 to 500 sound decisions, one a page."""
    pages = decisions.groupBy(by, "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(~decision_valid()).alias("bad"))
    report = pages.groupBy(by).agg(F.sum("n").alias("decisions"), F.sum("bad").alias("faulty"), F.count_if(F.col("n") > 1).alias("repeated"))
    return report.withColumn("valid", F.col("decisions").between(1, tx.MAX_PAGES) & (F.col("faulty") == 0) & (F.col("repeated") == 0))


def batch_report(selected: DataFrame, by: str = "batch", file: str = "file") -> DataFrame:
    """(by, documents, pages, valid) from rows (by, file, page) of pages to be read again: 1 to 50 PDF files and at most 500 pages."""
    files = selected.groupBy(by, file).agg(F.count(F.lit(1)).alias("n"))
    report = files.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("pages"), F.bool_and(F.lower(file).endswith(".pdf")).alias("_pdf"))
    valid = F.coalesce("_pdf", F.lit(False)) & F.col("documents").between(1, MAX_BATCH) & (F.col("pages") <= tx.MAX_PAGES)
    return report.select(by, "documents", "pages", valid.alias("valid"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_manifest(results: DataFrame, schema_version: str) -> DataFrame:
    n = results.limit(tx.MAX_PAGES + 1).count()
    if schema_version != MANIFEST_SCHEMA or not 1 <= n <= tx.MAX_PAGES:
        raise InvalidInput(f"Supply a review manifest of schema {MANIFEST_SCHEMA}.")
    require(results, result_valid(), "Manifest results need a page, textSha256, documentType, method, a reason identifier and the current taxonomy.")
    if not duplicates(results, "page").isEmpty():
        raise InvalidInput("Manifest pages must be unique.")
    return results


def require_decisions(header: DataFrame, decisions: DataFrame) -> DataFrame:
    require(header, decisions_header_valid(), "Supply a decisions file with its schema, manifestSha256, a pseudonym without spaces or @, and an ISO 8601 date or nothing.")
    if not 1 <= decisions.limit(tx.MAX_PAGES + 1).count() <= tx.MAX_PAGES:
        raise InvalidInput("Supply 1 to 500 decisions.")
    require(decisions, decision_valid(), "Each decision needs a page, its textSha256 and an outcome or null.")
    if not duplicates(decisions, "page").isEmpty():
        raise InvalidInput("Decision pages must be unique.")
    return decisions


def answer_valid(choice: Column, confidence: Column, probabilities: Column) -> Column:
    """A model's answer: exactly the 17 outcomes, probabilities that sum to 1, and a choice that is among the most probable."""
    outcomes = F.array(*map(F.lit, tx.MODEL_OUTCOMES))
    keys, values = F.map_keys(probabilities), F.map_values(probabilities)
    same = (F.size(keys) == len(tx.MODEL_OUTCOMES)) & (F.size(F.array_except(keys, outcomes)) == 0) & (F.size(F.array_except(outcomes, keys)) == 0)
    bounded = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    own = F.try_element_at(probabilities, choice)
    ok = choice.isin(*tx.MODEL_OUTCOMES) & ~F.isnan(confidence) & confidence.between(0.0, 1.0) & same & bounded & (F.abs(total - 1) < 0.001) & (own >= F.array_max(values)) & (F.abs(confidence - own) < 0.001)
    return F.coalesce(ok, F.lit(False))


def render_fits(width: Column, height: Column, scale: Column) -> Column:
    """The page can be drawn within the side and pixel limits."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    w, h = F.ceil(width * scale), F.ceil(height * scale)
    return F.coalesce(finite(width) & finite(height) & finite(scale) & (F.greatest(w, h) <= MAX_SIDE) & (w * h <= MAX_PIXELS), F.lit(False))


def geometry_report(pages: DataFrame) -> DataFrame:
    """(file, pages, valid) from rows (file, bytes, page, width, height, scale): all pages of a file must fit before any is drawn."""
    rows = pages.withColumn("fits", render_fits(F.col("width"), F.col("height"), F.col("scale")) & (F.col("page") >= 1))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("pages"), F.bool_and((F.col("bytes") <= tx.MAX_FILE_BYTES) & F.col("fits")).alias("fits"), F.count_distinct("page").alias("d")).select("file", "pages", (F.col("fits") & (F.col("pages") == F.col("d")) & F.col("pages").between(1, tx.MAX_PAGES)).alias("valid"))


def require_batch(documents: DataFrame, selected: DataFrame) -> None:
    """Limits of one fallback batch: 1 to 50 PDF files and at most 500 selected pages."""
    if not 1 <= documents.limit(MAX_BATCH + 1).count() <= MAX_BATCH:
        raise InvalidInput("Supply between 1 and 50 documents.")
    require(documents, F.lower("file").endswith(".pdf"), "The fallback reads PDF only.")
    if selected.limit(tx.MAX_PAGES + 1).count() > tx.MAX_PAGES:
        raise InvalidInput("Retry at most 500 pages a batch.")


def check_options(gate: float = tx.GATE, policy: str = "compare", retries: int = 4, timeout_s: float = 90.0) -> None:
    if not 0 < gate <= 1:
        raise InvalidInput("gate must be greater than zero and at most one")
    if policy not in ("compare", "uncertain"):
        raise InvalidInput("Invalid model policy")
    if not isinstance(retries, int) or isinstance(retries, bool) or retries < 1 or not 0 < timeout_s < float("inf"):
        raise InvalidInput("retries and timeout must be positive")


def local_origin(url: str = "http://127.0.0.1:8000") -> str:
    """The origin of a server on this machine; any other is refused."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or parts.hostname not in ("localhost", "127.0.0.1", "::1"):
        raise InvalidInput("The model server must run on this machine: use a loopback URL.")
    host = f"[{parts.hostname}]" if ":" in parts.hostname else parts.hostname
    return f"{parts.scheme}://{host}" + (f":{parts.port}" if parts.port else "")
