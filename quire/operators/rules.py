"""The rule classifier: a narrow projection over pages, with no shuffle.

A page table has doc_id, page, text, extraction, warnings, ocr_engine and ocr_line_confidence. The conditions of all rules
are unrolled into constant patterns, headings first, so a page's text is rewritten and searched only for the rules whose
heading occurs. Patterns with look-around and wide alternations stand behind the literals that any match must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..functions import text as tf
from ..functions.literals import matches
from ..functions.regexes import context_patterns, jvm

PAGE_SCHEMA = "doc_id STRING, page BIGINT, text STRING, extraction STRING, warnings ARRAY<STRING>, ocr_engine STRING, ocr_line_confidence ARRAY<DOUBLE>"
_EXTRA: list[tuple[str, str, object]] = []


def register_rule(name: str, heading: str, support) -> None:
    """Add a rule after the built-in ones: a heading pattern, and a pattern or a function of the text column for its support."""
    _EXTRA.append((name, heading, support))


def clear_registered_rules() -> None:
    _EXTRA.clear()


def has_low_line(confidence: Column) -> Column:
    return F.coalesce(F.exists(confidence, lambda c: c < tx.RELIABLE), F.lit(False))


def usable_text(pages: DataFrame, out: str = "clean") -> DataFrame:
    """Adds the text without unreliable lines, normalised."""
    return tf.normalise(pages.withColumn(out, tf.mask_lines(F.col("text"), F.col("ocr_line_confidence"))), out)


def needs_extraction(clean: Column) -> Column:
    """The page could not be read well enough for rules."""
    warned = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: (w != tx.LOW_LINES) | F.col("ocr_line_confidence").isNull())
    return F.col("extraction").isin("needs_ocr", "failed") | tf.is_blank(clean) | warned


def context_matches(clean: Column, low: Column | None = None) -> dict[str, Column]:
    """Each context pattern, searched only where its literals occur; ``low`` is the text in lower case, if there is a column of it."""
    low = F.lower(clean) if low is None else low
    return {k: matches(clean, low, p, jvm(p, lines)) for k, (p, lines) in context_patterns().items()}


def heading_matches(window: Column, low: Column | None = None) -> dict[str, Column]:
    """Each type's heading, searched only where its rarest words occur."""
    low = F.lower(window) if low is None else low
    return {t: matches(window, low, h, jvm(h)) for t, h in [*tx.HEADINGS.items(), *((t, h) for t, h, _ in _EXTRA)]}


def without_heading(clean: Column, type_: str) -> Column:
    """The text with every occurrence of the type's own heading blanked: a repeated title supports nothing."""
    heading = tx.HEADINGS.get(type_) or next(h for t, h, _ in _EXTRA if t == type_)
    return F.regexp_replace(clean, jvm(heading), " ")


def in_order(text: Column, pairs: list[tuple[str, list[str]]]) -> Column:
    """Some pair's second token occurs after its first: the text after the first occurrence of the first holds the second."""
    found = F.lit(False)
    for first, seconds in pairs:
        rest = F.get(F.split(text, jvm(rf"\b{first}\b"), 2), F.lit(1))
        found = found | F.coalesce(rest.rlike(jvm(rf"\b(?:{'|'.join(seconds)})\b")), F.lit(False))
    return found


def support(text: Column, type_: str) -> Column:
    for name, _, extra in _EXTRA:
        if name == type_:
            return extra(text) if callable(extra) else text.rlike(jvm(extra))
    if type_ in tx.IN_ORDER:
        return in_order(text, tx.IN_ORDER[type_])
    wanted = text.rlike(jvm(tx.SUPPORT[type_]))
    return ~text.rlike(jvm(tx.EXCLUDED[type_])) & wanted if type_ in tx.EXCLUDED else wanted


def classify(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` and the rules' result: documentType, candidates, method, confidence, requiresReview, reason,
    evidence, textSha256, taxonomyVersion, calls and inputTokens."""
    read = usable_text(pages, "_clean").withColumn("_low", F.lower("_clean"))
    clean = F.col("_clean")
    asked = F.lit(False)
    for match in context_matches(clean, F.col("_low")).values():
        asked = asked | match
    read = read.withColumn("_gate", F.when(needs_extraction(clean), "extraction").when(asked, "context").otherwise("rules"))
    read = read.withColumn("_window", F.when(F.col("_gate") == "rules", tf.heading_window(clean))).withColumn("_low", F.lower("_window"))
    headed = heading_matches(F.col("_window"), F.col("_low"))
    hits = [F.when(h & support(without_heading(clean, t), t), F.lit(t)) for t, h in headed.items()]
    read = read.withColumn("candidates", F.when(F.col("_gate") == "rules", F.filter(F.array(*hits), lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>")))
    n, low = F.size("candidates"), has_low_line(F.col("ocr_line_confidence"))
    gate = F.col("_gate")
    kind = (
        F.when(gate == "extraction", F.struct(F.lit("unreadable").alias("t"), F.lit("extraction").alias("m"), F.lit("extraction_requires_review").alias("r")))
        .when(gate == "context", F.struct(F.lit("unknown").alias("t"), F.lit("rules").alias("m"), F.lit("context_only_or_instructions").alias("r")))
        .when(n > 1, F.struct(F.lit("ambiguous").alias("t"), F.lit("rules").alias("m"), F.lit("conflicting_category_evidence").alias("r")))
        .when(n == 1, F.struct(F.get("candidates", F.lit(0)).alias("t"), F.lit("rules").alias("m"), F.lit("rule_suggestion").alias("r")))
        .when(low, F.struct(F.lit("unreadable").alias("t"), F.lit("extraction").alias("m"), F.lit("insufficient_reliable_ocr_evidence").alias("r")))
        .otherwise(F.struct(F.lit("unknown").alias("t"), F.lit("rules").alias("m"), F.lit("no_rule_match").alias("r")))
    )
    read = read.withColumn("_kind", kind)
    return read.select(
        *pages.columns,
        F.lit(tx.TAXONOMY_VERSION).alias("taxonomyVersion"),
        F.col("_kind.t").alias("documentType"),
        "candidates",
        F.col("_kind.m").alias("method"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(True).alias("requiresReview"),
        F.col("_kind.r").alias("reason"),
        F.transform("candidates", lambda t: F.concat(F.lit("heading_and_support:"), t)).alias("evidence"),
        tf.text_sha256(F.col("text")).alias("textSha256"),
        F.lit(0).cast("long").alias("calls"),
        F.lit(0).cast("long").alias("inputTokens"),
    )


def keyword_baseline(text: Column, extraction: Column) -> Column:
    """The first type, in catalogue order, whose name in plain words occurs anywhere."""
    low = F.lower(text)
    named = F.coalesce(*(F.when(F.contains(low, F.lit(tx.keyword(t))), F.lit(t)) for t in tx.TYPES), F.lit("unknown"))
    return F.when(tf.is_blank(text) | extraction.isin("needs_ocr", "failed"), F.lit("unreadable")).otherwise(named)


def is_named(outcome: Column) -> Column:
    return F.coalesce(outcome.isin(*tx.TYPES), F.lit(False))


def wants_fallback() -> Column:
    """Of a classified page: it should be read again by the second engine."""
    return F.col("extraction").isin("needs_ocr", "failed") | ((F.col("extraction") == "ocr") & F.col("documentType").isin("unknown", "unreadable"))
