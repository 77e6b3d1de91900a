"""Pages derived from the orders table, the same in Spark and in SQL: one template per order key, filled with integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "\n".join(f"Line {i} of the schedule" for i in range(1, 36))

#: (truth, extraction, text, warnings, line confidences, engine)
TEMPLATES: list[tuple[str, str, str, list[str] | None, list[float] | None, str | None]] = [
    ("income-statement", "native", "INCOME STATEMENT\nEmployee {c}\nSalary {k}\nTax ready", None, None, None),
    ("payment-summary", "native", "PAYG Payment Summary\nRecipient {c}\nTax withheld {k}", None, None, None),
    ("bank-statement", "native", "Savings account statement\nAccount {c}\nOpening balance {k}\nClosing balance {c}", None, None, None),
    ("loan-statement", "native", "Home loan account statement\nPrincipal {k}\nInterest charged {c}", None, None, None),
    ("dividend-statement", "native", "Dividend payment advice\nHolder {c}\nFranking credit {k}", None, None, None),
    ("managed-fund-statement", "native", "AMMA statement\nInvestor {c}\nCapital gains {k}", None, None, None),
    ("share-trade-confirmation", "native", "Contract note\nBuy {k}\nBrokerage {c}", None, None, None),
    ("rental-statement", "native", "Rental property annual statement\nOwner {c}\nRental income {k}", None, None, None),
    ("depreciation-schedule", "native", "Depreciation report\nCapital works {k}\nProperty {c}", None, None, None),
    ("business-activity-statement", "native", "Business Activity Statement\nG1 {k}\n1A {c}\n1B 0", None, None, None),
    ("notice-of-assessment", "native", "Notice of amended assessment\nTaxable income {k}\nRefund {c}", None, None, None),
    ("tax-return", "native", "Individual tax return\nIncome {k}\nDeductions {c}", None, None, None),
    ("tax-invoice", "native", "TAX INVOICE\nNumber {k}\nGST {c}\nTotal {k}", None, None, None),
    ("receipt", "native", "Payment receipt\nPaid {k}\nCustomer {c}", None, None, None),
    ("private-health-statement", "native", "Private health insurance tax statement\nBenefit code {c}\nRebate {k}", None, None, None),
    ("unknown", "native", "Tax invoice", None, None, None),
    ("unknown", "native", "Dividend statement\nDividend statement\nNumber {k}", None, None, None),
    ("ambiguous", "native", "Tax invoice and receipt\nGST {c}\nTotal {k}\nPaid {k}", None, None, None),
    ("unknown", "native", "Hello {c}\nCould you please send me a copy of your tax invoice {k}?\nGST total", None, None, None),
    ("unknown", "native", "Instructions for completing the tax return\nIncome {k}\nDeductions {c}", None, None, None),
    ("unknown", "native", "Tax invoice template\nGST {c}\nTotal {k}", None, None, None),
    ("unknown", "native", "Re: Fwd: subject: bank statement request\nOpening balance {k}", None, None, None),
    ("unknown", "native", "Receipt\nNumber {k}\nNot yet paid", None, None, None),
    ("unknown", "native", "BAS\n1B {k}\n1A {c}\nG1 {k}", None, None, None),
    ("unknown", "native", "Tax invoice\nBalance {k}\nGST {c}", None, None, None),
    ("unreadable", "native", "  \n\t\n", None, None, None),
    ("unreadable", "needs_ocr", "Tax invoice\nGST {c}\nTotal {k}", None, None, None),
    ("unreadable", "failed", "", None, None, None),
    ("tax-invoice", "ocr", "Tax invoice\nGST {c}\nTotal {k}\nfooter", ["paddle_low_confidence_lines"], [0.99, 0.98, 0.97, 0.4], "paddleocr-3.7.0-pp-ocrv6-small"),
    ("unreadable", "ocr", "Tax invoice\nGST {c}\nTotal {k}\nfooter", ["paddle_low_confidence_lines"], [0.5, 0.98, 0.97, 0.9], "paddleocr-3.7.0-pp-ocrv6-small"),
    ("unreadable", "ocr", "Tax invoice\nGST {c}\nTotal {k}", ["scan_skewed"], [0.9, 0.98, 0.97], "paddleocr-3.7.0-pp-ocrv6-small"),
    ("unreadable", "ocr", "Tax invoice\nGST {c}\nTotal {k}", ["paddle_low_confidence_lines"], None, "pdf-inspector-pp-ocrv6-small"),
    ("unknown", "native", "Tax invoice\nGST {c}\nTotal {k}\n" + LATE + "\nPlease provide the payment summary", None, None, None),
    ("unknown", "native", LATE + "\nTax invoice\nGST {c}\nTotal {k}", None, None, None),
    ("tax-invoice", "ocr", "# Tax Invoice\n\nUnit {c}\nStreet {k}\nTotal {k}\nGST {c}", None, [0.9, 0.0, 0.9, 0.9, 0.9, 0.9], "paddleocr-3.7.0-pp-ocrv6-small"),
    ("unknown", "native", "Dear accountant\nthe loan statement shows principal {k}", None, None, None),
    ("unknown", "native", "W-2 Wage and Tax Statement {k}\nEmployer {c}", None, None, None),
]
K = len(TEMPLATES)


def synth_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text, extraction, warnings, ocr_engine, ocr_line_confidence, truth, k."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    strings = lambda at: F.array(*(F.lit(t[at]).cast("string") for t in TEMPLATES))

    def lists(at: int, kind: str) -> Column:
        return F.array(*(F.lit(None).cast(f"array<{kind}>") if t[at] is None else F.array(*map(F.lit, t[at])).cast(f"array<{kind}>") for t in TEMPLATES))

    pick = lambda a: F.get(a, (F.col("k") % K).cast("int"))
    text = F.replace(F.replace(pick(strings(2)), F.lit("{k}"), F.col("k").cast("string")), F.lit("{c}"), F.col("c").cast("string"))
    return orders.select(F.concat(F.lit("o"), F.col("k").cast("string")).alias("doc_id"), (F.col("k") % 7 + 1).alias("page"), text.alias("text"), pick(strings(1)).alias("extraction"), pick(lists(3, "string")).alias("warnings"), pick(strings(5)).alias("ocr_engine"), pick(lists(4, "double")).alias("ocr_line_confidence"), pick(strings(0)).alias("truth"), "k")


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(quote, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def synth_sql() -> str:
    """The same pages as common table expression ``sp``."""
    column = lambda at, cast="": "[" + ", ".join(quote(t[at]) + cast for t in TEMPLATES) + f"][(o_orderkey % {K}) + 1]"
    return f"""sp AS (SELECT 'o' || o_orderkey AS doc_id, (o_orderkey % 7 + 1)::BIGINT AS page,
      replace(replace({column(2)}, '{{k}}', o_orderkey::VARCHAR), '{{c}}', o_custkey::VARCHAR) AS text, {column(1)} AS extraction,
      {column(3, "::VARCHAR[]")} AS warnings, {column(5, "::VARCHAR")} AS ocr_engine, {column(4, "::DOUBLE[]")} AS ocr_line_confidence, {column(0)} AS truth, o_orderkey AS k
      FROM orders)"""
