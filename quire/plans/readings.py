"""Queries of paged documents, kept answers, streams and catalogue lists, each over a given table and with its SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import answers, catalogue, evaluate, model, rules, validate
from ..sources import paged, readers, sinks, writers
from ..streaming import packs
from ..tables import new_folder
from . import queries as q
from .queries import query
from .synth import quote, synth_pages, synth_sql

#: Pages of a bundled document, and pages that a task reads.
BUNDLE, A_TASK = 40, 25


@query(
    f"""WITH p AS (SELECT page_id // {BUNDLE} AS d, row_number() OVER (PARTITION BY page_id // {BUNDLE} ORDER BY page_id) AS page, coalesce(html,
  '') AS t, page_id % 101 = 7 AS big FROM pages WHERE page_id IS NOT NULL),
g AS (SELECT *, bool_or(big) OVER (PARTITION BY d) AS refused FROM p)
SELECT d::VARCHAR || '.zip' AS doc, page::BIGINT AS page, 'native' AS extraction, sha256(t) AS text_sha256 FROM g WHERE NOT refused
UNION ALL SELECT DISTINCT d::VARCHAR || '.zip', 1, 'failed', sha256('') FROM g WHERE refused"""
)
def s4_paged_documents(spark, sf_dir):
    """All web pages, bundled as documents of many pages and read by ranges; one page that is too large stops its document."""
    doc = F.floor(F.col("page_id") / BUNDLE).cast("string")
    place = F.row_number().over(Window.partitionBy(doc).orderBy("page_id"))
    rows = q._table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select(doc.alias("doc_id"), place.alias("page"), F.coalesce("html", F.lit("")).alias("text"), F.lit(595.0).alias("width"), F.when(F.col("page_id") % 101 == 7, 6000.0).otherwise(842.0).alias("height"))
    folder = new_folder(spark, "bundles")
    paged.write_archives(rows, folder).count()
    got = paged.read_paged(spark, f"{folder}/*.zip", paged.ArchivePages(), pages_a_task=A_TASK, strict=False)
    return got.select(F.regexp_extract("doc_id", r"([^/]+)\z", 1).alias("doc"), "page", "extraction", F.sha2("text", 256).alias("text_sha256"))


class _Stub:
    """A model that names the outcome at the place that the text's length gives."""

    model = "by-length"

    def ask(self, state: dict, questions: dict) -> dict:
        choice = tx.MODEL_OUTCOMES[len(state["text"]) % len(tx.MODEL_OUTCOMES)]
        return {"answers": {name: {"choice": choice, "confidence": 1.0, "probabilities": {choice: 1.0}} for name in questions}, "inputTokens": 1}


_CHOICE = f"{quote(tx.MODEL_OUTCOMES)}[(length(text) % {len(tx.MODEL_OUTCOMES)}) + 1]"


@query(
    f"""WITH {synth_sql()}, runs AS (SELECT 1 AS run, k, text FROM sp UNION ALL SELECT 2, k, CASE WHEN k % 5 = 0 THEN text || chr(10) || 'Amended'
  ELSE text END FROM sp),
first AS (SELECT text, min(run) AS run FROM runs GROUP BY 1), asked AS (SELECT run, count(*) AS asked FROM first GROUP BY 1)
SELECT run, {_CHOICE} AS choice, count(*) AS pages, any_value(coalesce(asked, 0)) AS asked FROM runs LEFT JOIN asked USING (run) GROUP BY 1, 2"""
)
def m8_answers_across_runs(spark, sf_dir):
    """Two runs over one table of answers: the second, over changed pages, asks only for texts that the first did not see."""
    table, k = answers.AnswerTable(spark, new_folder(spark, "kept_answers")), F.col("k")
    pages, known, out = synth_pages(spark, sf_dir), 0, None
    for run, text in ((1, F.col("text")), (2, F.when(k % 5 == 0, F.concat("text", F.lit("\nAmended"))).otherwise(F.col("text")))):
        states = pages.select(k.cast("string").alias("key"), F.to_json(F.struct(text.alias("text"))).alias("state"))
        got = model.ask_pages(states, _Stub(), table=table)
        held = table.read().count()
        counted = got.where("answered").groupBy("choice").agg(F.count(F.lit(1)).alias("pages")).select(F.lit(run).alias("run"), "choice", "pages", F.lit(held - known).cast("long").alias("asked"))
        known, out = held, counted if out is None else out.unionByName(counted)
    return out


@query(
    """WITH p AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN 1 ELSE turn + 1 END AS page FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT *, lag(page) OVER (PARTITION BY conv_id ORDER BY turn, page) AS before, count(*) OVER (PARTITION BY conv_id, page) AS same FROM p)
SELECT conv_id::VARCHAR AS doc_id, count(*) AS pages, CASE WHEN count(*) <= 500 THEN bool_and(page > coalesce(before, 0)) END AS increasing,
 CASE WHEN count(*) <= 500 THEN count(DISTINCT page) FILTER (same > 1) END AS repeated, count(*) <= 500 AND bool_and(page > coalesce(before,
  0)) AS valid FROM b GROUP BY 1"""
)
def v2_stream_verdicts(spark, sf_dir):
    """The packs of the conversations table as a stream of pages out of order, worked off in two runs; a page of a later day closes all."""
    turns = q._table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    page = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 1), 1).otherwise(F.col("turn") + 1)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(500)))
    rows = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("pos"), page.cast("long").alias("page"), at.alias("arrived"), (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2))).alias("run"))
    folder, out, state = (new_folder(spark, f"pack_{n}") for n in ("in", "out", "state"))
    schema = rows.drop("run").schema
    for run in (0, 1):
        rows.where(F.col("run") == run).drop("run").write.mode("append").parquet(folder)
        packs.run_available(spark, packs.pack_verdicts(spark.readStream.schema(schema).parquet(folder)), out, state)
    for later in (86_400, 2 * 86_400):
        spark.range(1).select(F.lit("later").alias("doc_id"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("page"), F.timestamp_seconds(F.lit(1_700_000_000 + later)).alias("arrived")).write.mode("append").parquet(folder)
        packs.run_available(spark, packs.pack_verdicts(spark.readStream.schema(schema).parquet(folder)), out, state)
    return spark.read.schema(packs.VERDICT).parquet(out).where("doc_id <> 'later'")


@query(
    """SELECT l_suppkey AS supplier, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.9) AS p90,
  min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1"""
)
def a14_exact_quantiles(spark, sf_dir):
    lines = q._table(spark, sf_dir, "lineitem")
    middle = evaluate.exact_quantiles(lines, "l_suppkey", "l_extendedprice", {"median": 0.5, "p90": 0.9}).withColumnRenamed("l_suppkey", "supplier")
    ends = lines.groupBy(F.col("l_suppkey").alias("s")).agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))
    return middle.join(ends, F.col("supplier").eqNullSafe(F.col("s"))).drop("s")


_ENTRY_ID = "'form-' || (1000 + o_custkey % 300) || ['', '-a', '-ez', '-schedule-b'][(o_orderkey % 4) + 1]"


@query(
    f"""WITH e AS (SELECT DISTINCT {_ENTRY_ID} AS id FROM orders), s AS (SELECT id, regexp_extract(id, '(\\d{{3,4}})', 1) AS stem, regexp_extract(id,
  {q._P}, 1) AS b, regexp_extract(id, {q._P}, 2) AS sc FROM e),
t AS (SELECT id, stem, CASE WHEN sc <> '' THEN 'Schedule ' || upper(sc) || ' (Form ' || upper(b) || ')' ELSE 'Form ' || upper(b) END AS label FROM s)
SELECT a.id, string_agg(c.label, '; ' ORDER BY c.id) AS not_for FROM t a JOIN t c ON a.stem = c.stem AND a.id <> c.id GROUP BY 1"""
)
def j5_siblings_of_orders(spark, sf_dir):
    suffix = F.get(F.array(*map(F.lit, ["", "-a", "-ez", "-schedule-b"])), (F.col("o_orderkey") % 4).cast("int"))
    entries = q._table(spark, sf_dir, "orders").select(F.concat(F.lit("form-"), (F.lit(1000) + F.col("o_custkey") % 300).cast("string"), suffix).alias("id")).distinct()
    return catalogue.sibling_labels(entries).select("id", F.array_join("not_for", "; ").alias("not_for"))


@query(
    """WITH n AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'form-rrb-1042-s' WHEN p_partkey % 11 = 0 THEN NULL
  ELSE 'form-' || (1000 + p_partkey % 700) || CASE WHEN p_partkey % 3 = 0 THEN '-schedule-a' ELSE '' END END AS id FROM part)
SELECT DISTINCT id FROM (SELECT id FROM n WHERE id IS NOT NULL AND id <> 'form-rrb-1042-s' UNION ALL VALUES """ + ", ".join(f"({quote(i)})" for i in catalogue.INFORMATION_RETURNS) + ") u(id)"
)
def u1_listed_ids(spark, sf_dir):
    p = F.col("p_partkey")
    listed = F.concat(F.lit("Form "), (1000 + p % 700).cast("string"), F.when(p % 3 == 0, " Schedule A").otherwise(""))
    names = q._table(spark, sf_dir, "part").select(F.when(p % 13 == 0, "Form RRB1042S").when(p % 11 == 0, "Another heading").otherwise(listed).alias("name"))
    return catalogue.all_ids(names)


#: Pages of a manifest file.
MANIFEST_PAGES = 250


@query(
    f"""WITH {q.RULES}, m AS (SELECT k // {MANIFEST_PAGES} AS d, *, k % {MANIFEST_PAGES} + 1 AS pg FROM r)
SELECT d::VARCHAR AS manifest, '{validate.MANIFEST_SCHEMA}' AS "schemaVersion", pg AS page, "documentType", reason, "textSha256" FROM m"""
)
def s9_manifest_files(spark, sf_dir):
    """Manifests written as a file a pack, and scanned again: every result comes back under its file."""
    k = F.col("k")
    pages = synth_pages(spark, sf_dir).withColumn("doc_id", F.floor(k / MANIFEST_PAGES).cast("string")).withColumn("page", k % MANIFEST_PAGES + 1)
    folder = new_folder(spark, "manifests")
    named = writers.manifest_json(rules.classify(pages)).select(F.concat("doc_id", F.lit(".json")).alias("name"), F.col("json").alias("body"))
    sinks.write_files(named, folder)
    scanned = readers.read_manifest(spark, f"{folder}/*.json").select(F.regexp_extract("file", r"([^/]*)\.json\z", 1).alias("manifest"), "schemaVersion", F.explode("results").alias("r"))
    return scanned.select("manifest", "schemaVersion", "r.page", "r.documentType", "r.reason", "r.textSha256")


def _workbook(names: list[str]) -> bytes:
    """A workbook whose first sheet lists names in its first column, as shared and as inline strings in turn, with a title and gaps."""
    shared, rows = [], ['<row><c t="inlineStr"><is><t>List of forms</t></is></c></row>', "<row/>"]
    for i, name in enumerate(names):
        if i % 2:
            rows.append(f'<row><c t="inlineStr"><is><r><t>{escape(name)}</t></r></is></c><c><v>7</v></c></row>')
        else:
            rows.append(f'<row><c t="s"><v>{len(shared)}</v></c></row>')
            shared.append(f"<si><t>{escape(name)}</t></si>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst>{''.join(shared)}</sst>")
    return out.getvalue()


@query("""SELECT 'Form ' || (1000 + p_partkey) || CASE WHEN p_partkey % 3 = 0 THEN ' Schedule A' ELSE '' END AS name FROM part WHERE p_partkey % 11 <> 0""")
def s10_workbooks(spark, sf_dir):
    """Form lists as workbooks of 200 names, read again; rows that name no form are left out."""
    p = F.col("p_partkey")
    name = F.when(p % 11 == 0, F.concat(F.lit("Other "), p.cast("string"))).otherwise(F.concat(F.lit("Form "), (1000 + p).cast("string"), F.when(p % 3 == 0, " Schedule A").otherwise("")))
    lists = q._table(spark, sf_dir, "part").select(F.floor(p / 200).alias("book"), name.alias("name"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{group['book'].iloc[0]}.xlsx"], "body": [_workbook(group["name"].tolist())]})

    folder = new_folder(spark, "workbooks")
    sinks.write_files(lists.groupBy("book").applyInPandas(run, "name string, body binary"), folder)
    return readers.read_form_names(spark, f"{folder}/*.xlsx")
