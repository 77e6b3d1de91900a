"""Queries of files, runs and reports, each with its SQL: what is written and read back, models asked, cases evaluated."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import taxonomy as tx
from ..functions import text as tf
from ..operators import catalogue, evaluate, fallback, forms, model, review, rules, runs, validate
from ..sources import readers, sinks, writers
from ..tables import new_folder
from . import queries as q
from .queries import query
from .synth import quote, synth_pages, synth_sql

PACK = 100


def _packs(spark, sf_dir):
    """The derived pages in packs of PACK order keys."""
    k = F.col("k")
    return synth_pages(spark, sf_dir).withColumn("doc_id", F.floor(k / PACK).cast("string")).withColumn("page", k % PACK + 1)


def _cases(spark, sf_dir):
    """The derived pages as labelled cases of the four sets, their texts made unique."""
    k = F.col("k")
    name = F.get(F.array(*map(F.lit, q._SETS)), (k % 4).cast("int"))
    named = F.concat("text", F.lit("\nCase "), k.cast("string"))
    return synth_pages(spark, sf_dir).select(
        name.alias("dataset"), F.concat(F.lit("c"), k.cast("string")).alias("id"), F.concat(F.lit("g"), k.cast("string")).alias("group"), F.col("truth").alias("label"),
        F.when(F.size("ocr_line_confidence") > 0, F.col("text")).otherwise(named).alias("text"), "extraction", "warnings", "ocr_engine", "ocr_line_confidence", "k",
    )


CASE_TEXT = "CASE WHEN len(ocr_line_confidence) > 0 THEN text ELSE text || chr(10) || 'Case ' || k END"
CASE_RULES = q.RULES.replace(f"{synth_sql()}, ", f"{synth_sql().replace('sp AS', 'sp0 AS', 1)}, sp AS (SELECT * REPLACE ({CASE_TEXT} AS text) FROM sp0), ", 1)
SET = f"{quote(q._SETS)}[(k % 4) + 1]"

# --- sources: written as files, one a document, and read back


@query(
    """WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, count(*) OVER (PARTITION BY conv_id) AS of
  FROM conversations WHERE text IS NOT NULL)
SELECT conv_id::VARCHAR AS conv, n AS page, CASE WHEN n = of THEN text || chr(10) ELSE text END AS text, 'native' AS extraction FROM t"""
)
def s1_read_text_files(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    folder = new_folder(spark, "texts")
    body = F.concat(F.array_join("t.text", "\f"), F.lit("\n"))
    sinks.write_files(turns.select(F.concat(F.col("conv_id").cast("string"), F.lit(".txt")).alias("name"), body.alias("body")), folder)
    pages = readers.read_pages(spark, f"{folder}/*.txt")
    return pages.select(F.regexp_extract("doc_id", r"([^/]*)\.txt\z", 1).alias("conv"), "page", "text", "extraction")


@query(
    f"""WITH {synth_sql()} SELECT (k // {PACK})::VARCHAR AS doc, k % {PACK} + 1 AS page, text, extraction, array_to_string(warnings, ',') AS warnings,
  ocr_engine, len(ocr_line_confidence)::INTEGER AS lines FROM sp"""
)
def s3_read_json_files(spark, sf_dir):
    page = F.struct("page", "text", "extraction", "warnings", F.col("ocr_engine").alias("ocrEngine"), F.col("ocr_line_confidence").alias("ocrLineConfidence"))
    packs = _packs(spark, sf_dir).groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(page))).alias("text"))
    folder = new_folder(spark, "packs")
    sinks.write_files(packs.select(F.concat("doc_id", F.lit(".json")).alias("name"), F.col("text").alias("body")), folder)
    pages = readers.read_json_pages(spark, f"{folder}/*.json")
    confidence = F.when(F.col("ocr_line_confidence").isNotNull(), F.size("ocr_line_confidence"))
    return pages.select(F.regexp_extract("doc_id", r"([^/]*)\.json\z", 1).alias("doc"), "page", "text", "extraction", F.array_join("warnings", ",").alias("warnings"), "ocr_engine", confidence.alias("lines"))


@query(f"""WITH {synth_sql()} SELECT {SET} AS dataset, 'c' || k AS id, 'g' || k AS "group", truth AS label, text || chr(10) || 'Case ' || k AS text,
  extraction FROM sp""")
def s8_corpus(spark, sf_dir):
    text = F.when(F.size("ocr_line_confidence") > 0, F.concat("text", F.lit("\nCase "), F.col("k").cast("string"))).otherwise(F.col("text"))
    cases = _cases(spark, sf_dir).withColumn("text", text).withColumn("part", F.floor(F.col("k") / 5000))
    folder = new_folder(spark, "corpus")
    for name in q._SETS:
        case = F.struct("id", "group", "label", "text", "extraction")
        arrays = cases.where(F.col("dataset") == name).groupBy("part").agg(F.to_json(F.collect_list(case)).alias("text"))
        arrays.write.partitionBy("part").text(f"{folder}/{name}.json")
    return readers.read_corpus(spark, folder, q._SETS, {}).select("dataset", "id", "group", "label", "text", "extraction")


# --- sinks

_RESULT = """struct_pack(page := page, "taxonomyVersion" := 'au-1', "documentType" := "documentType", candidates := candidates, method := method, confidence := NULL::DOUBLE, "requiresReview" := true,
 reason := reason, extraction := extraction, "ocrEngine" := ocr_engine, warnings := coalesce(warnings, []), evidence := list_transform(candidates,
  lambda c: 'heading_and_support:' || c),
 "textSha256" := "textSha256", calls := 0, "inputTokens" := 0)"""
q.SQL["k1_manifest_json"] = f"""WITH {q.RULES}, g AS (SELECT doc_id, count(*) AS n, list({_RESULT} ORDER BY page) AS results FROM r GROUP BY 1)
SELECT doc_id, to_json(struct_pack("schemaVersion" := '{validate.MANIFEST_SCHEMA}', mode := 'local-rules', "requiresReview" := true,
  summary := struct_pack(pages := n, review := n, "automaticallyFiled" := 0), results := results))::VARCHAR AS json FROM g"""


@query(
    f"""WITH {q.RULES}, g AS (SELECT (k // {PACK})::VARCHAR AS doc_id, list(struct_pack(page := k % {PACK} + 1, "textSha256" := "textSha256",
  suggested := "documentType", decision := NULL::VARCHAR) ORDER BY k) AS decisions FROM r GROUP BY 1)
SELECT doc_id, to_json(struct_pack("schemaVersion" := '{validate.DECISIONS_SCHEMA}', "manifestSha256" := '{"0" * 64}', reviewer := '',
  "reviewedAt" := '', decisions := decisions))::VARCHAR AS json FROM g"""
)
def k2_template_json(spark, sf_dir):
    template = review.decision_template(rules.classify(_packs(spark, sf_dir)), "0" * 64, ("doc_id",))
    return writers.template_json(template, "0" * 64, ("doc_id",))


# --- validators of whole files

_OUT = quote([*tx.OUTCOMES, "other"])


def _decisions(spark, sf_dir):
    k = F.col("l_orderkey")
    said = F.get(F.array(*map(F.lit, [*tx.OUTCOMES, "other"])), (k % (len(tx.OUTCOMES) + 1)).cast("int"))
    sha = F.sha2(k.cast("string"), 256)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        k.alias("file"), F.col("l_linenumber").alias("line"), F.when(k % 5 == 0, 1).when(k % 9 == 0, F.col("l_linenumber") - 1).otherwise(F.col("l_linenumber")).alias("page"),
        F.when(k % 7 == 0, F.upper(sha)).otherwise(sha).alias("textSha256"), F.when(k % 3 == 0, F.lit(None)).otherwise(said).alias("decision"), F.lit("unknown").alias("suggested"),
    )


_DECISIONS = f"""d AS (SELECT l_orderkey AS file, l_linenumber AS line, CASE WHEN l_orderkey % 5 = 0 THEN 1 WHEN l_orderkey % 9 = 0
  THEN l_linenumber - 1 ELSE l_linenumber END AS page,
 l_orderkey % 7 <> 0 OR NOT regexp_matches(sha256(l_orderkey::VARCHAR), '[a-f]') AS hex, l_orderkey % 3 = 0
  OR {_OUT}[(l_orderkey % {len(tx.OUTCOMES) + 1}) + 1] <> 'other' AS known FROM lineitem),
v AS (SELECT *, page >= 1 AND hex AND known AS ok FROM d)"""


@query(f"WITH {_DECISIONS} SELECT file, line, ok AS valid FROM v")
def v4_decision_rows(spark, sf_dir):
    return _decisions(spark, sf_dir).select("file", "line", validate.decision_valid().alias("valid"))


@query(f"""WITH {_DECISIONS}, p AS (SELECT file, page, count(*) AS n, count_if(NOT ok) AS bad FROM v GROUP BY ALL)
SELECT file, sum(n)::BIGINT AS decisions, sum(bad)::BIGINT AS faulty, count_if(n > 1) AS repeated, sum(n) BETWEEN 1 AND 500 AND sum(bad) = 0
  AND max(n) = 1 AS valid FROM p GROUP BY 1""")
def v4_decision_files(spark, sf_dir):
    return validate.decisions_report(_decisions(spark, sf_dir))


@query("""WITH g AS (SELECT p_brand AS file, p_size * 1000000 AS bytes, p_partkey AS page, p_size * 100.5 AS w, p_retailprice AS h FROM part)
SELECT file || '-' || p AS file, count(*) AS pages, bool_and(page >= 1 AND bytes <= 50 * 1024 * 1024 AND ceil(w * 2) <= 10000 AND ceil(h * 2) <= 10000
  AND ceil(w * 2) * ceil(h * 2) <= 20000000) AND count(*) = count(DISTINCT page) AND count(*) <= 500 AS valid
FROM (SELECT *, page % 40 AS p FROM g) GROUP BY 1""")
def v6_geometry_veto(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    file = F.concat_ws("-", "p_brand", (F.col("p_partkey") % 40).cast("string"))
    pages = part.select(file.alias("file"), (F.col("p_size") * 1000000).alias("bytes"), F.col("p_partkey").alias("page"), (F.col("p_size") * 100.5).alias("width"), F.col("p_retailprice").alias("height"), F.lit(2.0).alias("scale"))
    return validate.geometry_report(pages)


@query("""WITH s AS (SELECT o_custkey AS batch, 'f' || (o_orderkey % 60) || CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 2 = 0 THEN '.txt'
  ELSE '.PDF' END AS file FROM orders)
SELECT batch, count(DISTINCT file) AS documents, count(*) AS pages, bool_and(file LIKE '%.PDF') AND count(DISTINCT file) <= 50
  AND count(*) <= 500 AS valid FROM s GROUP BY 1""")
def v9_batches(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    end = F.when((customer % 4 == 0) & (key % 2 == 0), ".txt").otherwise(".PDF")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return validate.batch_report(orders.select(customer.alias("batch"), F.concat(F.lit("f"), (key % 60).cast("string"), end).alias("file"), key.alias("page")))


# --- the catalogue

_TITLE = f"substr(trim(regexp_replace(regexp_replace(array_to_string(lines[1:8], ' '), {quote(catalogue.TITLE_NOISE)}, ' ', 'g'), '\\s+', ' ', 'g')), 1, 80)"


def _titled(spark, sf_dir):
    noise = F.when(F.col("doc_id") % 3 == 0, "Form 1040 OMB No. 1545-0074 VOID\n").otherwise("Department of the Treasury 2024\nAttach to Form 1040. ")
    return q._documents(spark, sf_dir).select((F.col("doc_id") % 50).alias("id"), F.col("doc_id").alias("page"), tf.lines_of(F.concat(noise, F.coalesce("text", F.lit("")))).alias("lines"))


_TITLED = f"""n AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN 'Form 1040 OMB No. 1545-0074 VOID' || chr(10)
  ELSE 'Department of the Treasury 2024' || chr(10) || 'Attach to Form 1040. ' END) || coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id % 50 AS id, doc_id AS page, {q._LINES} AS lines FROM n), t AS (SELECT *, {_TITLE} AS title, length(trim(array_to_string(lines,
  ' '))) < 60 OR contains(lower(array_to_string(lines, ' ')), 'left blank') AS blank FROM l)"""


@query(f"WITH {_TITLED} SELECT page, title FROM t")
def t11_titles(spark, sf_dir):
    return _titled(spark, sf_dir).select("page", catalogue.title_of(F.col("lines")).alias("title"))


@query(f"WITH {_TITLED} SELECT id, arg_min(title, page) AS title FROM t WHERE NOT blank AND title <> '' AND NOT starts_with(lines[1], 'Attention') GROUP BY 1")
def o7_first_titles(spark, sf_dir):
    return catalogue.first_titles(_titled(spark, sf_dir))


_URLS = ["form-1099-misc", "form-1099-b", "form-8845", "form-1040", "form-5498-esa", "form-w-2", "form-1120-s-schedule-k-1"]
_FILED = ["f1099msc.pdf", "", "", "f1040.pdf", "f5498e.pdf", "fw2.pdf", "f1120ssk.pdf"]
_MOVED = [None, "irs-pdf/f1099b--2025.pdf", "irs-prior/f8845--2022.pdf", None, None, None, None]


@query(f"""WITH i AS ({q._pick_sql(_URLS, "id")}) SELECT n, id, 'https://www.irs.gov/pub/' || coalesce({quote(_MOVED)}[(n % 7) + 1],
  'irs-pdf/' || {quote(_FILED)}[(n % 7) + 1]) AS url FROM i""")
def j8_file_urls(spark, sf_dir):
    return q._picked(spark, sf_dir, _URLS, "id").select("n", "id", catalogue.file_url(F.col("id")).alias("url"))


@query("""SELECT count(*) AS forms, count(*) FILTER (o_custkey % 2 = 0) AS with_boxes, count(*) FILTER (o_orderkey % 3 = 0) AS schedules,
  sum(o_custkey % 9)::BIGINT AS pages, sum(o_custkey % 4)::BIGINT AS blank_pages FROM orders""")
def a11_counters(spark, sf_dir):
    orders, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_custkey")
    criteria = orders.select(F.when(c % 2 == 0, F.array(F.lit("1 Wages"))).alias("boxes"), F.when(F.col("o_orderkey") % 3 == 0, "form-1040").alias("parent"))
    return catalogue.counters(criteria, orders.select((c % 9).alias("pages"), F.array_repeat(F.lit(1), (c % 4).cast("int")).alias("blankPages")))


@query("""SELECT o_orderkey AS pos, o_custkey AS doc_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 END AS answer FROM orders""")
def j3_responses_by_position(spark, sf_dir):
    jobs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("doc_id"))
    return fallback.align_responses(jobs, jobs.where("pos % 4 <> 0").select("pos", (F.col("pos") % 5).alias("answer")))


@query(f"""WITH {q._FORM_SQL} SELECT vec_id AS page, form, "formConfidence" FROM fr WHERE truth <> form OR "formConfidence" < 0.1""")
def o2_strict_errors(spark, sf_dir):
    rows = q._scored(spark, sf_dir).withColumn("label", F.col("truth")).withColumnRenamed("vec_id", "page")
    return forms.strict_errors(rows).select("page", "form", "formConfidence")


# --- models that answer by a text's length, so that SQL knows what they say


class ByLength:
    """Answers about a page: the outcome at length % 17, sure of it unless length % 3 = 0; it fails where length % 7 = 0."""

    def ask(self, state: dict, questions: dict) -> dict:
        n = len(state["text"])
        if n % 7 == 0:
            raise OSError("no answer")
        choice, p = tx.MODEL_OUTCOMES[n % 17], 0.5 if n % 3 == 0 else 0.97
        probabilities = {o: p if o == choice else (1 - p) / 16 for o in tx.MODEL_OUTCOMES}
        return {"answers": {"document": {"choice": choice, "confidence": p, "probabilities": probabilities}}, "inputTokens": n}


class FormsByLength:
    """Answers about a form page: of the options in their order the one at length % their number (for members, length // 8)."""

    def ask(self, state: dict, questions: dict) -> dict:
        n = len(state["header"]) + len(state["body"]) + len(state["footer"])
        sure, answers = 0.5 if n % 3 == 0 else 0.96, {}
        for name, asked in questions.items():
            options = list(asked["criteria"])
            choice = options[(n // 8 if name == "sub" else n) % len(options)]
            answers[name] = {"choice": choice, "confidence": sure, "probabilities": {o: sure if o == choice else 0.0 for o in options}}
        return {"answers": answers, "inputTokens": n % 100}


_ASKED = f"""an AS (SELECT *, length(text) AS n, {quote(tx.MODEL_OUTCOMES)}[(length(text) % 17) + 1] AS choice, CASE WHEN length(text) % 3 = 0
  THEN 0.5 ELSE 0.97 END::DOUBLE AS cf, length(text) % 7 = 0 AS failed FROM r),
po AS (SELECT *, unnest(['compare', 'uncertain']) AS policy FROM an),
rt AS (SELECT *, CASE WHEN {q._UNFIT} OR (policy = 'uncertain' AND ("documentType" IN {q.NAMED} OR reason = 'context_only_or_instructions'))
  THEN 'keep' ELSE 'ask' END AS route, CASE WHEN choice IN {q.NAMED} THEN choice END AS cand FROM po),
st AS (SELECT *, CASE WHEN route = 'keep' THEN 'keep' WHEN failed THEN 'model_unavailable' WHEN cand IS NOT NULL AND len(candidates) > 0
  AND NOT list_contains(candidates, cand) THEN 'model_rule_disagreement'
  WHEN "documentType" = 'ambiguous' THEN 'conflicting_category_evidence' WHEN cf < 0.95 THEN 'below_model_gate'
  ELSE 'model_suggestion_requires_validation' END AS s FROM rt),
md AS (SELECT *, CASE s WHEN 'keep' THEN "documentType" WHEN 'model_unavailable' THEN CASE WHEN "documentType" = 'ambiguous' THEN 'ambiguous'
  ELSE 'unknown' END WHEN 'model_rule_disagreement' THEN 'ambiguous' WHEN 'conflicting_category_evidence' THEN 'ambiguous' WHEN 'below_model_gate'
  THEN 'unknown' ELSE choice END AS outcome FROM st)"""


@query(f"""WITH {q.RULES}, {_ASKED} SELECT policy, doc_id, outcome AS "documentType", CASE WHEN s = 'keep' THEN reason ELSE s END AS reason, CASE
  WHEN route = 'ask' THEN 1 ELSE 0 END::BIGINT AS calls FROM md""")
def m8_shared_answers(spark, sf_dir):
    outcomes, _ = model.compare_policies(rules.classify(synth_pages(spark, sf_dir)), ByLength())
    return outcomes.select("policy", "doc_id", "documentType", "reason", "calls")


@query(f"""WITH {CASE_RULES}, {_ASKED} SELECT policy, {SET} AS dataset, count_if(outcome = "documentType") AS retained,
  count_if("documentType" <> truth AND outcome = truth) AS recovered, count_if("documentType" = truth AND outcome <> truth) AS degraded,
 count_if(truth NOT IN {q.NAMED} AND outcome IN {q.NAMED}) AS "falseSuggestions" FROM md GROUP BY ALL""")
def j7_policy_transitions(spark, sf_dir):
    return runs.policy_evaluation(_cases(spark, sf_dir), ByLength())["transitions"]


@query(f"""WITH {CASE_RULES}, {_ASKED}, x AS (SELECT {SET} AS dataset, failed, choice = truth AND NOT failed AS ok, choice <> truth
  AND NOT failed AS wrong, cf FROM md WHERE policy = 'compare' AND route = 'ask')
SELECT dataset, count(*) AS "pagesSent", count_if(failed) AS failed, count_if(NOT failed) AS valid, count_if(ok) AS correct, count_if(ok
  AND cf >= 0.95) AS "correctAtGate", count_if(wrong AND cf >= 0.95) AS "wrongAtGate",
 round(count_if(ok) / nullif(count_if(NOT failed), 0), 3) AS accuracy, round(avg(cf) FILTER (ok), 3) AS "meanConfidenceCorrect",
  round(avg(cf) FILTER (wrong), 3) AS "meanConfidenceWrong" FROM x GROUP BY 1""")
def a7_answer_rates(spark, sf_dir):
    metrics = runs.policy_evaluation(_cases(spark, sf_dir), ByLength())["model"]
    return metrics.select("dataset", "pagesSent", "failed", "valid", "correct", "correctAtGate", "wrongAtGate", "accuracy", "meanConfidenceCorrect", "meanConfidenceWrong")


@query(f"""WITH {CASE_RULES}, q AS (SELECT 'rules' AS method, {SET} AS dataset, truth, "documentType" AS prediction FROM r UNION ALL
  SELECT 'keywordBaseline', {SET}, truth, {q._KEYWORD} FROM sp) SELECT method, dataset, {q._TOTALS} FROM q GROUP BY ALL""")
def k3_evaluation_totals(spark, sf_dir):
    return runs.evaluation(_cases(spark, sf_dir))["totals"]


_SUBS = {f: [*m, tx.NOT_LISTED] for f, m in q._MEMBERS.items()}


def _chosen(options: list[str], at: str) -> str:
    """The option's place, or the first place with probability 0 where the way out was chosen."""
    return f"CASE WHEN ({at}) % {len(options)} = {len(options) - 1} THEN struct_pack(k := {quote(options[0])}, p := 0.0::DOUBLE) ELSE struct_pack(k := {quote(options)}[(({at}) % {len(options)}) + 1], p := sure) END"


@query(rf"""WITH l AS (SELECT doc_id, {q._LINES} AS lines FROM documents), s AS (SELECT doc_id, array_to_string(lines[1:12], chr(10)) AS header,
  substr(array_to_string(CASE WHEN len(lines) > 18 THEN lines[13:len(lines) - 6] ELSE lines[13:] END, chr(10)), 1, 2500) AS body,
  CASE WHEN len(lines) > 18 THEN array_to_string(lines[len(lines) - 5:], chr(10)) ELSE '' END AS footer,
  regexp_replace(regexp_replace(array_to_string(lines, ' '), '^\s+', ''), '\s+$', '') AS t FROM l),
n AS (SELECT doc_id, length(header) + length(body) + length(footer) AS n, coalesce(length(t) < 60 OR regexp_matches(t,
  '(?i)intentionally left blank|left blank intentionally'), true) AS blank FROM s), m AS (SELECT *, CASE WHEN n % 3 = 0 THEN 0.5
  ELSE 0.96 END::DOUBLE AS sure FROM n),
a AS (SELECT *, {_chosen(q._FIRST, "n")} AS a, {_chosen(_SUBS["form-5471"], "n // 8")} AS s1, {_chosen(_SUBS["form-8865"], "n // 8")} AS s2 FROM m),
  b AS (SELECT *, a.k IN ('form-5471', 'form-8865') AS two, CASE WHEN a.k = 'form-5471' THEN s1 ELSE s2 END AS s FROM a),
c AS (SELECT *, CASE WHEN blank THEN 1.0 WHEN two THEN least(a.p, s.p) ELSE a.p END::DOUBLE AS "formConfidence" FROM b)
SELECT doc_id, CASE WHEN blank THEN 'blank' WHEN two THEN s.k ELSE a.k END AS form, CASE WHEN blank THEN 'blank'
  ELSE {quote(tx.KINDS)}[(n % 7) + 1] END AS kind, "formConfidence", CASE WHEN blank THEN 1.0 ELSE sure END::DOUBLE AS "kindConfidence",
  "formConfidence" >= 0.95 AS gated,
 CASE WHEN blank THEN 0 WHEN two THEN 2 ELSE 1 END::BIGINT AS calls, CASE WHEN blank THEN 0 WHEN two THEN 2 * (n % 100)
  ELSE n % 100 END::BIGINT AS "inputTokens" FROM c""")
def m6_two_step_calls(spark, sf_dir):
    pages = q._documents(spark, sf_dir).select("doc_id", F.lit(1).cast("long").alias("page"), tf.lines_of(F.col("text")).alias("lines"))
    found = forms.classify_pages(pages, q._criteria(spark), FormsByLength())
    return found.select("doc_id", "form", "kind", "formConfidence", "kindConfidence", "gated", "calls", "inputTokens")


# --- SQL for queries that had none

#: Documents of the driver's tables are normalised already, so only the appended forms change.
q.SQL["t2_nfkc"] = "SELECT doc_id, sha256(text || ' fi1') AS sha, true AS folded FROM documents"

# pages near the length limit: (a line, what is said over and over, how often, a last line)
_LONG = [
    ("TAX INVOICE\n", "GST ", 49990, ""), ("Tax invoice\n", "total ", 33000, ""), ("BAS\n", "G1 ", 66000, ""), ("BAS\n", "1A ", 66000, ""), ("", " ", 190000, "\nPlease send the receipt"),
    ("", "\n", 190000, "Bank statement request"), ("", "\r\n", 95000, "Bank statement request"), ("", " \t\n", 63000, "Bank statement request"), ("", "re: ", 45000, "x"),
]
_LONG_SQL = ", ".join(f"('a{i}', {quote(a)} || repeat({quote(b)}, {n}) || {quote(z)})" for i, (a, b, n, z) in enumerate(_LONG))
q.SQL["p5_adversarial"] = (
    "WITH "
    + q.RULES.replace(
        synth_sql(),
        f"sp AS (SELECT doc_id, 1 AS page, text, 'native' AS extraction, NULL::VARCHAR[] AS warnings, NULL::VARCHAR AS ocr_engine, NULL::DOUBLE[] AS ocr_line_confidence FROM (VALUES {_LONG_SQL}) v(doc_id, text))",
        1,
    )
    + ' SELECT doc_id, "documentType", reason FROM r'
)
