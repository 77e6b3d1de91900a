"""One query for each operator of the inventory, each with its SQL. Both sides are built from the same taxonomy and templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import taxonomy as tx
from ..functions import text as tf
from ..functions.regexes import context_patterns, re2
from ..operators import catalogue, evaluate, fallback, forms, model, review, rules, validate
from ..sources.readers import split_form_feeds
from ..tables import written
from .synth import quote, synth_pages, synth_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            # count_if is a huge integer in the oracle; a filtered count is not
            SQL[f.__name__] = sql.replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


# --- the rule classifier in SQL


def _m(col: str, pattern: str, lines: bool = False) -> str:
    return f"regexp_matches({col}, {quote(re2(pattern, lines))})"


def _order(col: str, pairs) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {quote(rf'(?is)\b{a}\b.*\b(?:{"|".join(b)})\b')})" for a, b in pairs) + ")"


def _support(col: str, t: str) -> str:
    if t in tx.IN_ORDER:
        return _order(col, tx.IN_ORDER[t])
    out = _m(col, tx.SUPPORT[t])
    return f"(NOT {_m(col, tx.EXCLUDED[t])} AND {out})" if t in tx.EXCLUDED else out


BLANKED = {t: f"regexp_replace(clean, {quote(re2(h))}, ' ', 'g')" for t, h in tx.HEADINGS.items()}
CLEAN = """cl AS (SELECT *, replace(CASE WHEN ocr_line_confidence IS NULL THEN text ELSE array_to_string(list_transform(string_split(text, chr(10)),
  lambda l, i: CASE WHEN ocr_line_confidence[i] < 0.8 THEN '' ELSE l END), chr(10)) END, chr(13), '') AS clean FROM sp)"""
NAMED = "(" + ", ".join(map(quote, tx.TYPES)) + ")"


def _window(col: str) -> str:
    return rf"array_to_string(list_filter(string_split({col}, chr(10)), lambda l: NOT regexp_full_match(l, '\s*'))[1:32], chr(10))"


LOW = "coalesce(len(list_filter(ocr_line_confidence, lambda c: c < 0.8)) > 0, false)"
GATE = rf"""(extraction IN ('needs_ocr', 'failed') OR regexp_full_match(clean, '\s*') OR len(list_filter(coalesce(warnings, []), lambda w: w <> '{tx.LOW_LINES}' OR ocr_line_confidence IS NULL)) > 0)"""
CONTEXT = " OR ".join(_m("clean", p, lines) for p, lines in context_patterns().values())
CANDIDATES = "list_filter([" + ", ".join(f"CASE WHEN {_m('win', h)} AND {_support(BLANKED[t], t)} THEN '{t}' END" for t, h in tx.HEADINGS.items()) + "], lambda x: x IS NOT NULL)"
RULES = f"""{synth_sql()}, {CLEAN},
w AS (SELECT *, {_window("clean")} AS win, CASE WHEN {GATE} THEN 'extraction' WHEN {CONTEXT} THEN 'context' ELSE 'rules' END AS gate, {LOW} AS low FROM cl),
cd AS (SELECT *, CASE WHEN gate = 'rules' THEN {CANDIDATES} ELSE [] END AS candidates FROM w),
r AS (SELECT *, CASE WHEN gate = 'extraction' THEN 'unreadable' WHEN gate = 'context' THEN 'unknown' WHEN len(candidates) > 1 THEN 'ambiguous'
  WHEN len(candidates) = 1 THEN candidates[1] WHEN low THEN 'unreadable' ELSE 'unknown' END AS "documentType",
  CASE WHEN gate = 'extraction' THEN 'extraction_requires_review' WHEN gate = 'context' THEN 'context_only_or_instructions' WHEN len(candidates) > 1
  THEN 'conflicting_category_evidence' WHEN len(candidates) = 1 THEN 'rule_suggestion' WHEN low THEN 'insufficient_reliable_ocr_evidence'
  ELSE 'no_rule_match' END AS reason,
  CASE WHEN gate = 'extraction' OR (gate = 'rules' AND len(candidates) = 0 AND low) THEN 'extraction' ELSE 'rules' END AS method,
  sha256(text) AS "textSha256" FROM cd)"""


def _classified(spark, sf_dir):
    return rules.classify(synth_pages(spark, sf_dir))


@query(f"""WITH {RULES} SELECT doc_id, page, "documentType", reason, method, array_to_string(candidates, ',') AS candidates,
  array_to_string(list_transform(candidates, lambda c: 'heading_and_support:' || c), ',') AS evidence, "textSha256", NULL::DOUBLE AS confidence,
  true AS "requiresReview" FROM r""")
def p8_rule_outcomes(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "page", "documentType", "reason", "method", F.array_join("candidates", ",").alias("candidates"), F.array_join("evidence", ",").alias("evidence"), "textSha256", "confidence", "requiresReview")


@query(f"""WITH {RULES} SELECT "documentType", reason, count(*) AS pages FROM r GROUP BY ALL""")
def p8_outcome_histogram(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("documentType", "reason").agg(F.count(F.lit(1)).alias("pages"))


@query(f"""WITH {synth_sql()}, {CLEAN} SELECT doc_id, {GATE} AS gated FROM cl""")
def p1_extraction_gate(spark, sf_dir):
    read = rules.usable_text(synth_pages(spark, sf_dir))
    return read.select("doc_id", rules.needs_extraction(F.col("clean")).alias("gated"))


@query(f"""WITH {synth_sql()}, {CLEAN} SELECT doc_id, {", ".join(f"{_m('clean', p, lines)} AS {k}" for k, (p, lines) in context_patterns().items())} FROM cl""")
def p2_context_only(spark, sf_dir):
    read = rules.usable_text(synth_pages(spark, sf_dir))
    return read.select("doc_id", *(c.alias(k) for k, c in rules.context_matches(F.col("clean")).items()))


@query(f"""WITH {synth_sql()}, {CLEAN}, w AS (SELECT *, {_window("clean")} AS win FROM cl), u AS (SELECT doc_id,
  unnest([{", ".join(f"CASE WHEN {_m('win', h)} THEN '{t}' END" for t, h in tx.HEADINGS.items())}]) AS type FROM w) SELECT doc_id, type FROM u
  WHERE type IS NOT NULL""")
def p3_heading_matrix(spark, sf_dir):
    read = rules.usable_text(synth_pages(spark, sf_dir)).withColumn("win", tf.heading_window(F.col("clean")))
    hits = F.array(*(F.when(c, F.lit(t)) for t, c in rules.heading_matches(F.col("win")).items()))
    return read.select("doc_id", F.explode(F.filter(hits, lambda t: t.isNotNull())).alias("type"))


@query(f"""WITH {synth_sql()}, {CLEAN}, u AS (SELECT doc_id,
  unnest([{", ".join(f"CASE WHEN {_support(BLANKED[t], t)} THEN '{t}' END" for t in tx.HEADINGS)}]) AS type FROM cl) SELECT doc_id, type FROM u
  WHERE type IS NOT NULL""")
def p4_support_matrix(spark, sf_dir):
    read = rules.usable_text(synth_pages(spark, sf_dir))
    hits = F.array(*(F.when(rules.support(rules.without_heading(F.col("clean"), t), t), F.lit(t)) for t in tx.HEADINGS))
    return read.select("doc_id", F.explode(F.filter(hits, lambda t: t.isNotNull())).alias("type"))


@query(f"""WITH {synth_sql()} SELECT doc_id, {_order("text", tx.IN_ORDER["business-activity-statement"])} AS activity,
  {_order("text", tx.IN_ORDER["tax-invoice"])} AS invoice FROM sp""")
def p5_ordered_tokens(spark, sf_dir):
    t = F.col("text")
    return synth_pages(spark, sf_dir).select("doc_id", rules.in_order(t, tx.IN_ORDER["business-activity-statement"]).alias("activity"), rules.in_order(t, tx.IN_ORDER["tax-invoice"]).alias("invoice"))


@query(f"""WITH {synth_sql()} SELECT doc_id, {_support("text", "receipt")} AS paid FROM sp""")
def p6_receipt_negation(spark, sf_dir):
    return synth_pages(spark, sf_dir).select("doc_id", rules.support(F.col("text"), "receipt").alias("paid"))


_KEYWORD = rf"CASE WHEN regexp_full_match(text, '\s*') OR extraction IN ('needs_ocr', 'failed') THEN 'unreadable' " + " ".join(f"WHEN contains(lower(text), '{tx.keyword(t)}') THEN '{t}'" for t in tx.TYPES) + " ELSE 'unknown' END"


@query(f"""WITH {synth_sql()}, a AS (SELECT doc_id, text, extraction FROM sp UNION ALL SELECT doc_id::VARCHAR, text, 'native' FROM documents)
  SELECT doc_id, {_KEYWORD} AS outcome FROM a""")
def p9_keyword_baseline(spark, sf_dir):
    pages = synth_pages(spark, sf_dir).select("doc_id", "text", "extraction").unionByName(_documents(spark, sf_dir).select(F.col("doc_id").cast("string"), "text", F.lit("native").alias("extraction")))
    return pages.select("doc_id", rules.keyword_baseline(F.col("text"), F.col("extraction")).alias("outcome"))


_PICK = """(extraction IN ('needs_ocr', 'failed') OR (extraction = 'ocr' AND "documentType" IN ('unknown', 'unreadable')))"""


@query(f"""WITH {RULES} SELECT doc_id, page FROM r WHERE {_PICK}""")
def p10_fallback_selector(spark, sf_dir):
    return fallback.select_pages(synth_pages(spark, sf_dir))


@query(f"""WITH {RULES} SELECT doc_id, page,
  CASE WHEN {_PICK} AND k % 2 = 0 THEN 'Tax invoice' || chr(10) || 'GST 1' || chr(10) || 'Total ' || k::VARCHAR ELSE text END AS text,
  CASE WHEN {_PICK} AND k % 2 = 0 THEN 'ocr' ELSE extraction END AS extraction,
  array_to_string(CASE WHEN {_PICK} AND k % 2 = 0 THEN [] WHEN {_PICK} THEN list_concat(coalesce(warnings, []), ['{tx.FALLBACK_FAILED}'])
  ELSE coalesce(warnings, []) END, ',') AS warnings FROM r""")
def j2_fallback_merge(spark, sf_dir):
    pages = synth_pages(spark, sf_dir)
    chosen = fallback.select_pages(pages, "k")
    text = F.concat(F.lit("Tax invoice\nGST 1\nTotal "), F.col("k").cast("string"))
    again = chosen.where("k % 2 = 0").select("doc_id", "page", text.alias("text"), F.lit("ocr").alias("extraction"), F.array().cast("array<string>").alias("warnings"), F.lit(tx.ENGINES[1]).alias("ocr_engine"), F.array(*[F.lit(0.9)] * 3).alias("ocr_line_confidence"))
    merged = fallback.merge(pages, chosen.select("doc_id", "page"), again)
    return merged.select("doc_id", "page", "text", "extraction", F.coalesce(F.array_join("warnings", ","), F.lit("")).alias("warnings"))


_UNFIT = """("documentType" = 'unreadable' OR len(coalesce(warnings, [])) > 0 OR low)"""


@query(f"""WITH {RULES} SELECT doc_id, CASE WHEN {_UNFIT} THEN 'keep' WHEN length(text) > 20000 THEN 'too_long' ELSE 'ask' END AS compare,
  CASE WHEN {_UNFIT} OR "documentType" IN {NAMED} OR reason = 'context_only_or_instructions' THEN 'keep' WHEN length(text) > 20000 THEN 'too_long'
  ELSE 'ask' END AS uncertain FROM r""")
def p11_model_routing(spark, sf_dir):
    both = model.route(model.route(_classified(spark, sf_dir), "compare").withColumnRenamed("route", "compare"), "uncertain")
    return both.select("doc_id", "compare", F.col("route").alias("uncertain"))


# --- text shaping


@query(f"""WITH {synth_sql()}, {CLEAN} SELECT doc_id, clean FROM cl""")
def t1_masked_lines(spark, sf_dir):
    return synth_pages(spark, sf_dir).select("doc_id", tf.mask_lines(F.col("text"), F.col("ocr_line_confidence")).alias("clean"))


@query(f"""SELECT doc_id, {_window("text")} AS win FROM documents""")
def t4_heading_window(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tf.heading_window(F.col("text")).alias("win"))


@query(f"""WITH {synth_sql()} SELECT doc_id,
  {", ".join(f"regexp_replace(text, {quote(re2(tx.HEADINGS[t]))}, ' ', 'g') AS {n}" for t, n in (("tax-invoice", "invoice"), ("dividend-statement", "dividend"), ("business-activity-statement", "activity")))}
  FROM sp""")
def t5_blank_own_heading(spark, sf_dir):
    t = F.col("text")
    return synth_pages(spark, sf_dir).select("doc_id", *(rules.without_heading(t, k).alias(n) for k, n in (("tax-invoice", "invoice"), ("dividend-statement", "dividend"), ("business-activity-statement", "activity"))))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '\s+$', '')), lambda l: NOT regexp_full_match(l, '\s*'))"


@query(f"""SELECT doc_id, len({_LINES}) AS n, array_to_string({_LINES}, chr(10)) AS lines FROM documents""")
def t6_lines(spark, sf_dir):
    lines = tf.lines_of(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("n"), F.array_join(lines, "\n").alias("lines"))


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents) SELECT doc_id, array_to_string(lines[1:12], chr(10)) AS header,
  substr(array_to_string(CASE WHEN len(lines) > 18 THEN lines[13:len(lines) - 6] ELSE lines[13:] END, chr(10)), 1, 2500) AS body,
  CASE WHEN len(lines) > 18 THEN array_to_string(lines[len(lines) - 5:], chr(10)) ELSE '' END AS footer FROM l""")
def t7_page_state(spark, sf_dir):
    pages = _documents(spark, sf_dir).withColumn("lines", tf.lines_of(F.col("text")))
    return pages.select("doc_id", tf.page_state(F.col("lines")).alias("s")).select("doc_id", "s.header", "s.body", "s.footer")


@query(rf"""WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents), j AS (SELECT *, regexp_replace(regexp_replace(array_to_string(lines, ' '),
  '^\s+', ''), '\s+$', '') AS t FROM l)
SELECT doc_id, length(t) < 60 OR regexp_matches(t, '(?i)intentionally left blank|left blank intentionally') AS blank FROM j""")
def t8_blank(spark, sf_dir):
    pages = _documents(spark, sf_dir).withColumn("lines", tf.lines_of(F.col("text")))
    return pages.select("doc_id", tf.is_blank_page(F.col("lines")).alias("blank"))


@query(rf"""WITH l AS (SELECT doc_id, 'Att' AS w, {_LINES} AS lines FROM documents) SELECT doc_id, coalesce(starts_with(regexp_replace(lines[1],
  '^\s+', ''), 'Attention'), false) AS cover, coalesce(starts_with(regexp_replace(lines[1], '^\s+', ''), 'The'), false) AS the FROM l""")
def t9_cover(spark, sf_dir):
    pages = _documents(spark, sf_dir).withColumn("lines", tf.lines_of(F.col("text")))
    return pages.select("doc_id", tf.is_cover_sheet(F.col("lines")).alias("cover"), F.coalesce(F.startswith(tf.strip(F.get("lines", F.lit(0))), F.lit("The")), F.lit(False)).alias("the"))


@query("""SELECT sha256(text) AS sha, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1""")
def t10_text_hash_dupes(spark, sf_dir):
    return validate.duplicates(_documents(spark, sf_dir).select(tf.text_sha256(F.col("text")).alias("sha")), "sha")


@query()
def t2_nfkc(spark, sf_dir):
    """Compatibility forms normalised: no SQL form."""
    wide = _documents(spark, sf_dir).withColumn("text", F.concat(F.col("text"), F.lit(" ﬁ①\r")))
    return tf.normalise(wide, "text").select("doc_id", F.sha2("text", 256).alias("sha"), F.contains("text", F.lit(" fi1")).alias("folded"))


# --- sources


@query("""WITH d AS (SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS text FROM conversations GROUP BY 1), p AS (SELECT conv_id,
  string_split(text, chr(12)) AS a FROM d)
SELECT conv_id::VARCHAR AS doc_id, i::BIGINT AS page, a[i] AS text FROM (SELECT conv_id, a, unnest(range(1, len(a) + 1)) AS i FROM p)""")
def s2_formfeed_split(spark, sf_dir):
    packs = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = packs.select(F.col("conv_id").cast("string").alias("doc_id"), F.array_join("t.text", "\f").alias("text"))
    return split_form_feeds(texts).select("doc_id", "page", "text")


@query("""SELECT p_partkey || '.pdf' AS file, CASE WHEN page % 5 = 0 THEN 'blank' ELSE p_partkey::VARCHAR END AS truth, page::INTEGER AS page,
  p_size AS "pageCount" FROM (SELECT p_partkey, p_size, unnest(range(1, p_size + 1)) AS page FROM part)""")
def s12_blank_jobs(spark, sf_dir):
    every = F.sequence(F.lit(1), F.col("p_size"))
    listed = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("pages"), F.filter(every, lambda p: p % 5 == 0).alias("blankPages"))
    return forms.blank_jobs(listed).select("file", "truth", "page", "pageCount")


@query("""WITH s(stem, truth) AS (VALUES """ + ", ".join(f"({quote(a)}, {quote(b)})" for a, b in tx.STEM_FORMS.items()) + """), l AS (SELECT list(stem ORDER BY stem) AS a FROM s),
f AS (SELECT o_orderkey, a[(o_orderkey % 15) + 1] AS stem FROM orders, l) SELECT 'x/input/' || stem || '_2024_' || o_orderkey || '.pdf' AS path, truth
  FROM f JOIN s USING (stem)""")
def s13_bench_truth(spark, sf_dir):
    stems = F.array(*map(F.lit, sorted(tx.STEM_FORMS)))
    files = _table(spark, sf_dir, "orders").select(F.concat(F.lit("x/input/"), F.get(stems, (F.col("o_orderkey") % 15).cast("int")), F.lit("_2024_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path"))
    return forms.bench_truth(files).select("path", "truth")


# --- ids

_IDS = ["form-1040", "form-1040/p2", "form-1040-schedule-a", "form-1040-nr-schedule-nec", "form-8995-a-schedule-a/p12", "form-1065-schedule-k-1", "form-w-2g", "form-1099-r", "form-5471-schedule-j", "form-1040-schedule-8812", "form-1040-schedule-eic", "form-1118-schedule-i", "form-1118-schedule-j/p3", "schedule-a", "form-5471/sch-j", "blank", "form-t", "form-8933", ""]
_NAMES = ["Form 1040 Schedule A", "Form 1040NR Schedule NEC", "Form 8995A Schedule A", "Form 1065 Schedule K1", "Form 1040 Schedule 1A", "Form W2G", "Form 1099R", "Form RRB1042S", "Form 499W2PR", "Other", "  Form 4868 "]


def _pick_sql(values: list[str], name: str) -> str:
    return f"SELECT l_orderkey * 10 + l_linenumber AS n, {quote(values)}[((l_orderkey * 10 + l_linenumber) % {len(values)}) + 1] AS {name} FROM lineitem"


def _picked(spark, sf_dir, values, name):
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select(n.alias("n"), F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int")).alias(name))


_F = "split_part(id, '/', 1)"
_P = r"'^form-(.+?)(?:-schedule-(.+))?$'"


@query(rf"""WITH i AS ({_pick_sql(_IDS, "id")}) SELECT n, id, regexp_full_match(id, {quote(ids.GRAMMAR + "|blank")}) AS valid, {_F} AS form,
  nullif(regexp_extract(id, '/p(\d+)$', 1), '')::BIGINT AS page, nullif(regexp_extract({_F}, '^(form-.+?)-schedule-', 1), '') AS parent,
 CASE WHEN NOT regexp_matches({_F}, {_P}) THEN id WHEN regexp_extract({_F}, {_P}, 2) <> '' THEN 'Schedule ' || upper(regexp_extract({_F}, {_P},
  2)) || ' (Form ' || upper(regexp_extract({_F}, {_P}, 1)) || ')' ELSE 'Form ' || upper(regexp_extract({_F}, {_P}, 1)) END AS label,
 coalesce(nullif(regexp_extract(id, '(\d{{3,4}})', 1), ''), id) AS stem FROM i""")
def i1_form_ids(spark, sf_dir):
    i = F.col("id")
    return _picked(spark, sf_dir, _IDS, "id").select("n", "id", ids.is_form_id(i).alias("valid"), ids.form_of(i).alias("form"), ids.page_of(i).alias("page"), ids.parent_of(i).alias("parent"), ids.label_of(i).alias("label"), ids.stem_of(i).alias("stem"))


_N1 = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(regexp_extract(trim(name), '^Form (\S+)(?: Schedule (\S+))?$', 1)), '^W2', 'W-2'), '^(RRB|SSA)1042S$', '\1-1042-S'), '^499W2PR$', '499-W-2-PR'), '^(\d+)([A-Z]+)$', '\1-\2')"
_N2 = r"regexp_replace(regexp_replace(upper(regexp_extract(trim(name), '^Form (\S+)(?: Schedule (\S+))?$', 2)), '^([A-Z])(\d)$', '\1-\2'), '^(\d)([A-Z])$', '\1-\2')"


@query(rf"""WITH i AS ({_pick_sql(_NAMES, "name")}) SELECT n, CASE WHEN regexp_matches(trim(name), '^Form (\S+)(?: Schedule (\S+))?$')
  THEN 'form-' || lower({_N1}) || CASE WHEN {_N2} <> '' THEN '-schedule-' || lower({_N2}) ELSE '' END END AS id FROM i""")
def i5_name_ids(spark, sf_dir):
    return _picked(spark, sf_dir, _NAMES, "name").select("n", ids.id_of_name(F.col("name"), strict=False).alias("id"))


_B, _S = f"replace(regexp_extract({_F}, {_P}, 1), '-', '')", f"replace(regexp_extract({_F}, {_P}, 2), '-', '')"


@query(rf"""WITH i AS ({_pick_sql(_IDS, "id")}) SELECT n, CASE WHEN NOT regexp_matches({_F}, {_P}) THEN NULL WHEN {_S} = '' THEN 'f' || {_B} || '.pdf'
  WHEN {_B} = '1040' AND {_S} = '8812' THEN 'f1040s8.pdf' WHEN {_B} = '1040' AND {_S} = 'eic' THEN 'f1040sei.pdf'
 WHEN {_B} = '1040nr' THEN 'f1040nr' || {_S}[1] || '.pdf' WHEN {_B} = '1118' AND {_S} = 'i' THEN 'f1118s1.pdf' WHEN {_B} = '8995a'
  THEN 'f8995a' || {_S} || '.pdf' ELSE 'f' || {_B} || 's' || {_S} || '.pdf' END AS file FROM i""")
def i7_pdf_name(spark, sf_dir):
    return _picked(spark, sf_dir, _IDS, "id").select("n", ids.pdf_name(F.col("id"), strict=False).alias("file"))


# --- validators

_BAD = "CASE k % 13 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE page END"


@query(f"""WITH {synth_sql()}, b AS (SELECT *, {_BAD} AS pg, CASE WHEN k % 11 = 0 THEN 'scan' ELSE extraction END AS ex, CASE WHEN k % 17 = 0
  THEN 'other' ELSE ocr_engine END AS en, CASE WHEN k % 19 = 0 THEN list_concat(coalesce(ocr_line_confidence, []), [1.5::DOUBLE])
  ELSE ocr_line_confidence END AS cf FROM sp)
SELECT doc_id, pg BETWEEN 1 AND 9007199254740991 AND length(text) <= 200000 AND ex IN ('native', 'ocr', 'needs_ocr', 'failed') AND (cf IS NULL
  OR (ex = 'ocr' AND len(cf) = len(string_split(text, chr(10))) AND len(list_filter(cf, lambda c: NOT (c >= 0 AND c <= 1))) = 0))
 AND coalesce(en IN ('pdf-inspector-pp-ocrv6-small', 'paddleocr-3.7.0-pp-ocrv6-small'), true) AS valid FROM b""")
def v1_page_validity(spark, sf_dir):
    k = F.col("k")
    spoilt = synth_pages(spark, sf_dir).withColumns({
        "page": F.when(k % 13 == 0, 0).when(k % 13 == 1, -1).otherwise(F.col("page")),
        "extraction": F.when(k % 11 == 0, "scan").otherwise(F.col("extraction")),
        "ocr_engine": F.when(k % 17 == 0, "other").otherwise(F.col("ocr_engine")),
        "ocr_line_confidence": F.when(k % 19 == 0, F.concat(F.coalesce("ocr_line_confidence", F.array().cast("array<double>")), F.array(F.lit(1.5)))).otherwise(F.col("ocr_line_confidence")),
    })
    return spoilt.select("doc_id", validate.page_valid().alias("valid"))


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN 1 ELSE turn + 1 END AS page FROM conversations),
  b AS (SELECT *, lag(page) OVER (PARTITION BY conv_id ORDER BY turn) AS bef FROM p)
SELECT conv_id AS doc_id, count(*) AS pages, bool_and(page > coalesce(bef, 0)) AS increasing, bool_and(page > coalesce(bef, 0)) AND count(*) BETWEEN 1
  AND 500 AS valid FROM b GROUP BY 1""")
def v2_pack_order(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 1), 1).otherwise(F.col("turn") + 1).alias("page"))
    return validate.pack_report(turns)


@query(rf"""WITH {RULES}, b AS (SELECT *, CASE WHEN k % 9 = 0 THEN upper("textSha256") ELSE "textSha256" END AS sha, CASE WHEN k % 10 = 0
  THEN 'Bad reason' ELSE reason END AS re, CASE WHEN k % 12 = 0 THEN 'au-0' ELSE 'au-1' END AS v FROM r)
SELECT doc_id, regexp_full_match(sha, '[a-f0-9]{{64}}') AND regexp_full_match(re, '[a-z_]{{1,64}}') AND v = 'au-1' AS valid FROM b""")
def v3_result_validity(spark, sf_dir):
    k = F.col("k")
    rows = _classified(spark, sf_dir).withColumns({"textSha256": F.when(k % 9 == 0, F.upper("textSha256")).otherwise(F.col("textSha256")), "reason": F.when(k % 10 == 0, "Bad reason").otherwise(F.col("reason")), "taxonomyVersion": F.when(k % 12 == 0, "au-0").otherwise(F.col("taxonomyVersion"))})
    return rows.select("doc_id", validate.result_valid().alias("valid"))


_DATES = ["", "2026-09-27T10:00:00+10:00", "2026-13-45", "2026-09-27", "27/09/2026", "2026-02-28T23:59Z", "2026-09-27T25:00Z", "2026-09-27T10:61Z", "2026-09-27T10:00:00.123Z", "2026-00-10"]
_DATES_OK = [True, True, False, True, False, True, False, False, True, False]
_PEOPLE = ["rev-1", "a b", "x@y", "", "r" * 65]
_PEOPLE_OK = [True, False, False, True, False]


@query(f"""SELECT o_orderkey AS k, {_DATES_OK}[(o_orderkey % 10) + 1] AND {_PEOPLE_OK}[(o_orderkey // 10 % 5) + 1] AS valid FROM orders""")
def v4_decisions_validity(spark, sf_dir):
    k = F.col("o_orderkey")
    header = _table(spark, sf_dir, "orders").select(k.alias("k"), F.lit(validate.DECISIONS_SCHEMA).alias("schemaVersion"), F.sha2(k.cast("string"), 256).alias("manifestSha256"), F.get(F.array(*map(F.lit, _DATES)), (k % 10).cast("int")).alias("reviewedAt"), F.get(F.array(*map(F.lit, _PEOPLE)), (F.floor(k / 10) % 5).cast("int")).alias("reviewer"))
    return header.select("k", validate.decisions_header_valid().alias("valid"))


# an answer for each page, with every kind of fault: variant = k % 11
_MO = tx.MODEL_OUTCOMES
_ANSWERS = f"""an AS (SELECT *, k % 11 AS va, {quote(_MO)}[(k % 17) + 1] AS choice0, CASE k % 3 WHEN 0 THEN 0.97 WHEN 1 THEN 0.96
  ELSE 0.5 END::DOUBLE AS p0 FROM r),
pr AS (SELECT *, CASE va WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE choice0 END AS choice, CASE va WHEN 3 THEN 0.2 ELSE p0 END::DOUBLE AS conf,
  list_transform({quote(_MO)}, lambda o, i: CASE WHEN va = 4 AND i = 1 THEN -0.1 WHEN va = 5 AND i = 2 THEN 0.9 WHEN va = 6 AND (o = choice0
  OR i = ((k + 1) % 17) + 1) THEN 0.5 WHEN va = 6 THEN 0.0 WHEN o = choice0 THEN p0 ELSE (1 - p0) / 16 END::DOUBLE) AS ps FROM an),
ok AS (SELECT *, CASE WHEN va = 6 THEN 0.5::DOUBLE ELSE conf END AS cf, list_filter(ps, lambda x: x < 0 OR x > 1) AS outside,
  ps[list_position({quote(_MO)}, choice)] AS own FROM pr),
vd AS (SELECT *, coalesce(va <> 7 AND choice IN ({", ".join(map(quote, _MO))}) AND len(outside) = 0 AND abs(list_sum(ps) - 1) < 0.001
  AND own >= list_max(ps) AND abs(cf - own) < 0.001, false) AS valid, len(list_filter(ps, lambda x: x = own)) > 1 AS tied FROM ok)"""


def _answered(spark, sf_dir, pages=None):
    k, va = F.col("k"), F.col("va")
    rows = (_classified(spark, sf_dir) if pages is None else pages).withColumn("va", k % 11).withColumn("choice0", F.get(F.array(*map(F.lit, _MO)), (k % 17).cast("int"))).withColumn("p0", F.when(k % 3 == 0, 0.97).when(k % 3 == 1, 0.96).otherwise(0.5))

    def p(o, i):
        return F.when((va == 4) & (i == 0), -0.1).when((va == 5) & (i == 1), 0.9).when((va == 6) & ((o == F.col("choice0")) | (i == (k + 1) % 17)), 0.5).when(va == 6, 0.0).when(o == F.col("choice0"), F.col("p0")).otherwise((1 - F.col("p0")) / 16)

    names = F.array(*map(F.lit, _MO))
    full = F.map_from_arrays(names, F.transform(names, p))
    return rows.withColumns({
        "choice": F.when(va == 1, "other").when(va != 2, F.col("choice0")),
        "answer_confidence": F.when(va == 3, 0.2).when(va == 6, 0.5).otherwise(F.col("p0")),
        "probabilities": F.when(va == 7, F.map_filter(full, lambda key, v: key != "ambiguous")).otherwise(full),
        "answered": va != 8,
        "input_tokens": F.when(va != 9, k % 100),
        "truncated": va == 10,
    })


@query(f"""WITH {RULES}, {_ANSWERS} SELECT doc_id, valid FROM vd""")
def v5_valid_answer(spark, sf_dir):
    return _answered(spark, sf_dir).select("doc_id", validate.answer_valid(F.col("choice"), F.col("answer_confidence"), F.col("probabilities")).alias("valid"))


@query("""WITH g AS (SELECT p_brand AS file, p_partkey % 3 AS m, p_size * 100.5 AS w, p_retailprice AS h, 2.0 + p_partkey % 2 AS s FROM part)
SELECT file, count(*) AS pages, count(*) FILTER (ceil(w * s) <= 10000 AND ceil(h * s) <= 10000 AND ceil(w * s) * ceil(h * s) <= 20000000) AS fitting
  FROM g GROUP BY 1""")
def v6_geometry(spark, sf_dir):
    pages = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), (F.col("p_size") * 100.5).alias("w"), F.col("p_retailprice").alias("h"), (F.lit(2.0) + F.col("p_partkey") % 2).alias("s"))
    return pages.groupBy("file").agg(F.count(F.lit(1)).alias("pages"), F.count_if(validate.render_fits(F.col("w"), F.col("h"), F.col("s"))).alias("fitting"))


# --- the model decision

_DECIDED = f"""{RULES}, {_ANSWERS}, rt AS (SELECT *, CASE WHEN {_UNFIT} THEN 'keep' ELSE 'ask' END AS route, CASE WHEN choice IN {NAMED} THEN choice END AS cand FROM vd),
st AS (SELECT *, CASE WHEN route = 'keep' THEN 'keep' WHEN va = 8 THEN 'model_unavailable' WHEN NOT valid OR va = 9 THEN 'invalid_model_response'
  WHEN va = 10 THEN 'model_input_truncated' WHEN tied THEN 'tied_model_choices'
  WHEN cand IS NOT NULL AND len(candidates) > 0 AND NOT list_contains(candidates, cand) THEN 'model_rule_disagreement'
  WHEN "documentType" = 'ambiguous' THEN 'conflicting_category_evidence' WHEN cf < 0.95 THEN 'below_model_gate'
  ELSE 'model_suggestion_requires_validation' END AS s FROM rt),
md AS (SELECT *, CASE WHEN s = 'keep' THEN "documentType" WHEN s IN ('model_unavailable', 'invalid_model_response', 'model_input_truncated') THEN CASE
  WHEN "documentType" = 'ambiguous' THEN 'ambiguous' ELSE 'unknown' END
  WHEN s IN ('tied_model_choices', 'model_rule_disagreement', 'conflicting_category_evidence') THEN 'ambiguous' WHEN s = 'below_model_gate'
  THEN 'unknown' ELSE choice END AS outcome,
  route = 'ask' AND s NOT IN ('model_unavailable', 'invalid_model_response', 'model_input_truncated') AS used FROM st)"""


@query(f"""WITH {_DECIDED} SELECT doc_id, outcome AS "documentType", CASE WHEN s = 'keep' THEN reason ELSE s END AS reason, CASE WHEN route = 'ask'
  THEN 'model' ELSE method END AS method, CASE WHEN used THEN cf END AS confidence,
 array_to_string(CASE WHEN used AND cand IS NOT NULL AND NOT list_contains(candidates, cand) THEN list_append(candidates, cand) ELSE candidates END,
  ',') AS candidates, CASE WHEN route = 'ask' THEN 1 ELSE 0 END::BIGINT AS calls, CASE WHEN used OR s = 'model_input_truncated' THEN k % 100
  ELSE 0 END::BIGINT AS "inputTokens" FROM md""")
def m5_model_decision(spark, sf_dir):
    out = model.decided(_answered(spark, sf_dir, model.route(_classified(spark, sf_dir))))
    return out.select("doc_id", "documentType", "reason", "method", "confidence", F.array_join("candidates", ",").alias("candidates"), "calls", "inputTokens")


@query(f"""WITH {_DECIDED} SELECT truth, count_if(outcome = "documentType") AS retained, count_if("documentType" <> truth
  AND outcome = truth) AS recovered, count_if("documentType" = truth AND outcome <> truth) AS degraded, count_if(truth NOT IN {NAMED}
  AND outcome IN {NAMED}) AS "falseSuggestions" FROM md GROUP BY 1""")
def a8_transitions(spark, sf_dir):
    both = model.decided(_answered(spark, sf_dir, model.route(_classified(spark, sf_dir).withColumn("by_rules", F.col("documentType")))))
    return evaluate.transitions(both, F.col("truth"), F.col("by_rules"), F.col("documentType"), ("truth",))


@query(f"""WITH {RULES}, {_ANSWERS}, x AS (SELECT *, va <> 8 AS answered, choice = truth AS rt FROM vd) SELECT count(*) AS "pagesSent",
  count_if(NOT answered) AS failed, count_if(answered AND NOT valid) AS invalid, count_if(answered AND valid) AS valid, count_if(answered AND valid
  AND choice = truth) AS correct,
 count_if(answered AND valid AND choice = truth AND cf >= 0.95) AS "correctAtGate", count_if(answered AND valid AND choice <> truth
  AND cf >= 0.95) AS "wrongAtGate", count_if(answered AND valid AND va = 10) AS truncated FROM x""")
def a7_model_metrics(spark, sf_dir):
    rows = _answered(spark, sf_dir).withColumn("valid", validate.answer_valid(F.col("choice"), F.col("answer_confidence"), F.col("probabilities"))).withColumn("confidence", F.col("answer_confidence"))
    return evaluate.model_metrics(rows).select("pagesSent", "failed", "invalid", "valid", "correct", "correctAtGate", "wrongAtGate", "truncated")


# --- forms: probabilities from embeddings over a small catalogue

_FORMS = [("form-1040", None), ("form-1098", None), ("form-1099-r", None), ("form-5471", None), ("form-8865", None), ("form-w-2", None), ("form-5471-schedule-e", "form-5471"), ("form-5471-schedule-j", "form-5471"), ("form-8865-schedule-g", "form-8865"), ("form-1098-e", None)]
_FIRST = sorted(i for i, p in _FORMS if p not in tx.FAMILIES) + [tx.NOT_LISTED]
_MEMBERS = {f: sorted(i for i, p in _FORMS if i == f or p == f) for f in ("form-5471", "form-8865")}


def _criteria(spark):
    return spark.createDataFrame([(i, f"L {i}", "", 1, p, None, None) for i, p in _FORMS], forms.CRITERIA_SCHEMA)


def _form_answers(spark, sf_dir):
    e = F.col("embedding")
    first, all_ids = F.array(*map(F.lit, _FIRST)), F.array(*(F.lit(i) for i, _ in _FORMS))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.array(F.lit("short"))).otherwise(F.array(F.lit("x" * 80))).alias("lines"), F.map_from_arrays(first, F.transform(F.slice(e, 1, len(_FIRST)), lambda v: F.abs(v).cast("double"))).alias("form_probabilities"), F.map_from_arrays(all_ids, F.transform(F.slice(e, 20, len(_FORMS)), lambda v: F.abs(v).cast("double"))).alias("subs"), F.get(F.array(*map(F.lit, tx.KINDS)), (F.col("vec_id") % 7).cast("int")).alias("kind_choice"), F.lit(0.9).alias("kind_confidence"), F.lit(10).alias("tokens1"), F.lit(5).alias("tokens2"))
    members = F.when(forms.best(F.col("form_probabilities"), first, tx.NOT_LISTED)["key"] == "form-5471", F.array(*map(F.lit, _MEMBERS["form-5471"]))).otherwise(F.array(*map(F.lit, _MEMBERS["form-8865"])))
    return forms.decide_forms(rows.withColumnRenamed("subs", "sub_probabilities"), first, members, gate=0.1)


def _argmax_sql(names: list[str], values: str) -> str:
    return f"list_reduce(list_transform({quote(names)}, lambda n, i: struct_pack(p := {values}[i], k := n)), lambda a, b: CASE WHEN b.p > a.p THEN b ELSE a END)"


_E1 = "list_transform(embedding[1:9], lambda v: abs(v)::DOUBLE)"
_ID = [i for i, _ in _FORMS]
_SUBS = {f: "[" + ", ".join(f"abs(embedding[{20 + _ID.index(m)}])::DOUBLE" for m in ms) + "]" for f, ms in _MEMBERS.items()}
_FORM_SQL = f"""b AS (SELECT vec_id, vec_id % 7 = 0 AS blank, {_argmax_sql(_FIRST[:-1], _E1)} AS a,
  {_argmax_sql(_MEMBERS["form-5471"], _SUBS["form-5471"])} AS s1, {_argmax_sql(_MEMBERS["form-8865"], _SUBS["form-8865"])} AS s2 FROM embeddings),
f AS (SELECT *, a.k IN ('form-5471', 'form-8865') AS two, CASE WHEN a.k = 'form-5471' THEN s1 ELSE s2 END AS s FROM b),
fr AS (SELECT vec_id, CASE WHEN blank THEN 'blank' WHEN two THEN s.k ELSE a.k END AS form, CASE WHEN blank THEN 1.0 WHEN two THEN least(a.p, s.p)
  ELSE a.p END::DOUBLE AS "formConfidence", CASE WHEN blank THEN 0 WHEN two THEN 2 ELSE 1 END::BIGINT AS calls, CASE WHEN blank THEN 0 WHEN two THEN 15
  ELSE 10 END::BIGINT AS "inputTokens",
  CASE WHEN blank THEN 'blank' ELSE {quote(tx.KINDS)}[(vec_id % 7) + 1] END AS kind, {quote(_ID)}[(vec_id % 10) + 1] AS truth FROM f)"""


@query(f"""WITH {_FORM_SQL} SELECT vec_id, form, kind, "formConfidence", "formConfidence" >= 0.1 AS gated, calls, "inputTokens" FROM fr""")
def m6_two_step_form(spark, sf_dir):
    return _form_answers(spark, sf_dir).select("vec_id", "form", "kind", "formConfidence", "gated", "calls", "inputTokens")


def _scored(spark, sf_dir):
    truth = F.get(F.array(*(F.lit(i) for i, _ in _FORMS)), (F.col("vec_id") % 10).cast("int"))
    return forms.score(_form_answers(spark, sf_dir).withColumn("truth", truth), gate=0.1)


@query(f"""WITH {_FORM_SQL} SELECT vec_id, truth <> form AS wrong, truth <> form OR "formConfidence" < 0.1 AS strict FROM fr""")
def p12_strict_errors(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "wrong", "strict")


@query(f"""WITH {_FORM_SQL} SELECT count(*) AS pages, count_if(truth <> form) AS wrong, count_if(truth <> form OR "formConfidence" < 0.1) AS strict,
  count_if(truth <> form OR "formConfidence" < 0.1) / count(*) AS "strictRate", sum(calls)::BIGINT AS calls,
  sum("inputTokens")::BIGINT AS "inputTokens", sum("inputTokens")::BIGINT * 0.042::DOUBLE / 1e6 AS "estCostUsd" FROM fr""")
def a6_us_summary(spark, sf_dir):
    return forms.summarise(_scored(spark, sf_dir))


@query("SELECT * FROM (VALUES " + ", ".join(f"({quote(i)}, {quote(tx.FAMILIES.get(i, 'L ' + i if i != tx.NOT_LISTED else 'The page belongs to a form or schedule that is NOT one of the options above'))})" for i in _FIRST) + ") t(id, what)")
def m7_first_list(spark, sf_dir):
    return forms.first_list(_criteria(spark)).select("id", "what")


@query("SELECT * FROM (VALUES " + ", ".join(f"({quote(i)})" for i in _MEMBERS["form-5471"]) + ") t(id)")
def j10_family_members(spark, sf_dir):
    return forms.members(_criteria(spark), "form-5471").select("id")


# --- evaluation


def _truth(spark, sf_dir):
    return _classified(spark, sf_dir).select((F.col("k") % 4).alias("d"), "truth", F.col("documentType").alias("prediction"))


_CATS = "c(category) AS (VALUES " + ", ".join(f"({quote(o)})" for o in tx.OUTCOMES) + ")"


@query(f"""WITH {RULES}, {_CATS} SELECT category, (SELECT count(*) FROM r WHERE truth = category) AS cases, (SELECT count(*) FROM r
  WHERE truth = category AND "documentType" = category) AS correct,
 (SELECT count(*) FROM r WHERE truth = category AND "documentType" = category) / nullif((SELECT count(*) FROM r WHERE truth = category), 0) AS recall,
  (SELECT count(*) FROM r WHERE truth = category AND "documentType" = category) / nullif((SELECT count(*) FROM r WHERE "documentType" = category),
  0) AS "precision" FROM c""")
def a4_evaluate(spark, sf_dir):
    return evaluate.per_category(_truth(spark, sf_dir)).select("category", "cases", "correct", "recall", "precision")


_TOTALS = """count(*) AS cases, count_if(truth = prediction) AS correct, count_if(truth = prediction) / count(*) AS accuracy, count_if(truth IN {n}) AS "knownCases", count_if(prediction IN {n}) AS suggestions, count_if(prediction IN {n}) / count(*) AS "suggestionCoverage",
 count_if(prediction IN {n} AND truth = prediction) / nullif(count_if(prediction IN {n}), 0) AS "suggestionPrecision" """.replace("{n}", NAMED)


@query(f"""WITH {RULES}, q AS (SELECT k % 4 AS d, truth, "documentType" AS prediction FROM r) SELECT d, {_TOTALS} FROM q GROUP BY 1""")
def a5_totals(spark, sf_dir):
    return evaluate.totals(_truth(spark, sf_dir), by=("d",))


@query(f"""WITH {synth_sql()}, q AS (SELECT truth, {_KEYWORD} AS prediction FROM sp) SELECT {_TOTALS} FROM q""")
def a5_keyword_totals(spark, sf_dir):
    return evaluate.totals(synth_pages(spark, sf_dir).select("truth", rules.keyword_baseline(F.col("text"), F.col("extraction")).alias("prediction")))


_SETS = list(tx.GATE_CASES)


@query(f"""WITH {RULES}, q AS (SELECT {quote(_SETS)}[(k % 4) + 1] AS dataset, truth, "documentType" AS prediction FROM r), s AS (SELECT dataset,
  count(*) AS cases, count_if(truth = prediction) AS correct, count(DISTINCT truth) FILTER (truth IN {NAMED}) AS kinds FROM q GROUP BY 1)
SELECT dataset, cases, correct, CASE WHEN dataset IN ('development', 'held-out') THEN 15 - kinds ELSE 0 END AS missing, cases >= CASE dataset
  WHEN 'development' THEN 15 WHEN 'held-out' THEN 42 WHEN 'regression' THEN 35 ELSE 23 END AND cases = correct AND (dataset NOT IN ('development',
  'held-out') OR kinds = 15) AS passed FROM s""")
def v10_gates(spark, sf_dir):
    rows = _truth(spark, sf_dir).withColumn("dataset", F.get(F.array(*map(F.lit, _SETS)), F.col("d").cast("int")))
    seen = rows.groupBy("dataset", F.col("truth").alias("category")).agg(F.count(F.lit(1)).alias("cases"))
    return evaluate.gates(evaluate.totals(rows, by=("dataset",)), seen).select("dataset", "cases", "correct", "missing", "passed")


@query("""SELECT l_returnflag AS flag, median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1""")
def a14_medians(spark, sf_dir):
    return evaluate.median_ms(_table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_quantity")


# --- review: page = k, decisions from the truth, some open, some changed

_DEC = f"""{RULES}, dc AS (SELECT *, k AS pg, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN truth WHEN 2 THEN 'unknown' WHEN 3 THEN 'receipt' ELSE "documentType" END AS decision FROM r)"""


def _reviewed(spark, sf_dir):
    k = F.col("k")
    shown = ("page", "textSha256", "documentType", "method", "confidence", "reason", "k", "truth")
    results = written(_classified(spark, sf_dir).withColumn("page", k).select(*shown), "results")
    decisions = results.select("page", "textSha256", F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, F.col("truth")).when(k % 6 == 2, "unknown").when(k % 6 == 3, "receipt").otherwise(F.col("documentType")).alias("decision"))
    return results, review.joined(results, decisions, "0", "0")


@query(f"""WITH {RULES} SELECT k AS page, "textSha256", "documentType" AS suggested, NULL::VARCHAR AS decision FROM r""")
def r1_template(spark, sf_dir):
    return review.decision_template(_classified(spark, sf_dir).withColumn("page", F.col("k")), "0" * 64)


@query(f"""WITH {_DEC} SELECT count(*) AS pages, count(decision) AS reviewed, count(*) - count(decision) AS "notReviewed",
  count_if(decision = "documentType") AS accepted, count_if(decision IS NOT NULL AND "documentType" IN {NAMED}
  AND decision NOT IN {NAMED}) AS "falseSuggestions",
 count_if("documentType" IN {NAMED} AND decision IN {NAMED} AND decision <> "documentType") AS "changedCategory",
  count_if("documentType" IN ('unknown', 'ambiguous') AND decision IN {NAMED}) AS "missedByPipeline", count_if("documentType" = 'unreadable'
  AND decision IN {NAMED}) AS "unreadableButNamed" FROM dc""")
def r2_review_counts(spark, sf_dir):
    return review.review_counts(*_reviewed(spark, sf_dir))


@query(f"""WITH {_DEC}, m(method) AS (VALUES ('rules'), ('model'), ('extraction')) SELECT m.method, count(decision) AS pages,
  count_if(coalesce(decision = "documentType", false)) AS accepted FROM m LEFT JOIN dc ON dc.method = m.method GROUP BY 1""")
def r2_by_method(spark, sf_dir):
    return review.by_method(_reviewed(spark, sf_dir)[1])


@query(f"""WITH {_DEC}, c(category) AS (VALUES {", ".join(f"({quote(t)})" for t in tx.TYPES)}), x AS (SELECT category, (SELECT count(*) FROM dc
  WHERE decision IS NOT NULL AND "documentType" = category) AS suggested, (SELECT count(*) FROM dc WHERE decision = category) AS decided,
  (SELECT count(*) FROM dc WHERE decision = category AND "documentType" = category) AS correct FROM c)
SELECT *, correct / nullif(suggested, 0) AS "precision", correct / nullif(decided, 0) AS recall FROM x""")
def r2_per_category(spark, sf_dir):
    return review.by_category(_reviewed(spark, sf_dir)[1])


@query(f"""WITH {_DEC} SELECT k AS page, "textSha256", "documentType" AS suggested, method, NULL::DOUBLE AS confidence, reason, decision FROM dc
  WHERE decision IS NOT NULL""")
def r2_labels(spark, sf_dir):
    return review.labels(_reviewed(spark, sf_dir)[1])


# --- catalogue builder


@query(rf"""WITH i(id) AS (VALUES {", ".join(f"({quote(i)})" for i in catalogue.INFORMATION_RETURNS)}), s AS (SELECT id, regexp_extract(id,
  '(\d{{3,4}})', 1) AS st, regexp_extract(id, {_P}, 1) AS b, regexp_extract(id, {_P}, 2) AS sc FROM i), t AS (SELECT id, CASE WHEN st = '' THEN id
  ELSE st END AS stem, CASE WHEN sc <> '' THEN 'Schedule ' || upper(sc) || ' (Form ' || upper(b) || ')' ELSE 'Form ' || upper(b) END AS label FROM s)
SELECT a.id, string_agg(c.label, '; ' ORDER BY c.id) AS not_for FROM t a JOIN t c ON a.stem = c.stem AND a.id <> c.id GROUP BY 1""")
def j5_sibling_notfor(spark, sf_dir):
    entries = spark.createDataFrame([(i,) for i in catalogue.INFORMATION_RETURNS], "id string")
    return catalogue.sibling_labels(entries).select("id", F.array_join("not_for", "; ").alias("not_for"))


@query("""WITH a(id) AS (VALUES ('form-1040-schedule-a'), ('form-1040-nr-schedule-nec'), ('form-8995-a-schedule-a'), ('form-1040-schedule-1-a'),
  ('form-w-2g'), ('form-4868'), """ + ", ".join(f"({quote(i)})" for i in catalogue.INFORMATION_RETURNS) + """) SELECT DISTINCT id FROM a""")
def u1_id_union(spark, sf_dir):
    names = spark.createDataFrame([(n.strip(),) for n in ("Form 1040 Schedule A", "Form 1040NR Schedule NEC", "Form 8995A Schedule A", "Form 1040 Schedule 1A", "Form W2G", "Form 4868", "Form 1098", "Form 499W2PR", "Other")], "name string")
    return catalogue.all_ids(names)


@query("""WITH l AS (SELECT 'form-1099-' || chr(97 + (o_custkey % 26)::INTEGER) AS id, (o_orderkey % 12)::INTEGER AS num, o_orderkey AS page
  FROM orders), o AS (SELECT id, num, min(page) AS page FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page) AS n
  FROM o)
SELECT id, string_agg(num || ' Amount withheld ' || page, '; ' ORDER BY n) AS boxes FROM r WHERE n <= 8 GROUP BY 1""")
def o6_first_boxes(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    pages = o.select(F.concat(F.lit("form-1099-"), F.chr(F.lit(97) + F.col("o_custkey") % 26)).alias("id"), F.col("o_orderkey").alias("page"), F.array(F.lit("x" * 70), F.concat((F.col("o_orderkey") % 12).cast("string"), F.lit(" Amount withheld "), F.col("o_orderkey").cast("string"))).alias("lines"))
    return catalogue.first_boxes(pages).select("id", F.array_join("boxes", "; ").alias("boxes"))


@query()
def k1_manifest_json(spark, sf_dir):
    """The written manifests: one JSON a document; no SQL form."""
    from ..sources.writers import manifest_json

    return manifest_json(_classified(spark, sf_dir))


@query()
def p5_adversarial(spark, sf_dir):
    """Pages near the length limit that made naive patterns slow or overflow; rows only."""
    pages = [("TAX INVOICE\n" + "GST " * 49990), ("Tax invoice\n" + "total " * 33000), ("BAS\n" + "G1 " * 66000), ("BAS\n" + "1A " * 66000), (" " * 190000 + "\nPlease send the receipt"), ("\n" * 190000 + "Bank statement request"), ("\r\n" * 95000 + "Bank statement request"), (" \t\n" * 63000 + "Bank statement request"), ("re: " * 45000 + "x")]
    rows = [(f"a{i}", 1, t, "native", None, None, None) for i, t in enumerate(pages)]
    return rules.classify(spark.createDataFrame(rows, rules.PAGE_SCHEMA)).select("doc_id", "documentType", "reason")
