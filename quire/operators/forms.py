"""Form pages: option lists over a criteria table, the two-step form decision, and its scoring.

A criteria table has id, label, title, page_count, parent, boxes and not_for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import taxonomy as tx
from ..functions import text as tf
from ..tables import written
from .model import Backend, ask_states, best, union_all
from .validate import InvalidInput

CRITERIA_SCHEMA = "id string, label string, title string, page_count int, parent string, boxes array<string>, not_for array<string>"
RESULT_FIELDS = ["form", "kind", "formConfidence", "kindConfidence", "stepConfidences", "gated", "calls", "inputTokens"]


def option(criteria: DataFrame) -> DataFrame:
    """(id, what, examples, not_for) of each entry."""
    no = F.when(F.size(F.coalesce("not_for", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Not "), F.array_join("not_for", ", ")))
    what = F.when(F.coalesce("title", F.lit("")) != "", F.concat("label", F.lit(" — "), "title")).otherwise(F.col("label"))
    return criteria.select("id", what.alias("what"), F.when(F.size(F.coalesce("boxes", F.array().cast("array<string>"))) > 0, F.col("boxes")).alias("examples"), no.alias("not_for"))


def first_list(criteria: DataFrame) -> DataFrame:
    """Options of the first question: every entry that is its own family, families by their description, and the way out; in id order."""
    roots = criteria.where(ids.family_of(F.col("id"), F.col("parent")) == F.col("id"))
    described = F.create_map(*(F.lit(x) for pair in tx.FAMILIES.items() for x in pair))
    plain = option(roots)
    family = F.col("id").isin(*tx.FAMILIES)
    plain = plain.select("id", F.when(family, F.try_element_at(described, F.col("id"))).otherwise(F.col("what")).alias("what"), F.when(~family, F.col("examples")).alias("examples"), F.when(~family, F.col("not_for")).alias("not_for"))
    out = criteria.sparkSession.createDataFrame([(tx.NOT_LISTED, tx.NOT_LISTED_WHAT, None, None)], "id string, what string, examples array<string>, not_for string")
    return plain.withColumn("last", F.lit(0)).unionByName(out.withColumn("last", F.lit(1))).orderBy("last", "id").drop("last")


def members(criteria: DataFrame, parent: str) -> DataFrame:
    """A family's entries, itself included, in id order."""
    return criteria.where((F.col("id") == parent) | (F.col("parent") == parent)).orderBy("id")


def criteria_dict(options: DataFrame) -> dict[str, dict]:
    """Options as a model is asked them. The table is a catalogue, one row a form."""
    return {r.id: {k: v for k, v in (("what", r.what), ("examples", r.examples), ("not_for", r.not_for)) if v is not None} for r in options.collect()}


def first_questions(criteria: DataFrame) -> dict:
    """What every page is asked in its first call: its kind, and its form or family."""
    listed = criteria_dict(first_list(criteria))
    return {
        "kind": {"type": "choice", "instructions": tx.KIND_QUESTION, "criteria": tx.KIND_OPTIONS},
        "form": {"type": "choice", "instructions": tx.FORM_QUESTION, "criteria": listed},
    }


def member_questions(criteria: DataFrame, family: str) -> dict:
    """What a page of a family is asked in its second call."""
    options = criteria_dict(option(members(criteria, family)).orderBy("id")) | {tx.NOT_LISTED: {"what": tx.NOT_A_MEMBER_WHAT}}
    return {"sub": {"type": "choice", "instructions": tx.MEMBER_QUESTION.format(family=tx.FAMILIES[family]), "criteria": options}}


def classify_pages(pages: DataFrame, criteria: DataFrame, backend: Backend, gate: float = tx.GATE) -> DataFrame:
    """The two-step run over pages (doc_id, page, lines, others): adds the fields of :data:`RESULT_FIELDS`.

    A page that is not blank is asked its kind and form in one call; one whose first choice is a family is asked for the member in
    another, a stage for each of the fixed families. Answers are written before they are read, so no call is made twice; rows that
    share doc_id and page share their answers. Where a call fails, the page has an empty form with confidence -1 and no kind, and
    is never gated. The catalogue is one row a form and is read once."""
    catalogue = criteria.select("id", "parent").collect()
    families = sorted({r.parent for r in catalogue} & set(tx.FAMILIES) | {r.id for r in catalogue} & set(tx.FAMILIES))
    questions = first_questions(criteria)
    first_order = F.array(*map(F.lit, questions["form"]["criteria"]))
    key = F.concat_ws("/", F.col("doc_id"), F.col("page").cast("string"))
    # written: what is made of a page's lines is made once, however often it is read
    seen = lambda lines: F.struct(lines.alias("lines"), tf.is_blank_page(lines).alias("blank"), F.to_json(tf.page_state(lines)).alias("state"))
    others = [c for c in pages.columns if c != "lines"]
    shown = pages.select(*others, key.alias("_page_key"), F.explode(F.transform(F.array("lines"), seen)).alias("_s"))
    shown = written(shown.select(*others, "_page_key", "_s.lines", F.col("_s.blank").alias("_blank"), F.when(~F.col("_s.blank"), F.col("_s.state")).alias("_state")), "pages")
    keyed = shown.drop("_state")
    states = shown.where("NOT _blank").select(F.col("_page_key").alias("key"), F.col("_state").alias("state"))
    said = written(ask_states(states, backend, questions), "first_answers")
    form, kind = F.try_element_at("answers", F.lit("form")), F.try_element_at("answers", F.lit("kind"))
    first = said.select(
        F.col("key").alias("_page_key"), kind["choice"].alias("kind_choice"), kind["confidence"].alias("kind_confidence"), form["probabilities"].alias("form_probabilities"),
        F.col("input_tokens").alias("tokens1"), best(form["probabilities"], first_order, tx.NOT_LISTED)["key"].alias("_family"),
    )
    empty = states.sparkSession.createDataFrame([], "_page_key string, sub_probabilities map<string, double>, tokens2 bigint")
    parts, orders = [empty], F.array().cast("array<string>")
    for family in families:
        asked = member_questions(criteria, family)
        chosen = states.join(first.where(F.col("_family") == family).select(F.col("_page_key").alias("key")), "key", "left_semi")
        sub = F.try_element_at("answers", F.lit("sub"))["probabilities"]
        parts.append(ask_states(chosen, backend, asked).select(F.col("key").alias("_page_key"), sub.alias("sub_probabilities"), F.col("input_tokens").alias("tokens2")))
        orders = F.when(F.col("_family") == family, F.array(*map(F.lit, asked["sub"]["criteria"]))).otherwise(orders)
    second = written(union_all(parts), "second_answers")
    ready = keyed.join(first, "_page_key", "left").join(second, "_page_key", "left")
    out = decide_forms(ready, first_order, orders, gate, F.col("_blank"))
    return out.select(*pages.columns, *(c for c in RESULT_FIELDS))


def decide_forms(pages: DataFrame, option_order: Column, member_order: Column, gate: float = tx.GATE, blank: Column | None = None) -> DataFrame:
    """Adds the result to pages that carry lines and the answers: kind_choice, kind_confidence, form_probabilities, tokens1,
    and, for pages whose first choice is a family, sub_probabilities and tokens2.

    A blank page is answered without a call; ``blank`` tells, by default from the lines. The confidence of two steps is the lower one.
    """
    blank = tf.is_blank_page(F.col("lines")) if blank is None else blank
    pages = pages.withColumn("_1", best(F.col("form_probabilities"), option_order, tx.NOT_LISTED)).withColumn("_2", best(F.col("sub_probabilities"), member_order, tx.NOT_LISTED))
    two = F.col("_1.key").isin(*tx.FAMILIES)
    steps = F.when(blank, F.array(F.lit(1.0))).when(two, F.array("_1.p", "_2.p")).otherwise(F.array("_1.p"))
    pages = pages.withColumns({
        "form": F.when(blank, "blank").when(two, F.col("_2.key")).otherwise(F.col("_1.key")),
        "kind": F.when(blank, "blank").otherwise(F.col("kind_choice")),
        "stepConfidences": steps,
        "formConfidence": F.array_min(steps),
        "kindConfidence": F.when(blank, F.lit(1.0)).otherwise(F.col("kind_confidence")),
        "calls": F.when(blank, 0).when(two, 2).otherwise(1).cast("long"),
        "inputTokens": F.when(blank, 0).otherwise(F.coalesce("tokens1", F.lit(0)) + F.when(two, F.coalesce("tokens2", F.lit(0))).otherwise(0)).cast("long"),
    })
    return pages.withColumn("gated", F.col("formConfidence") >= gate).drop("_1", "_2")


def asks_members(option_order: Column) -> Column:
    """The page's first choice is a family, so its members are asked next."""
    return best(F.col("form_probabilities"), option_order, tx.NOT_LISTED)["key"].isin(*tx.FAMILIES)


def score(results: DataFrame, truth: str = "truth", gate: float = tx.GATE) -> DataFrame:
    """Adds wrong, and strict: wrong or under the gate."""
    wrong = ~F.col(truth).eqNullSafe(F.col("form"))
    return results.withColumn("wrong", wrong).withColumn("strict", wrong | (F.col("formConfidence") < gate))


def summarise(scored: DataFrame, usd_per_million: float = tx.USD_PER_MILLION_TOKENS) -> DataFrame:
    out = scored.agg(F.count(F.lit(1)).alias("pages"), F.count_if("wrong").alias("wrong"), F.count_if("strict").alias("strict"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("inputTokens"), F.lit(0)).alias("inputTokens"))
    return out.select("pages", "wrong", "strict", F.coalesce(F.try_divide("strict", "pages"), F.lit(0.0)).alias("strictRate"), "calls", "inputTokens", (F.col("inputTokens") * usd_per_million / 1e6).alias("estCostUsd"))


def strict_errors(scored: DataFrame) -> DataFrame:
    """Least confident first."""
    return scored.where("strict").orderBy("formConfidence", "label", "page")


def blank_jobs(manifest: DataFrame) -> DataFrame:
    """One row a page of each listed file; truth is ``blank`` for its blank pages."""
    pages = manifest.withColumn("page", F.explode(F.sequence(F.lit(1), "pages"))) if "pages" in manifest.columns else manifest
    return pages.select(F.concat("id", F.lit(".pdf")).alias("file"), F.when(F.array_contains("blankPages", F.col("page")), "blank").otherwise(F.col("id")).alias("truth"), "page", F.col("pages").alias("pageCount"), F.col("id").alias("label"))


def bench_truth(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds the form that a benchmark file's name stands for; an unknown name is an error."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\.pdf\z", 1), r"_\d+\z", "")
    stem = F.when(F.contains(stem, F.lit("_2024")), F.concat(F.substring_index(stem, "_2024", 1), F.substring(stem, F.instr(stem, "_2024") + 5, F.length(stem)))).otherwise(stem)
    known = files.sparkSession.createDataFrame(list(tx.STEM_FORMS.items()), "stem string, truth string")
    out = files.withColumn("stem", stem).join(F.broadcast(known), "stem", "left")
    if not out.where("truth IS NULL").isEmpty():
        raise InvalidInput("No id for a benchmark file.")
    return out
