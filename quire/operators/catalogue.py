"""Building the forms catalogue from ids and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tf
from .validate import InvalidInput

# Information returns, forms without a public file, files and titles that differ from the rule, and the patterns
# of titles and box labels.
INFORMATION_RETURNS = [
    "form-1097-btc", "form-1098", "form-1098-c", "form-1098-e", "form-1098-f", "form-1098-q", "form-1098-t", "form-1099-a", "form-1099-b", "form-1099-c", "form-1099-cap", "form-1099-da", "form-1099-div",
    "form-1099-g", "form-1099-h", "form-1099-int", "form-1099-k", "form-1099-ls", "form-1099-ltc", "form-1099-misc", "form-1099-nec", "form-1099-oid", "form-1099-patr", "form-1099-q", "form-1099-s",
    "form-1099-sa", "form-1099-sb", "form-3921", "form-3922", "form-5498", "form-5498-esa", "form-5498-qa", "form-5498-sa", "form-1095-a", "form-1095-b", "form-1095-c", "form-1042-s", "form-w-2c",
    "form-1065-schedule-k-1", "form-1120-s-schedule-k-1",
]
NO_PUBLIC_FILE = ["form-499-w-2-pr", "form-rrb-1042-s", "form-ssa-1042-s"]
FILES = {"form-1099-misc": "f1099msc.pdf", "form-1099-patr": "f1099ptr.pdf", "form-5498-esa": "f5498e.pdf", "form-1120-s-schedule-k-1": "f1120ssk.pdf"}
BASE_URL = "https://www.irs.gov/pub/irs-pdf/"
URLS = {"form-8845": "https://www.irs.gov/pub/irs-prior/f8845--2022.pdf", "form-1099-b": "https://www.irs.gov/pub/irs-pdf/f1099b--2025.pdf"}
TITLES = {
    "form-1098-e": "Student Loan Interest Statement — RECIPIENT'S/LENDER'S name, BORROWER'S name",
    "form-1098": "Mortgage Interest Statement — RECIPIENT'S/LENDER'S name, PAYER'S/BORROWER'S name",
}
BOXED = r"\Aform-(1099|1098|5498|1095|1097|1042|w-2|3921|3922)"
TITLE_NOISE = r"(Department of the Treasury|Internal Revenue Service|OMB No\.? ?\d{4}-\d{4}|Go to www\.irs\.gov\S*|www\.irs\.gov\S*|Attach to .*?\.|▶|►|VOID|CORRECTED|\(if checked\)|Cat\. No\. \S+|For Privacy Act.*|\b(19|20)\d\d\b|\d{4,5})"
#: Characters with which noise begins: the pattern's branches are tried only there.
NOISE_STARTS = r"DIOGwA▶►VC(F\d"
BOX = r"(?<![\w$,.\-/])(\d{1,2}[a-z]?)\s{1,4}([A-Z][^\n]{4,70}?)(?=\s{3,}|\z)"
BOX_STOP = r"(?i)\A(form|schedule|see |go to|attach|enter|if you|for )"
MOST_BOXES, BOX_CHARS, TITLE_CHARS, TITLE_LINES = 8, 60, 80, 8
#: Characters of a text without noise in which a title is looked for first.
TITLE_WITHIN = 1000


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def all_ids(names: DataFrame, name: str = "name") -> DataFrame:
    """Ids of listed forms together with the information returns, without those that have no public file; in order, all in the grammar."""
    listed = names.where(F.col(name).rlike(r"\AForm \S+")).select(ids.id_of_name(F.col(name)).alias("id"))
    more = names.sparkSession.createDataFrame([(i,) for i in INFORMATION_RETURNS], "id string")
    gone = names.sparkSession.createDataFrame([(i,) for i in NO_PUBLIC_FILE], "id string")
    out = listed.union(more).distinct().join(F.broadcast(gone), "id", "left_anti")
    if not out.where(~ids.is_form_id(F.col("id"))).isEmpty():
        raise InvalidInput("An id violates the grammar.")
    return out.orderBy("id")


def file_url(id_: Column) -> Column:
    return F.coalesce(_lookup(URLS, id_), F.concat(F.lit(BASE_URL), F.coalesce(_lookup(FILES, id_), ids.pdf_name(id_, strict=False))))


def title_of(lines: Column) -> Column:
    """The first lines without noise, white space folded, cut to TITLE_CHARS. White space is folded in the beginning of the text only, and in all of it where
    the beginning gives no whole title: folding is local, so the first characters are the same."""
    joined = F.regexp_replace(F.array_join(F.slice(lines, 1, TITLE_LINES), " "), rf"(?=[{NOISE_STARTS}]){TITLE_NOISE}", " ")
    folded = lambda text: F.regexp_replace(text, rf"[{tf.BLANK}]+", " ")

    def whole(text: Column) -> Column:
        begun = F.ltrim(folded(F.substring(text, 1, TITLE_WITHIN)))
        return tf.let(begun, lambda b: F.when(F.length(b) > TITLE_CHARS + 1, b).otherwise(tf.strip(folded(text))))

    return tf.utf16_prefix(tf.let(joined, whole), TITLE_CHARS)


def first_titles(pages: DataFrame) -> DataFrame:
    """(id, title): from the first page, of rows (id, page, lines), that is neither blank nor a cover sheet and gives a title."""
    # generated rows: a test on a projected column would be moved below the projection, and lines that are made of a text made anew for each use
    seen = lambda lines: F.struct((~tf.is_blank_page(lines) & ~tf.is_cover_sheet(lines)).alias("good"), title_of(lines).alias("title"))
    found = pages.select("id", "page", F.explode(F.transform(F.array("lines"), seen)).alias("s"))
    return found.where("s.good AND s.title <> ''").groupBy("id").agg(F.min_by("s.title", "page").alias("title"))


def first_boxes(pages: DataFrame) -> DataFrame:
    """(id, boxes): the first eight box labels of forms that have boxes, each number once, in page, line and place order."""
    good = pages.where(F.col("id").rlike(BOXED) & ~tf.is_blank_page(F.col("lines")) & ~tf.is_cover_sheet(F.col("lines")))
    lines = good.select("id", "page", F.posexplode("lines").alias("line", "text"))
    hits = lines.select("id", "page", "line", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(BOX), 1).alias("number"), F.regexp_extract_all("text", F.lit(BOX), 2).alias("label"))).alias("place", "m"))
    label = tf.strip(F.regexp_replace(F.col("m.label"), r"[ .]{3,}", " "))
    kept = hits.select("id", F.col("m.number").alias("number"), label.alias("label"), F.struct("page", "line", "place").alias("at")).where((F.length("label") >= 6) & ~F.col("label").rlike(BOX_STOP))
    once = kept.groupBy("id", "number").agg(F.min_by("label", "at").alias("label"), F.min("at").alias("at"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where(F.col("n") <= MOST_BOXES)
    out = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", tf.utf16_prefix(F.concat_ws(" ", "number", "label"), BOX_CHARS).alias("box")))).alias("b"))
    return out.select("id", F.col("b.box").alias("boxes"))


def sibling_labels(entries: DataFrame) -> DataFrame:
    """(id, not_for): labels of the other forms with the same stem, in id order."""
    stems = entries.select("id", ids.stem_of(F.col("id")).alias("stem"))
    other = stems.select(F.col("id").alias("other"), "stem")
    pairs = stems.join(other, "stem").where("id <> other")
    out = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", ids.label_of(F.col("other")).alias("label")))).alias("o"))
    return out.select("id", F.col("o.label").alias("not_for"))


def build(forms: DataFrame, pages: DataFrame) -> DataFrame:
    """Criteria entries of forms (id) from their page lines (id, page, lines)."""
    counts = pages.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    entries = forms.select("id").join(counts, "id").join(first_titles(pages), "id", "left").join(first_boxes(pages), "id", "left")
    entries = entries.join(sibling_labels(entries), "id", "left")
    id_ = F.col("id")
    return entries.select("id", ids.label_of(id_).alias("label"), F.coalesce(_lookup(TITLES, id_), "title", F.lit("")).alias("title"), "page_count", ids.parent_of(id_).alias("parent"), "boxes", "not_for").orderBy("id")


def manifest(forms: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, source, url, pages, blankPages) in id order."""
    blank = F.array_sort(F.collect_list(F.when(tf.is_blank_page(F.col("lines")), F.col("page"))))
    seen = pages.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("pages"), blank.alias("blankPages"))
    source = F.when(F.col("id").isin(*INFORMATION_RETURNS), "info").otherwise("mef")
    return forms.select("id").join(seen, "id").select("id", source.alias("source"), file_url(F.col("id")).alias("url"), "pages", "blankPages").orderBy("id")


def counters(criteria: DataFrame, listed: DataFrame) -> DataFrame:
    a = criteria.agg(F.count(F.lit(1)).alias("forms"), F.count("boxes").alias("with_boxes"), F.count("parent").alias("schedules"))
    return a.crossJoin(listed.agg(F.sum("pages").alias("pages"), F.sum(F.size("blankPages")).alias("blank_pages")))
