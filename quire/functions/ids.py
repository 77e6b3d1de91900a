"""Form identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as tx

# The grammar of ids and the shapes of names.
GRAMMAR = r"form-(\d+(-[a-z]{1,4})?|w-2[a-z]{0,2}|t|rrb-1042-s|ssa-1042-s|499-w-2-pr)(-schedule-(\d+(-[a-z])?|[a-z]{1,3}(-\d)?))?(/p\d+)?"
NAME = r"\AForm (\S+)(?: Schedule (\S+))?\z"
PARTS = r"\Aform-(.+?)(?:-schedule-(.+))?\z"


def is_form_id(id_: Column) -> Column:
    return id_.rlike(rf"\A(?:{GRAMMAR}|blank)\z")


def form_of(id_: Column) -> Column:
    return F.split_part(id_, F.lit("/"), F.lit(1))


def page_of(id_: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(id_, r"/p(\d+)\z", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def parent_of(id_: Column) -> Column:
    return F.nullif(F.regexp_extract(form_of(id_), r"\A(form-.+?)-schedule-", 1), F.lit(""))


def id_of_name(name: Column, strict: bool = True) -> Column:
    """A form's display name as an id; a name of another shape is an error, or null where not ``strict``."""
    from .text import strip

    trimmed = strip(name)
    form = F.upper(F.regexp_extract(trimmed, NAME, 1))
    for pattern, to in ((r"\AW2", "W-2"), (r"\A(RRB|SSA)1042S\z", "$1-1042-S"), (r"\A499W2PR\z", "499-W-2-PR"), (r"\A(\d+)([A-Z]+)\z", "$1-$2")):
        form = F.regexp_replace(form, pattern, to)
    schedule = F.upper(F.regexp_extract(trimmed, NAME, 2))
    for pattern in (r"\A([A-Z])(\d)\z", r"\A(\d)([A-Z])\z"):
        schedule = F.regexp_replace(schedule, pattern, "$1-$2")
    out = F.concat(F.lit("form-"), F.lower(form), F.when(schedule != "", F.concat(F.lit("-schedule-"), F.lower(schedule))).otherwise(""))
    bad = F.raise_error(F.lit("not a form name")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(trimmed.rlike(NAME), out).otherwise(bad)


def label_of(id_: Column) -> Column:
    form = form_of(id_)
    base, schedule = F.upper(F.regexp_extract(form, PARTS, 1)), F.upper(F.regexp_extract(form, PARTS, 2))
    return F.when(~form.rlike(PARTS), id_).when(schedule != "", F.concat(F.lit("Schedule "), schedule, F.lit(" (Form "), base, F.lit(")"))).otherwise(F.concat(F.lit("Form "), base))


def pdf_name(id_: Column, strict: bool = True) -> Column:
    form = form_of(id_)
    base, s = (F.replace(F.regexp_extract(form, PARTS, g), F.lit("-"), F.lit("")) for g in (1, 2))
    bad = F.raise_error(F.lit("no file for this id")).cast("string") if strict else F.lit(None).cast("string")
    # Files that do not follow the rule.
    return (
        F.when(~form.rlike(PARTS), bad)
        .when(s == "", F.concat(F.lit("f"), base, F.lit(".pdf")))
        .when((base == "1040") & (s == "8812"), "f1040s8.pdf")
        .when((base == "1040") & (s == "eic"), "f1040sei.pdf")
        .when(base == "1040nr", F.concat(F.lit("f1040nr"), F.substring(s, 1, 1), F.lit(".pdf")))
        .when((base == "1118") & (s == "i"), "f1118s1.pdf")
        .when(base == "8995a", F.concat(F.lit("f8995a"), s, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("f"), base, F.lit("s"), s, F.lit(".pdf")))
    )


def family_of(id_: Column, parent: Column) -> Column:
    """The family that a form is asked about under: its parent, where that is one of the families, else itself."""
    return F.when(parent.isin(*tx.FAMILIES), parent).otherwise(id_)


def stem_of(id_: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(id_, r"(\d{3,4})", 1), F.lit("")), id_)
