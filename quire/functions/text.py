"""Text shaping as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import taxonomy as tx
from .literals import matches
from .regexes import BLANK

NL = "\n"
#: The same white space as characters: ends are trimmed by Spark's trim, which looks at the ends only, where a pattern is tried at every place.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{BLANK}]", c, re.ASCII))
LEFT_BLANK = "(?i)intentionally left blank|left blank intentionally"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with a value that it names several times made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_blank(text: Column) -> Column:
    """Nothing but white space, in ECMAScript's sense."""
    return text.rlike(rf"\A[{BLANK}]*+\z")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def utf16_prefix(text: Column, units: int) -> Column:
    """The first so many UTF-16 units; a pair that would be split is left out."""

    def prefix(text: Column) -> Column:
        # code points are no more than units, so no more of them are needed
        units_of = F.encode(F.substring(text, 1, units), "UTF-16BE")
        last = F.hex(F.substring(units_of, 2 * units - 1, 1))
        cut = F.when(last.between("D8", "DB"), F.substring(units_of, 1, 2 * units - 2)).otherwise(F.substring(units_of, 1, 2 * units))
        return F.when((F.length(text) <= units) & (utf16_length(text) <= units), text).otherwise(F.decode(cut, "UTF-16BE"))

    return let(text, prefix)


def mask_lines(text: Column, confidence: Column) -> Column:
    """Lines that were read with confidence under RELIABLE become empty."""
    lines = F.transform(F.split(text, NL), lambda line, i: F.when(F.get(confidence, i) < tx.RELIABLE, F.lit("")).otherwise(line))
    return F.when(confidence.isNull(), text).otherwise(F.array_join(lines, NL))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(df: DataFrame, col: str) -> DataFrame:
    """Compatibility-normalise a column and drop carriage returns; only rows beyond ASCII go through Python."""
    wide = F.coalesce(F.col(col).rlike(r"[^\x00-\x7F]"), F.lit(False))
    both = df.where(~wide).unionByName(df.where(wide).withColumn(col, _nfkc(F.col(col))))
    return both.withColumn(col, F.replace(F.col(col), F.lit("\r"), F.lit("")))


def solid_lines(text: Column) -> Column:
    return F.filter(F.split(text, NL), lambda line: ~is_blank(line))


def heading_window(text: Column) -> Column:
    """The first lines that are not blank."""
    return F.array_join(F.slice(solid_lines(text), 1, tx.HEADING_LINES), NL)


def lines_of(text: Column) -> Column:
    """Lines without trailing white space, blank ones dropped."""
    return F.filter(F.transform(F.split(text, NL), strip_end), lambda line: line != "")


def page_state(lines: Column, body_chars: int = 2500) -> Column:
    """struct(header, body, footer): 12 lines, the middle cut to ``body_chars``, and 6 lines on pages over 18 lines."""
    n, long = F.size(lines), F.size(lines) > 18
    body = F.array_join(F.slice(lines, 13, F.greatest(F.when(long, n - 18).otherwise(n - 12), F.lit(0))), NL)
    return F.struct(
        F.array_join(F.slice(lines, 1, 12), NL).alias("header"),
        utf16_prefix(body, body_chars).alias("body"),
        F.when(long, F.array_join(F.slice(lines, F.greatest(n - 5, F.lit(1)), 6), NL)).otherwise("").alias("footer"),
    )


def is_blank_page(lines: Column) -> Column:
    return let(strip(F.array_join(lines, " ")), lambda said: (F.length(said) < 60) | let(F.lower(said), lambda low: matches(said, low, LEFT_BLANK, LEFT_BLANK)))


def is_cover_sheet(lines: Column) -> Column:
    return F.coalesce(F.startswith(strip(F.get(lines, F.lit(0))), F.lit("Attention")), F.lit(False))


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)
