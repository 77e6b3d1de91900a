"""Scans: page packs as text, Markdown, JSON and PDF; manifests and decisions; labelled cases; form lists and benchmark folders.

Files are found and read by Spark's readers, so any file system that Spark opens will do. PDF and OCR engines are not part of
this library: a reader takes a function from a file's bytes to page records, loaded once a task.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators.rules import PAGE_SCHEMA
from ..operators.validate import InvalidInput, duplicates, pack_report, page_valid, require
from ..tables import written_checked

JSON_PAGE = "struct<page:bigint,text:string,extraction:string,warnings:array<string>,ocrEngine:string,ocrLineConfidence:array<double>>"
CASE = f"struct<id:string,`group`:string,label:string,{JSON_PAGE[len('struct<page:bigint,'):]}"
RESULT = "struct<page:bigint,taxonomyVersion:string,documentType:string,candidates:array<string>,method:string,confidence:double,requiresReview:boolean,reason:string,extraction:string,ocrEngine:string,warnings:array<string>,evidence:array<string>,textSha256:string,calls:bigint,inputTokens:bigint>"
MANIFEST = f"struct<schemaVersion:string,mode:string,results:array<{RESULT}>>"
DECISIONS = "struct<schemaVersion:string,manifestSha256:string,reviewer:string,reviewedAt:string,decisions:array<struct<page:bigint,textSha256:string,suggested:string,decision:string>>>"
# Digests of the two evaluation sets that may not change.
PINNED = {"development": "cdb8cfa78d6df8d5a49c01d2d0d51272fe11c3bbf6b0843f3cb154e0e9f40fa9", "held-out": "96e115e6d3d3e63747b8a09cceaddfb4c6e500b9ca47a79e64786990ed094827"}


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw) of text files, each whole; files over the size limit refuse the input before any is read."""
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    require(sizes, F.col("length") <= tx.MAX_FILE_BYTES, "An input exceeds the 50 MiB limit.")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("raw"))


def _no_mark(raw):
    return F.regexp_replace(raw, r"\A﻿", "")


def _pages(df: DataFrame, page: str = "p") -> DataFrame:
    return df.select("doc_id", "pos", *(F.col(f"{page}.{a}").alias(b) for a, b in (("page", "page"), ("text", "text"), ("extraction", "extraction"), ("warnings", "warnings"), ("ocrEngine", "ocr_engine"), ("ocrLineConfidence", "ocr_line_confidence"))))


def split_form_feeds(texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A page for each part between form feeds, numbered from 1."""
    parts = texts.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\f")).alias("pos", "text"))
    return parts.select("doc_id", "pos", (F.col("pos") + 1).cast("long").alias("page"), "text", F.lit("native").alias("extraction"), F.lit(None).cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("ocr_engine"), F.lit(None).cast("array<double>").alias("ocr_line_confidence"))


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    return split_form_feeds(_whole(spark, path), "file", "raw")


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page arrays, in array order (pos); a leading byte order mark is ignored."""
    raw = _whole(spark, path).select(F.col("file").alias("doc_id"), F.from_json(_no_mark(F.col("raw")), f"array<{JSON_PAGE}>").alias("a"))
    require(raw, F.col("a").isNotNull(), "An input is not a JSON page array.")
    return _pages(raw.select("doc_id", F.posexplode("a").alias("pos", "p")))


def read_pdf_pages(spark: SparkSession, path: str, extractor: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """Pages of PDF files by a pluggable extractor of {page, text, extraction, warnings?, ocr_engine?, ocr_line_confidence?}.

    A file that fails gives one page with extraction ``failed``; the error's text is dropped, as it can echo content.
    """
    columns = ["doc_id", "pos", "page", "text", "extraction", "warnings", "ocr_engine", "ocr_line_confidence"]

    def run(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    got = list(extractor(bytes(content)))
                except Exception:  # noqa: BLE001
                    got = [{"page": 1, "text": "", "extraction": "failed"}]
                rows += [{**dict.fromkeys(columns), **p, "doc_id": file, "pos": i} for i, p in enumerate(got)]
            yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").load(path)
    require(files.select("length"), F.col("length") <= tx.MAX_FILE_BYTES, "An input exceeds the 50 MiB limit.")
    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA.replace("page BIGINT", "pos INT, page BIGINT"))


def ocr_page(page: int, lines: list[tuple[str, float]], engine: str = tx.ENGINES[1]) -> dict:
    """A page record from what an engine recognised: (text, score) pairs, whose text may itself hold line breaks.

    A score that is no number from 0 to 1 is an error of the engine, which the caller treats as a failed reading."""
    printed = [(part, float(score)) for said, score in lines for part in said.split("\n")]
    if any(not 0 <= score <= 1 for _, score in printed):
        raise ValueError("an OCR score is not between 0 and 1")
    record = {"page": page, "text": "\n".join(part for part, _ in printed), "extraction": "ocr", "ocr_engine": engine}
    if any(part.strip() for part, _ in printed):
        shaky = any(score < tx.RELIABLE for _, score in printed)
        return record | {"warnings": [tx.LOW_LINES] * shaky, "ocr_line_confidence": [score for _, score in printed]}
    # nothing readable: one unreliable line at least, so that no rule relies on the page
    return record | {"warnings": ["paddle_ocr_requires_review"], "ocr_line_confidence": [0.0] * max(1, len(printed))}


def read_pages(spark: SparkSession, path: str, extractor: Callable[[bytes], Iterable[dict]] | None = None) -> DataFrame:
    """Dispatch by extension and validate: a pack has 1 to 500 valid pages whose numbers rise. Files are parsed once: rows are checked on
    the pass that writes them, and packs on what was written."""
    kind = path.lower().rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if kind == "json":
        pages = read_json_pages(spark, path)
    elif kind in ("txt", "md"):
        pages = read_text_pages(spark, path)
    elif kind == "pdf" and extractor is not None:
        pages = read_pdf_pages(spark, path, extractor)
    else:
        raise InvalidInput("Supported inputs: text, Markdown, JSON page arrays, and PDF with an extractor.")
    pages = written_checked(pages, "pages", {"Invalid page: supply a positive page number, bounded text, extraction status and string warnings.": page_valid()}, InvalidInput)
    require(pack_report(pages), F.col("valid"), "Supply 1 to 500 pages with increasing numbers.")
    return pages


def read_corpus(spark: SparkSession, folder: str, names: Iterable[str] = tuple(tx.GATE_CASES), pinned: dict[str, str] | None = None) -> DataFrame:
    """Labelled cases of several sets, with the set's name and file digest; ids, groups and texts are unique over all."""
    parts = None
    for name in names:
        raw = _whole(spark, f"{folder}/{name}.json").select(F.lit(name).alias("dataset"), F.sha2("raw", 256).alias("digest"), F.from_json(_no_mark(F.col("raw")), f"array<{CASE}>").alias("a"))
        parts = raw if parts is None else parts.unionByName(raw)
    digests = {r.dataset: r.digest for r in parts.select("dataset", "digest").collect()}
    for name, digest in (PINNED if pinned is None else pinned).items():
        if name in digests and digests[name] != digest:
            raise InvalidInput(f"The {name} set changed. Restore it and add new cases to another set.")
    rows = parts.select("dataset", "digest", F.explode("a").alias("c")).select("dataset", "digest", "c.*").withColumnsRenamed({"ocrEngine": "ocr_engine", "ocrLineConfidence": "ocr_line_confidence"})
    for key in ("id", "group", "text"):
        if not duplicates(rows, key).isEmpty():
            raise InvalidInput("Duplicate case, group or text across the sets.")
    return require(rows, F.col("label").isin(*tx.OUTCOMES), "Invalid truth label")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, schemaVersion, results): the digest is of the exact text, mark included."""
    raw = _whole(spark, path).select("file", F.sha2("raw", 256).alias("sha256"), F.from_json(_no_mark(F.col("raw")), MANIFEST).alias("m"))
    require(raw, F.col("m").isNotNull(), "The file is not valid JSON.")
    return raw.select("file", "sha256", "m.schemaVersion", "m.results")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    raw = _whole(spark, path).select("file", F.from_json(_no_mark(F.col("raw")), DECISIONS).alias("d"))
    require(raw, F.col("d").isNotNull(), "The file is not valid JSON.")
    return raw.select("file", "d.*")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _said(node: ElementTree.Element) -> str:
    """The text of a string item: its runs joined, without phonetic readings."""
    if _local(node.tag) == "rPh":
        return ""
    return (node.text or "" if _local(node.tag) == "t" else "") + "".join(map(_said, node))


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The path of the first sheet in the workbook's order."""
    sheet = next(n for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet")
    wanted = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(n.get("Target") for n in links if n.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def xlsx_first_cells(content: bytes) -> list[str]:
    """What the first cell of each row of a workbook's first sheet says, white space folded; rows whose first cell is empty are
    left out. Shared, inline and formula strings are read, in any namespace."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        whole = {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names
        sheet = ElementTree.fromstring(book.read(_first_sheet(book) if whole else "xl/worksheets/sheet1.xml"))
        strings = ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else ()
    shared = [_said(item) for item in strings if _local(item.tag) == "si"]
    found = []
    for row in (n for n in sheet.iter() if _local(n.tag) == "row"):
        cell = next(iter(row), None)
        parts = {} if cell is None else {_local(n.tag): n for n in cell}
        if "is" in parts:
            found.append(_said(parts["is"]))
        elif "v" in parts and parts["v"].text:
            found.append(shared[int(parts["v"].text)] if cell.get("t") == "s" else parts["v"].text)
    return [" ".join(text.split()) for text in found if text.strip()]


def read_form_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the forms that a workbook lists."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"name": [n for c in batch["content"] for n in xlsx_first_cells(bytes(c))]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string").where(F.col("name").rlike(r"\AForm \S+"))


def bench_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the PDF files in each case's input folder."""
    return spark.read.format("binaryFile").load(f"{folder}/*/input/*.pdf").select("path")
