"""Documents that are read by ranges of pages.

A document of hundreds of pages should not be one task, and a page that cannot be drawn within limits should stop its document before
any page is drawn. Three passes: sizes of files from their listing; sizes of pages by the engine's metadata, in tasks, a file
to a row; then the pages themselves by a Python data source whose partitions are page ranges, several to a large file and many small
files to one. Only ranges are held by the driver, as Spark holds the splits of files.

An engine is any object with these two methods, and may be loaded with a model once a worker:

``geometry(stream) -> [(width, height), ...]``  sizes of all pages, without drawing any;
``read(stream, first, last) -> [record, ...]``  records of those pages: page, text, extraction, warnings?, ocr_engine?, ocr_line_confidence?.

Files are opened by their address through Arrow's file systems, so any store that Arrow knows will do.

Cases: a file over the size limit, without pages, with more than 500, or with a page that does not fit, is refused: the whole input is
(``strict``), or the file yields one page ``failed``. A range that cannot be read, or gives other pages than asked for, yields its pages
as ``failed``; an error's text is dropped, as it can echo content. No file gives an empty table.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import taxonomy as tx
from ..operators.rules import PAGE_SCHEMA
from ..operators.validate import MAX_PIXELS, MAX_SIDE, InvalidInput, geometry_report
from ..tables import written

#: Pages of a task, and the scale at which pages are drawn.
PAGES_A_TASK, SCALE = 50, 2.0
GEOMETRY = "file string, bytes bigint, page bigint, width double, height double, scale double"
COLUMNS = ("doc_id", "pos", "page", "text", "extraction", "warnings", "ocr_engine", "ocr_line_confidence")
SCHEMA = PAGE_SCHEMA.replace("page BIGINT", "pos INT, page BIGINT")


class Engine(Protocol):
    def geometry(self, stream: BinaryIO) -> list[tuple[float, float]]: ...

    def read(self, stream: BinaryIO, first: int, last: int) -> Iterable[dict]: ...


def open_file(address: str) -> BinaryIO:
    """A file by its address, seekable."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address if "://" in address or ":/" in address else f"file://{address}")
    return system.open_input_file(path)


def geometry(spark: SparkSession, path: str, engine: Engine, scale: float = SCALE) -> DataFrame:
    """(file, bytes, page, width, height, scale) of every page; a file that is too large is not opened, and one that the engine
    cannot open, or that has no pages, has one row without a page."""

    def run(batches):
        for batch in batches:
            rows = []
            for file, size in zip(batch["path"], batch["length"], strict=True):
                sizes: list = []
                if size <= tx.MAX_FILE_BYTES:
                    try:
                        with open_file(file) as stream:
                            sizes = list(engine.geometry(stream))
                    except Exception:  # noqa: BLE001
                        sizes = []
                rows += [(file, size, i, float(w), float(h), scale) for i, (w, h) in enumerate(sizes, 1)] or [(file, size, None, None, None, scale)]
            yield pd.DataFrame(rows, columns=["file", "bytes", "page", "width", "height", "scale"]).astype({"page": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInPandas(run, GEOMETRY)


@dataclass
class Ranges(InputPartition):
    """Ranges (file, first page, last page) of one task."""

    ranges: tuple[tuple[str, int, int], ...]


def dealt(files: Iterable[tuple[str, int]], pages_a_task: int) -> Iterator[Ranges]:
    """Ranges of about ``pages_a_task`` pages from (file, number of pages): long files are cut, short ones put together."""
    held, room = [], pages_a_task
    for file, pages in files:
        first = 1
        while first <= pages:
            last = min(pages, first + room - 1)
            held.append((file, first, last))
            room -= last - first + 1
            first = last + 1
            if not room:
                yield Ranges(tuple(held))
                held, room = [], pages_a_task
    if held:
        yield Ranges(tuple(held))


def checked(records: Iterable[dict], doc: str, first: int, last: int) -> list[tuple]:
    """Rows of a range; an error where the pages are not exactly those of the range."""
    rows = [{**dict.fromkeys(COLUMNS), **r, "doc_id": doc, "pos": int(r["page"]) - 1} for r in records]
    if [r["page"] for r in rows] != list(range(first, last + 1)):
        raise ValueError("other pages than asked for")
    return [tuple(r[c] for c in COLUMNS) for r in rows]


def _failed(doc: str, first: int, last: int) -> list[tuple]:
    return [(doc, n - 1, n, "", "failed", None, None, None) for n in range(first, last + 1)]


def source(engine: Engine, planned: list[Ranges], opener: Callable[[str], BinaryIO] = open_file) -> type[DataSource]:
    """A data source of the planned ranges, under a name of its own."""
    label = f"quire_pages_{uuid.uuid4().hex}"

    class PageReader(DataSourceReader):
        def partitions(self):
            return planned

        def read(self, partition):
            for file, first, last in partition.ranges:
                try:
                    with opener(file) as stream:
                        rows = checked(engine.read(stream, first, last), file, first, last)
                except Exception:  # noqa: BLE001
                    rows = _failed(file, first, last)
                yield from rows

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return label

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return PageReader()

    return Pages


def read_paged(spark: SparkSession, path: str, engine: Engine, pages_a_task: int = PAGES_A_TASK, scale: float = SCALE, strict: bool = True) -> DataFrame:
    """All pages of the documents at ``path``: doc_id, pos and the columns of a page."""
    if pages_a_task < 1:
        raise InvalidInput("pages_a_task must be positive")
    report = written(geometry_report(geometry(spark, path, engine, scale)), "geometry")
    if strict and not report.where("NOT valid").isEmpty():
        raise InvalidInput("A document exceeds the limits of size, pages or page geometry.")
    planned = list(dealt(report.where("valid").orderBy("file").select("file", "pages").toLocalIterator(), pages_a_task))
    refused = report.where("NOT valid").select(
        F.col("file").alias("doc_id"), F.lit(0).alias("pos"), F.lit(1).cast("long").alias("page"), F.lit("").alias("text"), F.lit("failed").alias("extraction"),
        F.lit(None).cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("ocr_engine"), F.lit(None).cast("array<double>").alias("ocr_line_confidence"),
    )
    if not planned:
        return refused
    kind = source(engine, planned)
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).load().unionByName(refused)


def fits(width: float, height: float, scale: float) -> bool:
    """As :func:`validate.render_fits`, for one page."""
    ok = all(0 < x < float("inf") for x in (width, height, scale))
    if not ok:
        return False
    w, h = -(-(width * scale) // 1), -(-(height * scale) // 1)
    return max(w, h) <= MAX_SIDE and w * h <= MAX_PIXELS


def second_reader(engine: Engine, scale: float = SCALE, opener: Callable[[str], BinaryIO] = open_file) -> Callable[[str, list[int]], list[dict]]:
    """A reader of selected pages for :func:`fallback.retry`: all of them must exist and fit before the first is drawn, and they are
    read in runs of neighbours."""

    def read(doc: str, pages: list[int]) -> list[dict]:
        with opener(doc) as stream:
            sizes = list(engine.geometry(stream))
            if not 1 <= len(sizes) <= tx.MAX_PAGES or not pages or pages != sorted(set(pages)) or pages[0] < 1 or pages[-1] > len(sizes):
                raise ValueError("selected pages")
            if not all(fits(*sizes[n - 1], scale) for n in pages):
                raise ValueError("page geometry")
            out, first = [], pages[0]
            for n, following in zip(pages, [*pages[1:], None], strict=True):
                if following != n + 1:
                    out += list(engine.read(stream, first, n))
                    first = following
        return out

    return read


class ArchivePages:
    """Pages bundled in a ZIP file, an entry each in the order of their names; an entry's comment is its size, ``width height``. The
    table of contents gives the geometry, and a range decompresses its own entries only."""

    def geometry(self, stream: BinaryIO) -> list[tuple[float, float]]:
        with zipfile.ZipFile(stream) as book:
            entries = sorted(book.infolist(), key=lambda e: e.filename)
            return [tuple(map(float, e.comment.split())) for e in entries]

    def read(self, stream: BinaryIO, first: int, last: int) -> list[dict]:
        with zipfile.ZipFile(stream) as book:
            entries = sorted(book.infolist(), key=lambda e: e.filename)[first - 1 : last]
            return [{"page": first + i, "text": book.read(e).decode(), "extraction": "native"} for i, e in enumerate(entries)]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes rows (doc_id, page, text, width, height) as one archive a document and returns (file, pages). A file is written under a
    name of its attempt and then moved, so a task that is run again leaves one whole file. A document has at most 500 pages."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        part, whole = f"{base}/_{uuid.uuid4().hex}", f"{base}/{group['doc_id'].iloc[0]}.zip"
        with system.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for row in group.sort_values("page").itertuples():
                entry = zipfile.ZipInfo(f"{row.page:06d}.txt")
                entry.comment, entry.compress_type = f"{row.width} {row.height}".encode(), zipfile.ZIP_DEFLATED
                book.writestr(entry, row.text or "")
        system.move(part, whole)
        return pd.DataFrame({"file": [whole], "pages": [len(group)]})

    return written(pages.groupBy("doc_id").applyInPandas(run, "file string, pages bigint"), "archives")
