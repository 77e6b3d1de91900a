"""Documents read by page ranges: planning, limits, failures, and a second reading."""

import zipfile

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quire.functions import taxonomy as tx
from quire.operators import fallback, rules, validate
from quire.sources import paged, readers


def archive(path, pages, size="595 842"):
    with zipfile.ZipFile(path, "w") as book:
        for i, text in enumerate(pages, 1):
            entry = zipfile.ZipInfo(f"{i:06d}.txt")
            entry.comment = size.encode()
            book.writestr(entry, text)


class Tracing(paged.ArchivePages):
    """Says in the text which task read the page and how many pages were asked for at once."""

    def read(self, stream, first, last):
        return [r | {"text": f"{TaskContext.get().partitionId()}:{last - first + 1}:{r['text']}"} for r in super().read(stream, first, last)]


def test_a_long_document_is_read_by_several_tasks(spark, tmp_path):
    archive(tmp_path / "long.zip", [f"p{i}" for i in range(1, 501)])
    for i in range(30):
        archive(tmp_path / f"short{i:02d}.zip", ["a", "b", "c"])
    rows = paged.read_paged(spark, str(tmp_path), Tracing(), pages_a_task=60).collect()
    assert len(rows) == 590
    long = sorted((r for r in rows if r.doc_id.endswith("long.zip")), key=lambda r: r.page)
    assert [r.text.split(":")[2] for r in long] == [f"p{i}" for i in range(1, 501)] and [r.pos for r in long] == list(range(500))
    tasks = {r.text.split(":")[0] for r in rows}
    assert len(tasks) == 10 and len({r.text.split(":")[0] for r in long}) == 9
    assert max(int(r.text.split(":")[1]) for r in rows) == 60


def test_ranges_cover_every_page_once():
    parts = list(paged.dealt([("a", 7), ("b", 1), ("c", 1), ("d", 12)], 5))
    assert all(sum(z - a + 1 for _, a, z in p.ranges) <= 5 for p in parts)
    seen = [(f, n) for p in parts for f, a, z in p.ranges for n in range(a, z + 1)]
    assert seen == [(f, n) for f, k in (("a", 7), ("b", 1), ("c", 1), ("d", 12)) for n in range(1, k + 1)]
    assert list(paged.dealt([], 5)) == []


class Drawing(paged.ArchivePages):
    """Leaves a file when a page is drawn."""

    def __init__(self, mark):
        self.mark = str(mark)

    def read(self, stream, first, last):
        open(self.mark, "w").close()
        return super().read(stream, first, last)


@pytest.mark.parametrize("size", ["5001 10", "3000 1700", "0 10", "nan 10", "inf 10", "x"])
def test_a_page_that_does_not_fit_stops_its_document_before_any_is_drawn(spark, tmp_path, size):
    folder = tmp_path / "in"
    folder.mkdir()
    archive(folder / "big.zip", ["a"], size)
    mark = tmp_path / "drawn"
    with pytest.raises(validate.InvalidInput):
        paged.read_paged(spark, str(folder), Drawing(mark))
    got = paged.read_paged(spark, str(folder), Drawing(mark), strict=False).collect()
    assert [(r.page, r.text, r.extraction) for r in got] == [(1, "", "failed")] and not mark.exists()
    archive(folder / "ok.zip", ["a", "b"], "5000 1000")
    got = paged.read_paged(spark, str(folder), Drawing(mark), strict=False).collect()
    assert sorted((r.extraction, r.page) for r in got) == [("failed", 1), ("native", 1), ("native", 2)] and mark.exists()


def test_limits_of_pages_and_bytes(spark, tmp_path, monkeypatch):
    archive(tmp_path / "many.zip", ["x"] * 501)
    archive(tmp_path / "none.zip", [])
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = paged.read_paged(spark, str(tmp_path), paged.ArchivePages(), strict=False).collect()
    assert [(r.page, r.extraction) for r in got] == [(1, "failed")] * 3
    monkeypatch.setattr(tx, "MAX_FILE_BYTES", 10)
    archive(tmp_path / "ok.zip", ["x"])
    assert {r.extraction for r in paged.read_paged(spark, str(tmp_path / "ok.zip"), paged.ArchivePages(), strict=False).collect()} == {"failed"}


class Faulty(paged.ArchivePages):
    def read(self, stream, first, last):
        rows = super().read(stream, first, last)
        if any("secret" in r["text"] for r in rows):
            raise OSError(rows[0]["text"])
        return rows[:-1] if any("short" in r["text"] for r in rows) else rows


def test_a_failing_range_flags_its_own_pages(spark, tmp_path):
    archive(tmp_path / "d.zip", ["a", "b", "secret", "c", "short", "e", "f"])
    rows = sorted(paged.read_paged(spark, str(tmp_path), Faulty(), pages_a_task=2).collect(), key=lambda r: r.page)
    assert [r.extraction for r in rows] == ["native", "native", "failed", "failed", "failed", "failed", "native"]
    assert not any("secret" in r.text for r in rows)


class Engine2(paged.ArchivePages):
    """A recognition engine: lines with scores."""

    def read(self, stream, first, last):
        return [readers.ocr_page(r["page"], [(line, 0.99) for line in r["text"].split("\n")]) for r in super().read(stream, first, last)]


def test_second_reading_by_ranges(spark, tmp_path):
    archive(tmp_path / "d.zip", ["Tax invoice\nGST 1\ntotal 2", "x", "Receipt\npaid 3", "Payment receipt\npaid"])
    doc = f"file:{tmp_path}/d.zip"
    rows = [(doc, n, "", "needs_ocr" if n != 2 else "native", None, None, None) for n in (1, 2, 3, 4)]
    pages = spark.createDataFrame(rows, rules.PAGE_SCHEMA)
    out = rules.classify(fallback.retry(pages, paged.second_reader(Engine2()))).orderBy("page").collect()
    assert [r.documentType for r in out] == ["tax-invoice", "unreadable", "receipt", "receipt"]
    read = paged.second_reader(Engine2())
    assert [r["page"] for r in read(doc, [1, 3, 4])] == [1, 3, 4]
    for bad in ([], [0], [5], [2, 1], [1, 1]):
        with pytest.raises(ValueError, match="selected"):
            read(doc, bad)
    archive(tmp_path / "w.zip", ["a", "b"], "9000 9000")
    with pytest.raises(ValueError, match="geometry"):
        read(f"file:{tmp_path}/w.zip", [1])


def test_one_page_fits_as_the_column_says(spark):
    sizes = [(5000.0, 1000.0, 2.0), (5000.1, 10.0, 2.0), (3000.0, 1700.0, 2.0), (0.0, 1.0, 1.0), (-1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0), (float("inf"), 1.0, 1.0), (2236.0, 2236.0, 2.0), (2237.0, 2237.0, 2.0)]
    df = spark.createDataFrame(sizes, "w double, h double, s double").select("*", validate.render_fits(F.col("w"), F.col("h"), F.col("s")).alias("ok"))
    assert [r.ok for r in df.collect()] == [paged.fits(*s) for s in sizes]
