"""Reports that appear whole or not at all, and pack verdicts over a stream."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import validate
from quire.sources import sinks
from quire.streaming import packs


def lines(folder):
    return [json.loads(x) for f in sorted(os.listdir(folder)) if f.startswith("part-") for x in open(os.path.join(folder, f))]


def test_a_report_is_written_once(spark, tmp_path):
    target = str(tmp_path / "report")
    df = spark.range(20).select("id", F.struct(F.lit("é").alias("a")).alias("s"), F.array(F.lit(None).cast("int")).alias("n")).repartition(3)
    sinks.write_once(df, target)
    got = lines(target)
    assert sorted(r["id"] for r in got) == list(range(20)) and got[0]["s"] == {"a": "é"} and got[0]["n"] == [None]
    assert os.listdir(tmp_path) == ["report"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(spark.range(1), target)
    assert len(lines(target)) == 20 and os.listdir(tmp_path) == ["report"]
    assert spark.read.json(target).count() == 20


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    @F.udf(T.LongType())
    def fails(i):
        if i == 17:
            raise ValueError("no")
        return i

    with pytest.raises(Exception, match="no"):
        sinks.write_once(spark.range(20).repartition(4).select(fails("id").alias("id")), str(tmp_path / "report"))
    assert os.listdir(tmp_path) == []
    sinks.write_once(spark.range(0), str(tmp_path / "report"))
    assert lines(tmp_path / "report") == []


def test_of_two_writers_one_wins(spark, tmp_path):
    target, results = str(tmp_path / "report"), []
    barrier = threading.Barrier(2)

    def go(n):
        barrier.wait()
        try:
            sinks.write_once(spark.range(n), target)
            results.append(n)
        except Exception as error:  # noqa: BLE001
            results.append(str(error))

    threads = [threading.Thread(target=go, args=(n,)) for n in (5, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [r for r in results if isinstance(r, int)]
    assert len(won) == 1 and len(lines(target)) == won[0] and os.listdir(tmp_path) == ["report"]
    assert "already exists" in next(r for r in results if isinstance(r, str))


def test_publishing_refuses_and_cleans_up(spark, tmp_path):
    target = str(tmp_path / "all")
    sinks.publish_all(spark, {"a": spark.range(2), "b": spark.range(3)}, target)
    assert spark.read.json(f"{target}/b").count() == 3
    with pytest.raises(sinks.ReportExists):
        sinks.publish_all(spark, {"a": spark.range(2)}, target)
    with pytest.raises(Exception):
        sinks.publish_all(spark, {"a": spark.range(2), "b": spark.range(1).select(F.raise_error(F.lit("x")).cast("string").alias("c"))}, str(tmp_path / "other"))
    assert os.listdir(tmp_path) == ["all"]


PACKS = {
    "fine": [(0, 1), (1, 4), (2, 5)],
    "falls": [(0, 2), (1, 1)],
    "again": [(0, 1), (1, 1), (2, 2)],
    "twice": [(0, 1), (0, 1)],
    "null": [(0, 1), (1, None)],
    "zero": [(0, 0), (1, 1)],
    "long": [(i, i + 1) for i in range(501)],
    "full": [(i, i + 1) for i in range(500)],
}


def test_stream_gives_the_batch_verdicts_across_a_restart(spark, tmp_path):
    schema = "doc_id string, pos long, page long, arrived timestamp"
    rows = [(d, pos, page, f"2024-01-01 00:0{random.Random(d).randrange(5)}:00") for d, own in PACKS.items() for pos, page in own]
    random.Random(3).shuffle(rows)
    cuts = [0, 300, 301, 700, len(rows)]
    stream = lambda: packs.pack_verdicts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], "doc_id string, pos long, page long, arrived string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if i in (1, 3):
            packs.run_available(spark, stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0
    for minute in (40, 59):  # later pages move the watermark, and with it the timers
        spark.createDataFrame([(f"tick{minute}", 0, 1, f"2024-01-01 00:{minute}:00")], "doc_id string, pos long, page long, arrived string").write.mode("append").json(str(tmp_path / "in"))
        packs.run_available(spark, stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).where("doc_id NOT LIKE 'tick%'").collect()}
    batch = spark.createDataFrame([(d, pos, page) for d, own in PACKS.items() for pos, page in own], "doc_id string, pos long, page long")
    want = {r.doc_id: r for r in validate.pack_report(batch).collect()}
    assert set(got) == set(want)
    for d, w in want.items():
        assert (got[d].pages, got[d].valid) == (w.pages, w.valid), d
        assert got[d].increasing == (w.increasing if w.pages <= 500 else None), d
    assert {d for d, r in got.items() if r.repeated} == {"again", "twice"}


def test_files_of_rows(spark, tmp_path):
    rows = [("a.txt", "é\n"), ("b.txt", ""), ("c.txt", None)]
    done = sinks.write_files(spark.createDataFrame(rows, "name string, body string"), f"{tmp_path}/out")
    assert sorted((r.file.rsplit("/", 1)[-1], r.bytes) for r in done.collect()) == [("a.txt", 3), ("b.txt", 0), ("c.txt", 0)]
    assert sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt", "c.txt"] and (tmp_path / "out" / "a.txt").read_bytes() == "é\n".encode()
    sinks.write_files(spark.createDataFrame([("x", b"\x00\xff")], "name string, body binary"), f"file:{tmp_path}/out")
    assert (tmp_path / "out" / "x").read_bytes() == b"\x00\xff"


def test_few_bodies_reach_a_worker_at_once(spark, tmp_path, monkeypatch):
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before, seen, real = [spark.conf.get(n) for n in names], [], sinks.written

    def spy(df, name):
        seen.append([int(spark.conf.get(n)) for n in names])
        return real(df, name)

    monkeypatch.setattr(sinks, "written", spy)
    rows = spark.range(0, 600, 1, 1).select(F.concat("id", F.lit(".txt")).alias("name"), F.repeat(F.lit("x"), 50_000).alias("body"))
    done = sinks.write_files(rows, f"{tmp_path}/out")
    assert done.agg(F.sum("bytes")).first()[0] == 600 * 50_000 and len(os.listdir(tmp_path / "out")) == 600
    assert seen == [[sinks.BATCH_BYTES, sinks.BATCH_FILES]] and [spark.conf.get(n) for n in names] == before
