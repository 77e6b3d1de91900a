"""Reports that appear whole or not at all.

Tasks write JSON lines to a staging folder beside the target, a file an attempt; the commit keeps the files of the attempts that Spark
accepted and gives the staging folder the target's name in one rename. A failed or killed write leaves nothing under the target. An
existing target is refused, and of two writers of one target the second one's rename fails, so exactly one wins.

A rename onto a folder with files fails on POSIX file systems; on others that Arrow opens, the target is checked just before.
"""

from __future__ import annotations

import errno
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..tables import written

NAME = "quire_report"
#: Bodies that are handed to a Python worker at once, where files are written: a batch ends at the first of these.
BATCH_BYTES, BATCH_FILES = 4 << 20, 256


class ReportExists(FileExistsError):
    """The target is taken; nothing was changed."""


def _store(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address or ":/" in address else f"file://{os.path.abspath(address)}")


def _exists(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


def _drop(system, path: str) -> None:
    if _exists(system, path):
        system.delete_dir(path)


def publish(staging: str, target: str) -> None:
    """Gives the folder ``staging`` the name ``target``, or refuses."""
    from pyarrow import fs

    system, path = _store(target)
    _, own = _store(staging)
    if _exists(system, path):
        raise ReportExists("the report already exists; choose a new name")
    if isinstance(system, fs.LocalFileSystem):
        try:
            os.rename(own, path)
        except OSError as error:
            if error.errno in (errno.ENOTEMPTY, errno.EEXIST, errno.ENOTDIR):
                raise ReportExists("the report already exists; choose a new name") from None
            raise
    else:
        system.move(own, path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, target: str) -> None:
        self.target = target.rstrip("/")
        head, _, tail = self.target.rpartition("/")
        self.staging = f"{head}/.{tail}-{uuid.uuid4().hex}"
        system, path = _store(self.target)
        if _exists(system, path):
            raise ReportExists("the report already exists; choose a new name")
        store, folder = _store(self.staging)
        store.create_dir(folder, recursive=True)  # not by tasks: one that outlives an abort finds no folder

    def write(self, iterator: Iterator[Row]) -> Part:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.json"
        system, folder = _store(self.staging)
        rows = 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
                rows += 1
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, folder = _store(self.staging)
        kept = {m.name for m in messages if m is not None}
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.base_name not in kept:
                system.delete_file(info.path)
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass
        try:
            publish(self.staging, self.target)
        except BaseException:
            _drop(system, folder)
            raise

    def abort(self, messages: list[Part | None]) -> None:
        _drop(*_store(self.staging))


class ReportSink(DataSource):
    """``df.write.format("quire_report").mode("append").save(path)``: a folder of JSON lines, written once."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if overwrite:
            raise ValueError("a report is not replaced")
        return ReportWriter(self.options["path"])


def write_once(df: DataFrame, path: str) -> None:
    """Writes ``df`` as a report at ``path``, which must not exist."""
    spark = df.sparkSession
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)  # data sources are looked up in the thread's session
    spark.dataSource.register(ReportSink)
    df.write.format(NAME).mode("append").save(path)


def write_files(df: DataFrame, folder: str, name: str = "name", body: str = "body") -> DataFrame:
    """Writes each row as a file of its own in ``folder`` and returns (file, bytes). A body is text or bytes; null is an empty file. Tasks
    write under a name of their attempt and then rename, so a task that runs again leaves whole files only. Names must be unique."""

    def run(batches):
        system, base = _store(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py()
                data = b"" if content is None else content.encode() if isinstance(content, str) else content
                file = f"{base}/{batch.column(0)[i].as_py()}"
                part = f"{base}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, file)
                done.append((file, len(data)))
            files, sizes = zip(*done, strict=True) if done else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    # a worker holds a batch or two: their bytes are bounded by those of few bodies, whatever a task is given
    with _set(df.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_FILES)}):
        return written(df.select(name, body).mapInArrow(run, "file string, bytes bigint"), "files")


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    """The session with other settings, for a result that is written within."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def publish_all(spark: SparkSession, parts: dict[str, DataFrame], target: str) -> None:
    """Several tables as one report: a folder each in ``target``, which appears when all of them are written."""
    head, _, tail = target.rstrip("/").rpartition("/")
    staging = f"{head or '.'}/.{tail}-{uuid.uuid4().hex}"
    system, path = _store(target)
    if _exists(system, path):
        raise ReportExists("the report already exists; choose a new name")
    try:
        for name, part in parts.items():
            part.write.json(f"{staging}/{name}")
        publish(staging, target)
    except BaseException:
        _drop(*_store(staging))
        raise
