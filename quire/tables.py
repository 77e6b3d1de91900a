"""Results that are read more than once, written once.

A classification feeds several branches of a review, a second reading or a comparison. Branches of one lazy plan would run it
again, each with a copy of the rules, so it is written as Parquet under the folder that ``spark.checkpoint.dir`` names, which
all executors read, and a lost executor loses nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for such tables; one of this machine only under a local master."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if (found := context._jsc.sc().getCheckpointDir()).isDefined():
        return found.get().rstrip("/")
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="quire-pages-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/quire-pages-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once; the plan of the result starts at its files."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(folder):
        fs.delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Delete all such tables of this application; call it when no result is read any more. They can hold page texts."""
    _delete(spark, f"{shared_folder(spark)}/quire-pages-{spark.sparkContext.applicationId}")


def written_checked(df: DataFrame, name: str, checks: dict[str, Column], refuse) -> DataFrame:
    """``df``, written once, with its rows checked on the same pass: ``checks`` maps a message to a column that holds for every sound row.
    If a row fails one (a null verdict fails), the files go and ``refuse`` is raised with the first message that was earned."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    seen = Observation()
    failed = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"check{i}") for i, ok in enumerate(checks.values())]
    df.observe(seen, *failed).write.parquet(path)
    for i, message in enumerate(checks):
        if seen.get[f"check{i}"]:
            _delete(spark, path)
            raise refuse(message)
    return spark.read.schema(df.schema).parquet(path)
