"""Shared intermediate tables.

Lineage is cut by writing Parquet under the folder that ``spark.checkpoint.dir`` names, which every executor can read,
so a lost executor never loses an intermediate result. A folder of this machine is used only where the session names none
and the master is local; on a cluster a session without that setting is refused, as executors share no local folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that are handed to a Python worker at once, unless the session names its own number.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches. Spark bounds a batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB)
    and by 10,000 rows; ordinary texts fill the former, several times over in flight, so the latter is lowered. It stays so in
    the session, as results are lazy; a number that the session has set itself is left as it is."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it when no result of an operator is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan of the result starts at those files."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame, share: int = 500, least: int = 100) -> DataFrame:
    """``rows.join(table, key, "left")`` without a hot key in one task. ``table`` has one row a key; ``sizes`` (key, c) counts the
    rows of each key. A key that holds over 1 / ``share`` of all rows is salted, so that no salted key does; such keys are fewer
    than ``share``, so their list is part of the plan and no row meets another join for it. Salts are powers of two; the rows of
    ``table`` of such keys are repeated at most 2 * ``share`` times in all. ``table`` grows with the input and is never broadcast."""
    total = sizes.agg(F.sum("c").alias("n")).first().n or 0
    hot = sizes.where((F.col("c") * share > total) & (F.col("c") > least) & F.col(key).isNotNull())
    by_salts: dict[int, list] = {}
    for k, c in hot.select(key, "c").collect():
        by_salts.setdefault(1 << (-(-c * share // total) - 1).bit_length(), []).append(k)
    if not by_salts:
        return rows.join(table.hint("merge"), key, "left")
    salts = F.lit(1)
    for n, keys in sorted(by_salts.items()):
        salts = F.when(F.col(key).isin(keys), n).otherwise(salts)
    others = [c for c in rows.columns if c != key] or [key]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), salts).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(repeated.hint("merge"), [key, "_salt"], "left").drop("_salt")


def few(table: DataFrame, counted: DataFrame, rows: int = 500_000) -> DataFrame:
    """``table`` for a join with whole texts: where ``counted``, a table made by :func:`cut` that it comes from, has over ``rows`` rows, it
    is never broadcast and the texts are shuffled; else Spark decides."""
    return table.hint("merge") if counted.count() > rows else table


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut`; only for tables that no later result reads."""
    spark = df.sparkSession
    for file in df.inputFiles():
        folder = file.rsplit("/", 1)[0]
        if "/quire-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if fs.exists(path):
                fs.delete(path, True)
            return
