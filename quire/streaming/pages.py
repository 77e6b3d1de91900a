"""The rule classifier over a stream of page records: stateless, so it runs unchanged on every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import PAGE_SCHEMA, classify
from ..operators.validate import page_valid, split


def read_page_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)


def classify_stream(pages: DataFrame, out: str, rejects: str, checkpoint: str, available_now: bool = True):
    """Valid pages to results, the others to rejects without their text; restarts go on from ``checkpoint``."""

    def each(batch: DataFrame, epoch: int) -> None:
        good, bad = split(batch, page_valid())
        classify(good).drop("text").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        bad.drop("text").write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")

    writer = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
