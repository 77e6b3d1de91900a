"""Validators of whole packs over a stream: keyed state that a timer closes.

Pages of a pack may come in any order, over several batches and across restarts. The state of a pack holds the positions and numbers of
its pages (at most one more than a pack may have) and their count. A pack closes when the watermark passes the time of its latest page
by ``close_after``; its verdict is that of the batch validators over all its rows, and its state goes. A page that comes later than the
watermark allows belongs to no pack any more: Spark drops it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import taxonomy as tx

VERDICT = "doc_id string, pages bigint, increasing boolean, repeated bigint, valid boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdict(doc: str, rows: list[tuple[int, int | None]], count: int) -> tuple:
    """(doc_id, pages, increasing, repeated, valid) of a pack's (position, page) rows: numbers rise strictly in the order of positions,
    from 1; ``repeated`` is how many numbers occur more than once. Both are null for a pack of too many pages."""
    if count > tx.MAX_PAGES:
        return doc, count, None, None, False
    numbers = [page for _, page in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))]
    rises = all(b is not None and b > (a or 0) for a, b in zip([0, *numbers], numbers, strict=False))
    repeated = sum(n > 1 for n in pd.Series(numbers, dtype="Int64").value_counts(dropna=False))
    return doc, count, rises, int(repeated), rises and count >= 1


class PackState(StatefulProcessor):
    def __init__(self, close_after_ms: int) -> None:
        self.close_after_ms = close_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", "pos bigint, page bigint")
        self.seen = handle.getValueState("seen", "n bigint, latest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, latest = self.seen.get() if self.seen.exists() else (0, 0)
        for batch in rows:
            room = tx.MAX_PAGES + 1 - n
            for row in batch.head(max(0, room)).itertuples():
                self.pages.appendValue((None if pd.isna(row.pos) else int(row.pos), None if pd.isna(row.page) else int(row.page)))
            n += len(batch)
            latest = max(latest, int(pd.Timestamp(batch["arrived"].max()).timestamp() * 1000))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((n, latest))
        self.handle.registerTimer(latest + self.close_after_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _ = self.seen.get()
        rows = [(0 if r[0] is None else int(r[0]), None if r[1] is None else int(r[1])) for r in self.pages.get()]
        self.pages.clear()
        self.seen.clear()
        yield pd.DataFrame([verdict(key[0], rows, n)], columns=["doc_id", "pages", "increasing", "repeated", "valid"])

    def close(self) -> None:
        pass


def pack_verdicts(pages: DataFrame, close_after_s: int = 600, delay: str = "10 minutes") -> DataFrame:
    """A stream of verdicts (VERDICT) from a stream of rows with doc_id, pos, page and ``arrived``, their event time."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.col("page").cast("long").alias("page"), "arrived")
    keyed = rows.where("doc_id IS NOT NULL").withWatermark("arrived", delay).groupBy("doc_id")
    return keyed.transformWithStateInPandas(PackState(close_after_s * 1000), VERDICT, "Append", "EventTime")


def run_available(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Works off what is there, appends Parquet to ``out`` and stops; a later run goes on from ``checkpoint``."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
