"""Tables that are written once, with checks on the same pass."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire import tables
from quire.operators.validate import InvalidInput


class Counted(DataSource):
    """Rows 0 to 99 in four partitions; leaves a line for each row that is read."""

    @classmethod
    def name(cls):
        return "counted"

    def schema(self):
        return "n int"

    def reader(self, schema):
        return CountedReader(self.options["log"])


class CountedReader(DataSourceReader):
    def __init__(self, log):
        self.log = log

    def partitions(self):
        return [InputPartition(i) for i in range(4)]

    def read(self, partition):
        for n in range(25 * partition.value, 25 * partition.value + 25):
            with open(self.log, "a") as out:
                out.write("x\n")
            yield (n,)


def test_rows_are_checked_on_the_pass_that_writes_them(spark, tmp_path):
    spark.dataSource.register(Counted)
    log = tmp_path / "log"
    rows = spark.read.format("counted").option("log", str(log)).load()
    got = tables.written_checked(rows, "t", {"below": F.col("n") >= 0, "above": F.col("n") < 100}, InvalidInput)
    assert got.count() == 100 and got.agg(F.sum("n")).first()[0] == 4950 and len(log.read_text().splitlines()) == 100
    with pytest.raises(InvalidInput, match="above"):
        tables.written_checked(rows, "u", {"below": F.col("n") >= 0, "above": F.col("n") < 99}, InvalidInput)
    assert len(log.read_text().splitlines()) == 200
    with pytest.raises(InvalidInput, match="null"):
        tables.written_checked(rows, "u", {"null": F.when(F.col("n") > 3, True)}, InvalidInput)
    folder = f"{tables.shared_folder(spark)}/quire-pages-{spark.sparkContext.applicationId}".removeprefix("file:")
    assert not [d for d in os.listdir(folder) if d.startswith("u-")] and [d for d in os.listdir(folder) if d.startswith("t-")]


def test_no_rows(spark):
    assert tables.written_checked(spark.range(0), "t", {"x": F.lit(False)}, InvalidInput).count() == 0
