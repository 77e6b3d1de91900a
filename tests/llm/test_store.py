import pathlib

from pyspark.sql import functions as F

from quire.llm.store import clear, cut, drop, few, join_hot, shared_dir, unused


def test_tables_are_written_and_dropped(spark):
    one, two = (cut(spark.range(10), n) for n in ("a", "b"))
    assert one.count() == 10
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    assert len(list(folder.glob("quire-*/a-*"))) >= 1
    drop(one)
    assert two.count() == 10
    clear(spark)
    assert not list(folder.glob(f"quire-{spark.sparkContext.applicationId}/*"))
    assert cut(spark.range(3).where("false"), "c").count() == 0


def test_hot_keys_are_salted(spark):
    """The same rows as a plain left join, with a key that holds half of all rows, one without a partner, and null keys."""
    k = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, 9).when(F.col("id") % 11 == 0, None).otherwise(F.col("id"))
    rows = spark.range(3000).select(k.alias("k"), F.col("id").alias("v"))
    table = rows.where("k < 2000 AND k <> 9").groupBy("k").agg(F.min("v").alias("least"))
    sizes = rows.groupBy("k").agg(F.count("v").alias("c"))
    got = join_hot(rows, table, "k", sizes)
    assert got.columns == ["k", "v", "least"]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "k", "left").collect()))


def test_hot_keys_take_no_join_of_all_rows(spark):
    """Fifteen hot keys, or none: the rows meet their table and no other join, and none is lost or repeated."""
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id") % 15).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = cut(rows.select("k").distinct().withColumn("w", F.col("k") * 2), "w")
    sizes = cut(rows.groupBy("k").agg(F.count("v").alias("c")), "c")
    for least, hot in ((100, True), (5000, False)):
        got = join_hot(rows, table, "k", sizes, share=40, least=least)
        plan = got._jdf.queryExecution().analyzed().toString()
        assert plan.count("Join ") == 1 and ("_salt" in plan) is hot
        assert got.columns == ["k", "v", "w"] and got.count() == 4000 and not got.where("w <> 2 * k OR w IS NULL").count()


def test_tables_of_keys_are_not_broadcast(spark):
    """Neither with hot keys nor without; and a table that whole texts meet only while it is small."""
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id") % 15).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table, sizes = cut(rows.select("k").distinct(), "w"), cut(rows.groupBy("k").agg(F.count("v").alias("c")), "c")
    made = [join_hot(rows, table, "k", sizes, share=40, least=n) for n in (100, 5000)] + [rows.join(few(table, table, n), "k", "left_anti") for n in (500, 5000)]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    assert ["Broadcast" in p for p in plans] == [False, False, False, True]
    assert made[2].count() == made[3].count() == 0


def test_unused_names(spark):
    df = spark.range(1).select(F.lit(1).alias("A"), F.lit(2).alias("a_"))
    assert unused(df, "a") == "a__" and unused(df, "b") == "b"
