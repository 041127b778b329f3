"""Steps whose work grew faster than their input, held to plans and times."""

import time

from pyspark.sql import functions as F

from ledgerspark.operators import duplicates, temporal
from ledgerspark.plans import catalogue
from ledgerspark.sources import paged

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_are_no_rows(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 9), ("a", 4, 4), ("a", 12, 12), ("a", 9, 8), ("b", 7, 7), ("b", 7, 7)], "k string, start int, end int")
    got = temporal.occupied_months(rows, ["k"])
    assert {tuple(r) for r in got.collect()} == {("a", 10), ("b", 1)} and "Generate" not in plan(got)


def test_segments_shuffle_orders(spark):
    text = plan(catalogue.month_segments(spark, D))
    assert text.count("Exchange hashpartitioning(k#") == 1 and text.index("Generate") < text.index("Exchange hashpartitioning(k#")


def test_recorded_reads_a_window(spark):
    listing = spark.range(100).select(F.lit("b").alias("board"), F.col("id").alias("place"), F.col("id").cast("string").alias("key"), F.lit("p").alias("path"), F.lit(None).cast("string").alias("row"))
    wanted = spark.createDataFrame([("b", 40, 2, 5)], "board string, start long, pages int, page_limit int")
    got = paged.recorded(listing)(wanted)
    assert "GreaterThanOrEqual(place,40)" in plan(got) and {(r["offset"], len(r["entries"]), r["total"]) for r in got.collect()} == {(40, 5, 100), (45, 5, 100)}


def test_groups_that_answer_alike_are_asked_once(spark):
    """Members of a board without a name and without a destination never join each other: each asked all before it."""
    n = 30_000
    k = F.col("id")
    members = spark.range(n).select(k.alias("key"), F.lit("").alias("destination"), F.lit("r").alias("requisition"), F.lit("external_id").alias("requisition_source"), F.lit("s").alias("source"), F.lit("").alias("board"), F.lit("e").alias("employer"), F.lit(True).alias("strong"))
    began = time.time()
    got = duplicates.duplicates(members, "key", duplicates.rank(F.lit("open"), F.lit(False), F.col("key").cast("double"), F.col("key")))
    assert got.where("key = winner").count() == n and time.time() - began < 60
