"""Paid work on a stream within a day's and a month's budget: each row is paid for once, whatever is killed and run again.

A batch writes what it pays for, before anything is done for it, to a folder of its own; then the results of exactly these
rows, and the rows that the budget had no room for, which come first in the next batch. A batch that runs again finds what
others have paid, pays the same rows and replaces its own folders, so that nothing is paid or kept twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.temporal import running_total

CHARGES, RESULTS, WAITING = "charges", "results", "waiting"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def charges(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """(key, usd, at, batch) of all that has been paid for; empty where nothing has."""
    schema = f"key {key_type}, usd double, at string, batch long"
    return spark.read.schema(schema).parquet(f"{path}/{CHARGES}") if _there(spark, f"{path}/{CHARGES}") else spark.createDataFrame([], schema)


def left(paid: DataFrame, at: str, daily: float, monthly: float) -> float:
    """What may still be spent at a time (ISO text): the less of what the day and the month have left, 0 at least."""
    day = F.sum(F.when(F.left("at", F.lit(10)) == at[:10], F.col("usd")).otherwise(0.0))
    month = F.sum(F.when(F.left("at", F.lit(7)) == at[:7], F.col("usd")).otherwise(0.0))
    spent = paid.agg(F.coalesce(day, F.lit(0.0)).alias("day"), F.coalesce(month, F.lit(0.0)).alias("month")).first()
    return max(min(daily - spent["day"], monthly - spent["month"]), 0.0)


def pay(rows: DataFrame, number: int, path: str, at: str, work: Callable[[DataFrame], DataFrame], daily: float, monthly: float) -> None:
    """One batch of rows (key, order, usd, ...): the longest run of them, the greatest order first, that the budget has room for is
    paid and worked on; the others wait. Keys and orders are unique in a batch; a row without an order waits for ever, and
    one that costs more than is left ends the run."""
    spark = rows.sparkSession
    before = f"{path}/{WAITING}/batch={number - 1}"
    if _there(spark, before):
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(before))
    paid = charges(spark, path, rows.schema["key"].dataType.simpleString())
    others = paid.where(F.col("batch") != number)
    rows = rows.join(others.select(F.col("key").alias("__k")).distinct(), F.col("key") == F.col("__k"), "left_anti")
    room = left(others, at, daily, monthly)
    ranked = running_total(rows.withColumn("__all", F.lit(1)), "__all", "order", F.col("usd"), descending=True)
    fits = F.coalesce(F.col("spent") <= room + 1e-9, F.lit(False))
    ranked.where(fits).select("key", "usd", F.lit(at).alias("at")).write.mode("overwrite").parquet(f"{path}/{CHARGES}/batch={number}")
    mine = spark.read.schema(f"key {rows.schema['key'].dataType.simpleString()}").parquet(f"{path}/{CHARGES}/batch={number}").withColumnRenamed("key", "__k")
    work(rows.join(mine, F.col("key") == F.col("__k"), "left_semi")).write.mode("overwrite").parquet(f"{path}/{RESULTS}/batch={number}")
    rows.join(mine, F.col("key") == F.col("__k"), "left_anti").write.mode("overwrite").parquet(f"{path}/{WAITING}/batch={number}")


def run_once(rows: DataFrame, path: str, checkpoint: str, at: str, work: Callable[[DataFrame], DataFrame], daily: float, monthly: float) -> None:
    """Runs a streaming DataFrame of rows (key, order, usd, ...) until it has read what is there."""

    def write(batch: DataFrame, number: int) -> None:
        pay(batch.persist(), number, path, at, work, daily, monthly)
        batch.unpersist()

    rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def resume(spark: SparkSession, path: str, at: str, work: Callable[[DataFrame], DataFrame], daily: float, monthly: float) -> int | None:
    """Works on what waits since the last batch that ended, as a batch of its own; its number, None where none has ended. One that was
    killed is done again. Not for a folder that a stream is writing to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{WAITING}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    ended = [int(f.getPath().getName().removeprefix("batch=")) for f in fs.listStatus(p) if _there(spark, f"{f.getPath()}/_SUCCESS")] if fs.exists(p) else []
    if not ended:
        return None
    pay(spark.read.parquet(f"{path}/{WAITING}/batch={max(ended)}").limit(0), max(ended) + 1, path, at, work, daily, monthly)
    return max(ended) + 1
