"""A published view: tables written aside, verified, and then made current by one small append."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def same_keys(a: DataFrame, b: DataFrame, *keys: str) -> bool:
    """Whether both hold the same set of keys."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, list(keys), "left_anti").isEmpty() and right.join(left, list(keys), "left_anti").isEmpty()


def publish(spark: SparkSession, top: str, tables: dict[str, DataFrame], checks: dict[str, Callable[[dict[str, DataFrame]], bool]]) -> str:
    """Writes tables below top as a new version and makes it current if all checks of the written tables hold.

    Readers see the version before until the end, and a failed check leaves them with it.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{top}/{version}/{name}")
    written = {name: spark.read.parquet(f"{top}/{version}/{name}") for name in tables}
    if failed := [name for name, holds in checks.items() if not holds(written)]:
        raise ValueError(f"the view fails {', '.join(failed)}")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{top}/current")
    return version


def read(spark: SparkSession, top: str, name: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A table of the current version; with columns (name: type), any other schema is refused."""
    version = spark.read.parquet(f"{top}/current").agg(F.max_by("version", "at")).first()[0]
    df = spark.read.parquet(f"{top}/{version}/{name}")
    if columns is not None and dict(df.dtypes) != columns:
        raise ValueError(f"{name} has other columns: {df.dtypes}")
    return df


def stale(spark: SparkSession, top: str, ledger: str) -> bool:
    """Whether a file of the ledger below that path is newer than the current version."""
    at = spark.read.parquet(f"{top}/current").agg(F.max("at")).first()[0]
    newest = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(ledger).agg(F.max("modificationTime")).first()[0]
    return newest is not None and newest > at
