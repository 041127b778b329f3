"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which has to be set: a local folder would lose rows on a cluster."""
    if not (top := spark.conf.get("spark.checkpoint.dir", None)):
        raise ValueError("spark.checkpoint.dir is not set; name a folder there that the driver and all executors share")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a new folder and read again: its lineage ends here."""
    df.write.parquet(path := folder(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)
