"""Scoring in batches by a function of a batch: ids are anonymous, and every one comes back just once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anonymous(rows: DataFrame, key: str) -> DataFrame:
    """rows with id, a digest that tells nothing of the key."""
    return rows.withColumn("id", F.sha2(F.concat(F.lit("row "), F.col(key).cast("string")), 256))


def scored(rows: DataFrame, key: str, state: str, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(key, probability) of rows (key, state) by a model of states. The model sees ids and states alone. An id that is
    missing, comes twice or was not asked for stops the job, and so does a probability outside 0 to 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "probability": model(b["state"])})

    asked = anonymous(rows.select(key, F.col(state).alias("state")), key)
    out = asked.select("id", "state").mapInPandas(run, "id string, probability double").groupBy("id").agg(F.count("*").alias("n"), F.max("probability").alias("probability"))
    both = asked.select(key, "id").join(out, "id", "full")
    sound = F.col(key).isNotNull() & (F.col("n") == 1) & F.col("probability").between(0, 1)
    stop = F.raise_error(F.concat(F.lit("no single probability for id "), F.col("id"))).cast("boolean")
    return both.where(F.coalesce(F.when(F.coalesce(sound, F.lit(False)), True), stop)).select(key, "probability")


def exported(rows: DataFrame, label: str, state: str, leaks: list[Column], pattern: str) -> DataFrame:
    """(id, keep, state) of rows to hand out: a row whose state matches pattern or holds one of leaks stops the job."""
    leak = F.col(state).rlike(pattern)
    for c in leaks:
        leak = leak | F.contains(state, c.cast("string"))
    stop = F.raise_error(F.lit("a state holds a key or contact details")).cast("boolean")
    return rows.where(F.when(~F.coalesce(leak, F.lit(False)), True).otherwise(stop)).select("id", F.col(label).alias("keep"), F.col(state).alias("state"))
