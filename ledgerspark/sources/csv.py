"""CSV tables with a header: a byte-order mark is fine, a missing column is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The columns (name: type) of the files at path; other columns go, cells that do not parse as their type raise."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    names = {c.removeprefix("﻿").strip(): c for c in rows.columns}
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows.select(*(F.col(f"`{names[c]}`").cast(t).alias(c) for c, t in columns.items()))
