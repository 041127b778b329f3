"""Edges of scores, checks, CSV and the published view."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerspark.operators import scores
from ledgerspark.sources import csv, view


def test_carried_scores_tie_to_the_binding_appended_last(spark):
    given = spark.createDataFrame([(1, "a", 0.1, 5, 0), (1, "b", 0.2, 5, 1), (1, "a", 0.3, 5, 2), (2, "x", 0.4, 1, 3)], "k int, b string, v double, at int, seq int")
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, b string")
    got = {r["k"]: (r["b"], r["v"], r["carried"]) for r in scores.bound(rows, given, "k", "b", "at", "seq", "v").collect()}
    assert got == {1: ("b", 0.2, True), 2: ("x", 0.4, False), 3: ("x", None, False)}


def test_checked_names_the_missing_key(spark):
    with pytest.raises(PySparkException, match="no such key: 2"):
        scores.checked(spark.range(3), spark.range(2).withColumn("x", F.lit(1)), "id").collect()


def test_csv_with_a_mark_and_without_a_column(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,n\nq,1\n".encode())
    assert csv.read(spark, f"file://{tmp_path}/a.csv", {"name": "string", "n": "int"}).collect() == [("q", 1)]
    with pytest.raises(ValueError, match="lacks m"):
        csv.read(spark, f"file://{tmp_path}/a.csv", {"m": "int"})


def test_a_failed_check_leaves_the_version_before(spark, tmp_path):
    top = f"file://{tmp_path}/view"
    view.publish(spark, top, {"t": spark.range(2)}, {})
    with pytest.raises(ValueError, match="fails count"):
        view.publish(spark, top, {"t": spark.range(5)}, {"count": lambda t: t["t"].count() == 2})
    assert view.read(spark, top, "t", {"id": "bigint"}).count() == 2
    with pytest.raises(ValueError, match="other columns"):
        view.read(spark, top, "t", {"id": "string"})


def test_a_ledger_newer_than_the_view(spark, tmp_path):
    import os
    import time

    top, ledger = f"file://{tmp_path}/view", tmp_path / "ledger"
    ledger.mkdir()
    (ledger / "a.jsonl").write_text("{}")
    os.utime(ledger / "a.jsonl", (time.time() - 60,) * 2)
    view.publish(spark, top, {"t": spark.range(2)}, {})
    assert not view.stale(spark, top, f"file://{ledger}")
    (ledger / "b.jsonl").write_text("{}")
    os.utime(ledger / "b.jsonl", (time.time() + 60,) * 2)
    assert view.stale(spark, top, f"file://{ledger}")
