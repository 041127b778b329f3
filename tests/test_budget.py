"""A budget over a stream: caps of a day and a month, batches that run again, and runs that are killed half way."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.streaming import budget as B


def rows(spark, *keys, usd=0.4):
    return spark.createDataFrame([(k, k, float(usd)) for k in keys], "key long, order long, usd double")


def score(paid):
    return paid.select("key", F.lit(0.5).alias("probability"))


def paid(spark, path):
    return {(r["key"], r["at"][:10]) for r in B.charges(spark, path).collect()}


def results(spark, path):
    return sorted(r["key"] for r in spark.read.parquet(f"{path}/{B.RESULTS}").collect())


def test_caps(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    assert B.resume(spark, path, "2026-01-30", score, 1.0, 1.5) is None
    B.pay(rows(spark, 1, 2, 3, 4, 5, 6), 0, path, "2026-01-30T09:00", score, 1.0, 1.5)
    assert paid(spark, path) == {(6, "2026-01-30"), (5, "2026-01-30")}  # the newest, as far as the day goes
    B.pay(rows(spark, 7), 1, path, "2026-01-30T23:00", score, 1.0, 1.5)
    assert len(paid(spark, path)) == 2  # 0.2 are left
    B.pay(rows(spark, 8), 2, path, "2026-01-31T09:00", score, 1.0, 1.5)
    assert paid(spark, path) == {(6, "2026-01-30"), (5, "2026-01-30"), (8, "2026-01-31")}  # the month has 0.7 left
    assert B.resume(spark, path, "2026-02-01T09:00", score, 1.0, 1.5) == 3 and B.resume(spark, path, "2026-02-02T09:00", score, 1.0, 1.5) == 4 and B.resume(spark, path, "2026-03-02T09:00", score, 1.0, 1.5) == 5
    assert paid(spark, path) >= {(7, "2026-02-01"), (4, "2026-02-01"), (3, "2026-02-02"), (2, "2026-03-02"), (1, "2026-03-02")} and results(spark, path) == [*range(1, 9)]
    B.resume(spark, path, "2026-03-03T09:00", score, 1.0, 1.5)
    assert len(paid(spark, path)) == 8 and B.left(B.charges(spark, path), "2026-03-02", 1.0, 1.5) == pytest.approx(0.2)


def test_run_again(spark, tmp_path):
    """A batch that ends and runs again, and one that dies between paying and working."""
    path = f"file://{tmp_path}/runs"

    def dies(some):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        B.pay(rows(spark, 1, 2, 3), 0, path, "2026-01-30T09:00", dies, 1.0, 9.0)
    assert paid(spark, path) == {(3, "2026-01-30"), (2, "2026-01-30")}
    for _ in range(2):
        B.pay(rows(spark, 1, 2, 3), 0, path, "2026-01-30T10:00", score, 1.0, 9.0)
        assert paid(spark, path) == {(3, "2026-01-30"), (2, "2026-01-30")} and results(spark, path) == [2, 3]
    with pytest.raises(RuntimeError):
        B.pay(rows(spark, 9, 3), 1, path, "2026-01-31T09:00", dies, 1.0, 9.0)
    B.pay(rows(spark, 9, 3), 1, path, "2026-01-31T09:00", score, 1.0, 9.0)
    assert paid(spark, path) == {(3, "2026-01-30"), (2, "2026-01-30"), (9, "2026-01-31"), (1, "2026-01-31")} and results(spark, path) == [1, 2, 3, 9]  # 3 comes again and is not paid again


def test_stream(spark, tmp_path):
    """Two runs of a stream over files, the second with new ones; then nothing new, and what waited."""
    source, path = tmp_path / "in", f"file://{tmp_path}/runs"
    run = lambda at: B.run_once(spark.readStream.schema("key long, order long, usd double").parquet(str(source)), path, f"file://{tmp_path}/checkpoint", at, score, 1.0, 9.0)
    rows(spark, 1, 2, 3).write.parquet(str(source))
    run("2026-01-30T09:00")
    rows(spark, 10).write.mode("append").parquet(str(source))
    run("2026-01-31T09:00")
    assert paid(spark, path) == {(3, "2026-01-30"), (2, "2026-01-30"), (10, "2026-01-31"), (1, "2026-01-31")}
    run("2026-01-31T10:00")
    assert results(spark, path) == [1, 2, 3, 10]


def test_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    B.pay(rows(spark), 0, path, "2026-01-30", score, 1.0, 1.0)
    B.pay(rows(spark, 5, usd=3.0), 1, path, "2026-01-30", score, 1.0, 1.0)
    assert paid(spark, path) == set() and results(spark, path) == []
