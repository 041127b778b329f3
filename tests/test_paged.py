"""Boards read page by page: windows, totals, repeated pages, failures, runs that die, cursors that are none."""

import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerspark.sources import paged as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not know this file


def entry(n):
    return {"key": f"R-{n}", "path": f"/job/{n}", "title": f"Scientist {n}"}


def listing(size, later_totals=True):
    def fetch(board, limit, offset):
        return {"total": size if later_totals or offset == 0 else 0, "entries": [entry(n) for n in range(offset, min(offset + limit, size))]}

    return fetch


class Board:
    """A board in the workers, with the offsets that it was asked for."""

    def __init__(self, spark, top, fetch):
        self.spark, self.path, self.log, self.fetch = spark, f"file://{top}/scan", str(top / "asked"), fetch

    def run(self, limit=2, pages=20, at="2026-09-05T00:00:00", boards=("b",), **more):
        fetch, log = self.fetch, self.log

        def asked(board, limit, offset):
            with open(log, "a") as f:
                f.write(f"{offset}\n")
            return fetch(board, limit, offset)

        return P.advance(self.spark, self.path, self.spark.createDataFrame([(b,) for b in boards], "board string"), P.calling(asked), at, limit, pages, **more)

    @property
    def asked(self):
        return [int(x) for x in Path(self.log).read_text().split()]

    @property
    def cursor(self):
        return P.cursors(self.spark, self.path).where("board = 'b'").first()

    @property
    def keys(self):
        return sorted((r["key"] for r in P.seen(self.spark, self.path).collect()), key=lambda k: int(k[2:]))


@pytest.fixture
def board(spark, tmp_path):
    return lambda fetch: Board(spark, tmp_path, fetch)


def test_windows(board):
    b = board(listing(100))
    assert b.run(pages=1) == 1 and b.cursor["next_offset"] == 2 and b.cursor["status"] == "partial" and b.cursor["error"] == "stopped at 1 pages"
    assert b.run(pages=1) == 1 and b.cursor["next_offset"] == 4 and b.asked == [0, 2]
    assert b.keys == ["R-0", "R-1", "R-2", "R-3"] and not b.cursor["whole"]


def test_later_totals_of_zero(board):
    b = board(listing(5, later_totals=False))
    assert b.run() == 0 and b.asked == [0, 2, 4] and len(b.keys) == 5
    assert b.cursor["whole"] and b.cursor["status"] == "complete" and b.cursor["next_offset"] == 0


def test_resumed_total_of_zero(board):
    b = board(listing(5, later_totals=False))
    b.run(pages=1), b.run(pages=1)
    assert b.asked == [0, 2, 0] and b.cursor["next_offset"] == 4 and b.cursor["status"] == "partial"
    b.run()
    assert b.asked == [0, 2, 0, 4, 0] and b.keys[-1] == "R-4" and b.cursor["status"] == "complete" and not b.cursor["whole"]


def test_repeated_page(board):
    b = board(lambda *_: {"total": 100, "entries": [entry(1), entry(2)]})
    assert b.run() == 0
    assert b.asked == [0, 2] and b.cursor["status"] == "stalled" and b.cursor["next_offset"] == 2 and b.cursor["fetched"] == 1 and b.keys == ["R-1", "R-2"]


def test_page_repeated_by_the_next_run(board):
    b = board(lambda *_: {"total": 100, "entries": [entry(1), entry(2)]})
    b.run(pages=1)
    b.run()
    assert b.cursor["status"] == "stalled" and b.cursor["fetched"] == 0 and b.cursor["next_offset"] == 2 and b.keys == ["R-1", "R-2"]


def test_head_may_repeat_a_short_board(board):
    b = board(listing(2))
    b.run()
    assert b.run() == 0 and b.asked == [0]  # read to its end: left alone
    b.run(again=True)
    assert b.asked == [0, 0] and b.cursor["status"] == "complete" and b.cursor["whole"]


def test_end_that_has_moved(board):
    size = {"n": 6}
    b = board(lambda board, limit, offset: listing(size["n"])(board, limit, offset))
    b.run(pages=2)
    size["n"] = 4
    b.run()
    assert b.cursor["status"] == "complete" and b.cursor["next_offset"] == 0 and b.cursor["fetched"] == 0 and not b.cursor["whole"]


def test_failures(board):
    down = {"at": 4}

    def fetch(board, limit, offset):
        if offset >= down["at"]:
            raise OSError("out of  order")
        return listing(8)(board, limit, offset)

    b = board(fetch)
    assert b.run(at="2026-09-01T00:00:00") == 1
    assert b.cursor["next_offset"] == 4 and b.cursor["status"] == "partial" and b.cursor["error"] == "stopped at offset 4: OSError: out of order"
    assert b.run(at="2026-09-05T00:00:00") == 0
    assert b.cursor["next_offset"] == 4 and b.cursor["status"] == "failed" and b.cursor["progressed"] == "2026-09-01T00:00:00" and b.cursor["attempted"] == "2026-09-05T00:00:00"
    down["at"] = 99
    b.run()
    assert b.keys == [f"R-{n}" for n in range(8)] and b.asked[-2:] == [4, 6]


def test_expiry(board):
    b = board(listing(100))
    b.run(pages=1, at="2026-09-01T00:00:00")
    b.run(pages=1, at="2026-09-09T00:00:00", expires="2026-09-02T00:00:00")
    assert b.asked == [0, 0]
    b.run(pages=1, at="2026-08-30T00:00:00", expires="2026-08-23T00:00:00")  # a cursor of the future is none either
    assert b.asked == [0, 0, 0]
    b.run(pages=1, at="2026-08-31T00:00:00", expires="2026-08-24T00:00:00")
    assert b.asked == [0, 0, 0, 2]


@pytest.mark.parametrize("said", [None, {"total": 3}, {"entries": []}, {"total": True, "entries": []}, {"total": -1, "entries": []}, {"total": 3, "entries": []}, {"total": 3, "entries": [entry(1), entry(1)]}])
def test_answers_that_are_no_page(board, said):
    b = board(lambda *_: said)
    assert b.run() == 0
    assert b.cursor["next_offset"] == 0 and b.cursor["status"] == ("partial" if said == {"total": 3, "entries": []} else "failed") and b.keys == []


def test_entries_without_a_key(board):
    b = board(lambda board, limit, offset: {"total": 4, "entries": [[entry(1), {"key": " "}], ["x", entry(2)]][offset // 2]})
    b.run()
    assert b.cursor["status"] == "complete" and not b.cursor["whole"] and b.cursor["error"] == "2 entries lack an identity" and b.cursor["observed"] == 4 and b.keys == ["R-1", "R-2"]


def test_boards_beside_each_other(board):
    b = board(lambda board, limit, offset: listing({"b": 3, "c": 9}[board])(board, limit, offset))
    assert b.run(boards=("b", "c", "c", None), pages=2) == 1
    assert b.run(boards=("b",), pages=2) == 0  # c waits, with its cursor
    now = {r["board"]: (r["status"], r["next_offset"]) for r in P.cursors(b.spark, b.path).collect()}
    assert now == {"b": ("complete", 0), "c": ("partial", 4)}
    assert b.run(boards=("b", "c")) == 0 and P.seen(b.spark, b.path).groupBy("board").count().collect() and P.seen(b.spark, b.path).count() == 12


def test_run_that_dies(board, spark):
    """What a run has written counts for nothing until it is whole."""
    b = board(listing(10))
    b.run(pages=2)
    good = spark.read.parquet(f"{b.path}/run=0")
    good.withColumn("next_offset", F.lit(8).cast("long")).write.parquet(f"{b.path}/run=1")
    (Path(b.path.removeprefix("file://")) / "run=1" / "_SUCCESS").unlink()
    assert b.cursor["next_offset"] == 4 and b.keys == [f"R-{n}" for n in range(4)]
    while b.run(pages=2):
        pass
    assert b.asked == [0, 2, 4, 6, 8] and b.keys == [f"R-{n}" for n in range(10)]


@pytest.mark.parametrize("field, value", [("status", "odd"), ("status", None), ("next_offset", -1), ("next_offset", None), ("page_limit", 0)])
def test_no_cursor(board, spark, field, value):
    b = board(listing(10))
    b.run(pages=1)
    spark.read.parquet(f"{b.path}/run=0").withColumn(field, F.lit(value).cast({"status": "string", "next_offset": "long", "page_limit": "int"}[field])).write.parquet(f"{b.path}/run=1")
    with pytest.raises(Exception, match="not a cursor: b"):
        b.run(pages=1)


def test_recorded(spark, tmp_path):
    rows = [("b", n, f"R-{n}", f"/{n}", json.dumps(entry(n))) for n in range(7)] + [("c", 0, "x", None, None)]
    fetch = P.recorded(spark.createDataFrame(rows, "board string, place long, key string, path string, row string"))
    path, boards = f"file://{tmp_path}/scan", spark.createDataFrame([("b",), ("c",), ("nothing",)], "board string")
    assert P.advance(spark, path, boards, fetch, "t0", 2, 2) == 1 and P.advance(spark, path, boards, fetch, "t1", 2, 2) == 0
    got = sorted((r["board"], r["run"], r["offset"], r["key"]) for r in P.seen(spark, path).collect())
    assert got == [("b", 0, 0, "R-0"), ("b", 0, 0, "R-1"), ("b", 0, 2, "R-2"), ("b", 0, 2, "R-3"), ("b", 1, 4, "R-4"), ("b", 1, 4, "R-5"), ("b", 1, 6, "R-6"), ("c", 0, 0, "x")]
    assert {r["board"]: r["status"] for r in P.cursors(spark, path).collect()} == {"b": "complete", "c": "complete", "nothing": "complete"}


def test_no_boards(spark, tmp_path):
    path = f"file://{tmp_path}/scan"
    assert P.advance(spark, path, spark.createDataFrame([], "board string"), P.calling(listing(3)), "t") == 0
    assert P.cursors(spark, path).count() == P.seen(spark, path).count() == 0
