"""Listings of boards, read page by page: a window of a few pages of every board a run, from where its last run has stopped.

A run writes what it has seen and each board's cursor in one folder, which counts once it is whole; a run that dies is done
again from the cursors before it. A cursor says where to go on and is no snapshot: a listing may move between runs. Of a
listing that is there in full, many runs are made at once, in one folder of theirs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.sources.scratch import stored

STATES = ("new", "partial", "complete", "stalled", "failed")
ENTRY = "struct<key:string,path:string,row:string>"
PAGES = f"board string, offset long, total long, entries array<{ENTRY}>, error string"
CURSOR = "board string, start long, next_offset long, page_limit int, status string, error string, signature string, attempted string, progressed string, fetched int, observed long, whole boolean"
RUN = f"{CURSOR}, seen array<struct<offset:bigint,key:string,path:string,row:string>>"
LONGEST_ERROR = 300
#: How many runs scan makes at once to begin with.
AHEAD = 16

#: From (board, start, pages, page_limit) to PAGES: pages of page_limit entries from start on, at most `pages` of them.
Fetch = Callable[[DataFrame], DataFrame]


def recorded(listing: DataFrame) -> Fetch:
    """Pages of a recorded listing (board, place from 0, key, path, row). A board that has nothing there has an empty page."""

    totals = stored(listing.groupBy(F.col("board").alias("__b")).agg(F.count("*").alias("total")))
    # by place, so that a window reads its own files and not the whole listing
    every = stored(listing.select(F.col("board").alias("__b"), "place", F.struct("key", "path", "row").cast(ENTRY).alias("entry")).repartitionByRange("place").sortWithinPartitions("place"))

    def fetch(wanted: DataFrame) -> DataFrame:
        asked = wanted.join(totals, F.col("board") == F.col("__b"), "left").select("board", "start", "pages", "page_limit", F.coalesce("total", F.lit(0)).alias("total"))
        low, high = wanted.agg(F.min("start"), F.max(F.col("start") + F.col("pages") * F.col("page_limit"))).first()
        rows = every.where((F.col("place") >= F.lit(low).cast("long")) & (F.col("place") < F.lit(high).cast("long")))
        inside = (F.col("board") == F.col("__b")) & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("pages") * F.col("page_limit"))
        page = F.col("start") + F.expr("(place - start) div page_limit") * F.col("page_limit")
        found = asked.join(rows, inside, "left").groupBy("board", F.coalesce(page, "start").alias("offset"), "total")
        placed = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "entry"))))
        return found.agg(F.transform(placed, lambda x: x["entry"]).alias("entries")).withColumn("error", F.lit(None).cast("string"))

    return fetch


def _entry(entry: object) -> dict:
    known = entry if isinstance(entry, dict) else {}
    text = lambda x: None if x is None else str(x)
    return {"key": text(known.get("key")), "path": text(known.get("path")), "row": json.dumps(entry, ensure_ascii=False)}


def _answer(fetch: Callable, board: str, limit: int, offset: int) -> tuple[int, list]:
    said = fetch(board, limit, offset)
    total, entries = (said.get("total"), said.get("entries")) if isinstance(said, dict) else (None, None)
    if isinstance(total, bool) or not isinstance(total, int) or total < 0 or not isinstance(entries, list):
        raise ValueError("the page has no list of entries or no total")
    return total, entries


def _walk(fetch: Callable, board: str, start: int, pages: int, limit: int) -> Iterator[tuple]:
    """Pages in order, to the first that is the last, says nothing new or fails. The head's total holds for all pages, as some
    boards say 0 on the later ones."""
    head, keys = None, set()
    for offset in range(start, start + pages * limit, limit):
        try:
            total, entries = _answer(fetch, board, limit, offset)
            if offset and total == 0 and head is None:
                head, _ = _answer(fetch, board, limit, 0)
        except Exception as e:  # whatever a board's transport raises is the board's answer
            yield board, offset, None, None, f"{type(e).__name__}: {e}"
            return
        head = total if offset == 0 else head
        total, entries = total if head is None else head, [_entry(e) for e in entries]
        yield board, offset, total, entries, None
        new = {e["key"] for e in entries} - keys
        keys |= new
        if not new or offset + len(entries) >= total:
            return


def calling(fetch: Callable[[str, int, int], dict]) -> Fetch:
    """Pages as fetch(board, limit, offset) gives them: {"total": ..., "entries": [{"key": ..., "path": ..., ...}]}. Boards are walked
    beside each other, each by one task, which holds a page and the keys of a window."""

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w in b.itertuples(index=False):
                for page in _walk(fetch, w.board, int(w.start), int(w.pages), int(w.page_limit)):
                    yield pd.DataFrame([page], columns=["board", "offset", "total", "entries", "error"]).astype({"total": "Int64"})

    return lambda wanted: wanted.select("board", "start", "pages", "page_limit").repartition("board").mapInPandas(walked, PAGES)


def _read(page: Column) -> Column:
    """A page with its entries that have keys, and its signature: the set of its keys and paths."""
    keyed = F.filter(page["entries"], lambda e: F.coalesce(F.btrim(e["key"]) != "", F.lit(False)))
    signature = F.sha2(F.to_json(F.array_sort(F.transform(keyed, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["path"], F.lit("")).alias("path"))))), 256)
    return F.struct(page["offset"].alias("offset"), page["total"].alias("total"), page["error"].alias("error"), F.size(page["entries"]).cast("long").alias("n"), F.transform(keyed, lambda e: e["key"]).alias("keys"), signature.alias("signature"))


def _judged(pages: Column, start: Column, known: Column, most: int) -> Column:
    """What a window's pages come to: where the next one starts, its state and why, and the pages that count (`fetched`)."""
    names = {"next": "bigint", "status": "string", "error": "string", "signature": "string", "fetched": "int", "observed": "bigint", "skipped": "bigint", "keys": "array<string>", "signatures": "array<string>"}
    kind = f"struct<{','.join(f'{n}:{t}' for n, t in names.items())}>"
    nothing = F.sha2(F.lit("[]"), 256)

    def step(s: Column, p: Column) -> Column:
        to = lambda **new: F.struct(*(new.get(n, s[n]).cast(t).alias(n) for n, t in names.items()))
        at = p["offset"]
        lost = F.when(F.size(s["keys"]) == 0, "failed").otherwise("partial")
        whole = F.when((start == 0) & (s["skipped"] == 0), "whole").otherwise("complete")
        observed, skipped = s["observed"] + p["n"], s["skipped"] + p["n"] - F.size(p["keys"])
        new = F.array_except(p["keys"], s["keys"])
        repeated = ((s["fetched"] == 0) & (start > 0) & F.coalesce(p["signature"] == known, F.lit(False))) | F.array_contains(s["signatures"], p["signature"]) | ((F.size(p["keys"]) > 0) & (F.size(new) == 0))
        end = at + p["n"]
        lacking = F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" entries lack an identity")))
        ends = F.when(end >= p["total"], F.when((start == 0) & (skipped == 0), "whole").otherwise("complete"))
        seen = {"fetched": s["fetched"] + 1, "observed": observed, "skipped": skipped, "keys": F.concat(s["keys"], new), "signatures": F.concat(s["signatures"], F.array(p["signature"])), "signature": p["signature"]}
        stopped = lambda why: F.concat(F.lit("stopped at offset "), at.cast("string"), F.lit(": "), why)
        return (
            F.when(s["status"].isNotNull(), s)
            .when(p["error"].isNotNull(), to(next=at, status=lost, error=stopped(p["error"])))
            .when(at >= p["total"], to(next=at, status=whole, signature=nothing))
            .when(p["n"] == 0, to(next=at, status=F.lit("partial"), error=stopped(F.concat(F.lit("no rows before the total of "), p["total"].cast("string")))))
            .when(F.size(F.array_distinct(p["keys"])) < F.size(p["keys"]), to(next=at, status=lost, observed=observed, skipped=skipped, error=stopped(F.lit("keys repeat within a page"))))
            .when(repeated, to(next=at, status=F.lit("stalled"), observed=observed, skipped=skipped, signature=p["signature"], error=F.concat(F.lit("repeated or non-advancing page at offset "), at.cast("string"))))
            .otherwise(to(next=end, status=ends, error=F.when(ends.isNotNull(), lacking), **seen))
        )

    first = {"next": start, "fetched": F.lit(0), "observed": F.lit(0), "skipped": F.lit(0), "keys": F.array(), "signatures": F.array()}
    none = F.struct(*(first.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()))
    out = F.aggregate(F.transform(pages, _read), none.cast(kind), step)
    early = F.struct(*(F.coalesce(out[n], F.lit(x)).alias(n) if x else out[n].alias(n) for n, x in {**dict.fromkeys(names), "status": "partial"}.items()), F.when(out["status"].isNull(), F.lit(f"stopped at {most} pages")).otherwise(out["error"]).alias("why"), out["status"].isNull().alias("open"))
    return early


def _ended(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders of the runs that are whole, by number; runs made at once are so together."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    out = {}
    for name in names:
        kind, _, numbers = name.partition("=")
        if kind in ("run", "runs") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}", "_SUCCESS")):
            first, _, last = numbers.partition("-")
            out |= {n: f"{path}/{name}" + (f"/run={n}" if last else "") for n in range(int(first), int(last or first) + 1)}
    return out


def _checked(rows: DataFrame) -> DataFrame:
    """rows, or an error where one is no cursor, rather than a start at some other offset."""
    sound = F.col("board").isNotNull() & F.col("status").isin(*STATES) & (F.col("next_offset") >= 0) & (F.col("page_limit") >= 1)
    bad = F.raise_error(F.concat(F.lit("not a cursor: "), F.coalesce("board", F.lit("no board")))).cast("string")
    return rows.withColumn("status", F.when(F.coalesce(sound, F.lit(False)), F.col("status")).otherwise(bad))


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """Each board's cursor (CURSOR) after the last run that is whole."""
    if not (runs := _ended(spark, path)):
        return spark.createDataFrame([], CURSOR)
    return _checked(spark.read.schema(CURSOR).parquet(runs[max(runs)]))


def seen(spark: SparkSession, path: str) -> DataFrame:
    """(board, run, offset, key, path, row) of all that whole runs have seen; a key that two pages have is there twice."""
    if not (runs := _ended(spark, path)):
        return spark.createDataFrame([], "board string, run int, offset long, key string, path string, row string")
    tops: dict[str, list[str]] = {}
    for folder in runs.values():
        tops.setdefault(folder.rpartition("/")[0], []).append(folder)
    rows = reduce(DataFrame.union, (spark.read.schema(RUN + ", run int").option("basePath", top).parquet(*folders) for top, folders in tops.items()))
    return rows.select("board", "run", F.inline("seen"))


def _due(old: DataFrame, named: DataFrame, at: str, again: bool = False, expires: str | None = None) -> DataFrame:
    """Cursors of all boards, with those named (__b) that have none yet; __due says which are read now, from __start on."""
    both = old.join(named, F.col("board") == F.col("__b"), "full").withColumn("board", F.coalesce("board", "__b"))
    due = F.col("__b").isNotNull() & (F.lit(again) | F.coalesce(F.col("status") != "complete", F.lit(True)))
    fresh = F.lit(True) if expires is None else F.coalesce((F.col("progressed") >= expires) & (F.col("progressed") <= at), F.lit(False))
    start = F.when(fresh, F.coalesce("next_offset", F.lit(0))).otherwise(0).cast("long")
    return both.withColumn("__due", due).withColumn("__start", start)


def _empty(error: str | None, total: Column | None = None) -> Column:
    """A window's pages where there is none."""
    return F.array(F.struct(F.col("__start").alias("offset"), (F.lit(0) if total is None else total).cast("long").alias("total"), F.array().cast(f"array<{ENTRY}>").alias("entries"), F.lit(error).cast("string").alias("error")))


def _after(limit: int, at: str) -> tuple[dict[str, Column], Column]:
    """The cursor and what was seen after a window (__pages from __start on, judged as __w), and whether all of it was read and
    the board has more."""
    w = F.col("__w")
    ended = w["status"].isin("whole", "complete")
    kept = F.flatten(F.transform(F.slice("__pages", F.lit(1), w["fetched"]), lambda p: F.transform(F.filter(p["entries"], lambda e: F.coalesce(F.btrim(e["key"]) != "", F.lit(False))), lambda e: F.struct(p["offset"].alias("offset"), e["key"].alias("key"), e["path"].alias("path"), e["row"].alias("row")))))
    now = {
        "start": F.col("__start"), "next_offset": F.when(ended, 0).otherwise(w["next"]), "page_limit": F.lit(limit), "status": F.when(ended, "complete").otherwise(w["status"]), "error": F.left(F.btrim(F.regexp_replace(w["why"], r"\s+", " ")), F.lit(LONGEST_ERROR)),
        "signature": F.coalesce(w["signature"], "signature"), "attempted": F.lit(at), "progressed": F.when(w["fetched"] > 0, F.lit(at)).otherwise(F.col("progressed")), "fetched": w["fetched"], "observed": w["observed"], "whole": w["status"] == "whole", "seen": kept,
    }
    return now, w["open"]


def advance(spark: SparkSession, path: str, boards: DataFrame, fetch: Fetch, at: str, limit: int = 20, pages: int = 20, again: bool = False, expires: str | None = None) -> int:
    """One run over `boards` (board), a window of at most `pages` pages of `limit` entries each; the number of boards that have moved on
    and have more to read.

    Boards that have been read to their end are left alone, or start again where `again` holds. A board whose page fails, or says what
    it said before, keeps its offset. Cursors do not expire, unless they have not moved since before `expires` (ISO text, as
    `at`): these start from 0. Null boards are none; a board given twice is one.
    """
    number = max(_ended(spark, path), default=-1) + 1
    named = boards.where("board is not null").select(F.col("board").alias("__b")).distinct()
    both = _due(cursors(spark, path), named, at, again, expires)
    wanted = both.where("__due").select("board", F.col("__start").alias("start"), F.lit(pages).alias("pages"), F.lit(limit).alias("page_limit"))
    got = fetch(wanted).groupBy(F.col("board").alias("__g")).agg(F.array_sort(F.collect_list(F.struct("offset", "total", "entries", "error"))).alias("__pages"))
    rows = both.join(got, F.col("board") == F.col("__g"), "left").withColumn("__pages", F.when(F.col("__due"), F.coalesce("__pages", _empty("no answer"))))
    now, _ = _after(limit, at)
    out = rows.withColumn("__w", _judged(F.col("__pages"), F.col("__start"), F.col("signature"), pages)).select("board", *(F.when(F.col("__due"), v).otherwise(F.col(c) if c != "seen" else None).alias(c) for c, v in now.items()))
    out.write.mode("overwrite").parquet(f"{path}/run={number}")
    moved = (F.col("status") == "partial") & (F.col("next_offset") > F.col("start"))
    return spark.read.schema(CURSOR).parquet(f"{path}/run={number}").where(moved).join(named, F.col("board") == F.col("__b"), "left_semi").count()


def scan(spark: SparkSession, path: str, boards: DataFrame, fetch: Fetch, at: str, limit: int = 20, pages: int = 20, ahead: int = AHEAD) -> None:
    """Runs until no board moves on, with the rows that advance would see run by run, of a listing that is there in full (recorded).

    Windows of up to `ahead` runs are read and judged beside each other, each as if the one before it had come to its end.
    Those that a board has behind one that has not are dropped, and runs count up to the first that such a board would have
    to begin elsewhere; the next ones are made from there. A round of runs costs what one run costs beside its rows.
    """
    named = stored(boards.where("board is not null").select(F.col("board").alias("__b")).distinct())
    span = pages * limit
    while True:
        number = max(_ended(spark, path), default=-1) + 1
        both = stored(_due(cursors(spark, path), named, at))
        first = both.where("__due").select("board", F.col("__start").alias("start"), F.lit(pages * ahead).alias("pages"), F.lit(limit).alias("page_limit"))
        placed = fetch(first).join(first.select(F.col("board").alias("__g"), F.col("start").alias("__s")), F.col("board") == F.col("__g"))
        got = stored(placed.groupBy("board", F.expr(f"cast((offset - __s) div {span} as int)").alias("window")).agg(F.array_sort(F.collect_list(F.struct("offset", "total", "entries", "error"))).alias("__pages"), F.max("total").alias("total")))
        # a window that begins at a board's end says so, and those behind it are none
        reach = F.coalesce(F.expr(f"(__total - __start) div {span}"), F.lit(0))
        grid = both.where("__due").join(got.groupBy(F.col("board").alias("__g")).agg(F.max("total").alias("__total")), F.col("board") == F.col("__g"), "left").drop("__g")
        grid = grid.withColumn("window", F.explode(F.sequence(F.lit(0), F.greatest(F.least(reach, F.lit(ahead - 1)), F.lit(0)).cast("int")))).withColumn("__start", F.col("__start") + F.col("window") * span)
        before = got.select("board", (F.col("window") + 1).alias("window"), _read(F.element_at("__pages", -1))["signature"].alias("__known"))
        rows = grid.join(got.drop("total"), ["board", "window"], "left").join(before, ["board", "window"], "left")
        late = F.col("window") > 0
        silent = F.when(F.col("__total").isNull(), _empty("no answer")).otherwise(_empty(None, F.col("__total")))
        rows = rows.withColumns({"__pages": F.coalesce("__pages", silent), "signature": F.when(late, F.col("__known")).otherwise(F.col("signature")), "progressed": F.when(late, at).otherwise(F.col("progressed"))})
        now, goes_on = _after(limit, at)
        judged = stored(rows.withColumn("__w", _judged(F.col("__pages"), F.col("__start"), F.col("signature"), pages)).select("board", "window", (goes_on & (F.col("__w")["next"] == F.col("__start") + span)).alias("__on"), *(v.alias(c) for c, v in now.items())))
        ends = judged.groupBy(F.col("board").alias("__g")).agg(F.coalesce(F.min(F.when(~F.col("__on"), F.col("window"))), F.max("window")).alias("__end"))
        valid = judged.join(ends, F.col("board") == F.col("__g")).where("window <= __end")
        open_, last = valid.where("window = __end").agg(F.min(F.when(F.col("status") != "complete", F.col("window"))), F.max("window")).first()
        if last is None:
            return
        last = last if open_ is None else open_
        kept = [c for c in judged.columns if c not in ("window", "__on")]
        run = lambda df, n, seen_: df.select(*(c for c in kept if c != "seen"), seen_.alias("seen"), (F.lit(number) + n).cast("int").alias("run"))
        none = F.lit(None).cast(judged.schema["seen"].dataType)
        made = valid.where(F.col("window") <= last)
        out = run(made, F.col("window"), F.col("seen")).union(run(made.where((F.col("window") == F.col("__end")) & (F.col("window") < last)), F.lit(last), none)).union(run(both.where("not __due"), F.lit(last), none))
        out.repartitionByRange("run", "board").write.mode("overwrite").partitionBy("run").parquet(f"{path}/runs={number}-{number + last}")
        if not made.where((F.col("window") == last) & (F.col("status") == "partial") & (F.col("next_offset") > F.col("start"))).count():
            return
        ahead = 2 * ahead if last + 1 == ahead else last + 1
