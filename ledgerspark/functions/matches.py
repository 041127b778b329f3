"""Where a pattern matches inside a text, as arrays, and what stands between the matches; Column expressions, but for runs of matches as rows.

Places are in code points, ends exclusive. Patterns are Java's and match something; (?iU) makes case, words and digits
those of all scripts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "struct<start:int,end:int,quote:string>"
#: How many matches are placed one by one.
BLOCK = 16
#: Rows of runs in a batch, at least.
RUNS = 20_000


#: Marks before and behind each match, which are no characters of any text.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """The matches of pattern in text, in order, as an array of (start, end, quote); null for null. One pass of the pattern marks
    them, and their places are read off what the marks part."""

    # an array that grows by one member is written anew each time, so places are summed within blocks, and blocks by their lengths

    def placed(so_far: Column, part: Column) -> Column:
        quote = F.substring_index(part, _CLOSE, 1)
        end = so_far["at"] + F.length(quote)
        found = F.struct(so_far["at"].alias("start"), end.alias("end"), quote.alias("quote"))
        return F.struct((so_far["at"] + F.length(part) - 1).alias("at"), F.concat(so_far["found"], F.array(found)).alias("found"))

    def block(parts: Column, at: Column) -> Column:
        return F.aggregate(parts, F.struct(at.alias("at"), F.array().cast(f"array<{MATCH}>").alias("found")), placed, lambda a: a["found"])

    def blocks(parts: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(parts) - 2, F.lit(BLOCK)), lambda i: F.slice(parts, i + 2, F.lit(BLOCK)))
        chars = lambda b: F.aggregate(b, F.lit(0), lambda n, part: n + F.length(part) - 1)
        starts = lambda c: F.aggregate(c, F.array(F.length(parts[0])), lambda so_far, b: F.concat(so_far, F.array(F.element_at(so_far, -1) + chars(b))))
        return let(cut, lambda c: F.flatten(let(starts(c), lambda at: F.transform(c, lambda b, i: block(b, F.get(at, i))))))

    def read(parts: Column) -> Column:
        few = F.size(parts) <= BLOCK
        return F.when(few, block(F.slice(parts, F.lit(2), F.lit(BLOCK)), F.length(parts[0]))).otherwise(blocks(parts))

    return let(F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1), lambda parts: F.when(parts.isNotNull(), read(parts)))


def runs(rows: DataFrame, keys: list[str], text: str, pattern: str, lengths: list[int]) -> DataFrame:
    """(keys, start, end, run) of the runs of so many matches of pattern in rows' texts, one row each, with what stands between them.

    Java marks the matches; Arrow batches read the runs off the marks, in time linear in the runs.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            return pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(said, pa.string())], [*keys, "start", "end", "run"])

        for batch in batches:
            at, starts, ends, said = [], [], [], []
            for i, marked in enumerate(batch.column("__marked")):
                if (t := marked.as_py()) is None:
                    continue
                head, *parts = t.split(_OPEN)
                begins, stops, place = [], [], len(head)
                for part in parts:
                    begins.append(place)
                    stops.append(place + part.index(_CLOSE))
                    place += len(part) - 1
                t = t.replace(_OPEN, "").replace(_CLOSE, "")
                for n in lengths:
                    last = stops[n - 1 :]
                    starts += begins[: len(last)]
                    ends += last
                    said += [t[a:b] for a, b in zip(begins, last)]
                at += [i] * (len(said) - len(at))
                if len(said) >= RUNS:
                    yield flush()
                    at, starts, ends, said = [], [], [], []
            yield flush()

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    marked = rows.select(*keys, F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}").alias("__marked"))
    return marked.mapInArrow(read, f"{kinds}, start int, end int, run string")


def between(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], empty where that is nothing."""
    start = F.greatest(start, F.lit(0))
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def before(text: Column, start: Column, reach: int | None = None) -> Column:
    """What stands before start, the last `reach` characters of it."""
    return between(text, F.lit(0) if reach is None else start - reach, start)


def after(text: Column, end: Column, reach: int | None = None) -> Column:
    return F.substr(text, end + 1, F.length(text) if reach is None else F.lit(reach))


def last_piece(text: Column, pattern: str) -> Column:
    """What stands behind the last match of pattern in text; the whole of it if there is none."""
    return F.element_at(F.split(text, pattern, -1), -1)


def first_piece(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)[0]


def islands(found: Column, joined: Callable[[Column, Column], Column], kind: str = MATCH) -> Column:
    """Runs of an array's members: one is in the run of the member before it where joined(that, it) holds."""

    def placed(so_far: Column, x: Column) -> Column:
        run = F.element_at(so_far, -1)
        more = F.concat(F.slice(so_far, F.lit(1), F.size(so_far) - 1), F.array(F.concat(run, F.array(x))))
        alone = F.concat(so_far, F.array(F.array(x)))
        return F.when(F.size(so_far) == 0, alone).otherwise(F.when(F.coalesce(joined(F.element_at(run, -1), x), F.lit(False)), more).otherwise(alone))

    return F.aggregate(found, F.array().cast(f"array<array<{kind}>>"), placed)


def apart(found: Column, kind: str = MATCH) -> Column:
    """The members of an array in order of start, without those that overlap one that is kept before them."""

    def placed(so_far: Column, x: Column) -> Column:
        clear = (F.size(so_far) == 0) | (F.element_at(so_far, -1)["end"] <= x["start"])
        return F.when(clear, F.concat(so_far, F.array(x))).otherwise(so_far)

    return F.aggregate(found, F.array().cast(f"array<{kind}>"), placed)
