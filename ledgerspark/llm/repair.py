"""Conversation structure repair: the cheapest edits that make turns alternate, by a dynamic programme over tensors.

A conversation's roles have to read `(s?(ua)+)?`. Rows are kept, given another role or deleted, and empty rows can be put
anywhere; the cheapest way is found from the end, as the least cost from each of four states (nothing yet, after the
system's row, the user's, the assistant's), one turn at a time for all conversations of a bucket at once: tensors are
turns by conversations by states, and conversations of like length share a bucket. The costs stay, and the edits are then
read off from the first turn on, again for all conversations at once.

Rows lie in the order of conversations and turns over all tasks, so a conversation may begin in one task and end in others.
It is cut into pieces of bounded size. A conversation of several is solved piece by piece: what a piece costs between each
two states is a 4 x 4 matrix, matrices of later pieces give each piece its costs of going on, and where the edits of
the pieces before leave off is where its own begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, drop_since, stored, table, written

#: What edits cost, and what an unmended end of a text does.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Roles by initial; any other, or an empty one, is 3 and fits nowhere. Faults, the first of which counts.
INITIALS, ROLES = "sua", ("system", "user", "assistant")
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Rows and characters of a piece, and rows in the tensors of a bucket.
MOST_ROWS, MOST_CHARS, BUCKET = 4096, 1 << 20, 1 << 18

FAR = np.int64(1 << 40)
#: From each state (start, s, u, a): where a row of a role leads if it is kept (4: nowhere), and where one that is given or put in leads.
KEPT = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
OTHER = np.array([2, 2, 3, 2])
#: What it costs to end: only nothing and whole pairs may.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def crc(*parts: Column) -> Column:
    """crc32 of parts with a colon between; a null is one space."""
    return F.crc32(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit(" ")) for p in parts)).cast("binary"))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of turns, damaged by crc32(`conv_id:turn`) % 20; a null role or text is one space."""
    code = crc(F.col("conv_id"), F.col("turn")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("code <> 0").select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "code")
    return rows.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("code", "copy")


def _coded(rows: DataFrame) -> DataFrame:
    """rows with start (the role's place in INITIALS), blank, cut, and seen: whether an equal row comes earlier; digest and
    id, which order the rows of one turn."""
    shown = F.btrim("text", F.lit(SPACES))
    first = F.position(F.left("role", F.lit(1)), F.lit(INITIALS))
    start = F.when((F.col("role") == "") | (first == 0), 3).otherwise(first - 1).cast("int")
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    coded = stored(rows.withColumns({"id": F.monotonically_increasing_id(), "digest": digest, "start": start, "blank": shown == "", "cut": ~F.right(shown, F.lit(1)).isin(".", "!", "?")}))
    # of rows that come twice or more in a conversation, the first one; nulls come before all turns
    place = F.struct(F.col("turn").isNotNull().alias("a"), "turn", "id")
    again = coded.where("not blank").groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
    again = stored(again.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("least.id").alias("least")))
    found = coded.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return found.withColumn("seen", F.coalesce(F.col("id") != F.col("least"), F.lit(False))).drop("c", "d", "least")


_PIECE = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("conv_id", pa.int64()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
PIECES = "part long, no long, conv_id long, codes binary, roles array<string>, texts array<string>"


def _pieces(most_rows: int):
    """Runs of rows of one conversation, in order, with a byte a row: 4 * fault + start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, now, chars, held = TaskContext.get().partitionId(), 0, None, 0, 0
        done: list[tuple] = []

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, (*d[:3], bytes(d[3]), *d[4:]))) for d in done], _PIECE)
            done.clear()
            return out

        for batch in batches:
            for conv_id, role, text, start, blank, cut, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[2] != conv_id or len(now[3]) >= most_rows or chars >= MOST_CHARS:
                    if held >= 1 << 23:
                        yield handed()
                        held = 0
                    now, chars, no = (part, no, conv_id, bytearray(), [], []), 0, no + 1
                    done.append(now)
                now[3].append(4 * (BLANK if blank else DUPLICATE if seen else CUT if cut else 0) + start)
                now[4].append(role)
                now[5].append(text)
                chars += len(text) + len(role)
                held += len(text) + len(role) + 50
        yield handed()

    return cut


def tensors(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, rows): pieces of like length, BUCKET rows at most (or one piece), as codes by turn and piece; -1 where a piece has ended."""
    sizes = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # as many as keep the padded rows within BUCKET and lengths within a factor of two
        n = sizes[order[at:]]
        fits = (n <= max(2 * n[0], 4)) & ((np.arange(len(n)) + 1) * n <= BUCKET)
        fits[0] = True
        end = at + (int(np.argmin(fits)) if not fits.all() else len(n))
        which = order[at:end]
        rows = np.full((sizes[which[-1]], len(which)), -1, np.int8)
        for k, i in enumerate(which):
            rows[: sizes[i], k] = np.frombuffer(codes[i], np.int8)
        yield which, rows
        at = end


def _costs(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least cost from each turn and state on, as turns + 1 by pieces by states; ends is what it costs to go on behind the piece."""
    out = np.empty((len(rows) + 1, *ends.shape), np.int64)
    out[-1] = _with_inserts(ends)
    for t in range(len(rows) - 1, -1, -1):
        out[t] = np.where((rows[t] < 0)[:, None], out[t + 1], _with_inserts(np.minimum.reduce(_options(rows[t], out[t + 1]))))
    return out


def _options(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What deleting, keeping and giving a role to a row costs with all after it, by pieces and states."""
    fault, start = np.maximum(codes, 0) >> 2, np.maximum(codes, 0) & 3
    stays = np.where(fault == CUT, TRUNCATED, np.where(fault > 0, FAR, 0))[:, None]
    led = np.concatenate([after, np.full((len(after), 1), FAR)], 1)
    return after + DELETE, np.take_along_axis(led, KEPT.T[start], 1) + stays, after[:, OTHER] + REROLE + stays


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    for _ in range(2):  # a third row put in leads to where the first one did
        costs = np.minimum(costs, costs[:, OTHER] + INSERT)
    return costs


def _edits(rows: np.ndarray, ends: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, states, state behind): letters as turns + 1 by pieces by 3 (two rows put in, then the row's own; 0 for none)
    and the states that they lead to. Of the cheapest ways the one whose letters are least; they go D, I, K, R. Only where
    last holds, rows are put in behind the piece's own; elsewhere the next piece does so."""
    costs = _costs(rows, ends)
    letters, states = (np.zeros((len(rows) + 1, len(state), 3), np.uint8) for _ in range(2))
    every = np.arange(len(state))
    for t in range(len(rows) + 1):
        here = costs[t]
        if t < len(rows):
            live = rows[t] >= 0
            deleted, kept, other = _options(rows[t], costs[t + 1])
            start = np.maximum(rows[t], 0) & 3
        for k in range(2):
            put = here[every, state] == here[every, OTHER[state]] + INSERT
            put &= live & (deleted[every, state] != here[every, state]) if t < len(rows) else last
            letters[t, put, k] = ord("I")
            state = np.where(put, OTHER[state], state)
            states[t, :, k] = state
        if t < len(rows):
            now = here[every, state]
            is_deleted = deleted[every, state] == now
            is_kept = ~is_deleted & (kept[every, state] == now)
            letters[t, :, 2] = np.where(live, np.where(is_deleted, ord("D"), np.where(is_kept, ord("K"), ord("R"))), 0)
            state = np.where(live & ~is_deleted, np.where(is_kept, KEPT[state, start], OTHER[state]), state)
            states[t, :, 2] = state
    return letters, states, state


def _matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a piece costs from each state to each."""
    for b in batches:
        out = [None] * len(b)
        for which, rows in tensors(list(b["codes"])):
            unit = np.where(np.eye(4, dtype=bool), 0, FAR)
            each = [_costs(rows, np.repeat(unit[k : k + 1], len(which), 0))[0] for k in range(4)]
            for i, m in zip(which, np.stack(each, 2)):
                out[i] = m.ravel().tolist()
        yield b[["part", "no", "conv_id"]].assign(m=out)


def _going_on(g: pd.DataFrame) -> pd.DataFrame:
    """The costs of going on behind each piece of a conversation, from those of the pieces after it."""
    g = g.sort_values(["part", "no"])
    ends, now = [], END
    for m in reversed(g["m"].tolist()):
        ends.append(now.tolist())
        now = np.minimum((np.array(m).reshape(4, 4) + _with_inserts(now[None])).min(1), FAR)
    return g[["part", "no", "conv_id"]].assign(ends=ends[::-1], last=[False] * (len(g) - 1) + [True])


def _leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where a piece's edits lead from each state."""
    for b in batches:
        out = [None] * len(b)
        ends = np.array(b["ends"].tolist(), np.int64).reshape(-1, 4)
        for which, rows in tensors(list(b["codes"])):
            each = [_edits(rows, ends[which], np.full(len(which), k), b["last"].to_numpy()[which])[2] for k in range(4)]
            for i, m in zip(which, np.stack(each, 1)):
                out[i] = m.tolist()
        yield b[["part", "no", "conv_id", "ends", "last"]].assign(leads=out)


def _beginning(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["part", "no"])
    begins, now = [], 0
    for leads in g["leads"]:
        begins.append(now)
        now = leads[now]
    return g[["part", "no", "ends", "last"]].assign(begins=begins)


_REPAIRED = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("conv_id", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("faults", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
REPAIRED = "part long, no long, conv_id long, audit string, cost long, faults array<long>, starts array<long>, turns array<struct<role:string,text:string>>"
#: Two initials that may stand one after the other.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    price = np.zeros(256, np.int64)
    price[[ord("D"), ord("R"), ord("I")]] = DELETE, REROLE, INSERT
    for batch in batches:
        part, no, conv_id, codes, roles, texts, ends, last, begins = (c.to_pylist() for c in batch.columns)
        last = np.array([x is not False for x in last], bool)
        ends = np.array([END if e is None else e for e in ends], np.int64).reshape(-1, 4)
        begins = np.array([b or 0 for b in begins], np.int64)
        out = []
        for which, rows in tensors(codes):
            letters, states, _ = _edits(rows, ends[which], begins[which], last[which])
            for k, i in enumerate(which):
                flat, to = letters[:, k].ravel(), states[:, k].ravel()
                # in order; D leaves nothing behind, the others a row each
                at = np.flatnonzero(flat)
                turns = [
                    {"role": roles[i][a // 3] if e == "K" else ROLES[to[a] - 1], "text": "" if e == "I" else texts[i][a // 3]}
                    for a, e in zip(at.tolist(), flat[at].tobytes().decode()) if e != "D"
                ]
                code = np.frombuffer(codes[i], np.int8)
                fault, start = code >> 2, code & 3
                own = letters[: len(code), k, 2]
                cost = price[flat].sum() + TRUNCATED * ((fault == CUT) & (own != ord("D"))).sum()
                faults = [*(int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT)), int((~_LEGAL[start[:-1], start[1:]]).sum())]
                out.append((part[i], no[i], conv_id[i], flat[at].tobytes().decode(), int(cost), faults, [int(start[0]), int(start[-1])], turns))
        yield pa.RecordBatch.from_pylist([dict(zip(_REPAIRED.names, o)) for o in out], _REPAIRED)


def repaired(rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Pieces (part, no, conv_id, audit, cost, faults, starts, turns) of the repaired conversations of rows (conv_id, turn, role, text).

    A conversation is its pieces by part and no: audit has the edits' initials, turns the rows that they leave, faults the
    blank, duplicate and truncated rows and the adjacent initials that do not fit, starts the first and the last role's
    place in INITIALS. Rows go by turn, nulls first, then by digest of role and text, so that ties keep a fixed order; a
    null conv_id is a conversation of its own; a null role or text is one space; roles go by their first character, and
    one of no other or none fits nowhere; an empty table gives no rows; other columns are ignored.
    """
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    order, mark = ["conv_id", "turn", "digest", "id"], written()
    laid = _coded(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(laid.select("conv_id", "role", "text", "start", "blank", "cut", "seen").mapInArrow(_pieces(most_rows), PIECES))
    drop_since(rows.sparkSession, mark, pieces)  # rows before they were laid in order

    # conversations of several pieces: narrow rows, at most one in most_rows or MOST_CHARS but for the ends of tasks
    several = stored(pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c")))
    parts = stored(pieces.drop("roles", "texts").join(several, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))
    keys = "part long, no long, conv_id long"
    going = stored(parts.mapInPandas(_matrix, f"{keys}, m array<long>").groupBy("conv_id").applyInPandas(lambda g: _going_on(g), f"{keys}, ends array<long>, last boolean"))
    leads = parts.join(going.drop("conv_id"), ["part", "no"]).mapInPandas(_leads, f"{keys}, ends array<long>, last boolean, leads array<long>")
    begins = stored(leads.groupBy("conv_id").applyInPandas(lambda g: _beginning(g), "part long, no long, ends array<long>, last boolean, begins long"))
    whole = pieces.join(begins, ["part", "no"], "left")
    return whole.select("part", "no", "conv_id", "codes", "roles", "texts", "ends", "last", "begins").mapInArrow(_repair, REPAIRED)


_DIGESTS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation; its pieces come one after another, and no more than a batch of them is held."""
    now = None

    def row() -> tuple:
        return now["conv_id"], *now["sums"], "".join(now["audit"]), now["sha"].hexdigest()

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now:
                    out.append(row())
                now = {"conv_id": r["conv_id"], "sums": [0] * 5, "audit": [], "sha": hashlib.sha256(), "start": None, "any": False}
            first, last = r["starts"]
            if now["start"] is not None and not _LEGAL[now["start"], first]:
                now["sums"][3] += 1
            now["sums"] = [a + b for a, b in zip(now["sums"], [*r["faults"], r["cost"]])]
            now["audit"].append(r["audit"])
            now["start"] = last
            if r["turns"]:
                now["sha"].update(("\n" * now["any"] + "\n".join(f"{t['role']}:{t['text']}" for t in r["turns"])).encode())
                now["any"] = True
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, o)) for o in out], _DIGESTS)
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, row()))], _DIGESTS)


def digests(turns: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """A row for each conv_id of turns: what was wrong with it once damaged, the edits, and a digest of what they leave.

    A digest of a whole conversation has to read it in one go, in one task; it does so piece by piece.
    """
    rows = damaged(turns)
    zero = F.lit(0).cast("long")
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), zero)
    found = repaired(rows, most_rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    found = found.mapInArrow(_digest, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = found.unionByName(rows.groupBy("conv_id").agg(gap.alias("gaps")), True).unionByName(every, True)
    sums = (F.coalesce(F.max(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.groupBy("conv_id").agg(*sums, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each conversation, once damaged, is repaired."""
    return digests(table(spark, sf_dir, "conversations"))
