"""Conversation repair, byte-level BPE and the source audit against plain versions, and on null, empty, repeated and missing rows."""

import base64
import functools
import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerspark.llm import byte_bpe, repair, source_audit

D = "/root/testdata/sf0.001"
sys.setrecursionlimit(20_000)  # the plain version of the repair goes down a frame a row


# --- conversation repair ---


def damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def mended(rows, delete=2):
    """What repair.digests has for one conversation's rows (turn, role, text), in order, by recursion over all edits."""
    fault, seen = [], set()
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\f\r")[-1:]
        fault.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, put):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if put < 3:
            ways += [(5 + c, "I" + a) for to in NEXT[state] if to != "s" for c, a in [best(i, to, put + 1)]]
        if i < len(rows):
            ways += [(delete + c, "D" + a) for c, a in [best(i + 1, state, 0)]]
            if fault[i] in ("", "truncated"):
                more = 5 * (fault[i] == "truncated")
                ways += [(more + c, "K" + a) for c, a in ([best(i + 1, NEXT[state][rows[i][1][:1]], 0)] if rows[i][1][:1] in NEXT[state] else [])]
                ways += [(more + 1 + c, "R" + a) for to in NEXT[state] if to != "s" for c, a in [best(i + 1, to, 0)]]
        return min(ways, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    out, state, i = [], "", 0
    for e in audit:
        if e != "D":
            state = rows[i][1][0] if e == "K" else next(to for to in NEXT[state] if to != "s")
            role = rows[i][1] if e == "K" else {"u": "user", "a": "assistant"}[state]
            out.append(f"{role}:{'' if e == 'I' else rows[i][2]}")
        i += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def mended_all(rows):
    by = {r[0]: [] for r in rows}
    for c, *row in damage(rows):
        by[c].append(row)
    place = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest())
    return {c: mended(sorted(of, key=place)) for c, of in by.items()}


def repairs(df, **how):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = repair.digests(df, **how).collect()
    out = {r["conv_id"]: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def test_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = {r["conv_id"]: r for r in repair.op11_conversation_repair(spark, D).collect()}
    want = mended_all(rows)
    assert {c: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for c, r in out.items()} == want
    assert {e for w in want.values() for e in w[6]} == set("DKR")  # at these prices, deleting a row beside it is cheaper than any insertion


@pytest.mark.parametrize("most_rows", [4096, 3])
def test_repair_odd(spark, most_rows):
    """Nulls everywhere, ties of turns, roles of no meaning, repeated rows, one conversation with a third of all rows; cut into pieces of three rows, too."""
    r = random.Random(most_rows)
    rows = [
        (r.choice([c, None]) if c % 20 == 0 else c, r.choice([t, t, t, t // 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["a.", "b!", "c", "", " \n", "x y?", f"{t}.", None]))
        for c in range(100) for t in range(r.randrange(1, 20))
    ]
    rows += [(7, t, "user" if t % 2 else "assistant", f"{t % 90}.") for t in range(300)] + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit("x"), "part": F.lit(1), "digest": F.lit(0)})
    assert repairs(df.repartition(5), most_rows=most_rows) == mended_all(rows)


def test_repair_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repairs(none) == {} and repair.repaired(none).count() == 0
    gone = next((c, 0, "user", "x.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repairs(spark.createDataFrame([gone], none.schema)) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_inserts(monkeypatch):
    """Where deletions are dear, rows are put in, before, between and behind the others."""
    monkeypatch.setattr(repair, "DELETE", 11)
    r = random.Random(4)
    texts = ["", "a.", "a.", "no end", "b!"]
    rows = [[(t, r.choice(["system", "user", "assistant", "tool"]), r.choice(texts) if t % 3 else f"{t}.") for t in range(r.randrange(1, 12))] for _ in range(400)]
    codes = []
    for some in rows:
        seen = set()
        fault = [repair.BLANK if not x else repair.DUPLICATE if (o, x) in seen or seen.add((o, x)) else repair.CUT if x[-1] not in ".!?" else 0 for _, o, x in some]
        codes.append(bytes(4 * f + {"s": 0, "u": 1, "a": 2}.get(o[0], 3) for f, (_, o, _) in zip(fault, some)))
    got = {}
    for which, t in repair.tensors(codes):
        letters, _, _ = repair._edits(t, np.repeat(repair.END[None], len(which), 0), np.zeros(len(which), np.int64), np.ones(len(which), bool))
        got |= {int(i): bytes(letters[:, k].ravel()).replace(b"\0", b"").decode() for k, i in enumerate(which)}
    assert got == {i: mended(some, 11)[6] for i, some in enumerate(rows)} and sum("I" in g for g in got.values()) > 100


def test_repair_tensors():
    r = np.random.default_rng(0)
    codes = [bytes(r.integers(0, 16, n).astype(np.int8)) for n in (1, 1, 2, 3, 9, 9, 10, 400, 5000)]
    met = {}
    for which, rows in repair.tensors(codes):
        assert len(rows) <= max(4, 2 * min(len(codes[i]) for i in which))
        met |= {int(i): bytes(rows[rows[:, k] >= 0, k]) for k, i in enumerate(which)}
    assert met == dict(enumerate(codes))


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def own():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(own, text):
    ids = np.array(own.encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe(spark, own):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = byte_bpe.op12_byte_bpe(spark, D).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {i: digest(own, t) for i, t in texts.items()}
    assert len(rows) == len(texts)


def odd_texts():
    r = random.Random(5)
    some = ["a", "b", "'", "s", "ll", "re", " ", "  ", "\n", "\t", "1", "2", ".", "é", "漢", "　", "'v", "e", "😀", "\x00", "\x1c", "\x85"]
    long = ["a" * 500, " " * 300, "a" * 60 + " " * 60 + "b" * 60, "\n" * 90 + "x", ("ab'll " * 9 + "z" * 40) * 5, "word " * 200]
    return ["".join(r.choice(some) for _ in range(r.randrange(400))) for _ in range(120)] + long + [None, "", "<|endoftext|>", " "]


@pytest.mark.parametrize("step, overlap", [(20, 8), (64, 16), (byte_bpe.STEP, byte_bpe.OVERLAP)])
def test_byte_bpe_chunks(spark, own, step, overlap):
    """Chunks that share no boundary with the next (runs longer than an overlap), and those that do, give what whole texts give."""
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row long, ids string")
    rows = byte_bpe.digests(df, step, overlap).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {i: digest(own, t) for i, t in enumerate(texts)}
    assert len(rows) == len(texts)


def test_byte_bpe_rows(spark, own):
    long = "one two three " * 30
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, None)], "doc_id long, text string")
    parts = byte_bpe.decoded(byte_bpe.encoded(df, step=64, overlap=16)).collect()
    rows = {}
    for p in sorted(parts, key=lambda p: (p["row"], p["part"])):
        doc_id, ids, raw, n = rows.get(p["row"], (p["doc_id"], b"", b"", 0))
        rows[p["row"]] = doc_id, ids + p["ids"], raw + p["bytes"], n + 1
    assert all(rows[p["row"]][3] == p["n_parts"] for p in parts) and sum(v[3] > 1 for v in rows.values()) == 3
    want = np.array(own.encode_ordinary(long), "<u4").tobytes()
    assert sorted((v[0] or 0, v[1], v[2]) for v in rows.values()) == sorted([(1, want, long.encode())] * 2 + [(0, want, long.encode()), (0, b"", b"")])
    assert byte_bpe.digests(df.limit(0)).count() == 0 and byte_bpe.encoded(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encoded(df, step=8, overlap=8)


# --- source audit ---


def audit_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows) if rows else None
    res = con.execute(source_audit.ORACLE)
    assert [c[0] for c in res.description] == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(res.fetchall())


def test_source_audit(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got = sorted(map(tuple, source_audit.op13_source_audit(spark, D).collect()))
    assert got == sorted(con.execute(source_audit.ORACLE).fetchall()) and {r[2] for r in got} == {"pair", "term"}


def plain_audit(rows, least=3):
    """The pairs' values by loops over all terms."""
    counts, docs = {}, {}
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        of = counts.setdefault((lang or "", source or ""), {})
        for t in terms:
            of[t] = of.get(t, 0) + 1
        for t in set(terms):
            docs[lang or "", t] = docs.get((lang or "", t), 0) + 1
    out = {}
    for a in counts:
        for b in counts:
            if a[0] == b[0] and a != b:
                kept = [t for (lang, t), n in docs.items() if lang == a[0] and n >= least]
                p, q = ({t: 1 + 10**9 * (counts[g].get(t, 0) + 1) // (sum(counts[g].get(x, 0) for x in kept) + len(kept)) for t in kept} for g in (a, b))
                out[*a, b[1]] = sum((p[t] - q[t]) ** 2 // q[t] for t in kept)
    return out


def test_source_audit_odd(spark):
    """Terms that all groups share and terms of few, groups without text or without kept terms, nulls and repeated rows."""
    r = random.Random(2)
    words = ["the", "The", "of", "é", "É", "x1y", "über-all", "日本"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = [(" ".join(r.choice(words[: r.choice([8, 40, len(words)])]) for _ in range(r.randrange(30))), r.choice(["en", "fr", None]), r.choice([*(f"s{i}" for i in range(9)), None, ""])) for _ in range(300)]
    rows += [(None, "en", "none"), ("", "it", "a"), ("once", "it", "b"), ("12 34", "xx", "only"), (None, None, None)] + [("same same text", "en", "hot")] * 100 + [("zebra\x00zebra ZEBRA", "fr", "s1")] * 3
    df = spark.createDataFrame([(*x, 1, "t") for x in rows], "text string, lang string, source string, n long, term string")
    got = sorted(map(tuple, source_audit.audited(df.repartition(6)).collect()))
    assert got == audit_rows(rows)
    assert {(r[0], r[1], r[3]): r[4] for r in got if r[2] == "pair"} == plain_audit(rows)
    assert ("it", "a", "pair", "b", 0, 1) in got and not any(r[0] == "xx" for r in got)
    assert source_audit.audited(df.limit(0)).count() == 0


def test_source_audit_tiles():
    """Dense and sparse tiles of the same postings give the same sums of pairs."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    base = r.integers(1, 50, 7)
    held = [(t, g, int(p)) for t in range(60) for g in r.choice(7, r.integers(1, 7), replace=False).tolist() for p in [r.integers(1, 10**6)]]
    postings = pa.array([[{"t": t, "g": g, "p": p} for t, g, p in held]], pa.list_(pa.struct([("t", pa.int64()), ("g", pa.int32()), ("p", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), postings, pa.array([base.tolist()], pa.list_(pa.int64()))], ["lang", "postings", "base"])
    sums = []
    for of in (source_audit._dense, source_audit._sparse):
        s = np.zeros((7, 7), np.int64)
        for b in of([batch]):
            np.add.at(s, (b.column(1).to_numpy(), b.column(2).to_numpy()), b.column(3).to_numpy())
        sums.append(s)
    f = lambda p, q: (p - q) ** 2 // q
    assert (sums[0] == sums[1] + 60 * f(base[:, None], base[None])).all()


def test_source_audit_share(spark):
    """Shares stay exact where SCALE * count leaves 64 bits."""
    rows = [(a, b) for b in (1, 7, 10**12 + 39, 9 * 10**15 - 1) for a in (1, b // 3 + 1, b)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", source_audit._share(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * r["a"] // r["b"] for r in got)


def test_source_audit_blocks():
    words = source_audit._words(b"ab cd  ef " * 3 + b"x" * 20, 4)
    assert [w for some in words for w in some] == (b"ab cd  ef " * 3 + b"x" * 20).split()


def test_folders():
    assert not list(Path("/root/repo").rglob("*.tiktoken"))
