"""Secret scans: three fixed kinds of spans, and a randomness test battery for all other strings.

The battery takes every run of LEAST or more letters, digits and `+/_=-` that has a digit, infers its
encoding from the characters it has (of groups joined by - or _, such as UUIDs, from those of the groups), and holds
it against uniform draws from that alphabet: chi-squared over
the symbols, a runs test about the alphabet's middle, and serial correlation at lag one. Fisher's method joins
the three into log10 of one p value, at best 0; ordinary text is far below.

How far is read from the corpus: the letters of every document, whole, are cut into blocks of the least length of
each stratum of lengths, and go through the same battery as decoys, along with PRIOR decoys a stratum drawn from the
frequencies of letters, so that a table of any size has some. The share of decoys at least as random as a candidate,
counted one too many, is its p value for being ordinary text, and Benjamini and Hochberg's procedure at level `fdr`
runs over the candidates of each stratum, so that short strings, which tell less, need a better result than
long ones. Only the histograms of candidates and decoys, of fixed size, are gathered. A second pass over the texts
then finds, or masks, the spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .minhash_dedup import chunks

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of a run of A-Z0-9 after AKIA, 20 or more characters in all
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
DIGIT = re.compile("[0-9]")
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: name, symbols in order, tried in this order
ENCODINGS = [
    (name, re.compile(f"[{re.escape(symbols)}]+=*"), {c: i for i, c in enumerate(symbols)})
    for lower, upper, digits in [("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")]
    for name, symbols in [
        ("decimal", digits), ("hex", digits + lower[:6]), ("HEX", digits + upper[:6]), ("base32", upper + digits[2:8]), ("base36", digits + lower),
        ("BASE36", digits + upper), ("base62", upper + lower + digits), ("base64", upper + lower + digits + "+/"), ("base64url", upper + lower + digits + "-_"), ("mixed", upper + lower + digits + "+/-_="),
    ]
]
#: How many of ENCODINGS a string of groups joined by - or _ may have within its groups.
GROUPED = 6
STRATA = (LEAST, 28, 40, 64, 128)
BIN, BINS = 0.05, 240  # of -log10 p, the last one open
#: Decoys a stratum that any corpus has, and how often letters from a to z come in a thousand of English prose.
PRIOR = 2000
FREQUENCIES = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
CHUNK = 1 << 18


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of x >= 0, within 1.2e-7 of its value (Chebyshev fit in 1 / (1 + x / 2))."""
    t = 1 / (1 + 0.5 * x)
    fit = np.polynomial.polynomial.polyval(t, (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277))
    return t * np.exp(-x * x + fit)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return np.maximum(_erfc(np.abs(z) / np.sqrt(2)), 1e-15)


def battery(codes: np.ndarray, k: int) -> np.ndarray:
    """-log10 of the battery's p value for each row of codes below k: near 0 for random rows, large for others."""
    m, n = codes.shape
    counts = np.bincount((np.arange(m)[:, None] * k + codes).ravel(), minlength=m * k).reshape(m, k)
    chi2 = np.einsum("ij,ij->i", counts, counts) * k / n - n
    z = (np.cbrt(chi2 / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / np.sqrt(2 / (9 * (k - 1)))  # Wilson and Hilferty
    tail = 0.5 * _erfc(np.abs(z) / np.sqrt(2))
    uniform = np.maximum(np.where(z > 0, tail, 1 - tail), 1e-15)
    high = codes >= k / 2
    n1 = high.sum(axis=1)
    runs, mean = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1), 1 + 2 * n1 * (n - n1) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        turns = np.where(var > 0, _two_sided((runs - mean) / np.sqrt(var)), 1e-15)
        turns = np.where((n1 == 0) | (n1 == n), max(2.0 ** (1 - n), 1e-15), turns)
        d = codes - codes.mean(axis=1, keepdims=True, dtype=np.float32)
        s2 = (d * d).sum(axis=1)
        serial = np.where(s2 > 0, _two_sided(((d[:, 1:] * d[:, :-1]).sum(axis=1) / s2 + 1 / (n - 1)) * np.sqrt(n)), 1e-15)
    f = -np.log(uniform) - np.log(turns) - np.log(serial)
    return np.maximum((f - np.log1p(f + f * f / 2)) / np.log(10), 0.0)


def encoded(s: str) -> tuple[str, list[int], int]:
    """The inferred encoding of s, its symbols' places in the alphabet, and the alphabet's size."""
    groups = re.sub("[-_]", "", s)
    tries = [(s, e) for e in ENCODINGS[:GROUPED]] + [(groups, e) for e in ENCODINGS[:GROUPED] if groups != s] + [(s, e) for e in ENCODINGS[GROUPED:]]
    x, (name, _, order) = next((x, e) for x, e in tries if e[1].fullmatch(x))
    return name, [order[c] for c in x if c in order], len(order)


def randomness(s: str) -> tuple[str, float]:
    """The inferred encoding of s and -log10 of the battery's p value."""
    name, codes, k = encoded(s)
    return name, float(battery(np.array([codes]), k)[0]) if len(codes) >= 8 else BIN * BINS


def stratum(length: int) -> int:
    return sum(length >= s for s in STRATA) - 1


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of each candidate outside the fixed spans."""
    found = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if DIGIT.search(m[0]) and not any(x < b and a < y for x, _, y in base):
            found.append((a, b, stratum(b - a), min(int(randomness(m[0])[1] / BIN), BINS - 1)))
    return found


def _bins(values: np.ndarray) -> np.ndarray:
    return np.minimum((values / BIN).astype(np.int64), BINS - 1)


def decoys(texts: list[bytes]) -> np.ndarray:
    """How many blocks of the letters of texts fall into each (stratum, bin)."""
    h = np.zeros((len(STRATA), BINS), np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    at, letters = owner[letter], data[letter]
    sizes = np.bincount(at, minlength=len(texts))
    ends = np.cumsum(sizes)
    for s, n in enumerate(STRATA):
        blocks = sizes // n
        first = np.repeat(ends - sizes, blocks) + (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * n
        x = letters[first[:, None] + np.arange(n)]
        upper, place = (x < 97), (x & 31) - 1
        ups, hexes = upper.sum(axis=1), (place < 6).all(axis=1)
        # alphabets as in ENCODINGS: digits before letters but for base32 and base62
        for rows, code, k in (
            ((ups == 0) & ~hexes, place + 10, 36), ((ups == n) & ~hexes, place, 32), ((ups > 0) & (ups < n), place + 26 * ~upper, 62), (((ups == 0) | (ups == n)) & hexes, place + 10, 16),
        ):
            some = np.flatnonzero(rows)
            if len(some):
                h[s] += np.bincount(_bins(battery(code[some], k)), minlength=BINS)
    return h


def _prior() -> np.ndarray:
    """Of PRIOR decoys a stratum, drawn letter by letter."""
    share = np.array(FREQUENCIES) / sum(FREQUENCIES)
    r = np.random.default_rng(0)
    return np.stack([np.bincount(_bins(battery(r.choice(26, (PRIOR, n), p=share) + 10, 36)), minlength=BINS) for n in STRATA])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (s, p, found, made) for each (stratum, bin) of the task's texts."""
    h = np.zeros((2, len(STRATA), BINS), np.int64)
    for _, texts in chunks(batches, CHUNK):
        h[1] += decoys(texts)
        for t in texts:
            t = t.decode()
            for _, _, s, p in candidates(t, base_spans(t)):
                h[0, s, p] += 1
    s, p = np.nonzero(h.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(p), pa.array(h[0, s, p]), pa.array(h[1, s, p])], ["s", "p", "found", "made"])


def limits(docs: DataFrame, fdr: float) -> dict[int, int]:
    """The last bin of each stratum that is still called random, over all texts of docs. Gathers a histogram of fixed size."""
    tally = docs.select(F.lit(0).cast("long").alias("k"), F.col("text").cast("binary")).mapInArrow(_tally, "s long, p long, found long, made long")
    h = np.stack([np.zeros((len(STRATA), BINS)), _prior()])
    for r in tally.groupBy("s", "p").agg(F.sum("found").alias("found"), F.sum("made").alias("made")).collect():
        h[:, r["s"], r["p"]] += (r["found"], r["made"])
    out = {}
    for s in range(len(STRATA)):
        found, made = np.cumsum(h[0, s]), np.cumsum(h[1, s])
        good = np.flatnonzero((made + 1) / (made[-1] + 1) * found[-1] <= fdr * found)
        if found[-1] and len(good):
            out[s] = int(good[-1])
    return out


def spans_of(text: str, cut: dict[int, int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds and of the candidates within the limits, by start and then kind."""
    base = base_spans(text)
    return sorted(base + [(a, 3, b) for a, b, s, p in candidates(text, base) if p <= cut.get(s, -1)])


def secret_spans(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, spans) for each row of docs (doc_id, text).

    spans is an array of (start, kind, end) by start and then kind, in code points with the end exclusive; kind
    indexes KINDS and the first three are the fixed ones. Null and empty texts have none; texts are scanned
    whole; repeated rows come back as often; an empty table gives an empty result; other columns are ignored.
    """
    cut = limits(docs, fdr)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t.as_py() or "", cut) for t in batch.column(1)]
            n = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(3)]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["a", "k", "b"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.ListArray.from_arrays(pa.array(offsets), spans)], ["doc_id", "n_assign", "n_access", "n_hex", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, spans array<struct<a:int,k:int,b:int>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["a"].cast("string"), x["b"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with every span replaced by mark; overlapping spans make one."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[secret]", fdr: float = 0.05) -> DataFrame:
    """docs, all columns, with every span in text replaced by mark and n_chars, if there, counted anew.

    Each row is masked where it is scanned, so that repeated rows and rows without a doc_id are masked, too.
    Documents without spans and null texts stay as they are.
    """
    cut = limits(docs, fdr)

    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, spans_of(t, cut), mark), na_action="ignore")

    hidden = F.pandas_udf(hide, "string")
    out = docs.withColumn("__text", hidden(F.col("text")))
    same = F.col("__text").eqNullSafe(F.col("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("__text").cast("long")))
    return out.withColumn("text", F.col("__text")).select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of each of the documents."""
    s = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"] < 3)
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
