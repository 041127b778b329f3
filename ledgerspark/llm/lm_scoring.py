"""LM scoring: a small causal self-attention model over subword ids, with a memory of words.

Texts become subword ids (public tokenizer), an end id last. Windows of 2 * HALF ids overlap by half: each id is
predicted once, in the second half of its window, from all ids of the window before it, by one head of masked
attention and a hidden layer. What is predicted is the id's class (of CLASSES, by k-means over the neighbours that
an id has), and within a class an id has its own share, so that a probability is two small factors.

A word's probability mixes three: at weight MEMORY its share among all training words; at weight CACHE its share among
the words of the text before it (of the first word this goes to the memory); and else the model's product over its
subwords. They are added in logarithms, as the product of a long word is less than any double. score adds up log10 of
these over the words and the end. The counts of the MOST_KNOWN most frequent words go to every task, and the others are
joined.

All training documents are counted and learned from: they are dealt by hash, a copy of the model descends on each
CHUNK of ids, about, and the copies are averaged by ids, ROUNDS times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, drop_since, stored, summed, table, written
from .minhash_dedup import Powers, chunks, hashed_words, located_words
from .tokens import coder, word_bpe

DIM, HIDDEN, HALF, CLASSES = 16, 32, 16, 192
TOP, OTHER, NEAR = 4096, 1024, 128
END_ID, END_HASH = 49407, 1
DOCS_A_TASK, ROUNDS, BATCH = 640, 1, 32
MEMORY, CACHE, MOST_KNOWN = 0.55, 0.15, 1 << 20
RATE = 0.01
SAFE = 60


def rows_of(ids: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rows of the embedding: frequent ids have their own, the others share by remainder; the last one starts a text."""
    r = rank[ids]
    return np.where(r < TOP, r, TOP + ids % OTHER)


START = TOP + OTHER


def laid_out(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids of texts that end at `ends` in a line of blocks of HALF, each text after an empty block; and which blocks are not empty."""
    sizes = np.diff(np.concatenate([[0], ends]))
    room = -(-sizes // HALF) * HALF + HALF
    start = np.cumsum(np.concatenate([[0], room[:-1]])) + HALF
    place = np.arange(len(ids)) + np.repeat(start - np.concatenate([[0], ends[:-1]]), sizes)
    full = np.zeros(int(room.sum()) // HALF, bool)
    full[place // HALF] = True
    return place, np.flatnonzero(full)


#: A query at HALF + i sees keys up to HALF + i.
MASK = np.where(np.arange(2 * HALF) <= HALF + np.arange(HALF)[:, None], 0.0, -1e9).astype(np.float32)


def extreme(x: np.ndarray) -> bool:
    """Whether exp of x, and sums of it, could leave the range of floats; if not, no row's greatest need be taken off first."""
    return len(x) > 0 and (x.max() > SAFE or x.min() < -SAFE)


def fresh(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shape = {"E": (START + 1, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "x": (DIM, HIDDEN), "o": (DIM, HIDDEN), "h": (HIDDEN,), "u": (HIDDEN, CLASSES), "c": (CLASSES,), "near": (HALF, 2 * HALF)}
    return {n: (r.normal(0, 0.3 if n == "E" else 1 / math.sqrt(s[0]), s) * (len(s) > 1 and n != "near")).astype(np.float32) for n, s in shape.items()}


def flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def forward(p: dict, rows: np.ndarray, empty: np.ndarray) -> dict:
    """rows, empty: (windows, 2 * HALF), the embedding's row for each id's predecessor and whether there is none. logits: a row a place."""
    x = p["E"].take(rows, axis=0)
    xq = np.ascontiguousarray(x[:, HALF:])
    q, k, v = flat(xq) @ p["q"], flat(x) @ p["k"], flat(x) @ p["v"]
    q *= q.dtype.type(1 / math.sqrt(DIM))
    z = flat(xq) @ p["x"]
    z += p["h"]
    return {"x": x, "xq": xq} | attended(p, q.reshape(xq.shape), k.reshape(x.shape), v.reshape(x.shape), z, empty)


def attended(p: dict, q: np.ndarray, k: np.ndarray, v: np.ndarray, z: np.ndarray, empty: np.ndarray) -> dict:
    """The rest of forward(), from what its ids' rows are projected to: q (scaled), k, v, and z, the hidden layer's share of the id itself."""
    s = q @ k.transpose(0, 2, 1)
    s += p["near"]
    far = extreme(s)
    s += MASK
    some = np.flatnonzero(empty @ np.ones(2 * HALF, empty.dtype))
    if len(some):
        s[some] += (empty[some] * np.float32(-1e9))[:, None, :]
    if far:
        s -= s.max(axis=2, keepdims=True)
    a = np.exp(s, out=s)
    a /= (flat(a) @ np.ones(2 * HALF, a.dtype)).reshape(len(q), HALF, 1)
    o = a @ v
    z += flat(o) @ p["o"]
    top = np.ones((len(z), HIDDEN + 1), z.dtype)  # its last column takes c in
    np.maximum(z, 0, out=top[:, :HIDDEN])
    logits = top @ np.concatenate([p["u"], p["c"][None]])
    if extreme(logits):
        logits -= logits.max(axis=1, keepdims=True)
    return {"q": q, "k": k, "v": v, "a": a, "o": o, "top": top, "logits": logits}


def gradients(p: dict, f: dict, rows: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over the places where counts is 1; of E for `rows` only. Uses f's arrays up."""
    b = len(rows)
    d = np.exp(f["logits"], out=f["logits"])
    total = d @ np.ones(d.shape[1], d.dtype)
    d[np.arange(len(d)), classes.ravel()] -= total
    scale = (counts.ravel() / max(counts.sum(), 1) / total).astype(d.dtype)  # of d's rows, put on what is narrower than d
    top, o, xq, x = f["top"], flat(f["o"]), flat(f["xq"]), flat(f["x"])
    u = (top * scale[:, None]).T @ d
    g = {"u": u[:-1], "c": u[-1]}
    dz = d @ p["u"].T
    dz *= scale[:, None]
    dz *= top[:, :-1] > 0
    g |= {"x": xq.T @ dz, "o": o.T @ dz, "h": dz.sum(axis=0)}
    do = (dz @ p["o"].T).reshape(b, HALF, DIM)
    ds = do @ f["v"].transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", ds, f["a"])[..., None]
    ds *= f["a"]
    g["near"] = ds.sum(axis=0)
    dq, dk, dv = flat(ds @ f["k"]) * ds.dtype.type(1 / math.sqrt(DIM)), flat(ds.transpose(0, 2, 1) @ f["q"]), flat(f["a"].transpose(0, 2, 1) @ do)
    g |= {"q": xq.T @ dq, "k": x.T @ dk, "v": x.T @ dv}
    dx = (dk @ p["k"].T + dv @ p["v"].T).reshape(b, 2 * HALF, DIM)
    dx[:, HALF:] += (dq @ p["q"].T + dz @ p["x"].T).reshape(b, HALF, DIM)
    order = np.argsort(rows.ravel().astype(np.uint16), kind="stable")  # START fits
    r = rows.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return g | {"E": np.add.reduceat(flat(dx).take(order, axis=0), first, axis=0), "rows": r[first]}


def windows(ids: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rows, empty, place of each id among the windows' second halves) for the ids of texts that end at ends."""
    place, blocks = laid_out(ids, ends)
    n = (int(place[-1]) // HALF + 1) * HALF if len(place) else 0
    row, empty = np.full(n, START), np.ones(n, np.float32)
    before = rows_of(ids, rank)
    before = np.concatenate([[START], before[:-1]])
    before[np.concatenate([[0], ends[:-1]])] = START
    row[place], empty[place] = before, 0
    by = lambda a: np.concatenate([a.reshape(-1, HALF)[blocks - 1], a.reshape(-1, HALF)[blocks]], axis=1)
    where = np.zeros(n // HALF, np.int64)
    where[blocks] = np.arange(len(blocks))
    return by(row), by(empty), where[place // HALF] * HALF + place % HALF


def subwords(texts: list[bytes], tokenizer: str, located: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts with END_ID behind each, where each text's ids end, where each word's and end's ids end); located: located_words() of the texts, if known."""
    ids, sizes, first = coder(tokenizer).spans(texts, located)
    text_ends = np.concatenate([[0], np.cumsum(sizes)])[first[1:]]
    ids = np.insert(ids.astype(np.int64), text_ends, END_ID)
    of_unit = np.cumsum(np.insert(sizes, first[1:], 1))
    return ids, text_ends + np.arange(1, len(texts) + 1), of_unit


def _averaged(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of rows m of `size` doubles as bytes, level by level, so that few reach a task or the driver."""
    rows = summed(parts, []).collect()
    return np.sum([np.frombuffer(r["m"], np.float64) for r in rows], axis=0) if rows else np.zeros(size)


def train(docs: DataFrame, tokenizer: str) -> dict:
    """The model, from the texts of docs (doc_id, text)."""
    spark, vocabulary = docs.sparkSession, coder(tokenizer).tokenizer.get_vocab_size()
    tasks = max(1, docs.count() // DOCS_A_TASK)
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, texts in chunks(batches):
            ids, ends = subwords(texts, tokenizer)[:2]
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array([x.astype(kind).tobytes() for x in np.split(ids, ends[:-1])], pa.binary())], ["task", "ids"])

    dealt = docs.select(F.pmod(F.hash("doc_id", "text"), F.lit(tasks)).alias("task"), "text").mapInArrow(encoded, "task int, ids binary")
    dealt = stored(dealt.repartitionById(tasks, F.col("task")))

    def per_task(of_ids):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = None
            for _, some in chunks(batches):
                ids = np.frombuffer(b"".join(some), kind).astype(np.int64)
                new = of_ids(ids, np.cumsum([len(x) // kind.itemsize for x in some])).astype(np.float64)
                m = new if m is None else m + new
            if m is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["p", "m"])

        return dealt.mapInArrow(of, "p int, m binary")

    uses = _averaged(per_task(lambda ids, ends: np.bincount(ids, minlength=vocabulary)), vocabulary)
    order = np.lexsort((np.arange(vocabulary), -uses))
    rank = np.empty(vocabulary, np.int64)
    rank[order] = np.arange(vocabulary)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each of the TOP ids has each of the NEAR ones before and behind it, in the task's texts."""
        m = np.zeros(TOP * 2 * NEAR, np.int64)
        for _, some in chunks(batches):
            ids = np.frombuffer(b"".join(some), kind).astype(np.int64)
            ends = np.cumsum([len(x) // kind.itemsize for x in some])
            r = rank[ids]
            inside = np.ones(max(len(ids) - 1, 0), bool)
            inside[ends[:-1] - 1] = False  # a text's end and the next text are no neighbours
            for side, (here, there) in enumerate(((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))):
                t = (r[here] < TOP) & inside
                m += np.bincount(r[here][t] * (2 * NEAR) + side * NEAR + np.minimum(r[there][t], NEAR - 1), minlength=len(m))
        cell = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(m[cell])], ["cell", "n"])

    cells = dealt.mapInArrow(near, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # TOP * 2 * NEAR rows at most
    neighbours = np.zeros(TOP * 2 * NEAR)
    neighbours[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    classes = np.full(vocabulary, CLASSES - 1)
    classes[order[:TOP]] = _clusters(neighbours.reshape(TOP, 2 * NEAR), CLASSES - 1)
    within = (uses + 0.5) / np.bincount(classes, uses + 0.5, CLASSES)[classes]
    params = fresh()
    names = list(params)
    for turn in range(ROUNDS):

        def descend(ids: np.ndarray, ends: np.ndarray, start=params) -> np.ndarray:
            p = _descended({k: v.copy() for k, v in start.items()}, ids, ends, rank, classes, turn)
            return np.concatenate([*(p[k].ravel() * float(len(ids)) for k in names), [float(len(ids))]])

        total = _averaged(per_task(descend), 1 + sum(v.size for v in params.values()))
        if not total[-1]:
            break
        flat, at, new = total[:-1] / total[-1], 0, {}
        for k in names:
            new[k] = flat[at : at + params[k].size].reshape(params[k].shape).astype(np.float32)
            at += params[k].size
        params = new
    drop(dealt)
    return {"params": params, "rank": rank, "classes": classes, "within": np.log(within)}


def _clusters(counts: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    x = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    centres = x[np.linspace(0, len(x) // 4, k).astype(int)]
    for _ in range(rounds):
        label = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x * np.sqrt(counts.sum(axis=1, keepdims=True)))
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return label


def _descended(p: dict, ids: np.ndarray, ends: np.ndarray, rank: np.ndarray, classes: np.ndarray, turn: int) -> dict:
    """One pass of Adam over all windows, in a fixed random order."""
    rows, empty, at = windows(ids, ends, rank)
    target, counts = np.zeros(rows.shape[0] * HALF, np.int64), np.zeros(rows.shape[0] * HALF, np.float32)
    target[at], counts[at] = classes[ids], 1
    target, counts = target.reshape(-1, HALF), counts.reshape(-1, HALF)
    names = [k for k in p if k != "E"]
    dense = np.concatenate([p[k].ravel() for k in names])  # all but the embedding lie in one row, so that a step is few calls
    cuts = np.cumsum([p[k].size for k in names])[:-1]
    p = {"E": p["E"]} | {k: x.reshape(p[k].shape) for k, x in zip(names, np.split(dense, cuts))}
    means = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (dense, p["E"])]
    order = np.random.default_rng(turn).permutation(len(rows))
    for t, a in enumerate(range(0, len(order), BATCH)):
        b = order[a : a + BATCH]
        g = gradients(p, forward(p, rows[b], empty[b]), rows[b], target[b], counts[b])
        rate = RATE * (1 - 0.8 * a / len(order)) * math.sqrt(1 - 0.98 ** (t + 1)) / (1 - 0.9 ** (t + 1))
        # embeddings that a step does not meet keep their means
        for (x, m, v), at, gx in zip(means, (slice(None), g["rows"]), (np.concatenate([g[k].ravel() for k in names]), g["E"])):
            mk, vk = m[at], v[at]
            mk += 0.1 * (gx - mk)
            vk += 0.02 * (gx * gx - vk)
            m[at], v[at] = mk, vk
            x[at] -= np.float32(rate) * mk / (np.sqrt(vk) + np.float32(1e-6))
    return p


def log_probabilities(model: dict, ids: np.ndarray, ends: np.ndarray, step: int = 64) -> np.ndarray:
    """Natural logarithms for each id given those before it in its window; `step` windows at a time stay in a core's cache."""
    rows, empty, at = windows(ids, ends, model["rank"])
    target = np.zeros(rows.shape[0] * HALF, np.int64)
    target[at] = model["classes"][ids]
    p, out = model["params"], []
    # each row of the embedding is projected once, not wherever it comes
    q, z, k, v = p["E"] @ p["q"] * p["q"].dtype.type(1 / math.sqrt(DIM)), p["E"] @ p["x"] + p["h"], p["E"] @ p["k"], p["E"] @ p["v"]
    for a in range(0, len(rows), step):
        own, seen = np.ascontiguousarray(rows[a : a + step, HALF:]), rows[a : a + step]
        logits = attended(p, q.take(own, axis=0), k.take(seen, axis=0), v.take(seen, axis=0), flat(z.take(own, axis=0)), empty[a : a + step])["logits"]
        hit = logits[np.arange(len(logits)), target[a * HALF : a * HALF + len(logits)]]
        out.append(hit - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)))
    return np.concatenate(out)[at].astype(float) + model["within"][ids] if out else np.zeros(0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word, by hash, and the end of a text come in docs (doc_id, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0

        def done() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for _, texts in chunks(batches):
            held += [hashed_words(texts, powers)[0], np.full(len(texts), END_HASH, np.uint64)]
            size += len(held[-2])
            if size > 2_000_000:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def earlier(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word how often it comes, and how many words there are, before it among those of its owner."""
    order = np.lexsort((h, owner))  # keeps the order of what is equal
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])]) if len(h) else np.zeros(0, bool)
    at = np.arange(len(h))
    same = np.empty(len(h), np.int64)
    same[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return same, at - np.searchsorted(owner, owner)


def scored(docs: DataFrame, training: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs' doc_id with n_tokens, n_known, train_tokens, base_score and score, learned from training (both doc_id, text).

    Null, empty and blank texts are the end alone. Texts are scored whole. Repeated rows are scored each time. With
    no training rows every count is 0 and the model is the untrained one; an empty table gives an empty result;
    other columns are ignored.
    """
    mark = written()
    spark, tokenizer = docs.sparkSession, tokenizer or word_bpe()
    counts = stored(word_counts(training))
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    least = n + 0.5 * (v + 1)
    known = counts.orderBy(F.desc("c"), "h").limit(MOST_KNOWN).toArrow().sort_by("h")  # 16 bytes a row
    model = train(training.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), tokenizer)
    shared = spark.sparkContext.broadcast((model, known["h"].to_numpy(), known["c"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, uses = shared.value
        powers, row = Powers(), TaskContext.get().partitionId() << 40
        for ids, texts in chunks(batches):
            hashed, first = (located := located_words(texts, powers))[:2]
            subs, text_ends, unit_ends = subwords(texts, tokenizer, located)
            logs = np.concatenate([[0.0], np.cumsum(log_probabilities(model, subs, text_ends))])
            unit = logs[unit_ends] - logs[np.concatenate([[0], unit_ends[:-1]])]
            # units are the words with the end behind each text's
            owner = np.repeat(np.arange(len(texts)), np.diff(first) + 1)
            h = np.insert(hashed, first[1:], np.uint64(END_HASH)).view(np.int64)
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            c = np.where(words[at] == h, uses[at], 0) if len(words) else np.zeros(len(h), np.int64)
            same, before = earlier(h, owner)
            memory = np.where(before > 0, MEMORY, MEMORY + CACHE)
            with np.errstate(divide="ignore"):
                other = np.logaddexp(math.log(1 - MEMORY - CACHE) + unit, np.log(CACHE * same / np.maximum(before, 1)))
                share = np.log(memory * c / max(n, 1))
            total = np.bincount(owner, np.where(c > 0, np.logaddexp(share, other) / math.log(10), 0.0), len(texts))
            base = np.bincount(owner, np.where(c > 0, np.log10((c + 0.5) / least), 0.0), len(texts))
            rare = np.flatnonzero(c == 0)
            offsets = np.searchsorted(owner[rare], np.arange(len(texts) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(h[rare]), pa.array(other[rare]), pa.array(memory[rare])], ["h", "other", "memory"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(texts))), pa.array(ids, pa.int64()), pa.array(np.diff(first) + 1), pa.array(np.bincount(owner, c > 0, len(texts)).astype(np.int64)), pa.array(base), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), pairs)],
                ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"],
            )
            row += len(texts)

    seen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    seen = stored(seen.mapInArrow(score, "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<h:long,other:double,memory:double>>"))
    rare = seen.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.other", "x.memory").join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share = F.log(F.col("c") * F.col("memory") / F.lit(float(max(n, 1))))
    both = F.greatest(share, "other") + F.log1p(F.exp(-F.abs(share - F.col("other"))))
    more = F.sum(F.log10((F.col("c") + 0.5) / F.lit(float(least)))).alias("more")
    rest = stored(rare.groupBy("row").agg(more, F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum(F.when(F.col("c") > 0, both).otherwise(F.col("other")) / math.log(10)).alias("rest")))
    drop_since(spark, mark, seen, rest)
    out = seen.drop("rare").join(rest, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each of the documents, learned from those outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))  # without a doc_id: not held out
    out = scored(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
