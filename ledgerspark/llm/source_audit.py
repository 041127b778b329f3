"""Source divergence audit: how far each source's use of terms lies from each other source's of its language.

A term's share in a group (lang, source) is p = 1 + floor(SCALE * (count + 1) / (N + V)), and the divergence of p from q
sums floor((p - q)^2 / q) over the V terms that the language keeps. Terms are split by how many groups have them:

* heavy ones, in more than half of a language's groups, fill dense numpy tiles of terms by groups, in which each group
  without the term has its share of no occurrence; a tile gives the sums of all pairs of its columns;
* light ones are postings. Were they in no group, each pair (g, h) of groups would get the same summand f(b_g, b_h) from
  each of them, b being the share of no occurrence. What a term adds to that is, for all h, f(p_g, b_h) - f(b_g, b_h) where
  g has it, likewise for h, and for pairs that both have it f(p_g, p_h) - f(p_g, b_h) - f(b_g, p_h) + f(b_g, b_h). The first
  two are taken once for all terms of one share in a group, the third from pairs within a term's postings.

Floors are taken a term at a time in both, and all sums are of integers, so the parts add up exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE, LEAST_DOCS, RANKS = 1_000_000_000, 3, 200
#: Distinct terms of all groups that a worker counts before it hands them on, cells of a dense tile, postings of a light one,
#: and pairs that a tile sums at a time.
MOST_COUNTED, CELLS, POSTINGS, PAIRS = 300_000, 1 << 20, 1 << 16, 1 << 21

#: Bytes of a term as they are (A-Z as a-z), all others as spaces: a character beyond ASCII is a letter in each of its bytes.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(folded: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text, of about `most` bytes at a time."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + most)
        yield folded[at : end if end >= 0 else None].split()
        at = end if end >= 0 else len(folded)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, summed as far as its memory goes; a group's own row has no term."""
    names = ["lang", "source", "term", "n", "docs"]

    def handed(seen) -> pa.RecordBatch:
        keys = [(*g, t) for g, (n, _) in seen.items() for t in n]
        values = [c for n, _ in seen.values() for c in n.values()], [docs[t] for n, docs in seen.values() for t in n]
        of = [pa.array([k[i] for k in keys], pa.string() if i < 2 else pa.binary()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*of[:2], of[2].cast(pa.string()), *(pa.array(v, pa.int64()) for v in values)], names)

    seen: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    groups: set[tuple] = set()
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, docs = seen[lang, source]
            own: set[bytes] = set()
            for words in _words(text.as_py().translate(_FOLDED)):
                n.update(words)
                own.update(words)
            docs.update(own)
            groups.add((lang, source))
        if sum(len(n) for n, _ in seen.values()) >= MOST_COUNTED:
            yield handed(seen)
            seen.clear()
        if len(groups) >= MOST_COUNTED:
            yield _groups(groups, names)
            groups.clear()
    yield handed(seen)
    yield _groups(groups, names)


def _groups(groups: set[tuple], names: list[str]) -> pa.RecordBatch:
    langs, sources = zip(*groups) if groups else ((), ())
    zeros = pa.array([0] * len(groups), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.nulls(len(groups), pa.string()), zeros, zeros], names)


def _share(n: Column, of: Column) -> Column:
    """1 + floor(SCALE * n / of) for n <= of, by long division three digits at a time: no product leaves 64 bits while of < 9e15."""
    out, rest = F.lit(1).cast("long"), n
    for power in (1_000_000, 1000, 1):
        out = out + F.call_function("div", rest * 1000, of) * power
        rest = rest * 1000 % of
    return out


def _f(p, q):
    """floor((p - q)^2 / q) of numpy arrays; shares are at most SCALE + 1, so squares stay within 64 bits."""
    return (p - q) ** 2 // q


def _rows(lang: str, g: np.ndarray, h: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int32()), pa.array(h, pa.int32()), pa.array(v, pa.int64())], ["lang", "g", "h", "v"])


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, g, h, v): of each tile of heavy terms, the sums of all pairs of groups."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, (term, g, p), base = batch.column(0)[i].as_py(), _flat(batch.column(1), i), batch.column(2).slice(i, 1).flatten().to_numpy()
            _, row = np.unique(term, return_inverse=True)
            tile = np.repeat(base[:, None], row.max() + 1, 1)  # groups by terms
            tile[g, row] = p
            some = max(1, PAIRS // tile.size)
            for a in range(0, len(base), some):
                sums = np.stack([_f(tile[x], tile).sum(1) for x in range(a, min(a + some, len(base)))])
                yield _rows(lang, np.repeat(np.arange(a, a + len(sums)), len(base)), np.tile(np.arange(len(base)), len(sums)), sums.ravel())


def _flat(column: pa.Array, i: int) -> list[np.ndarray]:
    """The postings (term, g, p) of row i as arrays."""
    return [x.to_numpy() for x in column.slice(i, 1).flatten().flatten()]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, g, h, v): what each tile of light terms adds to f(b_g, b_h) for each of them."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, (term, g, p), base = batch.column(0)[i].as_py(), _flat(batch.column(1), i), batch.column(2).slice(i, 1).flatten().to_numpy()
            every, size = np.arange(len(base)), len(base)
            # one side: all terms of one share in a group at once
            sides, times = np.unique(np.stack([g, p]), axis=1, return_counts=True)
            for a in range(0, len(times), some := max(1, PAIRS // size)):
                x, q, m = sides[0, a : a + some], sides[1, a : a + some, None], times[a : a + some, None]
                b = base[x][:, None]
                yield _summed(lang, np.concatenate([np.repeat(x, size), np.tile(every, len(x))]), np.concatenate([np.tile(every, len(x)), np.repeat(x, size)]), np.concatenate([(m * (_f(q, base) - _f(b, base))).ravel(), (m * (_f(base, q) - _f(base, b))).ravel()]), size)
            # both sides: pairs within each term's postings, terms of about PAIRS pairs at a time
            order = np.argsort(term, kind="stable")
            g, p = g[order], p[order]
            _, first, n = np.unique(term[order], return_index=True, return_counts=True)
            upto = np.cumsum(n.astype(np.int64) ** 2)
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(upto // PAIRS)) + 1):
                k = np.repeat(first[part], n[part]), np.repeat(n[part], n[part])  # each posting with its term's first one and their number
                at = np.concatenate([np.arange(a, a + c) for a, c in zip(first[part], n[part])])
                left = np.repeat(at, k[1])
                right = np.arange(len(left)) - np.repeat(np.cumsum(k[1]) - k[1], k[1]) + np.repeat(k[0], k[1])
                x, y, px, py = g[left], g[right], p[left], p[right]
                yield _summed(lang, x, y, _f(px, py) - _f(px, base[y]) - _f(base[x], py) + _f(base[x], base[y]), size)


def _summed(lang: str, g: np.ndarray, h: np.ndarray, v: np.ndarray, size: int) -> pa.RecordBatch:
    code, at = np.unique(g.astype(np.int64) * size + h, return_inverse=True)
    sums = np.zeros(len(code), np.int64)
    np.add.at(sums, at, v)
    return _rows(lang, code // size, code % size, sums)


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Part `pair`: the divergence of a source from each other source of its language, over all terms that at least
    least_docs of the language's documents have; 0 where there are none. Part `term`: the terms that a source has and uses
    more than its language does, with what each adds to the divergence from the language, the first `ranks` of them. Ranks
    go by value, the largest first, then by item. Null texts, langs and sources are ''; repeated rows are documents of
    their own; an empty table gives no rows; other columns are ignored.

    Counts are summed in the tasks that read the texts and again by (lang, source, term) before anything is gathered, so
    that a hot source costs one row a term. A term's postings are at most its language's sources, and so is a tile's
    other side; the result has a row for each pair of these.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("held"))
    terms = stored(terms.where(F.col("docs") >= least_docs).drop("docs"))
    postings = stored(counts.where("term is not null").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "total", "held"))

    # a row a group and a row a language; both are few beside the postings
    langs = terms.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    groups = counts.where("term is null").select("lang", "source").join(postings.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.select("lang", "source", zero("n_group"), zero("n_lang"), zero("v"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"), F.count("*").over(Window.partitionBy("lang")).alias("sources"))
    groups = stored(groups.withColumn("base", F.when(F.col("v") > 0, _share(F.lit(1).cast("long"), F.col("n_group") + F.col("v")))))
    shared = postings.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n") + 1, F.col("n_group") + F.col("v")))

    return _pairs(shared, terms, groups).union(_terms(shared, ranks))


def _terms(shared: DataFrame, ranks: int) -> DataFrame:
    q = _share(F.col("total") + 1, F.col("n_lang") + F.col("v"))
    more = shared.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    return more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)


def _pairs(shared: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    # tiles: of CELLS dense cells or POSTINGS postings each, by the language's numbers of terms, groups and postings
    heavy = F.col("held") * 2 > F.col("sources")
    size = stored(terms.join(groups.select("lang", "sources").distinct(), "lang").groupBy("lang").agg(F.sum(F.when(heavy, F.col("sources"))).alias("cells"), F.sum(F.when(~heavy, F.col("held"))).alias("light"), F.count_if(~heavy).alias("n_light")))
    tiles = F.when(heavy, F.ceil(F.col("cells") / CELLS)).otherwise(F.ceil(F.col("light") / POSTINGS))
    placed = shared.join(size, "lang").select("lang", heavy.alias("heavy"), F.pmod(F.xxhash64("term"), tiles).alias("tile"), F.struct(F.xxhash64("term").alias("t"), "g", "p").alias("posting"))
    placed = placed.groupBy("lang", "heavy", "tile").agg(F.collect_list("posting").alias("postings"))
    bases = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "base"))), lambda x: x["base"]).alias("base"))
    placed = stored(placed.join(bases, "lang").select("lang", "heavy", "postings", "base"))
    some = placed.where("heavy").drop("heavy").mapInArrow(_dense, "lang string, g int, h int, v long").union(placed.where("not heavy").drop("heavy").mapInArrow(_sparse, "lang string, g int, h int, v long"))
    sums = some.groupBy("lang", "g", "h").agg(F.sum("v").alias("v"))

    a = groups.select("lang", "source", "g", F.col("base").alias("b"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("base").alias("c"))
    pairs = a.join(b, "lang").where("g <> h").join(size.select("lang", "n_light"), "lang", "left").join(sums, ["lang", "g", "h"], "left")
    value = F.expr("coalesce(n_light * ((b - c) * (b - c) div c), 0) + coalesce(v, 0)")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's divergence from the others of its language, and the terms that set it apart."""
    return audited(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, sum(total)::BIGINT AS n, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, kept.total, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.n + l.v) AS p
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), own AS (
  SELECT p.lang, p.source, p.term, p.p, 1 + (1000000000 * (p.total + 1)::HUGEINT) // (l.n + l.v) AS q FROM p JOIN l USING (lang) WHERE p.n > 0
), r AS (
  SELECT pairs.lang, pairs.source, 'pair' AS part, pairs.item, coalesce(value, 0)::BIGINT AS value
  FROM pairs LEFT JOIN far ON far.lang = pairs.lang AND far.source = pairs.source AND far.item = pairs.item
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM own WHERE p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
