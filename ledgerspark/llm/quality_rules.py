"""Quality rules: word statistics of whole texts, and robust multivariate outliers of each language and source.

The statistics are Column expressions on one row. The outlier rule is the minimum covariance determinant: from
each of STARTS (distances by median and median deviation: Euclidean, by sum, by largest) two concentration steps keep
the share `core` of a group's documents that lie nearest and take mean and covariance anew from them, the start with
the least determinant goes on until its determinant settles. Covariances of a core are
made consistent for the normal distribution; after a last step over all documents below the 0.975 quantile of
chi-squared, documents whose squared Mahalanobis distance passes its `cut` quantile are rejected. A group of a language and source
with few documents is judged by all of its language, and a language with few by all documents. Everything is DataFrame
operations: a group is never gathered, its moments and quantiles are combined aggregates, and parameter tables hold one
row a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, SPACES, drop, drop_since, let, small, stored, table, words, written

#: name: (expression over the statistics, least standard deviation that a group is taken to have: a feature that hardly
#: varies in a group, such as symbols where there are none, would else reject the first document that has one)
FEATURES = {
    "mean_chars": ("__q.word_chars / __q.n_words", 0.8),
    "symbols": ("log1p(100 * __q.n_symbols / __q.n_words)", 0.55),
    "marks": ("log1p(100 * __q.n_marks / __q.n_words)", 0.55),
    "capitals": ("log1p(100 * __q.n_capitals / __q.word_chars)", 0.45),
    "dup_lines": ("log1p(100 * __q.n_dup_lines / __q.n_lines)", 0.8),
    "repeats": ("log1p(100 * __q.n_repeat_words / __q.n_words)", 0.7),
}
STARTS, MOST_STEPS = 3, 60


def chi2_share(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom <= x), df even."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = (low, (low + high) / 2) if chi2_share((low + high) / 2, df) >= p else ((low + high) / 2, high)
    return high


def consistency(core: float, df: int) -> float:
    """What the covariance of the nearest `core` of normal points is to be multiplied by."""
    return core / chi2_share(chi2_quantile(core, df), df + 2)


def repeated_words(w: Column) -> Column:
    """How many words of the array w lie in 5-word windows found twice or more in it.

    If the hashes of all windows, made of their words' hashes, differ, so do the windows; else the windows themselves are
    sorted with their places, those equal to a neighbour kept, and the words they cover counted. Exact either way.
    """
    starts = F.sequence(F.lit(0), F.size(w) - 5)
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda x: F.transform(starts, lambda i: F.xxhash64(*(x[i + k] for k in range(5)))))
    by_window = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *(w[i + k] for k in range(5))).alias("s"), i.alias("i"))))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["s"] == x["s"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["s"] == x["s"], F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.get(p, k + 1) - x)), F.lit(0), lambda a, b: a + b)

    return F.when(F.size(w) < 6, F.lit(0)).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(by_window, places), covered)))
    )


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry, and a struct __q of statistics of the whole text (null: none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    count = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    of_text = {
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": count("#*$%&|<>"),
        "n_marks": count("!?;:"),
        "n_capitals": count(r"\p{Lu}"),
    }
    of_words = {
        "n_words": F.size("__w").cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": let(F.col("__w"), repeated_words).cast("long"),
    }
    own = docs.select(*carry, F.col("lang").alias("__lang"), F.col("source").alias("__source"), words(F.col("text")).alias("__w"), lines.alias("__l"), F.struct(*(c.alias(k) for k, c in of_text.items())).alias("__t"))
    return own.select(*carry, "__lang", "__source", F.struct(*(c.alias(k) for k, c in of_words.items()), "__t.*").alias("__q"))


def _fit(rows: DataFrame, keys: list[str], names: list[str], floors: list[float], factor: float) -> DataFrame:
    """Of each group of rows, stored: means __m_i, the Cholesky factor __l_i_j of its covariance times factor, no variance
    below its squared floor, and the logarithm __det of the determinant."""
    n = range(len(names))
    moments = rows.groupBy(*keys).agg(*(F.avg(names[i]).alias(f"__m_{i}") for i in n), *(F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i in n for j in range(i, len(names))))
    params = stored(moments)
    made = params
    for i in n:
        for j in range(i + 1):
            v = F.col(f"c_{j}_{i}") * factor
            if i == j:
                v = F.greatest(v, F.lit(floors[i] ** 2))
            for k in range(j):
                v = v - F.col(f"__l_{i}_{k}") * F.col(f"__l_{j}_{k}")
            # rounding may leave nothing of a variance that others explain in full
            made = made.withColumn(f"__l_{i}_{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"__l_{j}_{j}"))
    det = sum((F.log(f"__l_{i}_{i}") for i in n), F.lit(0.0))
    out = stored(made.select(*keys, *(f"__m_{i}" for i in n), *(f"__l_{i}_{j}" for i in n for j in range(i + 1)), det.alias("__det")))
    drop(params)
    return out


def _distance(rows: DataFrame, params: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """rows with __d2, the squared distance from their group's centre."""
    rows = rows.join(small(params), keys, "left")
    for i, name in enumerate(names):
        v = F.col(name) - F.col(f"__m_{i}")
        for j in range(i):
            v = v - F.col(f"__l_{i}_{j}") * F.col(f"__y_{j}")
        rows = rows.withColumn(f"__y_{i}", v / F.col(f"__l_{i}_{i}"))
    d2 = sum((F.col(f"__y_{i}") ** 2 for i in range(len(names))), F.lit(0.0))
    return rows.withColumn("__d2", d2).drop(*(c for c in params.columns if c not in keys), *(f"__y_{i}" for i in range(len(names))))


def _core(near: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows whose __d2 is among the least `share` of their group."""
    limit = stored(near.groupBy(*keys).agg(F.percentile_approx("__d2", share, 10000).alias("__most")))
    return near.join(small(limit), keys).where("__d2 <= __most")


def minimum_determinant(rows: DataFrame, f: list[str], floors: list[float], core: float) -> DataFrame:
    """The parameters (of _fit) of each group __g of rows (__g, features f)."""
    factor = consistency(core, len(f))
    mark = written()
    mid = stored(rows.groupBy("__g").agg(*(F.percentile_approx(c, 0.5).alias(f"md_{i}") for i, c in enumerate(f))))
    near = rows.join(small(mid), "__g")
    spread = stored(near.groupBy("__g").agg(*(F.percentile_approx(F.abs(F.col(c) - F.col(f"md_{i}")), 0.5).alias(f"s_{i}") for i, c in enumerate(f))))
    z = [F.abs(F.col(c) - F.col(f"md_{i}")) / F.greatest(1.4826 * F.col(f"s_{i}"), F.lit(floors[i])) for i, c in enumerate(f)]
    first = [sum((x * x for x in z), F.lit(0.0)), sum(z, F.lit(0.0)), F.greatest(*z)]
    starts = F.array(*(F.struct(F.lit(i).alias("__s"), d.alias("__d2")) for i, d in enumerate(first[:STARTS])))
    near = near.join(small(spread), "__g").select("__g", *f, F.explode(starts).alias("__x")).select("__g", *f, "__x.*")
    for _ in range(2):
        params = _fit(_core(near, ["__g", "__s"], core), ["__g", "__s"], f, floors, factor)
        near = _distance(near.drop("__d2"), params, ["__g", "__s"], f)
    params = stored(params.groupBy("__g").agg(F.min_by(F.struct(*params.columns[2:]), F.struct("__det", "__s")).alias("p")).select("__g", "p.*"))
    for step in range(MOST_STEPS):
        near = _distance(rows, params, ["__g"], f)
        again = _fit(_core(near, ["__g"], core), ["__g"], f, floors, factor)
        gain = params.select("__g", F.col("__det").alias("was")).join(again, "__g").agg(F.max(F.col("was") - F.col("__det"))).first()[0]
        params = again
        if gain is None or gain < 1e-4:
            break
    else:
        raise RuntimeError(f"the covariances have not settled in {MOST_STEPS} steps")
    near = _distance(rows, params, ["__g"], f).where(F.col("__d2") <= chi2_quantile(0.975, len(f)))
    out = _fit(near, ["__g"], f, floors, consistency(0.975, len(f)))
    drop_since(rows.sparkSession, mark, out)
    return out


def quality_rules(docs: DataFrame, carry: list[str] | None = None, core: float = 0.75, cut: float = 0.99999, least_group: int = 60, out: str = "quality") -> DataFrame:
    """docs (text, lang, source and any others) with a struct `out` of statistics, d2, base_failed and kept.

    carry names the columns of docs to return (all, if None); an input column named like `out` is replaced.
    Null, empty and blank texts have no words and fail the base rule. Null languages and sources are groups
    of their own. A group with fewer than least_group documents that pass the base rule is judged by the estimate of its
    whole language, and a language with fewer by that of all documents. Repeated rows are judged alike; an empty table
    gives an empty result.
    """
    mark = written()
    names, floors = list(FEATURES), [f for _, f in FEATURES.values()]
    carry = [c for c in (docs.columns if carry is None else carry) if c != out]
    seen = kept = stored(statistics(docs, carry))
    seen = seen.withColumn("__bad", (F.col("__q.n_words") < 10) | (100 * F.col("__q.n_repeat_words") > 20 * F.col("__q.n_words")))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    seen = seen.withColumn("__lang", named("__lang")).withColumn("__source", named("__source"))
    counts = stored(seen.where(~F.col("__bad")).groupBy("__lang", "__source").agg(F.count("*").alias("__n")))
    by_lang = stored(counts.groupBy("__lang").agg(F.sum("__n").alias("__m")))
    group = F.when(F.col("__n") >= least_group, F.concat_ws("\x1f", "__lang", "__source")).when(F.col("__m") >= least_group, F.col("__lang")).otherwise("*")
    of = stored(counts.join(by_lang, "__lang").select("__lang", "__source", group.alias("__g")))
    # a group's rows count for its language's estimate, or that of all, where another group needs it
    needs = stored(of.where(~F.contains("__g", F.lit("\x1f"))).select("__g").distinct())
    wider = stored(of.select("__lang", "__source").withColumn("__w", F.explode(F.array("__lang", F.lit("*")))).join(small(needs), F.col("__w") == F.col("__g"), "left_semi"))
    own = of.where(F.contains("__g", F.lit("\x1f"))).select("__lang", "__source", F.col("__g").alias("__w"))
    into = stored(own.union(wider.select("__lang", "__source", "__w")).groupBy("__lang", "__source").agg(F.collect_set("__w").alias("__into")))
    f = [f"__f_{k}" for k in names]
    features = [F.when(~F.col("__bad"), F.expr(e)).alias(f"__f_{k}") for k, (e, _) in FEATURES.items()]
    rows = stored(seen.where(~F.col("__bad")).select("__lang", "__source", *features).join(small(into), ["__lang", "__source"]).select(F.explode("__into").alias("__g"), *f))
    params = minimum_determinant(rows, f, floors, core)
    drop_since(docs.sparkSession, mark, kept, of, params)
    full = seen.join(small(of), ["__lang", "__source"], "left").select("*", *features)
    judged = _distance(full, params, ["__g"], f)
    passed = F.col("__d2").isNull() | (F.col("__d2") <= chi2_quantile(cut, len(f)))
    verdict = F.struct(F.col("__q.*"), F.col("__d2").alias("d2"), F.col("__bad").alias("base_failed"), (~F.col("__bad") & passed).alias("kept"))
    return judged.select(*carry, verdict.alias(out))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each of the documents."""
    q = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "quality.*")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2"))
