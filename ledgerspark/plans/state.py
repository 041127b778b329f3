"""More of the catalogue: scores and answers, caches, checks, summaries, nested fields, files and the published view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.operators import ledger, scores
from ledgerspark.plans.catalogue import query, table
from ledgerspark.sources import csv, paged, view
from ledgerspark.sources.scratch import folder, stored
from ledgerspark.streaming import budget


@query("""
WITH s AS (SELECT user_id, event_type AS input, arg_max(value, event_id) AS value, arg_max(ts, event_id) AS ts, min(event_id) AS first FROM events GROUP BY ALL),
p AS (SELECT DISTINCT user_id, 'purchase' AS input FROM events),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, first DESC) = 1)
SELECT p.user_id, coalesce(s.input, c.input) AS input, CASE WHEN s.input IS NULL THEN c.value ELSE s.value END AS value,
  CASE WHEN s.input IS NULL THEN c.ts ELSE s.ts END AS ts, s.input IS NULL AS carried
FROM p LEFT JOIN s USING (user_id, input) LEFT JOIN c ON c.user_id = p.user_id
""")
def score_binding_carry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("input"), "value", "ts", "event_id")
    return scores.bound(e.select("user_id", F.lit("purchase").alias("input")).distinct(), e, "user_id", "input", "ts", "event_id", "value")


@query("""
WITH a AS (SELECT user_id, event_type AS scope, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('purchase', 'view') GROUP BY ALL),
p AS (SELECT DISTINCT user_id, 'purchase' AS scope FROM events)
SELECT p.user_id, p.scope, coalesce(o.value, w.value) AS value, CASE WHEN o.value IS NOT NULL THEN 'own' WHEN w.value IS NOT NULL THEN 'anywhere' ELSE 'none' END AS found
FROM p LEFT JOIN a o ON o.user_id = p.user_id AND o.scope = p.scope LEFT JOIN a w ON w.user_id = p.user_id AND w.scope = 'view'
""")
def answer_scope_precedence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("scope"), "value", "event_id")
    answers = ledger.latest(e.where("scope in ('purchase', 'view')"), ["user_id", "scope"], "event_id").drop("event_id")
    return scores.scoped(e.select("user_id", F.lit("purchase").alias("scope")).distinct(), answers, "user_id", "scope", "value", "view")


@query("""
SELECT d.doc_id, d.n_chars % 2 AS version, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE -1 END::INT AS verdict, l.doc_id IS NOT NULL AS hit
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = d.n_chars % 2
""")
def cache_by_version(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("version"))
    cache = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("version"), F.col("toxic").alias("verdict"))
    return scores.cached(rows, cache, "doc_id", "version", "verdict", F.lit(-1))


@query("SELECT doc_id, quality, toxic, source, n_chars FROM labels JOIN documents USING (doc_id)")
def checked_label_join(spark: SparkSession, d: str) -> DataFrame:
    return scores.checked(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query("""
SELECT user_id, arg_max(ts, event_id) AS last_at, arg_max(event_type <> 'error', event_id) AS last_ok, max(ts) FILTER (event_type <> 'error') AS last_success_at,
  NOT coalesce(last_at <= n.now AND last_at > n.now - INTERVAL 6 HOURS, false)
    AND (coalesce(NOT last_ok, false) OR user_id % 5 = 0 OR last_success_at IS NULL OR last_success_at > n.now OR last_success_at <= n.now - INTERVAL 7 DAYS) AS due
FROM events, (SELECT max(ts) AS now FROM events) n GROUP BY user_id, n.now
""")
def source_health_due(spark: SparkSession, d: str) -> DataFrame:
    """What is due for another fetch; of every fifth only a snippet is stored."""
    e = table(spark, d, "events")
    folded = scores.health(e, "user_id", "ts", "event_id", F.col("event_type") != "error").crossJoin(e.agg(F.max("ts").alias("now")))
    kind = F.when(F.col("user_id") % 5 == 0, "snippet").otherwise("full")
    due = scores.due(F.col("last_at"), F.when(F.col("last_ok"), "ok").otherwise("failed"), F.lit("text"), kind, F.col("last_success_at"), F.col("now"))
    return folded.withColumn("due", due).drop("now")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > count(*) OVER (PARTITION BY user_id) - greatest(1, ceil(count(*) OVER (PARTITION BY user_id) / 5.0)) AS held_out
FROM events
""")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return scores.holdout(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT source, count(*) AS n, count(*) FILTER ((n_chars % 100 >= 50) = (quality = 1)) AS n_right FROM labels JOIN documents USING (doc_id) GROUP BY source
""")
def holdout_accuracy(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return scored.groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.col("n_chars") % 100 >= 50) == (F.col("quality") == 1)).alias("n_right"))


@query("""
SELECT o_custkey, count(*) AS n, sha256('[' || string_agg('[' || o_orderkey || ',' || o_custkey || ']', ',' ORDER BY o_orderkey) || ']') AS selection_sha256 FROM orders GROUP BY o_custkey
""")
def selection_hashes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("customer", F.col("o_custkey"))
    return scores.selection_hash(o, ["customer"], ["o_orderkey", "o_custkey"], n=F.count("*")).withColumnRenamed("customer", "o_custkey")


@query("""
SELECT count(*) AS processed, count(*) FILTER (toxic = 0) AS passed, count(*) FILTER (toxic = 1) AS killed, count(*) FILTER (toxic IS NULL) AS skipped,
  count(*) FILTER (lang IS NULL) AS unnamed FROM documents LEFT JOIN labels USING (doc_id)
""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("toxic")
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("processed"), F.count_if(t == 0).alias("passed"), F.count_if(t == 1).alias("killed"), F.count_if(t.isNull()).alias("skipped"), F.count_if(F.col("lang").isNull()).alias("unnamed"))


@query("""
SELECT coalesce((SELECT max(t) FROM (SELECT max(ts) AS t FROM events WHERE event_type = 'signup' UNION ALL SELECT max(o_orderdate) FROM orders)), (SELECT max(ts) FROM events)) AS updated_at,
  (SELECT max(ts) FROM events) AS without_records, string_agg(event_type, ',' ORDER BY event_type) AS versions FROM (SELECT DISTINCT event_type FROM events)
""")
def latest_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The latest instant of two ledgers; where neither has one, that of a third; and the versions that wrote the third, in order."""
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    both = e.where("event_type = 'signup'").select("ts").union(o.select("o_orderdate"))
    rest = e.agg(F.max("ts").alias("b"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("versions"))
    latest = both.agg(F.max("ts").alias("a")).crossJoin(both.where("ts is null").agg(F.max("ts").alias("none"))).crossJoin(rest)
    return latest.select(F.coalesce("a", "b").alias("updated_at"), F.coalesce("none", "b").alias("without_records"), "versions")


@query("""
SELECT doc_id, 'quality' AS name, 'rating' AS kind, quality AS answer FROM labels UNION ALL SELECT doc_id, 'toxic', 'text', toxic FROM labels
""")
def nested_fields(spark: SparkSession, d: str) -> DataFrame:
    """Questions nested in rows, one row a question; kinds by a fixed map; a name twice in a row stops the job."""
    kinds = F.create_map(F.lit("quality"), F.lit("rating"))
    asked = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("answer")) for c in ("quality", "toxic")))
    nested = table(spark, d, "labels").select("doc_id", asked.alias("questions"))
    names = F.transform("questions", lambda x: x["name"])
    sound = nested.where(F.coalesce(F.when(F.size(F.array_distinct(names)) == F.size("questions"), True), F.raise_error(F.lit("a name twice")).cast("boolean")))
    return sound.select("doc_id", F.inline("questions")).select("doc_id", "name", F.coalesce(kinds[F.col("name")], F.lit("text")).alias("kind"), "answer")


@query("""
SELECT s_suppkey, s_nationkey, bool_or(s_acctbal > 5000) OVER (PARTITION BY s_nationkey) AS has_local, min(s_name) OVER (PARTITION BY s_nationkey) AS employer FROM supplier
""")
def employer_local_sites(spark: SparkSession, d: str) -> DataFrame:
    """Whether any site of an employer is local, and one name for all: aggregated first, so that a large employer is no large group."""
    s = table(spark, d, "supplier")
    by = s.groupBy("s_nationkey").agg(F.bool_or(F.col("s_acctbal") > 5000).alias("has_local"), F.min("s_name").alias("employer"))
    return s.select("s_suppkey", "s_nationkey").join(by, "s_nationkey")


@query("""
SELECT c_custkey, token FROM customer LEFT JOIN (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS token FROM part) ON p_partkey = c_custkey
""")
def contact_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Contacts with one row a triage token, and one without where there is none."""
    tokens = table(spark, d, "part").select(F.col("p_partkey").alias("c_custkey"), F.split("p_type", " ").alias("t"))
    return table(spark, d, "customer").select("c_custkey").join(tokens, "c_custkey", "left").select("c_custkey", F.explode_outer("t").alias("token"))


@query("""
SELECT user_id, CASE WHEN arg_max(event_type, event_id) = 'click' THEN max(event_id) END AS outreach FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id
""")
def outreach_fold(spark: SparkSession, d: str) -> DataFrame:
    """The latest outreach of each contact; undone, it is null."""
    e = table(spark, d, "events").where("event_type in ('click', 'error')")
    return e.groupBy("user_id").agg(F.max_by(F.when(F.col("event_type") == "click", F.col("event_id")), "event_id").alias("outreach"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, greatest(0, 40 - count(*)) AS attempts_left FROM events GROUP BY day")
def attempts_left_by_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.greatest(F.lit(0), F.lit(40) - F.count("*")).alias("attempts_left"))


@query("SELECT doc_id, quality, toxic FROM labels")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "labels").write.option("header", True).csv(path := folder(spark))
    return csv.read(spark, path, {"doc_id": "bigint", "quality": "int", "toxic": "int"})


@query("SELECT doc_id, source, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def published_view(spark: SparkSession, d: str) -> DataFrame:
    """Two tables published together, once keys agree and counts by source add up to all rows; read under a fixed schema."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    rows = docs.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    tables = {"postings": rows, "coverage": rows.groupBy("source").agg(F.count("*").alias("known"))}
    checks = {
        "postings": lambda t: view.same_keys(docs, t["postings"], "doc_id"),
        "coverage": lambda t: (t["coverage"].agg(F.sum("known")).first()[0] or 0) == t["postings"].count(),
    }
    view.publish(spark, top := folder(spark), tables, checks)
    return view.read(spark, top, "postings", {"doc_id": "bigint", "source": "string", "toxic": "int"})


_COST = "(n_chars + 255) // 256 / 1000.0"


@query(f"""
WITH c AS (SELECT doc_id, {_COST} AS usd FROM documents),
a AS (SELECT *, sum(usd) OVER (ORDER BY doc_id DESC) <= 1.0 + 1e-9 AS paid FROM c),
b AS (SELECT doc_id, usd, sum(usd) OVER (ORDER BY doc_id DESC) <= least(1.0, 1.5 - (SELECT coalesce(sum(usd), 0) FROM a WHERE paid)) + 1e-9 AS paid FROM a WHERE NOT paid)
SELECT doc_id, round(usd, 6) AS usd, '2026-03-01' AS day FROM a WHERE paid UNION ALL SELECT doc_id, round(usd, 6), '2026-03-02' FROM b WHERE paid
""")
def budgeted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Which documents are paid for, and when, on two days of one month: 1 USD a day and 1.5 a month, the newest first. The first
    day's run is a stream; the second works on what has waited."""
    to = folder(spark)
    usd = F.expr("((n_chars + 255) div 256) / 1000.0").cast("double")
    docs = spark.readStream.schema(table(spark, d, "documents").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet*")
    rows = docs.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("order"), usd.alias("usd"))
    score = lambda paid: paid.select("key", (F.pmod(F.xxhash64("key"), F.lit(1000)) / 1000).alias("probability"))
    budget.run_once(rows, f"{to}/runs", f"{to}/checkpoint", "2026-03-01T08:00:00", score, 1.0, 1.5)
    budget.resume(spark, f"{to}/runs", "2026-03-02T08:00:00", score, 1.0, 1.5)
    paid = budget.charges(spark, f"{to}/runs").join(spark.read.parquet(f"{to}/runs/{budget.RESULTS}").select("key"), "key", "left_semi")
    return paid.select(F.col("key").alias("doc_id"), F.round("usd", 6).alias("usd"), F.left("at", F.lit(10)).alias("day"))


# Boards that are read page by page: pages of one host are a board; and users are boards whose entries are kinds of events, which
# soon repeat.


@query("""
WITH p AS (SELECT page_id, split_part(url, '/', 3) AS board, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) - 1 AS place FROM pages)
SELECT page_id, board, (place // 200)::INT AS run, (place // 20 * 20)::BIGINT AS "offset" FROM p
""")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Which run has seen each page of each host, and at which offset: ten pages of 20 a run, until all boards are read."""
    pages = table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("board"), "page_id", "url")
    place = F.row_number().over(Window.partitionBy("board").orderBy("page_id")) - 1
    listing = pages.select("board", place.cast("long").alias("place"), F.col("page_id").cast("string").alias("key"), F.col("url").alias("path"), F.lit(None).cast("string").alias("row"))
    to, boards = folder(spark), stored(pages.select("board").distinct())
    paged.scan(spark, to, boards, paged.recorded(listing), "2026-03-01T08:00:00", pages=10)
    return paged.seen(spark, to).select(F.col("key").cast("long").alias("page_id"), "board", "run", "offset")


@query("""
WITH e AS (SELECT user_id, event_type || '/' || (value > 20)::INT AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events),
k AS (SELECT *, min(place) OVER (PARTITION BY user_id, key) AS first, place // 2 AS page FROM e WHERE place < 8),
p AS (SELECT user_id, page, any_value(total) AS total, count(*) AS n, count(DISTINCT key) AS keys, count(*) FILTER (first // 2 = page) AS new FROM k GROUP BY user_id, page),
s AS (SELECT user_id, min(page) AS stop, arg_min(CASE WHEN keys < n THEN 'repeats' ELSE 'stalled' END, page) AS how FROM p WHERE keys < n OR new = 0 GROUP BY user_id),
w AS (SELECT user_id, any_value(total) AS total, any_value(stop) AS stop, any_value(how) AS how, count(*) FILTER (stop IS NULL OR page < stop) AS fetched, sum(n) FILTER (stop IS NULL OR page <= stop) AS observed FROM p LEFT JOIN s USING (user_id) GROUP BY user_id)
SELECT user_id::VARCHAR AS board, CASE WHEN how = 'stalled' THEN 'stalled' WHEN how = 'repeats' THEN CASE WHEN stop = 0 THEN 'failed' ELSE 'partial' END WHEN total <= 8 THEN 'complete' ELSE 'partial' END AS status,
  CASE WHEN how IS NOT NULL THEN stop * 2 WHEN total <= 8 THEN 0 ELSE 8 END::BIGINT AS next_offset, fetched::INT AS fetched, observed::BIGINT AS observed, coalesce(how IS NULL AND total <= 8, false) AS whole,
  CASE WHEN how = 'stalled' THEN 'repeated or non-advancing page at offset ' || (stop * 2) WHEN how = 'repeats' THEN 'stopped at offset ' || (stop * 2) || ': keys repeat within a page' WHEN total > 8 THEN 'stopped at 4 pages' END AS error
FROM w
""")
def scan_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Where a run of four pages of two has left each board, and why."""
    key = F.concat("event_type", F.lit("/"), (F.col("value") > 20).cast("int").cast("string"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    listing = table(spark, d, "events").select(F.col("user_id").cast("string").alias("board"), place.cast("long").alias("place"), key.alias("key"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("row"))
    to = folder(spark)
    paged.advance(spark, to, listing.select("board"), paged.recorded(listing), "2026-03-01T08:00:00", limit=2, pages=4)
    return paged.cursors(spark, to).select("board", "status", "next_offset", "fetched", "observed", "whole", "error")
