"""The queries of the catalogue and their DuckDB counterparts, over the shared tables: ledgers, entries, joins, text, time.

events are a ledger (user_id the key, event_id the append order, ts the clock), documents are postings (first line
the title, source the board), labels are decisions (toxic: kill, else pass; quality: a score), conversations are
timelines, pages raw postings with a URL, orders and lineitem measures and intervals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions import text
from ledgerspark.operators import entries as E
from ledgerspark.operators import ledger, lifecycle, temporal
from ledgerspark.sources.scratch import folder
from ledgerspark.streaming import lifecycle as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

STATES = {"click": "approved", "view": "rejected", "purchase": "submitted", "signup": "queued"}
STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Ledgers


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def ledger_latest_append(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def ledger_latest_time(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id")


@query("""
WITH e AS (SELECT *, event_type = 'error' OR event_id = min(event_id) OVER (PARTITION BY user_id) AS is_full FROM events),
f AS (SELECT user_id, max(event_id) AS s FROM e WHERE is_full GROUP BY user_id),
l AS (SELECT e.* FROM e JOIN f USING (user_id) WHERE event_id >= s),
o AS (SELECT user_id, event_id, event_type AS field, (value * 100)::BIGINT::VARCHAR AS value, 0 AS gone FROM l WHERE event_type <> 'signup'
  UNION ALL SELECT user_id, event_id, 'click', NULL, 1 FROM l WHERE event_type = 'signup')
SELECT user_id, field, value FROM o QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY event_id DESC, gone DESC) = 1 AND gone = 0
""")
def ledger_delta_replay(spark: SparkSession, d: str) -> DataFrame:
    """error rows and a user's first are full, signup removes the field click, every other type sets the field of its name."""
    e, kind = table(spark, d, "events"), F.col("event_type")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    value = F.round(F.col("value") * 100).cast("long").cast("string")
    fields = F.when(kind != "signup", F.create_map(kind, value)).otherwise(F.create_map().cast("map<string,string>"))
    removed = F.when(kind == "signup", F.array(F.lit("click"))).otherwise(F.array().cast("array<string>"))
    full = (kind == "error") | (F.col("event_id") == F.col("first"))
    return ledger.replay(e.join(first, "user_id").select("user_id", "event_id", full.alias("full"), fields.alias("fields"), removed.alias("removed")), "user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type")
def ledger_changed_only(spark: SparkSession, d: str) -> DataFrame:
    return ledger.changed_only(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"])


@query("SELECT DISTINCT user_id, event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level FROM events")
def ledger_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping ledgers joined by content: events of high value, and all."""
    e = table(spark, d, "events").select("user_id", "event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("level"))
    return ledger.appended(e.where("level = 'high'").distinct(), e, ["user_id", "event_type", "level"])


@query("""
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN CASE WHEN d.n_chars % 10 = 0 THEN 'closed' ELSE 'unknown' END
  WHEN l.toxic = 1 THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN l.doc_id IS NOT NULL THEN 'refreshed' WHEN d.n_chars % 10 = 0 THEN 'kept' ELSE 'unknown' END AS action
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def snapshot_reconcile(spark: SparkSession, d: str) -> DataFrame:
    prior = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 10 == 0, "closed").otherwise("open").alias("status"))
    incoming = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "closed").otherwise("open").alias("status"))
    return ledger.reconciled(prior, incoming, "doc_id")


# Lifecycle

FOLD_SQL = f"SELECT user_id, arg_max({STATE_SQL}, event_id) AS state, max(event_id) AS seq FROM events WHERE {STATE_SQL} IS NOT NULL GROUP BY user_id"


@query(FOLD_SQL)
def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.fold(table(spark, d, "events"), STATES, "user_id", "event_id", "event_type")


@query(f"""
WITH f AS (SELECT user_id, arg_max({STATE_SQL}, event_id) AS state, max(event_id) AS seq FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id),
q AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (
  SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING arg_max(value, event_id) > 20))
SELECT user_id, coalesce(f.state, 'queued') AS state, f.seq FROM f FULL JOIN q USING (user_id)
""")
def lifecycle_with_queue_layer(spark: SparkSession, d: str) -> DataFrame:
    """Users with a view are queued unless their last error vetoes it; click and purchase stand above."""
    e = table(spark, d, "events")
    veto = ledger.latest(e.where("event_type = 'error'").select("user_id", "event_id", "value"), ["user_id"], "event_id").where("value > 20")
    queued = e.where("event_type = 'view'").select("user_id").distinct().join(veto, "user_id", "left_anti")
    return lifecycle.fold(e, {k: STATES[k] for k in ("click", "purchase")}, "user_id", "event_id", "event_type", queued)


@query("""
SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 100) THEN 1
  ELSE arg_max(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 ELSE -1 END, event_id) FILTER (event_type IN ('click', 'view', 'signup')) END::INT AS label
FROM events GROUP BY user_id HAVING label >= 0
""")
def label_fold_sticky(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("kind", F.when((F.col("event_type") == "purchase") & (F.col("value") <= 100), "small").otherwise(F.col("event_type")))
    return lifecycle.sticky_labels(e, "purchase", {"click": 1, "view": 0}, "signup", "user_id", "event_id", "kind")


@query(FOLD_SQL)
def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """The fold as a stream that runs until it has read what is there."""
    schema, to = table(spark, d, "events").schema, folder(spark)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    stream.run_once(stream.fold_stream(events, STATES, "user_id", "event_id", "event_type"), f"{to}/out", f"{to}/checkpoint")
    return stream.current(spark.read.schema("user_id long, state string, seq long").parquet(f"{to}/out"), "user_id")


# Entries


def all_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries: a decision and a score by labels, an application state by the last turn of a conversation."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role")
    last = ledger.latest(turns, ["doc_id"], "turn").select("doc_id", F.when(F.col("role") == "assistant", "submitted").when(F.col("role") == "user", "approved").otherwise("rejected").alias("state"))
    clock = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("discovered"))
    fetches = table(spark, d, "events").where("event_type = 'signup'").join(docs.select(F.col("doc_id").alias("event_id")), "event_id", "left_semi")
    window, n = E.fetch_window(fetches, "ts"), F.col("n_chars")
    e = docs.join(labels, "doc_id", "left").join(last, "doc_id", "left").join(clock, "doc_id", "left").crossJoin(window)
    verdict = F.when(F.col("toxic") == 1, "kill").when(F.col("toxic") == 0, "pass")
    listing = F.when(n % 10 == 0, "closed").otherwise("open")
    p = F.when(n % 7 != 0, F.when(F.col("quality") == 1, 0.8).when(n % 3 == 0, 0.05).otherwise(0.3))
    return e.select(
        F.col("doc_id").alias("key"), F.substring_index("text", "\n", 1).alias("title"), F.when(n % 11 != 0, F.col("lang")).alias("company"), F.col("source").alias("board"),
        F.when(n % 4 == 1, "Remote").when(n % 4 > 1, F.concat(F.lit("Site "), (n % 3).cast("string"))).alias("location"), F.when(n % 13 != 0, n).alias("verified"), "discovered",
        "state", verdict.alias("verdict"), F.when(verdict == "kill", "toxic").alias("rule"), F.when(verdict == "kill", "toxic text").alias("reason"),
        F.when(p.isNotNull(), "scored").otherwise("not scored").alias("summary"), p.alias("probability"), listing.alias("listing"),
        E.status(F.col("state"), verdict, listing, p, verdict == "pass").alias("status"), E.is_new(F.col("discovered"), F.col("previous"), F.col("last")).cast("int").alias("is_new"),
    )


ENTRIES_SQL = """
WITH last AS (SELECT conv_id AS doc_id, CASE arg_max(role, turn) WHEN 'assistant' THEN 'submitted' WHEN 'user' THEN 'approved' ELSE 'rejected' END AS state FROM conversations GROUP BY conv_id),
fetches AS (SELECT ts FROM events WHERE event_type = 'signup' AND event_id IN (SELECT doc_id FROM documents) ORDER BY ts DESC LIMIT 2),
win AS (SELECT CASE WHEN count(*) = 2 THEN min(ts) END AS previous, max(ts) AS last FROM fetches),
raw AS (SELECT d.doc_id AS key, split_part(text, chr(10), 1) AS title, CASE WHEN n_chars % 11 <> 0 THEN lang END AS company, source AS board,
  CASE WHEN n_chars % 4 = 1 THEN 'Remote' WHEN n_chars % 4 > 1 THEN 'Site ' || (n_chars % 3) END AS location, CASE WHEN n_chars % 13 <> 0 THEN n_chars END AS verified, ev.ts AS discovered,
  state, CASE toxic WHEN 1 THEN 'kill' WHEN 0 THEN 'pass' END AS verdict, CASE toxic WHEN 1 THEN 'toxic' END AS rule, CASE toxic WHEN 1 THEN 'toxic text' END AS reason,
  CASE WHEN n_chars % 7 <> 0 THEN 'scored' ELSE 'not scored' END AS summary,
  CASE WHEN n_chars % 7 <> 0 THEN CASE WHEN quality = 1 THEN 0.8::DOUBLE WHEN n_chars % 3 = 0 THEN 0.05::DOUBLE ELSE 0.3::DOUBLE END END AS probability,
  CASE WHEN n_chars % 10 = 0 THEN 'closed' ELSE 'open' END AS listing,
  CASE WHEN win.last IS NOT NULL AND ev.ts <= win.last AND (win.previous IS NULL OR ev.ts > win.previous) THEN 1 ELSE 0 END AS is_new
  FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN last USING (doc_id) LEFT JOIN events ev ON ev.event_id = d.doc_id, win),
entries AS (SELECT *, CASE WHEN state IN ('approved', 'rejected', 'prepared', 'filled', 'submitted', 'concluded', 'withdrawn') THEN 'applied'
    WHEN verdict = 'kill' THEN 'hard-killed' WHEN listing = 'closed' THEN 'closed' WHEN verdict = 'pass' AND probability >= 0.5 THEN 'queued'
    WHEN verdict = 'pass' AND probability < 0.1 THEN 'hard-killed' WHEN verdict = 'pass' AND probability IS NOT NULL THEN 'needs-review' WHEN verdict = 'pass' THEN 'unscored' ELSE 'not-filtered' END AS status FROM raw),
grouped AS (SELECT *, CASE WHEN trim(coalesce(company, ''), ' ') = '' OR trim(title, ' ') = '' OR trim(coalesce(location, ''), ' ') = '' THEN key::VARCHAR
    ELSE lower(trim(company, ' ')) || chr(31) || lower(trim(title, ' -–—,.;:/\\|·•*&_+()[]{}''"')) || chr(31) || lower(trim(location, ' ')) END AS group_id FROM entries),
ranked AS (SELECT *, row_number() OVER (g ORDER BY probability DESC NULLS LAST, verified DESC NULLS LAST, key) AS rank, count(*) OVER g AS group_size, max(is_new) OVER g AS group_is_new
  FROM grouped WINDOW g AS (PARTITION BY group_id))
"""


def heads(entries: DataFrame) -> DataFrame:
    """entries by presentation group, best score, latest check and smallest key first."""
    order = [F.desc_nulls_last("probability"), F.desc_nulls_last("verified"), F.col("key")]
    return E.grouped(entries, E.title_group(F.col("company"), F.col("title"), F.col("location"), F.col("key")), order)


@query(ENTRIES_SQL + "SELECT * FROM entries")
def entries_projection(spark: SparkSession, d: str) -> DataFrame:
    return all_entries(spark, d)


@query(ENTRIES_SQL + "SELECT count(*) AS discovered, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.replace('-', '_')}" for s in E.STATUSES) + ", count(*) FILTER (state = 'approved') AS saved, count(*) FILTER (state = 'rejected') AS dismissed FROM entries")
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.funnel(all_entries(spark, d))


@query(ENTRIES_SQL + "SELECT group_id, key, group_size, group_is_new, status FROM ranked WHERE rank = 1")
def grouped_heads(spark: SparkSession, d: str) -> DataFrame:
    return heads(all_entries(spark, d)).where("rank = 1").select("group_id", "key", "group_size", "group_is_new", "status")


@query(ENTRIES_SQL + "SELECT group_id, string_agg(key::VARCHAR, ',' ORDER BY probability DESC NULLS LAST, key) AS members FROM ranked GROUP BY group_id")
def group_members(spark: SparkSession, d: str) -> DataFrame:
    member = F.struct((-F.coalesce("probability", F.lit(-1.0))).alias("p"), "key")
    members = F.transform(F.sort_array(F.collect_list(member)), lambda m: m["key"].cast("string"))
    return heads(all_entries(spark, d)).groupBy("group_id").agg(F.array_join(members, ",").alias("members"))


@query(ENTRIES_SQL + "SELECT count(*) AS total, coalesce(sum(group_is_new), 0)::BIGINT AS new_groups FROM ranked WHERE rank = 1")
def page_totals(spark: SparkSession, d: str) -> DataFrame:
    return heads(all_entries(spark, d)).where("rank = 1").agg(F.count("*").alias("total"), F.coalesce(F.sum("group_is_new"), F.lit(0)).alias("new_groups"))


def _page(spark: SparkSession, d: str, request: E.Page) -> DataFrame:
    """A page of the groups of the entries that a request asks for; its limit is what a page is."""
    entries = all_entries(spark, d)
    first = heads(E.asked(entries, request)).where("rank = 1")
    return E.page(first, entries, request).select("position", "key", "title", "board", "status", "verified", "group_size")


def _page_sql(where: str, order: str, limit: int, offset: int) -> str:
    ranked = ENTRIES_SQL.replace("FROM entries),\nranked", f"FROM entries WHERE {where}),\nranked")
    return ranked + f"""SELECT (row_number() OVER (ORDER BY {order}))::INT - {offset} AS position, key, title, board, status, verified, group_size
      FROM ranked WHERE rank = 1 QUALIFY row_number() OVER (ORDER BY {order}) BETWEEN {offset + 1} AND {offset + limit}"""


VERIFIED_SQL = "verified DESC NULLS LAST, discovered DESC NULLS LAST, key"


@query(_page_sql("status = 'queued'", "probability DESC NULLS LAST, " + VERIFIED_SQL, 50, 10))
def postings_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten on, of queued groups, the best score first, then the latest check."""
    return _page(spark, d, E.Page(status="queued", offset=10))


@query(_page_sql("status = 'hard-killed' AND verdict = 'kill' AND rule = 'toxic' AND (contains(lower(title), 'a') OR contains(lower(coalesce(company, '')), 'a') OR contains(lower(board), 'a') OR contains(lower(coalesce(location, '')), 'a') OR contains(key::VARCHAR, 'a') OR contains(coalesce(reason, ''), 'a') OR contains(summary, 'a'))", "title NULLS FIRST, board NULLS FIRST, key", 1000, 0))
def page_by_title(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, E.Page(status="hard-killed", rule="toxic", search=" A ", sort="title", limit=1000))


@query(_page_sql("true", "discovered DESC NULLS LAST, key", 200, 5))
def page_by_discovery(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, E.Page(sort="discovered", limit=200, offset=5))


@query(ENTRIES_SQL + """SELECT list, count(*) AS n, sum(is_new)::BIGINT AS new FROM (
  SELECT *, unnest(list_filter([CASE WHEN status = 'queued' THEN 'queued' END, CASE WHEN status = 'needs-review' THEN 'needs-review' END, CASE WHEN status = 'hard-killed' THEN 'filtered' END,
    CASE WHEN status = 'unscored' THEN 'unscored' END, CASE WHEN status = 'applied' AND state NOT IN ('approved', 'rejected') THEN 'applied' END,
    CASE WHEN state = 'approved' THEN 'saved' END, CASE WHEN state = 'rejected' THEN 'dismissed' END], lambda x: x IS NOT NULL)) AS list FROM entries) GROUP BY list""")
def preset_lists(spark: SparkSession, d: str) -> DataFrame:
    """How many entries each home list asks for."""
    entries = all_entries(spark, d)
    lists = [E.asked(entries, request).select(F.lit(name).alias("list"), "is_new") for name, request in E.PRESETS.items()]
    return reduce(DataFrame.union, lists).groupBy("list").agg(F.count("*").alias("n"), F.sum("is_new").alias("new"))


@query(ENTRIES_SQL + """SELECT key, CASE WHEN status = 'applied' THEN CASE state WHEN 'approved' THEN 'saved' WHEN 'rejected' THEN 'dismissed' ELSE 'applied' END
  WHEN status IN ('unscored', 'needs-review', 'queued') THEN status ELSE 'filtered' END AS list FROM entries""")
def home_lists(spark: SparkSession, d: str) -> DataFrame:
    """The home list each entry belongs to."""
    return all_entries(spark, d).select("key", E.home_list(F.col("status"), F.col("state")).alias("list"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), '%') OR contains(lower(source), '%')")
def search_literal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(E.contains("%", F.col("text"), F.col("source"))).select("doc_id")


@query(ENTRIES_SQL + "SELECT key, title, board FROM entries WHERE is_new = 0 AND probability >= 0.5 AND verdict = 'pass' AND listing = 'open' AND key NOT IN (SELECT doc_id FROM last)")
def notify_picks(spark: SparkSession, d: str) -> DataFrame:
    """Open entries with a good score that passed and have no application state: an anti join."""
    picks = all_entries(spark, d).where("is_new = 0 and probability >= 0.5 and verdict = 'pass' and listing = 'open'").select("key", "title", "board")
    states = table(spark, d, "conversations").select(F.col("conv_id").alias("key")).distinct()
    return picks.join(states, "key", "left_anti")


@query("SELECT conv_id, turn, role, turn = max(turn) OVER (PARTITION BY conv_id, role) AS latest FROM conversations")
def timeline_with_latest_flag(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", "role", (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id", "role"))).alias("latest"))


# Joins, counts and sets


@query("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS known, count(*) FILTER (c_acctbal > 0) AS verified FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS k, count(*) AS boards FROM supplier GROUP BY 1)
SELECT k, coalesce(known, 0) AS known, coalesce(verified, 0) AS verified, coalesce(known, 0) - coalesce(verified, 0) AS needs_check, coalesce(boards, 0) AS boards FROM c FULL JOIN s USING (k)
""")
def coverage_full_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("known"), F.count_if(F.col("c_acctbal") > 0).alias("verified"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("boards"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return c.join(s, "k", "full").select("k", zero("known").alias("known"), zero("verified").alias("verified"), (zero("known") - zero("verified")).alias("needs_check"), zero("boards").alias("boards"))


@query("SELECT facet, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS facet FROM part) GROUP BY facet")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


@query("SELECT o_orderdate::DATE AS day, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY ALL")
def spend_by_day_month(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS open FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_anti_keys(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    keys = lambda df: df.select(F.col("o_custkey").alias("c_custkey")).distinct()
    rest = c.join(keys(o.where("o_orderpriority = '1-URGENT'")), "c_custkey", "left_anti")
    return rest.join(keys(o.where("o_orderstatus = 'O'")).withColumn("o", F.lit(True)), "c_custkey", "left").select("c_custkey", F.coalesce("o", F.lit(False)).alias("open"))


@query("SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


# Text and identity

_URL_SQL = """
WITH u AS (SELECT page_id, regexp_replace(trim(url, ' '), '#.*$', '') AS b FROM pages),
p AS (SELECT page_id, split_part(b, '?', 1) AS base, list_transform(list_filter(string_split(CASE WHEN contains(b, '?') THEN regexp_replace(b, '^[^?]*\\?', '') ELSE '' END, '&'),
  lambda x: x <> '' AND NOT starts_with(lower(trim(split_part(x, '=', 1))), 'utm_') AND lower(trim(split_part(x, '=', 1))) NOT IN
    ('_ga', '_gl', 'dclid', 'fbclid', 'gclid', 'igshid', 'li_fat_id', 'mc_cid', 'mc_eid', 'msclkid', 'twclid', 'vero_conv', 'vero_id', 'wbraid', 'yclid')),
  lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END) AS q FROM u),
c AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)), '^(http://[^:]*):80$', '\\1'), '^(https://[^:]*):443$', '\\1')
  || CASE WHEN regexp_replace(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+$', '') END
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS destination FROM p)
"""


@query(_URL_SQL + "SELECT page_id, destination FROM c")
def canonical_destination(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.destination(F.col("url")).alias("destination"))


@query(_URL_SQL + "SELECT page_id, min(page_id) OVER (PARTITION BY destination) AS winner, page_id <> min(page_id) OVER (PARTITION BY destination) AS loser FROM c")
def duplicate_losers(spark: SparkSession, d: str) -> DataFrame:
    """Equal destinations are one posting; the smallest page_id wins. The winner is a combined aggregate, joined back."""
    p = table(spark, d, "pages").select("page_id", text.destination(F.col("url")).alias("destination"))
    first = p.groupBy("destination").agg(F.min("page_id").alias("winner"))
    return p.join(first, "destination").select("page_id", "winner", (F.col("page_id") != F.col("winner")).alias("loser"))


@query("SELECT sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS content, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_text_groups(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(text.folded(F.col("text")), 256)
    return table(spark, d, "documents").groupBy(key.alias("content")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


@query(r"""SELECT doc_id, trim(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[ \t\n\r\f\v]+', ' ', 'g')), ' -–—,.;:/\|·•*&_+()[]{}''"“”‘’') AS title FROM documents""")
def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.title(F.substring_index("text", "\n", 1)).alias("title"))


_HTML_SQL = reduce(lambda s, e: f"replace({s}, '{e[0]}', '{e[1]}')", [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", " "), ("&amp;", "&")],
                   "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")


@query(f"SELECT page_id, trim(regexp_replace({_HTML_SQL}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages")
def html_text_native(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


#: DuckDB's patterns cannot look behind, so that digits around a telephone number are not asked for here; tests do.
@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?i)https?://[^ \t\n\r\f\v]+|www\.[^ \t\n\r\f\v]+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|(?:\+?1[ \t\n\r\f\v.-]?)?\(?\d{3}\)?[ \t\n\r\f\v.-]\d{3}[ \t\n\r\f\v.-]\d{4}\b', '[contact removed]', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS text FROM documents""")
def pii_scrub(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.scrubbed(F.col("text")).alias("text"))


# Rules


@query(f"""
SELECT doc_id, CASE WHEN source = 'src3' THEN 'kill' WHEN regexp_matches(text, '(?i)\\b(the|and)\\b') AND n_chars < 300 THEN 'kill' WHEN toxic = 1 THEN 'kill' ELSE 'pass' END AS verdict,
  CASE WHEN source = 'src3' THEN 'employer' WHEN regexp_matches(text, '(?i)\\b(the|and)\\b') AND n_chars < 300 THEN 'short' WHEN toxic = 1 THEN 'toxic' END AS rule
FROM documents LEFT JOIN labels USING (doc_id)
""")
def rules_first_kill(spark: SparkSession, d: str) -> DataFrame:
    """Rules in order; the first that holds kills and gives the reason."""
    rules: list[tuple[str, Column]] = [("employer", F.col("source") == "src3"), ("short", F.col("text").rlike(r"(?i)\b(the|and)\b") & (F.col("n_chars") < 300)), ("toxic", F.col("toxic") == 1)]
    rule = reduce(lambda rest, r: F.when(r[1], r[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", rule.alias("rule"))
    return j.select("doc_id", F.when(F.col("rule").isNull(), "pass").otherwise("kill").alias("verdict"), "rule")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN o_totalprice < 50000 THEN 'kill' ELSE 'pass' END AS finding FROM orders")
def rules_salary_three_valued(spark: SparkSession, d: str) -> DataFrame:
    """A floor that only stated amounts can miss: what is not stated is unknown and never kills."""
    stated = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", F.when(stated.isNull(), "unknown").when(stated < 50000, "kill").otherwise("pass").alias("finding"))


# Time and order

_MONTHS_SQL = """
WITH i AS (SELECT o_custkey AS k, min(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS a, max(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS b
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey),
m AS (SELECT DISTINCT k, unnest(generate_series(a, b)) AS m FROM i)
"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(temporal.month(F.col("l_shipdate"))).alias("start"), F.max(temporal.month(F.col("l_shipdate"))).alias("end"))
    return table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), "start", "end")


@query(_MONTHS_SQL + "SELECT k, count(*) AS months FROM m GROUP BY k")
def month_intervals(spark: SparkSession, d: str) -> DataFrame:
    return temporal.occupied_months(_intervals(spark, d), ["k"])


@query("""
WITH i AS (SELECT o_custkey AS k, o_orderkey AS id, min(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS a, max(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS b
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey),
m AS (SELECT k, m, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM (SELECT k, id, unnest(range(a + 1, b)) AS m FROM i) GROUP BY k, m),
s AS (SELECT *, sum(CASE WHEN lag_m = m - 1 AND lag_members = members THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY m) AS g
  FROM (SELECT *, lag(m) OVER w AS lag_m, lag(members) OVER w AS lag_members FROM m WINDOW w AS (PARTITION BY k ORDER BY m)))
SELECT k, min(m)::INT AS first, max(m)::INT AS last, min(members) AS members FROM s GROUP BY k, g
""")
def month_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of months in which the same orders are under way for certain: months strictly inside each."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(temporal.month(F.col("l_shipdate"))).alias("start"), F.max(temporal.month(F.col("l_shipdate"))).alias("end"))
    rows = table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("end") - F.col("start") >= 2)
    # dealt by customer before months are rows, so that only orders are shuffled
    rows = rows.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), "start", "end").repartition("k")
    inside = rows.select("k", "id", F.explode(F.sequence(F.col("start") + 1, F.col("end") - 1)).alias("month"))
    active = inside.groupBy("k", "month").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("members"))
    return temporal.segments(active, ["k"])


@query("SELECT doc_id, source, spent FROM (SELECT doc_id, source, sum(64 * ((n_chars + 255) // 256)) OVER (PARTITION BY source ORDER BY doc_id DESC)::BIGINT AS spent FROM documents) WHERE spent <= 500000")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The newest of each source that fit a budget of padded tokens."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return temporal.running_total(docs, "source", "doc_id", F.expr("64 * ((n_chars + 255) div 256)"), descending=True).where("spent <= 500000").select("doc_id", "source", "spent")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return temporal.interleaved(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) - 1) // 500 AS batch FROM documents")
def score_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 500 of each language, the newest first."""
    return temporal.batches(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")
