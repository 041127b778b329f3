"""More of the catalogue: questions and phrases, observations, answers, timelines, exports and batch scores."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions import questions, reader, text, time, unicode
from ledgerspark.operators import batchscore, ledger, observations
from ledgerspark.plans.catalogue import query, table


@query("""
SELECT doc_id, CASE n_chars % 8 WHEN 0 THEN 'sign_in' WHEN 1 THEN 'file' WHEN 2 THEN 'consent' WHEN 3 THEN 'eeo' WHEN 4 THEN 'authorization_sponsorship' WHEN 5 THEN 'sponsorship' WHEN 6 THEN 'authorization' END AS bucket,
  'why {company} and not ' || lang AS key FROM documents
""")
def sensitive_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which questions are left to a person, and questions without their company."""
    n = F.col("n_chars") % 8
    asked = (
        F.when(n == 0, "Your One-Time Code").when(n == 1, "CV").when(n == 2, "I certify that").when(n == 3, "Gender (required)").when(n == 4, "Authorized to work, or sponsorship?")
        .when(n == 5, "Need a work visa?").when(n == 6, "Right to work").otherwise("Visa support research")
    )
    key = questions.question_key(F.concat(F.lit("Why "), F.initcap("source"), F.lit(" & not "), "lang"), F.concat("source", F.lit(" Holdings")))
    return table(spark, d, "documents").select("doc_id", questions.reserved(asked, F.when(n == 1, "file").otherwise("text")).alias("bucket"), key.alias("key"))


@query(r"""
SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9+#])a[ \t\n\r\f\v]+the($|[^A-Za-z0-9+#])') AS phrase, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(de|la)($|[^\p{L}\p{N}_])|[0-9]{4}') AS matched FROM documents
""")
def term_matches(spark: SparkSession, d: str) -> DataFrame:
    """A phrase with its own idea of a word's ends, and terms and patterns that a profile gives."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", questions.has_phrase(t, "a the").alias("phrase"), questions.matcher(t, ("de", "la"), ("[0-9]{4}",)).alias("matched"))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS w FROM part),
v AS (SELECT p_partkey, unnest(list_concat(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' ')), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')), list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i + 1], ' ')))) AS variant FROM w)
SELECT DISTINCT p_partkey, variant FROM v
""")
def phrase_variants(spark: SparkSession, d: str) -> DataFrame:
    """All runs of two to four words."""
    words = F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    return table(spark, d, "part").select("p_partkey", F.explode(questions.variants(words)).alias("variant"))


@query(rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+') AS w FROM documents),
n AS (SELECT doc_id, w, list_filter(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN TRY_CAST(x AS INT) ELSE list_position({list(questions.NUMBERS)}, lower(x)) - 1 END), lambda x: x IS NOT NULL) AS n,
  list_transform(list_filter(w, lambda x: regexp_matches(x, '^(mailto:)?[^\s@<>?]+@[^\s@<>?]+\.[^\s@<>?]+$')), lambda x: 'mailto:' || regexp_replace(x, '^mailto:', '')) AS mail,
  list_filter(w, lambda x: regexp_matches(x, '^https?://[^\s/@?#:]+(:[0-9]+)?([/?#]\S*)?$')) AS web FROM w)
SELECT doc_id, len(n)::INT AS numbers, coalesce(list_sum(n), 0)::BIGINT AS total, array_to_string(list_sort(list_concat(mail, web)), ' ') AS links FROM n
""")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that each document's words are, in digits or letters, and the words that are mail or web addresses, as links."""
    found = lambda p: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"(?<!\S)(?:{p})(?!\S)"), F.lit(0))
    some = (("n", questions.number, rf"[+-]?[0-9]+|(?i:{'|'.join(questions.NUMBERS)})"), ("l", questions.contact_link, r"[^\s@]+@\S+|https?://\S+"))
    docs = table(spark, d, "documents").select("doc_id", *(F.filter(F.transform(found(p), of), lambda x: x.isNotNull()).alias(name) for name, of, p in some))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select("doc_id", F.size("n").alias("numbers"), total.alias("total"), F.array_join(F.array_sort("l"), " ").alias("links"))


LEVELS = [("small", r"\b(?:small|economy)\b"), ("old", r"\bold\b"), ("standard", r"\b(?:standard|new)\b"), ("large", r"\blarge\b"), ("promo", r"\bpromo\b|\bgizmo\b")]


@query(f"""
WITH t AS (SELECT p_partkey, p_type || ' ' || p_name AS title FROM part),
r AS (SELECT p_partkey, l.rung, greatest(1 - l.rung, l.rung - 2, 0) AS away FROM t JOIN (VALUES {", ".join(f"({i}, '{p}')" for i, (_, p) in enumerate(LEVELS))}) AS l(rung, pattern) ON regexp_matches(title, '(?i)' || pattern))
SELECT p_partkey, arg_min(rung, away * 10 + rung)::INT AS rung FROM t LEFT JOIN r USING (p_partkey) GROUP BY p_partkey
""")
def role_levels(spark: SparkSession, d: str) -> DataFrame:
    """The rung that each part's own words name, taken as near to the band as they allow."""
    return table(spark, d, "part").select("p_partkey", questions.rung(F.concat_ws(" ", "p_type", "p_name"), LEVELS, (1, 2)).alias("rung"))


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://x.org/' || page_id WHEN 1 THEN 'https://y.org/' || page_id ELSE '' END AS destination, CASE page_id % 4 WHEN 0 THEN 'r' || page_id WHEN 1 THEN page_id::VARCHAR ELSE '' END AS requisition,
  CASE page_id % 4 WHEN 0 THEN 'requisition_id' WHEN 1 THEN 'external_id' ELSE '' END AS requisition_source FROM pages
""")
def first_identity(spark: SparkSession, d: str) -> DataFrame:
    """The first alias that says something, whatever its place in the list; and which it was."""
    k, page = F.col("page_id"), F.col("page_id").cast("string")
    apply_url, url = F.when(k % 3 == 0, F.concat(F.lit("HTTPS://X.org/"), page, F.lit("/?utm_x=1"))).otherwise(" "), F.when(k % 3 == 1, F.concat(F.lit("https://y.org/"), page))
    requisition, external = F.when(k % 4 == 0, F.concat(F.lit(" R"), page, F.lit("."))), F.when(k % 4 <= 1, page)
    first = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c), F.lit(""))
    source = F.when(F.coalesce(text.title(requisition), F.lit("")) != "", "requisition_id").when(F.coalesce(external, F.lit("")) != "", "external_id").otherwise("")
    return table(spark, d, "pages").select("page_id", first(text.destination(apply_url), text.destination(url)).alias("destination"), first(text.title(requisition), external).alias("requisition"), source.alias("requisition_source"))


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'new title' ELSE d.source END AS title,
  CASE WHEN l.doc_id IS NULL THEN d.lang WHEN l.toxic = 1 THEN 'more' WHEN d.n_chars % 2 = 0 THEN d.lang ELSE 'bit' END AS description,
  CASE WHEN l.doc_id IS NULL THEN CASE WHEN d.n_chars % 2 = 0 THEN 'full' ELSE 'snippet' END WHEN l.toxic = 1 OR d.n_chars % 2 = 0 THEN 'full' ELSE 'snippet' END AS kind,
  'a=' || CASE WHEN l.quality = 1 THEN 'y' ELSE 'x' END || ',b=' || d.lang || CASE WHEN l.quality = 1 THEN ',c=z' ELSE '' END AS facts, 1 AS first_seen,
  CASE WHEN l.doc_id IS NULL THEN 'open' WHEN l.toxic = 1 THEN 'open' ELSE 'unknown' END AS listing, CASE WHEN l.toxic = 1 THEN 9 ELSE 1 END AS last_verified, CASE WHEN l.toxic = 0 THEN 9 END AS last_attempt
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def observation_merge(spark: SparkSession, d: str) -> DataFrame:
    """What is known of documents after their labels' rows were seen as observations."""
    n = F.col("n_chars") % 2
    known = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("lang").alias("description"), F.when(n == 0, "full").otherwise("snippet").alias("kind"),
        F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("lang")).alias("facts"), F.lit(1).alias("first_seen"), F.lit("open").alias("listing"), F.lit(1).alias("last_verified"), F.lit(None).cast("int").alias("last_attempt"),
    )
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    facts = F.when(good, F.create_map(F.lit("a"), F.lit("y"), F.lit("c"), F.lit("z"))).otherwise(F.create_map().cast("map<string,string>"))
    seen = table(spark, d, "labels").select("doc_id", F.when(good, "new title").otherwise("").alias("title"), F.when(toxic, "more").otherwise("bit").alias("description"), F.when(toxic, "full").otherwise("snippet").alias("kind"), facts.alias("facts"), F.when(toxic, "open").alias("listing"))
    out = observations.merged(known, seen, "doc_id", F.lit(9))
    return out.withColumn("facts", F.array_join(F.transform(F.array_sort(F.map_entries("facts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query("""
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)::INT AS place FROM conversations
""")
def timelines(spark: SparkSession, d: str) -> DataFrame:
    """What happened to each conversation, in order."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")).alias("place"))


@query("""
SELECT facet, n, row_number() OVER (ORDER BY n DESC, facet)::INT AS place FROM (SELECT facet, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type || ' ' || p_brand, ' ')) AS facet FROM part) GROUP BY facet)
""")
def facet_order(spark: SparkSession, d: str) -> DataFrame:
    """Facets by how many rows have them, then by name; there are as many as words, which are few."""
    facets = table(spark, d, "part").select(F.explode(F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_brand"), " "))).alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))
    return facets.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "facet")))


@query("SELECT DISTINCT conv_id AS key FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def orphan_states(spark: SparkSession, d: str) -> DataFrame:
    """States whose posting is not there: a sound ledger has none."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("key")).distinct().join(table(spark, d, "labels").select(F.col("doc_id").alias("key")), "key", "left_anti")


@query("""
WITH a AS (SELECT user_id % 20 AS question, CASE WHEN event_type = 'purchase' THEN 'any' ELSE 'board' || (event_id % 3) END AS scope, CASE WHEN event_type <> 'error' THEN round(value, 2) END AS answer, event_id FROM events)
SELECT question, scope, answer FROM a QUALIFY row_number() OVER (PARTITION BY question, scope ORDER BY event_id DESC) = 1 AND answer IS NOT NULL
""")
def answers_current(spark: SparkSession, d: str) -> DataFrame:
    """The answers that stand: appended ones replace, a null retracts, and promoted ones hold anywhere."""
    scope = F.when(F.col("event_type") == "purchase", "any").otherwise(F.concat(F.lit("board"), (F.col("event_id") % 3).cast("string")))
    a = table(spark, d, "events").select((F.col("user_id") % 20).alias("question"), scope.alias("scope"), F.when(F.col("event_type") != "error", F.round("value", 2)).alias("answer"), "event_id")
    return ledger.latest(a, ["question", "scope"], "event_id").where("answer is not null").select("question", "scope", "answer")


@query("""
WITH k AS (SELECT *, (props->>'$.k')::INT AS k FROM events)
SELECT event_id, NOT (coalesce(k < 20, false) OR event_type = 'error' OR value > 30) AS confirmed FROM k
""")
def confirmed_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts count unless they are said to be unconfirmed, drafts or withheld; what says nothing counts. An event of a low k is said to
    be unconfirmed, one of a high k to be confirmed; errors are drafts, and events of high value withheld."""
    k = F.get_json_object("props", "$.k").cast("int")
    fact = F.struct(F.when(F.col("event_type") == "error", "draft").alias("status"), F.when(F.col("value") > 30, True).alias("withheld"), F.when(k < 20, False).when(k > 50, True).alias("confirmed"))
    f = table(spark, d, "events").select("event_id", fact.alias("f"))
    return f.select("event_id", (F.coalesce("f.confirmed", F.lit(True)) & ~F.coalesce(F.col("f.status") == "draft", F.lit(False)) & ~F.coalesce("f.withheld", F.lit(False))).alias("confirmed"))


@query("""
SELECT sha256('row ' || doc_id) AS id, quality AS keep, source || ' ' || lang AS state FROM labels JOIN documents USING (doc_id)
""")
def anonymous_export(spark: SparkSession, d: str) -> DataFrame:
    """Labelled states without keys; one that held an address would stop the job."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("state", F.concat_ws(" ", "source", "lang"))
    key = F.concat(F.lit("key:"), F.col("doc_id").cast("string"))
    return batchscore.exported(batchscore.anonymous(rows, "doc_id"), "quality", "state", [key], f"(?i){text.CONTACT}")


def _model(states: pd.Series) -> pd.Series:
    """A stand-in for a model: a share read off the state's length."""
    return states.str.len() % 97 / 97


@query("SELECT doc_id, (length(text) % 97) / 97.0::DOUBLE AS probability FROM documents")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's probability by a model that sees anonymous ids, each once."""
    return batchscore.scored(table(spark, d, "documents"), "doc_id", "text", _model)


@query("""
SELECT event_id, sha256('{"props":' || '{"k":' || (props::JSON ->> 'k') || '}' || ',"type":"' || event_type || '"}') AS row_hash FROM events
""")
def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a row's canonical JSON: keys in order at any depth."""
    row = F.to_json(F.struct(F.col("event_type").alias("type"), F.from_json("props", "k int").alias("props")))
    return table(spark, d, "events").select("event_id", unicode.revision(())(row).alias("row_hash"))


@query("""
SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END::INT AS n, CASE n_chars % 3 WHEN 0 THEN lang END AS first FROM documents
""")
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists stored as JSON: decoded where they are lists of texts, null where they are anything else."""
    n = F.col("n_chars") % 3
    stored = F.when(n == 0, F.concat(F.lit('["'), "lang", F.lit('","b"]'))).when(n == 1, "[]").otherwise('{"a": 1}')
    rows = table(spark, d, "documents").select("doc_id", F.when(F.json_array_length(stored).isNotNull(), F.from_json(stored, "array<string>")).alias("x"))
    return rows.select("doc_id", F.when(F.col("x").isNotNull(), F.size("x")).alias("n"), F.get("x", 0).alias("first"))


@query("""
SELECT o_orderkey, replace(replace(lower(trim(o_orderpriority)), ' ', '_'), '-', '_') AS period, ((floor(o_totalprice)::BIGINT + 63) // 64 * 64)::BIGINT AS padded FROM orders
""")
def pay_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orders' priorities spelt as periods are, and their whole prices as tokens in whole blocks."""
    tokens = F.floor("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", time.period(F.col("o_orderpriority")).alias("period"), time.padded(tokens).cast("long").alias("padded"))


def _reader_sql() -> str:
    """Segments of one block and one emphasis each as rows: kinds go on and emphasis is summed by windows."""
    marks = "".join((reader.PART, reader.STRONG, reader.WEAK, reader.GONE))
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    spaced = lambda p: p.replace("(?![a-z0-9-])", r"\b").replace("\\s", "[ \\t\\n\\r\\f\\v]")
    marked = reduce(lambda x, step: f"regexp_replace({x}, {quoted(spaced(step[0]))}, {quoted(step[1])}, 'g')", reader.STEPS, f"{quoted(reader.PART + 'p')} || html")
    decoded = reduce(lambda x, e: f"replace({x}, {quoted('&' + e[0] + ';')}, {quoted(e[1])})", sorted(reader.NAMED.items(), key=lambda e: e[0] == "amp"), "t")
    bullet = quoted(spaced(reader.BULLET))
    return f"""
WITH s AS (SELECT page_id, regexp_extract_all({marked}, '[{marks}][^{marks}]*') AS l FROM pages),
g AS (SELECT page_id, i, left(l[i], 1) AS m, CASE left(l[i], 1) WHEN {quoted(reader.PART)} THEN substr(l[i], 2, 1) END AS k, substr(l[i], CASE left(l[i], 1) WHEN {quoted(reader.PART)} THEN 3 ELSE 2 END) AS t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM s)),
d AS (SELECT page_id, i, k, {decoded} AS t, count(k) OVER w AS block, sum(CASE m WHEN {quoted(reader.STRONG)} THEN 1 WHEN {quoted(reader.WEAK)} THEN -1 ELSE 0 END) OVER w AS depth FROM g WINDOW w AS (PARTITION BY page_id ORDER BY i)),
e AS (SELECT *, depth - least(0, min(depth) OVER (PARTITION BY page_id ORDER BY i)) AS strong FROM d),
b AS (SELECT page_id, block, any_value(k) AS k, trim(regexp_replace(string_agg(t, '' ORDER BY i), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t, coalesce(sum(length(regexp_replace(t, '[ \\t\\n\\r\\f\\v]', '', 'g'))) FILTER (strong > 0), 0) AS strong FROM e GROUP BY page_id, block),
k AS (SELECT *, CASE WHEN k IN ('h', 'i', 'p') THEN k WHEN last_value(CASE WHEN k IN ('h', 'i', 'p') THEN k END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block) = 'i' THEN 'i' ELSE 'p' END AS kind FROM b),
f AS (SELECT *, kind = 'p' AND regexp_matches(t, {bullet}) AS item, kind = 'h' OR (kind = 'p' AND ((length(t) <= {reader.LONGEST_BOLD} AND strong >= length(replace(t, ' ', '')) AND NOT regexp_matches(t, '[.!?]$')) OR (t LIKE '%:' AND length(t) <= {reader.LONGEST_COLON}))) AS heading FROM k WHERE t <> '')
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY block) - 1)::INT AS place, CASE WHEN item OR kind = 'i' THEN 'item' WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN item THEN regexp_replace(t, {bullet}, '') WHEN heading THEN rtrim(regexp_replace(t, ':$', '')) ELSE t END AS text FROM f
"""


@query(_reader_sql())
def reader_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pages as headings, paragraphs and list items, in order."""
    return table(spark, d, "pages").select("page_id", F.posexplode(reader.blocks(F.col("html"))).alias("place", "b")).select("page_id", "place", "b.kind", "b.text")
