"""More of the catalogue: rules and findings, text and identity functions, clocks, selections and encodings."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions import text, time, unicode
from ledgerspark.operators import duplicates, eligibility, entries, ledger, temporal
from ledgerspark.plans.catalogue import query, table

SP = "[ \\t\\n\\r\\f\\v]"

# Rules


@query("""
SELECT doc_id, lower(source) IN ('src3', 'acme') OR lower(lang) IN ('src3', 'acme') OR source = 'src1' AS excluded FROM documents
""")
def rules_employer(spark: SparkSession, d: str) -> DataFrame:
    """Excluded by board, company, or the name that a board stands for."""
    docs = table(spark, d, "documents")
    resolved = F.create_map(F.lit("src1"), F.lit("ACME"))[F.col("source")]
    return docs.select("doc_id", eligibility.employer_excluded(["SRC3", "Acme"], F.col("source"), F.col("lang"), resolved).alias("excluded"))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS low, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.2 END AS high,
  CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS cur, CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'hour' END AS per FROM orders),
f AS (SELECT o_orderkey, CASE WHEN low IS NULL AND high IS NULL THEN 'unknown salary_unknown' WHEN cur IS NULL THEN 'unknown currency_unknown' WHEN cur <> 'USD' THEN 'unknown salary_currency'
  WHEN per IS NULL THEN 'unknown period_unknown' WHEN per <> 'year' THEN 'unknown salary_period' WHEN high IS NULL AND low < 60000 THEN 'unknown salary_unknown'
  WHEN high < 60000 THEN 'kill salary_below_floor' ELSE 'pass salary_clear' END AS x FROM o)
SELECT o_orderkey, split_part(x, ' ', 1) AS status, split_part(x, ' ', 2) AS fact FROM f
""")
def rules_pay(spark: SparkSession, d: str) -> DataFrame:
    """Stated pay in several spellings of currency and period against a floor of 60,000 USD a year."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    low, high = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 1.2)
    currency = F.when(k % 4 == 0, "$").when(k % 4 == 1, " usd ").when(k % 4 == 2, "€")
    period = F.when(k % 3 == 0, "Annually").when(k % 3 == 1, "HR")
    return o.select("o_orderkey", eligibility.pay(low, high, currency, period, 60000, "USD", "year").alias("f")).select("o_orderkey", "f.*")


_ROLES_SQL = """
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'summer' WHEN 1 THEN 'winter' END AS season, CASE WHEN o_orderkey % 4 < 2 THEN 2022 + o_orderkey % 5 END AS year,
  CASE WHEN o_orderkey % 11 = 0 THEN DATE '2025-01-20' WHEN o_orderkey % 7 = 1 THEN make_date(2023 + o_orderkey % 3, 9, 15) WHEN o_orderkey % 7 = 0 THEN make_date(2023 + o_orderkey % 3, 7, 1) END AS start,
  CASE WHEN o_orderkey % 13 = 0 THEN DATE '2024-05-01' END AS deadline FROM orders)
"""


def _roles(spark: SparkSession, d: str) -> DataFrame:
    """Orders as postings whose titles and texts speak of seasons and first days."""
    k = F.col("o_orderkey")
    year = lambda a, n: (F.lit(a) + k % n).cast("string")
    title = F.when(k % 4 == 0, F.concat(F.lit("Intern Summer "), year(2022, 5))).when(k % 4 == 1, F.concat(F.lit("Co-op, winter "), year(2022, 5))).when(k % 4 == 2, F.concat(F.lit("Engineer fall "), year(2022, 5))).otherwise("Engineer")
    said = F.when(k % 7 == 0, F.concat(F.lit("You start in July "), year(2023, 3))).when(k % 7 == 1, F.concat(F.lit("Beginning on "), year(2023, 3), F.lit("-09-15"))).otherwise("An ordinary role")
    field = F.when(k % 11 == 0, "2025-01-20T00:00:00").when(k % 11 == 1, "soon")
    deadline = F.when(k % 13 == 0, "2024-05-01").when(k % 13 == 1, "2025-02-30")
    rows = table(spark, d, "orders").select(k.alias("k"), title.alias("title"), said.alias("said"), field.alias("field"), deadline.alias("deadline"))
    return rows.select("k", time.cohort(F.col("title"), F.lit(None).cast("string"), F.col("said")).alias("cohort"), time.start(F.concat_ws(" ", "title", "said"), F.col("field")).alias("start"), time.date(F.col("deadline")).alias("deadline"))


@query(_ROLES_SQL + "SELECT k, season, year, start, deadline FROM r")
def role_times(spark: SparkSession, d: str) -> DataFrame:
    return _roles(spark, d).select("k", "cohort.season", F.col("cohort.year").cast("long").alias("year"), "start", "deadline")


TIMING = eligibility.Timing(datetime.date(2024, 6, 1), years=(2024, 2025), seasons=("summer", "fall"), available_from=datetime.date(2024, 6, 15), available_until=datetime.date(2025, 8, 31))


@query(_ROLES_SQL + """, f AS (SELECT k, CASE WHEN deadline < DATE '2024-06-01' THEN 'kill expired'
  WHEN year < 2024 OR (year = 2024 AND CASE season WHEN 'summer' THEN 1 ELSE 3 END < 1) THEN 'kill past_cohort' WHEN year NOT IN (2024, 2025) THEN 'kill year_mismatch' WHEN season NOT IN ('summer', 'fall') THEN 'kill season_mismatch'
  WHEN season IS NULL AND start IS NULL THEN 'unknown timing_unknown' WHEN month(start) NOT IN (6, 7, 8, 9, 10, 11) THEN 'kill season_mismatch' WHEN year(start) NOT IN (2024, 2025) THEN 'kill year_mismatch'
  WHEN start IS NULL THEN 'unknown timing_unknown' WHEN start < DATE '2024-06-15' THEN 'kill before_available' WHEN start > DATE '2025-08-31' THEN 'kill after_available' ELSE 'pass timing_clear' END AS x FROM r)
SELECT k, split_part(x, ' ', 1) AS status, split_part(x, ' ', 2) AS fact FROM f""")
def rules_timing_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Deadlines, cohorts and first days against a window of availability."""
    found = eligibility.timing(F.col("deadline"), F.col("cohort"), F.col("start"), TIMING)
    return _roles(spark, d).select("k", found.alias("f")).select("k", "f.*")


@query(_ROLES_SQL + """, t AS (SELECT k, CASE WHEN deadline IS NULL AND season IS NULL AND start IS NULL THEN 'pass' WHEN deadline < DATE '2024-06-01' THEN 'kill' WHEN year < 2024 THEN 'kill' ELSE 'pass' END AS t,
  CASE WHEN k % 3 = 0 THEN 'unknown' WHEN k % 5 = 0 THEN 'kill' ELSE 'pass' END AS m, deadline IS NOT NULL OR season IS NOT NULL OR k % 3 <> 0 AS relevant FROM r)
SELECT k, CASE WHEN t = 'kill' OR m = 'kill' THEN 'kill' WHEN m = 'unknown' THEN 'unknown' ELSE 'pass' END AS status, relevant FROM t""")
def rules_combined(spark: SparkSession, d: str) -> DataFrame:
    """Time and pay together: an explicit kill outranks the unknown; and whether a row says anything on either."""
    none, k = eligibility.Timing(datetime.date(2024, 6, 1)), F.col("k")
    cohort = F.when(F.col("cohort.year") < 2024, F.col("cohort"))  # later ones are not judged without a window
    money = eligibility.first_of((k % 3 == 0, "unknown", "salary_unknown"), (k % 5 == 0, "kill", "salary_below_floor"), otherwise=("pass", "salary_clear"))
    rows = _roles(spark, d)
    status = eligibility.combined(eligibility.timing(F.col("deadline"), cohort, F.col("start"), none), money, 1.0)
    said = eligibility.relevant(F.col("deadline"), F.lit(None), k % 3 != 0, F.col("cohort"), none, None)
    return rows.select("k", status["status"].alias("status"), said.alias("relevant"))


@query("""
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'passed location, work authorization, and eligibility hard filters, but work authorization could not be assessed: the stored description is a truncated snippet'
  ELSE 'passed location, work authorization, and eligibility hard filters' END AS reason FROM documents
""")
def rules_pass_reason(spark: SparkSession, d: str) -> DataFrame:
    reason = eligibility.passed_reason(["location", "work_authorization", "eligibility"], ["work_authorization"], F.col("n_chars") % 3 == 0)
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 10 - p_size WHEN p_size > 20 THEN p_size - 20 ELSE 0 END AS distance FROM part")
def rules_ladder_band(spark: SparkSession, d: str) -> DataFrame:
    """How far rungs are from a band; nearest first, then the lower rung, is the order that readings are taken in."""
    return table(spark, d, "part").select("p_partkey", time.band_distance(F.col("p_size"), 10, 20).alias("distance"))


# Text and identity


@query("""
SELECT c_custkey, trim(regexp_replace(trim(lower(c_name || CASE c_custkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' S.A.' ELSE ' Company' END), ' -–—,.;:/\\|·•*&_+()[]{}''"'), ' (inc|llc|ltd|corp|plc|s\\.a)$', ''), ' -–—,.;:/\\|·•*&_+()[]{}''"') AS employer FROM customer
""")
def employer_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(k == 0, ", Inc.").when(k == 1, "  LLC").when(k == 2, " S.A.").otherwise(" Company"))
    return table(spark, d, "customer").select("c_custkey", text.employer(name).alias("employer"))


@query("""
SELECT s_suppkey, trim(regexp_replace(replace(lower(s_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' and more' AS label, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS plain FROM supplier
""")
def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    asked = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " & More (Required) ").otherwise(" & more Required"))
    return table(spark, d, "supplier").select("s_suppkey", text.label(asked).alias("label"), text.alphanumeric(F.col("s_name")).alias("plain"))


@query("""
WITH v AS (SELECT doc_id, string_split(source, '') AS x, source || ' ' || lang AS value, regexp_replace(lower(text || ' ' || source), '[^\\p{L}\\p{N}]', '', 'g') AS document FROM documents)
SELECT doc_id, list_count(list_filter(regexp_extract_all(value, '[\\p{L}\\p{N}]{2,}'), lambda r: NOT contains(document, lower(r)))) = 0 AS by_token, contains(document, regexp_replace(lower(value), '[^\\p{L}\\p{N}]', '', 'g')) AS whole FROM v
""")
def token_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document spells out its own source and language, token by token and as a whole."""
    value, document = F.concat_ws(" ", "source", "lang"), text.alphanumeric(F.concat_ws(" ", "text", "source"))
    return table(spark, d, "documents").select("doc_id", text.grounded(value, document, F.lit(False)).alias("by_token"), text.grounded(value, document, F.lit(True)).alias("whole"))


@query(f"""
WITH f AS (SELECT doc_id, text, strpos(text, 'e') - 1 AS p FROM documents)
SELECT doc_id, CASE WHEN greatest(p - 70, 0) > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(p - 70, 0) + 1, least(p + 71, length(text)) - greatest(p - 70, 0)), '{SP}+', ' ', 'g'))
  || CASE WHEN least(p + 71, length(text)) < length(text) THEN '…' ELSE '' END AS excerpt, substr(trim(regexp_replace(text, '{SP}+', ' ', 'g')), 1, 300) AS concise FROM f WHERE p >= 0
""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """What stands around the first e, and a text's first 300 characters without line ends: both are what a report shows."""
    at = F.instr("text", "e") - 1
    return table(spark, d, "documents").where(at >= 0).select("doc_id", text.excerpt(F.col("text"), at, at + 1).alias("excerpt"), text.concise(F.col("text")).alias("concise"))


@query("""
SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'unknown' END AS listing,
  CASE n_chars % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'remote' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS workplace,
  CASE n_chars % 6 WHEN 0 THEN 'job' WHEN 1 THEN 'talent_pool' WHEN 2 THEN 'program' WHEN 3 THEN 'unknown' WHEN 4 THEN 'program' ELSE 'job' END AS opportunity FROM documents
""")
def canonical_types(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    listing = F.when(n % 5 == 0, "Canceled").when(n % 5 == 1, " PUBLISHED ").when(n % 5 == 2, "who knows")
    place = F.when(n % 4 == 0, "Flexible, partly on_site").when(n % 4 == 1, "Work From Home").when(n % 4 == 2, "On_Site").otherwise(" ")
    kind = F.when(n % 6 == 0, "Full-time").when(n % 6 == 1, "General Application").when(n % 6 == 2, "Rotational").when(n % 6 == 3, "other")
    title = F.when(n % 6 == 4, "A Rotational  Program").otherwise("Engineer")
    return table(spark, d, "documents").select("doc_id", text.listing_status(listing).alias("listing"), text.workplace(place).alias("workplace"), text.opportunity(kind, title, F.lit(None).cast("string")).alias("opportunity"))


@query(r"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '\d+(?:[.,]\d+)*%?') AS a, regexp_extract_all(split_part(text, chr(10), 1), '\d+(?:[.,]\d+)*%?') AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ' ') AS introduced FROM n
""")
def introduced_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of a text that its first line does not have."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.introduced_numbers(F.col("text"), F.substring_index("text", "\n", 1)), " ").alias("introduced"))


@query("""
WITH h AS (SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN replace(replace(replace('<b>' || lang || '</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') WHEN 1 THEN '&amp;lt;p&amp;gt;' || lang ELSE lang || chr(10) || 'x & y' || chr(10) || chr(10) || source END AS raw, lang, source, n_chars FROM documents)
SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN '<b>' || lang || '</b>' WHEN 1 THEN '<p>' || lang ELSE '<p>' || lang || '<br>x &amp; y</p><p>' || source || '</p>' END AS html FROM h
""")
def description_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions escaped once, escaped twice, and plain, all as HTML."""
    n = F.col("n_chars") % 3
    raw = F.when(n == 0, F.concat(F.lit("  &lt;b&gt;"), "lang", F.lit("&lt;/b&gt;"))).when(n == 1, F.concat(F.lit("&amp;lt;p&amp;gt;"), "lang")).otherwise(F.concat("lang", F.lit("\nx & y\n\n"), "source"))
    return table(spark, d, "documents").select("doc_id", text.description_html(raw).alias("html"))


@query("SELECT event_id, sha256('{\"k\":' || (props::JSON ->> 'k') || ',\"type\":\"' || event_type || '\"}') AS revision, sha256('{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}') AS input_hash FROM events")
def posting_revision(spark: SparkSession, d: str) -> DataFrame:
    """Digests of an object without its clocks, its keys in order, and of a fixed list of fields."""
    e = table(spark, d, "events")
    row = F.to_json(F.struct(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("ts").cast("string").alias("seen_at")))
    fixed = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return e.select("event_id", unicode.revision(("seen_at",))(row).alias("revision"), F.sha2(fixed, 256).alias("input_hash"))


@query(r"""
WITH t AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS source, regexp_extract(url, '^https?://[^/?#]+/[^/?#]+/([A-Za-z0-9_-]+)', 1) AS board FROM pages)
SELECT source, board, min(page_id) AS first_page, count(*) AS n FROM t WHERE source <> '' AND board <> '' AND board NOT IN (SELECT doc_id::VARCHAR FROM labels) GROUP BY 1, 2
""")
def harvest_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Boards that URLs name behind their language, without those that have labels already."""
    p = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("source"), F.regexp_extract("url", r"^https?://[^/?#]+/[^/?#]+/([A-Za-z0-9_-]+)", 1).alias("board"))
    known = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("board")).distinct()
    found = p.where("source <> '' and board <> ''").groupBy("source", "board").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
    return found.join(known, "board", "left_anti").select("source", "board", "first_page", "n")


@query("SELECT doc_id, lang AS source, CASE WHEN n_chars % 2 = 0 THEN 'a:b' ELSE '' END AS board FROM documents")
def source_split(spark: SparkSession, d: str) -> DataFrame:
    """A source and board, parted at the first colon."""
    both = F.concat("lang", F.when(F.col("n_chars") % 2 == 0, ":a:b").otherwise(":"))
    docs = table(spark, d, "documents").withColumn("both", both)
    return docs.select("doc_id", F.substring_index("both", ":", 1).alias("source"), F.substr("both", F.instr("both", ":") + 1).alias("board"))


# Clocks, pay and cost


def _clock() -> Column:
    n = F.col("n_chars") % 6
    return F.when(n == 0, "2024-01-05T10:00:00Z").when(n == 1, "2024-01-05 10:00:00").when(n == 2, "2124-01-05T10:00:00+00:00").when(n == 3, "last week").when(n == 4, "2024-01-05T10:00:00+02:00").otherwise("")


@query("""
SELECT doc_id, CASE n_chars % 6 WHEN 0 THEN 1704448800 WHEN 1 THEN 1704448800 WHEN 2 THEN 4860122400 WHEN 4 THEN 1704441600 END::DOUBLE AS instant, CASE n_chars % 6 WHEN 0 THEN 1704448800 WHEN 4 THEN 1704441600 END::DOUBLE AS past,
  CASE n_chars % 6 WHEN 0 THEN 1704448800 WHEN 4 THEN 1704441600 WHEN 5 THEN 1704067200 END::DOUBLE AS first, CASE WHEN n_chars % 6 IN (0, 1, 4) THEN DATE '2024-01-05' WHEN n_chars % 6 = 2 THEN DATE '2124-01-05' END AS day FROM documents
""")
def clocks(spark: SparkSession, d: str) -> DataFrame:
    """Instants of several spellings: read at all, only with a zone and not in the future, and the first clock that says anything."""
    now = F.lit(1_750_000_000.0)
    c = table(spark, d, "documents").select("doc_id", _clock().alias("c"))
    return c.select("doc_id", time.instant(F.col("c")).alias("instant"), time.past_instant(F.col("c"), now).alias("past"), time.first_clock(now, F.col("c"), F.lit("2024-01-01T00:00:00Z")).alias("first"), time.date(F.col("c")).alias("day"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey + 0.5 END::DOUBLE AS amount, CASE o_orderkey % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'CHF' WHEN 2 THEN 'USD' END AS currency,
  CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'per_day' WHEN 2 THEN 'week' END AS period FROM orders
""")
def pay_words(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    amount = F.when(k % 3 == 0, F.concat(F.lit("from $"), k.cast("string"), F.lit(" up"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise("negotiable")
    currency = F.when(k % 4 == 0, "£").when(k % 4 == 1, " chf").when(k % 4 == 2, "US$").otherwise(" ")
    period = F.when(k % 4 == 0, "ANNUAL").when(k % 4 == 1, "per-day").when(k % 4 == 2, "Weekly ")
    return table(spark, d, "orders").select("o_orderkey", time.number(amount).alias("amount"), time.currency(currency).alias("currency"), time.period(period).alias("period"))


@query("SELECT source, sum(64 * ((n_chars + 63) // 64))::BIGINT AS padded, round((sum(64 * ((n_chars + 63) // 64)) * 0.0001 + 90) * 4 / 3600 + 0.1, 9) AS cost FROM documents GROUP BY source")
def projected_costs(spark: SparkSession, d: str) -> DataFrame:
    """What scoring a source's documents would cost: linear in tokens padded to blocks, with start-up and a reservation."""
    p = table(spark, d, "documents").groupBy("source").agg(F.sum(time.padded(F.col("n_chars"))).cast("long").alias("padded"))
    return p.select("source", "padded", F.round(time.projected_cost(F.col("padded"), 0.0001, 90, 4, 0.1), 9).alias("cost"))


# Selections


@query("""
WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey::VARCHAR ELSE '' END AS board, CASE s_suppkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE '' END AS employer FROM supplier)
SELECT s_suppkey, count(c_custkey) AS n FROM c LEFT JOIN customer ON CASE WHEN board <> '' THEN board = c_nationkey::VARCHAR ELSE employer <> '' AND employer = lower(c_mktsegment) END GROUP BY s_suppkey
""")
def conditional_contact_match(spark: SparkSession, d: str) -> DataFrame:
    """Contacts go by board where they state one, else by employer: two equi-joins on counts, not one on a condition."""
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 != 0, F.col("s_nationkey").cast("string")).otherwise("").alias("board"), F.when(k % 5 == 0, "Building, Inc").when(k % 5 == 1, "MACHINERY").otherwise("").alias("name"))
    rows = table(spark, d, "customer")
    by_board = rows.groupBy(F.col("c_nationkey").cast("string").alias("board")).agg(F.count("*").alias("n"))
    by_name = rows.groupBy(text.employer(F.col("c_mktsegment")).alias("employer")).agg(F.count("*").alias("n"))
    stated = c.where("board <> ''").join(by_board, "board", "left").select("s_suppkey", "n")
    named = c.where("board = ''").withColumn("employer", text.employer(F.regexp_replace("name", ",", ""))).join(by_name.where("employer <> ''"), "employer", "left").select("s_suppkey", "n")
    return stated.union(named).select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND n_chars > 500 UNION SELECT conv_id FROM conversations WHERE role = 'assistant'
""")
def recheck_keys(spark: SparkSession, d: str) -> DataFrame:
    """New picks and whatever stands in an application, each once."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    picks = table(spark, d, "documents").where("n_chars > 500").join(good, "doc_id", "left_semi").select("doc_id")
    return picks.union(table(spark, d, "conversations").where("role = 'assistant'").select("conv_id")).distinct()


@query("""
SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, lang DESC, doc_id DESC) AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND doc_id NOT IN (SELECT conv_id FROM conversations) AND doc_id NOT IN (SELECT user_id FROM events) AND source IN ('src1', 'src2', 'web') QUALIFY place <= 100
""")
def predraft_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Good scores without progress or an attempt, of the sources that can be drafted for; the 100 checked last, as attempts a day are limited."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    rows = table(spark, d, "documents").where(F.col("source").isin("src1", "src2", "web")).join(good, "doc_id", "left_semi")
    for done in (table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")), table(spark, d, "events").select(F.col("user_id").alias("doc_id"))):
        rows = rows.join(done.distinct(), "doc_id", "left_anti")
    order = [F.desc("n_chars"), F.desc("lang"), F.desc("doc_id")]
    top = rows.select("doc_id", "n_chars", "lang").orderBy(*order).limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("SELECT arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS waiting FROM events WHERE event_type IN ('error', 'view')")
def score_pause(spark: SparkSession, d: str) -> DataFrame:
    """What the last heartbeat of a stage says."""
    e = table(spark, d, "events").where("event_type in ('error', 'view')")
    return e.agg(F.max_by("event_type", "event_id").alias("status"), F.max_by("value", "event_id").alias("waiting"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND source <> '' AND source <> 'src1' GROUP BY source")
def stray_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that another profile wrote, by its name; rows that name none are of any."""
    return table(spark, d, "documents").where("source is not null and source not in ('', 'src1')").groupBy("source").agg(F.count("*").alias("n"))


@query("""
SELECT d.source, count(*) AS observed, count(*) FILTER (l.doc_id IS NULL) AS new, count(*) FILTER (l.quality = 1) AS refreshed, count(*) FILTER (l.quality = 0 AND l.toxic = 0) AS unknown,
  count(*) FILTER (l.quality = 0 AND l.toxic = 1) AS closed, count(*) FILTER (l.doc_id IS NULL OR l.quality IN (0, 1)) AS appended FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source
""")
def refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    kinds = {"new": F.col("known").isNull(), "refreshed": q == 1, "unknown": (q == 0) & (t == 0), "closed": (q == 0) & (t == 1)}
    out = rows.groupBy("source").agg(F.count("*").alias("observed"), *(F.count_if(c).alias(n) for n, c in kinds.items()))
    return out.withColumn("appended", F.col("new") + F.col("refreshed") + F.col("unknown") + F.col("closed"))


@query("""
WITH i AS (SELECT o_custkey AS k, o_orderkey, o_orderpriority, greatest(max(year(l_shipdate) * 12 + month(l_shipdate)) - min(year(l_shipdate) * 12 + month(l_shipdate)) - 1, 0) AS months
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT k, coalesce(sum(months) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), 0)::BIGINT AS months, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS withheld FROM i GROUP BY k
""")
def guaranteed_months(spark: SparkSession, d: str) -> DataFrame:
    """Months that a subset of a customer's intervals guarantees, and how many intervals are left out."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(temporal.month(F.col("l_shipdate"))).alias("start"), F.max(temporal.month(F.col("l_shipdate"))).alias("end"))
    counts = F.arrays_overlap(F.array("o_orderpriority"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    rows = table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("k")).agg(F.coalesce(F.sum(F.when(counts, temporal.guaranteed(F.col("start"), F.col("end")))), F.lit(0)).alias("months"), F.count_if(~counts).alias("withheld"))


@query("""
SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_transform(p.w, lambda x: list_position(p.w, x))), lambda i: i)), lambda i: p.w[i]), '; ') AS places
FROM (SELECT p_partkey, string_split(p_type || ' ' || p_name || ' ' || p_type, ' ') AS w FROM part) p
""")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of a list in the order they first come, joined."""
    w = F.split(F.concat_ws(" ", "p_type", "p_name", "p_type"), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(w), "; ").alias("places"))


@query("""
WITH l AS (SELECT lang AS k, doc_id, CASE WHEN n_chars % 3 = 0 THEN source ELSE '' END AS company FROM documents)
SELECT k, coalesce(arg_min(company, doc_id) FILTER (company <> ''), k) AS label FROM l GROUP BY k
""")
def label_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The first label that says more than the key; the key itself until there is one."""
    company = F.when(F.col("n_chars") % 3 == 0, F.col("source"))
    return table(spark, d, "documents").groupBy(F.col("lang").alias("k")).agg(F.min_by(company, F.when(company.isNotNull(), F.col("doc_id"))).alias("c")).select("k", F.coalesce("c", "k").alias("label"))


@query("""
SELECT user_id, list_position(['queued', 'approved', 'prepared', 'filled', 'submitted', 'concluded', 'rejected', 'withdrawn'], CASE arg_max(event_type, event_id) WHEN 'click' THEN 'approved' WHEN 'view' THEN 'rejected' WHEN 'purchase' THEN 'submitted' WHEN 'signup' THEN 'queued' ELSE 'filled' END)::BIGINT AS place FROM events GROUP BY user_id
""")
def state_order(spark: SparkSession, d: str) -> DataFrame:
    """Where a user's state stands in the states' own order."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"))
    state = F.when(F.col("t") == "click", "approved").when(F.col("t") == "view", "rejected").when(F.col("t") == "purchase", "submitted").when(F.col("t") == "signup", "queued").otherwise("filled")
    return e.select("user_id", F.array_position(F.array(*map(F.lit, entries.STATES)), state).alias("place"))


@query("""
SELECT d.doc_id, row_number() OVER (PARTITION BY source ORDER BY ts IS NOT NULL, n_chars % 2 = 0, ts NULLS FIRST, d.doc_id) AS place FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id AND e.event_type <> 'error' QUALIFY place <= 20
""")
def candidate_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 of each source whose details are to be fetched, as a run takes no more: never tried ones, those without their text, the longest ago."""
    clock = table(spark, d, "events").where("event_type <> 'error'").select(F.col("event_id").alias("doc_id"), "ts")
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(clock, "doc_id", "left")
    order = F.struct(F.col("ts").isNotNull().alias("a"), (F.col("n_chars") % 2 == 0).alias("b"), F.col("ts").alias("c"), F.col("doc_id").alias("d"))
    # partial tops by a salt, then the top of these
    salted = rows.select("doc_id", "source", order.alias("o")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    for keys in (["source", "salt"], ["source"]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where("place <= 20")
    return salted.select("doc_id", "place")


@query("""
SELECT doc_id, len(list_filter(string_split(upper(lang) || ' ' || upper(source), ' '), lambda x: x IN ('EN', 'DE', 'SRC1'))) > 0 AS inside FROM documents
""")
def scope_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Whether any reading of a place is in scope."""
    readings = F.array(F.upper("lang"), F.upper("source"))
    return table(spark, d, "documents").select("doc_id", (F.size(F.array_intersect(readings, F.array(*map(F.lit, ("EN", "DE", "SRC1"))))) > 0).alias("inside"))


@query("""
SELECT d.doc_id, l.doc_id IS NOT NULL AND l.quality = d.n_chars % 2 AS fresh, l.doc_id IS NOT NULL AND l.quality = d.n_chars % 2 AND l.toxic = 0 AS settled FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def fresh_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether a standing decision was made of this very version, and can be trusted without another look: duplicates never are."""
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("version"))
    decided = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("posting_version"), F.when(F.col("toxic") == 1, "duplicate").alias("rule"), F.lit(True).alias("known"))
    fresh = F.coalesce(F.col("known") & F.col("version").eqNullSafe(F.col("posting_version")), F.lit(False))
    return rows.join(decided, "doc_id", "left").select("doc_id", fresh.alias("fresh"), (fresh & ~F.col("rule").eqNullSafe(F.lit("duplicate"))).alias("settled"))


@query("""
WITH p AS (SELECT *, lag(event_type) OVER w AS t0, lag(value) OVER w AS v0, lag(event_id) OVER w AS e0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, e0 IS NULL AS is_full, CASE WHEN e0 IS NULL OR t0 <> event_type THEN event_type END AS type, CASE WHEN value > 50 AND (e0 IS NULL OR v0 <= 50 OR round(v0, 2) <> round(value, 2)) THEN round(value, 2) END AS high, e0 IS NOT NULL AND v0 > 50 AND value <= 50 AS high_removed FROM p
""")
def delta_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Rows as what they change of the row before, and what they no longer have; a key's first row in full."""
    e = table(spark, d, "events")
    fields = F.map_filter(F.create_map(F.lit("type"), F.col("event_type"), F.lit("high"), F.when(F.col("value") > 50, F.round("value", 2).cast("string"))), lambda k, v: v.isNotNull())
    out = ledger.deltas(e.select("user_id", "event_id", fields.alias("fields")), "user_id", "event_id")
    return out.select("event_id", F.col("full").alias("is_full"), F.col("fields")["type"].alias("type"), F.col("fields")["high"].cast("double").alias("high"), F.array_contains("removed", "high").alias("high_removed"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Pages and orders as postings with destinations, requisitions and employers that partly agree."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("key"), F.when(k % 3 != 0, F.concat(F.lit("https://x/"), (k % 97).cast("string"))).otherwise("").alias("destination"), F.when(k % 5 != 0, F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string"))).otherwise("").alias("requisition"),
        F.when(k % 2 == 0, "external_id").otherwise("requisition_id").alias("requisition_source"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("source"), F.when(k % 7 != 0, F.concat(F.lit("b"), (k % 4).cast("string"))).otherwise("").alias("board"),
        F.concat(F.lit("e"), (k % 6).cast("string")).alias("employer"), (k % 4 != 0).alias("strong"), F.when(k % 9 == 0, "closed").otherwise("open").alias("listing"), (k % 8 == 0).alias("truncated"), F.when(k % 10 != 0, (k % 1000).cast("double")).alias("discovered"),
    )


@query(None)
def duplicate_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate groups by destination or requisition, with vetoes, best members first: each member and its group's winner."""
    rank = duplicates.rank(F.col("listing"), F.col("truncated"), F.col("discovered"), F.col("key"))
    return duplicates.duplicates(_members(spark, d), "key", rank)
