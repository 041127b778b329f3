"""Queries over documents read as postings: authorisation, education, requirement spans and what evidence says of them.

The tables' texts are invented words, so a posting is a document's own text with its commonest words read as those of
postings (WORDS), wherever they stand; each sentence is a line, and a line of one word starts a section of requirements,
one of two words a section of duties.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.operators import assessment as A
from ledgerspark.operators import authorization, education, entries, places, requirements, shifts
from ledgerspark.operators import placeholders as P
from ledgerspark.plans.catalogue import query, table

WORDS = {
    "that": "security clearance", "was": "required", "by": "preferred", "be": "must", "at": "no", "this": "3 years", "on": "Bachelor's degree", "for": "PhD", "it": "experience",
    "are": "certification", "is": "or equivalent", "as": "plus", "from": "completed", "th": "5+ years of experience", "er": "license", "he": "work authorization", "an": "citizenship",
    "ed": "not", "re": "Master's degree in", "en": "sponsorship", "ea": "a plus", "st": "; or", "ly": "green card", "ou": "starting June 2026", "ing": "minimum",
    "the": "and", "of": "or", "ha": "starting in March 2026", "rewh": "available 2026-07-15", "nd": "graduating by May 2026", "orre": "graduated in 2026-01", "thatin": "recent graduate", "ti": "GPA", "nt": "GED",
    "der": "Bachelor's degree", "die": "required", "den": "2-4 years", "la": "PhD in", "les": "preferred", "des": "experience", "el": "must", "los": "5 years", "que": "or", "et": "and", "y": "and", "und": "or",
}


def posting(text: Column, words: dict[str, str] = WORDS) -> Column:
    """A document's text with the words of postings."""
    return _reworded(words)(text)


#: How many pieces of text a task remembers, and the longest of them.
PIECES, PIECE = 100_000, 40
_MARKS = (".", ",", ";", ":", "!", "?", ")")
#: What a line may end with behind its last full stop.
_BREAKS = "\r\x85\u2028\u2029"


def _reworded(words: dict[str, str]) -> Callable[[Column], Column]:
    """Texts with each run of letters that is one of words, whatever its case, put in other words, a line for each sentence, and
    headings for lines of one and two words. In Python, as an array of a text's words costs a text more than all that is read
    in it; what stands between two spaces is reworded by itself, and remembered."""

    run, get, ends = re.compile(r"([^\W\d_]+)"), words.get, re.compile(r"\. +")

    def parted(w: str) -> str:
        # numbers that are no digits, as in "the²", part letters
        return "".join(get(x.lower(), x) for x in ("".join(g) for _, g in itertools.groupby(w, str.isalpha)))

    def reword(t: str) -> str:
        parts = run.split(t)  # what stands between runs, and each run behind it
        parts[1::2] = [(w if w.isalpha() else parted(w)) if (new := get(w.lower())) is None else new for w in parts[1::2]]
        return "".join(parts)

    class Known(dict):
        def __missing__(self, piece: str) -> str:
            word, mark = (piece[:-1], piece[-1]) if piece[-1:] in _MARKS else (piece, "")
            new = get(word.lower(), word) + mark if word.isalpha() else reword(piece)
            if len(piece) <= PIECE and len(self) < PIECES:
                self[piece] = new
            return new

    def line(t: str) -> str:
        spaces = t.count(" ")
        if spaces > 1 or not (said := t[:-1] if t[-1:] in _BREAKS else t).endswith("."):
            return t
        if not spaces:
            return "Requirements:" if len(said) > 1 else t
        at = said.index(" ")
        return "Responsibilities:" if 0 < at < len(said) - 2 else t

    @F.pandas_udf("string")
    def reworded(texts: pd.Series) -> pd.Series:
        known = Known()
        return texts.map(lambda t: "\n".join(map(line, ends.sub(".\n", " ".join(map(known.__getitem__, t.split(" ")))).split("\n"))), na_action="ignore")

    return reworded


def dealt(docs: DataFrame) -> DataFrame:
    """docs over all tasks, whatever their files: the rules cost a text far more than its way does."""
    return docs.repartition("doc_id", F.xxhash64("text"))


def posting_sql(words: dict[str, str] = WORDS) -> str:
    """The same in SQL: p (doc_id, n_chars, text)."""
    pairs = "MAP {" + ", ".join("'{}': '{}'".format(*(x.replace("'", "''") for x in pair)) for pair in words.items()) + "}"
    return rf"""
WITH w AS (SELECT doc_id, n_chars, array_to_string(list_transform(regexp_extract_all(text, '\p{{L}}+|[^\p{{L}}]+'), lambda x: coalesce({pairs}[lower(x)], x)), '') AS t FROM documents),
p AS (SELECT doc_id, n_chars, array_to_string(list_transform(string_split(regexp_replace(t, '\. +', '.' || chr(10), 'g'), chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[^ ]+\.$') THEN 'Requirements:' WHEN regexp_matches(x, '^[^ ]+ [^ ]+\.$') THEN 'Responsibilities:' ELSE x END), chr(10)) AS text FROM w)
"""


POSTING_SQL = posting_sql()


# Work authorisation

AUTHORIZATION = authorization.Authorization(
    restrictions=(r"(?iU)\bsecurity clearance\b[^.;]{0,45}\brequired\b", r"(?iU)\bmust\b[^.;]{0,45}\b(?:citizenship|green card)\b"),
    noted=(r"(?iU)\bsponsorship\b[^.;]{0,30}\bno\b",), noted_label="sponsorship is limited", clear="no clearance or citizenship wording",
)


def _sql_matches(pattern: str, group: int) -> str:
    """(doc_id, n_chars, t, k, i, s, e, q): matches of pattern with places, from what stands between them. Letters beyond ASCII
    count as x, as DuckDB's word boundaries know ASCII alone."""
    return f"""SELECT doc_id, t, x, {group} AS k, i, list_sum(list_transform(g[1:i], lambda a: length(a)))::BIGINT + coalesce(list_sum(list_transform(q[1:i - 1], lambda a: length(a))), 0)::BIGINT AS s, s + length(q[i]) AS e, q[i] AS quote
  FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM (SELECT doc_id, t, x, regexp_extract_all(x, '{pattern}') AS q, regexp_split_to_array(x, '{pattern}') AS g FROM l))"""


_PREF, _REQ, _DENY = (p.replace("(?iU)", "(?i)").replace("'", "''") for p in (authorization.PREFERENCE, authorization.REQUIREMENT, authorization.DENIAL))
_EXCERPT = """'''' || CASE WHEN s > 70 THEN '…' ELSE '' END || trim(regexp_replace(substr(t, greatest(s - 70, 0) + 1, least(e + 70, length(t)) - greatest(s - 70, 0)), ' +', ' ', 'g')) || CASE WHEN e + 70 < length(t) THEN '…' ELSE '' END || ''''"""


@query(
    POSTING_SQL
    + rf""", l AS (SELECT doc_id, n_chars, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^\x00-\x7F]', 'x', 'g') AS x FROM p),
m AS ({" UNION ALL ".join(_sql_matches(p.replace("(?iU)", "(?i)"), k) for k, p in enumerate(AUTHORIZATION.restrictions))}),
h AS (SELECT *, CASE WHEN regexp_matches(substr(x, greatest(s - 70, 0) + 1, s - greatest(s - 70, 0)), '{_PREF}')
    OR (regexp_matches(substr(x, 1, s), '{_PREF}') AND NOT regexp_matches(list_last(regexp_split_to_array(substr(x, 1, s), '{_PREF}')), '{_REQ}')) THEN 'preferred'
  WHEN regexp_matches(substr(x, greatest(s - 30, 0) + 1, s - greatest(s - 30, 0)), '{_DENY}') OR regexp_matches(quote, '{_DENY}') THEN 'denied' ELSE 'kill' END AS how FROM m),
n AS ({_sql_matches(AUTHORIZATION.noted[0].replace("(?iU)", "(?i)"), 0)}),
kills AS (SELECT doc_id, {_EXCERPT} AS said FROM h WHERE how = 'kill' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, i) = 1),
noted AS (SELECT doc_id, {_EXCERPT} AS said FROM n WHERE i = 1),
waived AS (SELECT doc_id, bool_or(how = 'denied') AS denied, bool_or(how = 'preferred') AS preferred FROM h GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN kills.said IS NOT NULL THEN 'kill' ELSE 'pass' END AS status,
  CASE WHEN kills.said IS NOT NULL THEN 'restricted' WHEN noted.said IS NOT NULL THEN 'noted' WHEN denied THEN 'denied' WHEN preferred THEN 'preferred' WHEN n_chars < 400 THEN 'unassessed' ELSE 'clear' END AS fact,
  CASE WHEN kills.said IS NOT NULL THEN 'work-authorization restriction: ' || kills.said WHEN noted.said IS NOT NULL THEN 'passed deliberately — {AUTHORIZATION.noted_label}: ' || noted.said
    WHEN n_chars < 400 THEN 'work authorization could not be assessed: the stored description is a truncated snippet' ELSE '{AUTHORIZATION.clear}' END AS reason
FROM l LEFT JOIN kills USING (doc_id) LEFT JOIN noted USING (doc_id) LEFT JOIN waived USING (doc_id)
"""
)
def rules_work_auth(spark: SparkSession, d: str) -> DataFrame:
    """What each document, read as a posting, asks of citizenship and clearance; those under 400 characters are snippets."""
    line = F.btrim(F.regexp_replace(posting(F.col("text")), r"\s+", " "))
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") < 400).alias("snippet"), line.alias("line"))
    return docs.select("doc_id", authorization.work_authorization(F.col("line"), F.col("snippet"), AUTHORIZATION).alias("f")).select("doc_id", "f.*")


# Requirement spans


def requirement_nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = dealt(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", posting(F.col("text")).alias("text"))
    return requirements.nodes(requirements.atoms(requirements.text_spans(docs, "doc_id", "text"), "doc_id"), "doc_id")


@query(None)
def requirement_spans(spark: SparkSession, d: str) -> DataFrame:
    """What each document, read as a posting, asks for: spans, the trees that their words make, and atoms, with places."""
    n = requirement_nodes(spark, d)
    a = F.col("atom")
    return n.select("doc_id", "span", "heading", "hint", "node", "parent", "depth", "kind", "start", "end", "quote", a["hint"].alias("own_hint"), *(a[c].alias(c) for c in ("years_min", "years_max", "scope", "level", "attainment", "or_equivalent")), F.array_join(a["fields"], " ").alias("fields"))


CANDIDATE = requirements.Profile(
    sure_months=40, touched_months=47, education=(requirements.Education("bsc", "bachelor", "awarded", "the of biology"), requirements.Education("msc", "master", "in_progress", "chemistry")),
    requires_sponsorship=True, available_from=2026 * 12 + 5, graduation=2026 * 12 + 4,
)


@query(None)
def requirement_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether one candidate meets each span, operator and atom: 0 unmet, 1 unknown, 2 met."""
    n = requirement_nodes(spark, d)
    n = n.withColumn("value", F.when(F.col("atom").isNotNull(), requirements.atom_value(F.col("atom"), CANDIDATE)))
    return requirements.evaluated(n.select("doc_id", "span", "node", "parent", "depth", "kind", "value"), ["doc_id", "span"])


@query(None)
def requirement_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of each posting with spans: flags on authorisation, whether sponsorship is a conflict, first days and graduations that
    fit, and the first spans on recent graduates and on grades."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", posting(F.col("text")).alias("text"))
    s = requirements.text_spans(docs, "doc_id", "text")
    text = F.col("text")
    begins, ends = requirements.availability(text, CANDIDATE)
    s = s.select("doc_id", "span", requirements.authorization_flags(text).alias("flags"), begins.alias("begins"), ends.alias("ends"), text.rlike(requirements.RECENT).alias("recent"), text.rlike(requirements.GRADES).alias("grades"))
    count = lambda c, field, value: F.sum(F.size(F.filter(c, lambda x: x[field] == value))).alias(value)
    kinds = [kind for kind, _ in requirements.AUTHORIZATION] + ["no_sponsorship", "sponsorship_available"]
    out = s.groupBy("doc_id").agg(F.count("*").alias("spans"), *(count("flags", "kind", k) for k in kinds), *(count("begins", "comparison", v) for v in ("compatible", "incompatible", "unknown")), F.sum(F.size("ends")).alias("graduations"), F.min(F.when(F.col("recent"), F.col("span"))).alias("recent_span"), F.min(F.when(F.col("grades"), F.col("span"))).alias("grades_span"))
    return out.withColumn("sponsorship_conflict", requirements.sponsorship_conflict(F.col("no_sponsorship") > 0, CANDIDATE))


# A tree of five levels over the star schema: a line is met, unknown or unmet; an order needs all of its lines, a customer
# any of its orders, a nation all of its customers, a region any of its nations.

_LINE = "CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN CASE WHEN l_quantity < 40 THEN 2 ELSE 1 END ELSE CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END END"


@query(f"""
WITH l AS (SELECT l_orderkey AS o, {_LINE} AS value FROM lineitem),
o AS (SELECT o_orderkey, o_custkey, min(value) AS value FROM orders JOIN l ON o = o_orderkey GROUP BY ALL),
c AS (SELECT c_custkey, c_nationkey, max(value) AS value FROM customer JOIN o ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT n_nationkey, n_regionkey, min(value) AS value FROM nation JOIN c ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT n_regionkey, max(value) AS value FROM n GROUP BY ALL)
SELECT 'order' AS level, value::INT AS value, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT 'customer', value::INT, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'nation', value::INT, count(*) FROM n GROUP BY ALL UNION ALL SELECT 'region', value::INT, count(*) FROM r GROUP BY ALL
""")
def evidence_tree(spark: SparkSession, d: str) -> DataFrame:
    """How many orders, customers, nations and regions are unmet, unknown and met."""
    t = lambda name: table(spark, d, name)
    lines = t("lineitem").select(F.concat(F.lit("l"), "l_orderkey", F.lit("."), "l_linenumber").alias("node"), F.concat(F.lit("o"), "l_orderkey").alias("parent"), F.lit("line").alias("level"), F.lit(4).alias("depth"), F.lit("leaf").alias("kind"), F.expr(_LINE).alias("value"))
    inner = lambda df, mark, key, above, parent, level, depth, kind: df.select(F.concat(F.lit(mark), key).alias("node"), F.concat(F.lit(above), parent).alias("parent"), F.lit(level).alias("level"), F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("value"))
    orders = t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    tree = lines.union(inner(orders, "o", "o_orderkey", "c", "o_custkey", "order", 3, "AND"))
    customers = t("customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    tree = tree.union(inner(customers, "c", "c_custkey", "n", "c_nationkey", "customer", 2, "OR"))
    nations = t("nation").join(customers.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    tree = tree.union(inner(nations, "n", "n_nationkey", "r", "n_regionkey", "nation", 1, "AND"))
    regions = nations.select(F.col("n_regionkey").alias("k")).distinct()
    tree = tree.union(regions.select(F.concat(F.lit("r"), "k"), F.lit(None), F.lit("region"), F.lit(0), F.lit("OR"), F.lit(None)))
    return requirements.evaluated(tree, [], 4).where("kind <> 'leaf'").groupBy("level", "value").agg(F.count("*").alias("n"))


# Education and experience

OWNER = education.Education(holds="bachelor", in_progress="master", years_kill=4)


@query(None)
def rules_education(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document, read as a posting, asks for more education or experience than one candidate has; those under 400
    characters are snippets."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text", "n_chars")).select("doc_id", posting(F.col("text")).alias("text"), (F.col("n_chars") < 400).alias("snippet"))
    return education.education(docs, "text", "snippet", OWNER).select("doc_id", "education.*")


# Shifts

SHIFT_WORDS = WORDS | {"to": "weekend", "a": "shift", "in": "night shift", "and": "Saturday", "und": "weekend", "de": "overnight", "la": "shift", "y": "no", "with": "Preferred skills:\n", "they": "Required skills:\n"}
_SHIFT_SQL = {name: p.replace("(?iU)", "(?i)") for name, p in (("weekend", shifts.WEEKEND), ("title", shifts.WEEKEND_TITLE), ("night", shifts.NIGHT))}
_SECTION = education.SECTION.replace("(?iU)", "(?i)").replace("'", "''")


@query(
    posting_sql(SHIFT_WORDS)
    + rf""", b AS (SELECT doc_id, n_chars, string_split(text, chr(10))[1] AS title, CASE WHEN contains(text, chr(10)) THEN text ELSE text || chr(10) END AS text FROM p),
l AS (SELECT doc_id, text AS t, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS x FROM b),
m AS ({" UNION ALL ".join(_sql_matches(_SHIFT_SQL[name], k) for k, name in ((0, "weekend"), (2, "night")))} UNION ALL
  SELECT * FROM ({_sql_matches(_SHIFT_SQL["title"], 1).replace("FROM l)", "FROM (SELECT doc_id, title AS t, regexp_replace(title, '[^\\x00-\\x7F]', 'x', 'g') AS x FROM b))")})),
c AS (SELECT *, substr(x, 1, s) AS head, list_last(string_split(substr(x, 1, s), chr(10))) AS line FROM m),
h AS (SELECT *, right(line, 70) AS near, list_last(list_filter(string_split(CASE WHEN length(line) = s THEN line ELSE substr(x, 1, s - length(line) - 1) END, chr(10)), lambda y: length(y) < 100 AND regexp_matches(rtrim(trim(y), ':'), '{_SECTION}'))) AS above FROM c),
g AS (SELECT *, CASE WHEN k = 1 THEN regexp_matches(near, '{_PREF}') OR (regexp_matches(head, '{_PREF}') AND NOT regexp_matches(list_last(regexp_split_to_array(head, '{_PREF}')), '{_REQ}'))
    ELSE (regexp_matches(near, '{_PREF}') AND NOT regexp_matches(list_last(regexp_split_to_array(near, '{_PREF}')) || quote, '{_REQ}')) OR coalesce(regexp_matches(above, '{_PREF}'), false) END
  OR regexp_matches(right(head, 30), '{_DENY}') OR regexp_matches(quote, '{_DENY}') AS waived FROM h),
q AS (SELECT doc_id, k, {_EXCERPT.replace("' +', ' '", "'[ \\t\\n\\r\\f\\v]+', ' '")} AS said FROM g WHERE NOT waived QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) = 1),
f AS (SELECT doc_id, n_chars < 400 AS snippet, max(said) FILTER (k = 0) AS inside, max(said) FILTER (k = 1) AS titled, max(said) FILTER (k = 2) AS night FROM b LEFT JOIN q USING (doc_id) GROUP BY ALL),
r AS (SELECT doc_id, snippet, coalesce(inside, titled) AS weekend, night, unnest(['weekdays_only', 'no_weekends', 'no_nights']) AS preference FROM f),
j AS (SELECT *, CASE WHEN preference <> 'no_nights' AND weekend IS NOT NULL THEN 'weekend' WHEN preference <> 'no_weekends' AND night IS NOT NULL THEN 'night' WHEN snippet AND weekend IS NULL AND night IS NULL THEN 'unassessed' ELSE 'clear' END AS fact FROM r)
SELECT doc_id, preference, CASE WHEN fact IN ('weekend', 'night') THEN 'kill' ELSE 'pass' END AS status, fact,
  CASE fact WHEN 'weekend' THEN 'shift preference ' || preference || ' excludes weekend work: ' || weekend WHEN 'night' THEN 'shift preference ' || preference || ' excludes night shifts: ' || night
    WHEN 'unassessed' THEN 'shift preference could not be assessed: the stored description is a truncated snippet' ELSE 'no excluded shift for preference ' || preference END AS reason
FROM j
"""
)
def rules_shift(spark: SparkSession, d: str) -> DataFrame:
    """What each document, read as a posting, says of weekends and nights, under each preference that rules anything out; those under
    400 characters are snippets."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text", (F.col("n_chars") < 400).alias("snippet")))
    lines = docs.select("doc_id", "snippet", posting(F.col("text"), SHIFT_WORDS).alias("text"))
    title = F.substring_index("text", "\n", 1)
    said = lines.select("doc_id", "snippet", shifts.stated(title, F.substr("text", F.length(title) + 2)).alias("said"))
    found = F.array(*(F.struct(F.lit(p).alias("preference"), shifts.shift(F.col("said"), F.col("snippet"), p).alias("f")) for p, out in shifts.RULED_OUT.items() if out))
    return said.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.preference", "x.f.*")


# Fit


def fit_facts(spark: SparkSession, d: str) -> DataFrame:
    """What a candidate states: the first eight words of each benchmark passage, of three kinds."""
    kind = F.element_at(F.array(F.lit("skill"), F.lit("experience"), F.lit("credential")), (F.col("item_id") % 3 + 1).cast("int"))
    words = F.split(posting(F.col("text")), " ")
    return table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("fact"), F.array_join(F.slice(words, 1, 8), " ").alias("value"), kind.alias("kind"))


def fit_contexts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, context, source, text): context 0 is the title, the others are the spans of requirements."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", posting(F.col("text")).alias("text"))
    source = F.when(F.col("span") == 0, "title").when(F.col("hint") == "preferred", "preferred").otherwise("required")
    return requirements.text_spans(docs, "doc_id", "text", title=True).select("doc_id", F.col("span").alias("context"), source.alias("source"), "text")


def fit_postings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return p.select(
        "doc_id", F.when(F.col("toxic") == 1, "kill").when(F.col("toxic") == 0, "pass").alias("verdict"), (F.col("quality") == 0).alias("unknown_facts"), F.when(n % 10 == 0, "closed").otherwise("open").alias("listing"),
        F.when(n < 400, "snippet").otherwise("full").alias("kind"), F.when(F.col("source") == "src1", "program").otherwise("job").alias("opportunity"), F.when(n % 13 != 0, n).alias("verified"),
    )


def fit_rows(spark: SparkSession, d: str, gaps: bool = True) -> DataFrame:
    return A.fitted(fit_contexts(spark, d), A.index(fit_facts(spark, d)), "doc_id", gaps)


@query(None)
def assessment(spark: SparkSession, d: str) -> DataFrame:
    """How each document, read as a posting, fits one candidate: status, what blocks it, contexts with evidence, and gaps."""
    out = A.verdicts(fit_postings(spark, d), fit_rows(spark, d), "doc_id")
    return out.withColumn("blocking", F.array_join("blocking", " "))


@query(None)
def assessment_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Where in a posting which fact is met."""
    found = fit_rows(spark, d, gaps=False).select("doc_id", "context", "source", F.explode("found").alias("f"))
    return found.select("doc_id", "context", "source", "f.start", "f.end", "f.run", "f.fact", "f.kind")


_TERMS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS t FROM benchmark"


@query(f"""
WITH RECURSIVE v AS ({_TERMS}), e AS (
  SELECT n.t AS narrow, b.t AS broad, length(b.t) > 3 AS passes FROM v n JOIN v b ON b.t = substr(n.t, 1, length(b.t)) AND length(b.t) < length(n.t) AND length(b.t) BETWEEN 2 AND 6
  UNION SELECT b.t, n.t, true FROM v n JOIN v b ON b.t = substr(n.t, 1, length(b.t)) AND length(n.t) = length(b.t) + 1 AND length(b.t) = 6),
r AS (SELECT * FROM e UNION SELECT r.narrow, e.broad, e.passes FROM r JOIN e ON r.broad = e.narrow WHERE r.passes AND r.narrow <> e.broad)
SELECT DISTINCT narrow, broad FROM r
""")
def broader_skills(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's words as skills: a word stands for those it begins with, and some of six letters for the next longer ones, so
    that there are cycles; what leads to a word of two or three letters goes no further."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("t")).distinct()
    starts = words.select(F.col("t").alias("narrow"), F.explode(F.sequence(F.lit(2), F.lit(6))).alias("n")).where(F.length("narrow") > F.col("n")).select("narrow", F.substr("narrow", F.lit(1), F.col("n")).alias("broad"))
    down = starts.join(words.withColumnRenamed("t", "broad"), "broad").select("narrow", "broad", (F.length("broad") > 3).alias("passes"))
    up = down.where((F.length("broad") == 6) & (F.length("narrow") == 7)).select(F.col("broad").alias("narrow"), F.col("narrow").alias("broad"), F.lit(True).alias("passes"))
    return A.broader(down.union(up))


# Places

#: Words of a first line that are read as parts of places.
PLACE_WORDS = {
    "the": "Remote", "of": ", MA", "and": ";", "to": ", NH", "in": ", Canada", "is": ", Texas", "that": "; 2 Locations;", "it": "United States", "for": "County", "was": ", CA", "on": "-", "with": "Office", "be": "; USA", "by": ", Rhode Island",
    "der": ", Germany", "und": ";", "die": "Remote", "de": ", MA", "la": ";", "le": ", France", "et": ";", "y": ";", "el": ", Spain", "que": ", VT",
}


def placed_postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an employer (their source and length's last digit), a title and a location: the first sixty characters of their text."""
    pairs = F.create_map(*(F.lit(x) for pair in PLACE_WORDS.items() for x in pair))
    said = F.transform(F.regexp_extract_all(F.substr(F.substring_index("text", "\n", 1), F.lit(1), F.lit(60)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(pairs, F.lower(w)), w))
    location = F.regexp_replace(F.array_join(said, ""), r"\s+,", ",")
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", (F.col("n_chars") % 10).cast("string")).alias("employer"), F.concat(F.lit("Role - "), F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit("")), F.lit(", NH")).alias("title"), F.when(F.col("n_chars") % 11 != 0, location).alias("location"))


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's words as towns, each in the states of the passages that have it."""
    codes = F.array(*map(F.lit, places.STATES))
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))))
    return table(spark, d, "benchmark").select(words.alias("name"), F.element_at(codes, (F.col("item_id") % 51 + 1).cast("int")).alias("place")).distinct()


@query(None)
def location_scope(spark: SparkSession, d: str) -> DataFrame:
    """Whether each posting's sites are in a candidate's states."""
    region = places.Region(states=(*places.NEW_ENGLAND, "CA"))
    return places.location_scope(placed_postings(spark, d), "doc_id", "employer", "title", "location", gazetteer(spark, d), region)


@query(None)
def place_facets(spark: SparkSession, d: str) -> DataFrame:
    """Postings by place: cities below states and countries, each posting once a place."""
    return places.facets(places.choices(placed_postings(spark, d), "doc_id", "location", gazetteer(spark, d)))


@query(None)
def place_filter(spark: SparkSession, d: str) -> DataFrame:
    """The postings in either of two states, or anywhere."""
    chosen = places.choices(placed_postings(spark, d), "doc_id", "location", gazetteer(spark, d))
    rows = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_set("choice")).alias("places"))
    found = entries.asked(rows, entries.Page(places=("state:MA", "state:TX", "remote")))
    return found.select("doc_id", F.array_join("places", "; ").alias("places"))


# Placeholders


def names_known(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one to three words of the benchmark's passages as names of institutions and organisations, in the order of their items."""
    words = F.split("text", " ")
    runs = F.explode(F.array(*(F.array_join(F.slice(words, start, n), " ") for start, n in ((1, 2), (2, 1), (4, 3), (9, 2), (12, 1)))))
    kind = F.when(F.col("item_id") % 2 == 0, "Institution").otherwise("Organisation")
    return table(spark, d, "benchmark").select(kind.alias("kind"), runs.alias("name"), "item_id").select("kind", F.regexp_replace("name", r"(?U)^\W+|\W+$", "").alias("name"), F.row_number().over(Window.orderBy("item_id", "name")).alias("at"))


@query(None)
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the known names replaced, and what is withheld."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text"))
    return P.scrubbed(docs, "doc_id", "text", P.named(names_known(spark, d), "at"))
