"""How a posting fits a candidate: facts matched by an inverted index of their words, clauses that no fact covers, and a verdict.

Contexts are texts of a posting (its title, what it requires, prefers or describes). A fact's variants, runs of its words,
are rows; a context's runs of words meet them in a table that each task holds, where a candidate's variants are few enough
for that, and else in one equi-join on the run, so that neither facts nor variants are tried one by one. Of matches that
overlap, the first and longest one stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import matches as M
from ledgerspark.functions.questions import variants
from ledgerspark.sources.scratch import stored

#: What parts words, and words that no variant begins with or consists of alone.
WORD = r"(?U)[\p{L}\p{N}+#]+(?:[-.'’][\p{L}\p{N}+#]+)*"
STOP = tuple("a an and as at be by for from in of on or the to with degree degrees field fields".split())
GENERIC = ("intern", "internship", "assistant", "associate", "entry level", "hands-on", "full-time", "part-time", "e.g", "i.e")
#: Kinds of facts whose runs of words are variants; of others only the whole and terms of TOOLS are.
WHOLE_RUNS = ("skill", "coursework", "degree", "role", "project", "credential")
LONGEST = 4
#: What denies a fact, and where a denial ends; clauses, and what asks for a credential.
DENIED = r"(?iU)\b(?:no|not(?!\s+only)|never|without|lack\w*|observed|watch\w*|shadow\w*|didn['’]?t|doesn['’]?t|don['’]?t|isn['’]?t|aren['’]?t|can(?:not|'t)|unable)\b"
DENIAL_ENDS = (
    r"(?iU)[.;!?]|\b(?:but|however|except|rather than)\b|(?:\b(?:and|or)\b|,)\s*(?:\b(?:and|or)\b\s*)?(?:i\s+)?"
    r"(?:built|build|developed|develop|implemented|implement|wrote|write|maintained|maintain|coded|code)\b"
)
NEXT_PHRASE = r"(?iU)[.,;!?]|\b(?:and|or|but|however|except)\b"
CLAUSES = r"(?iU)\s+(?:(?!and/or\b)and|as well as)\s+|,\s+(?:and\s+)?"
CREDENTIAL = r"(?iU)\b(?:certificat(?:e|ion)|licen[cs]e|security clearance|export.control|U\.?S\.? persons?|citizenship|work authori[sz]ation)\b"
TENURE = r"(?iU)\b(?:\d+(?:\.\d+)?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\+?\s+(?:years?|months?)\b"

#: The most variants that a task holds; beyond that contexts and variants are joined.
MOST_HELD = 50_000
#: WORD, CLAUSES and Java's \s for a text without underscores, and white space of all scripts.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORD, _PARTS = re.compile(r"[\w+#]+(?:[-.'’][\w+#]+)*"), re.compile(r"([\w+#]+(?:[-.'’][\w+#]+)*)")
_CLAUSES = re.compile(rf"{_WHITE}+(?:and|as well as){_WHITE}+|,{_WHITE}+(?:and{_WHITE}+)?", re.I)
_GAP, _SPACED, _ODD = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"[\t\n\x0b\f\r]|  "), re.compile("[\u0130\u03a3]")

FOUND = "struct<start:int,less:int,end:int,run:string,fact:string,kind:string>"


def asserted(value: Column, start: Column, end: Column) -> Column:
    """Whether a fact states what stands at [start, end) of it: no denial before it reaches that far, and none follows in its phrase."""

    def denies(m: Column) -> Column:
        ahead = (m["end"] <= start) & ~M.between(value, m["end"], start).rlike(DENIAL_ENDS)
        behind = (m["start"] >= end) & ~M.between(value, end, m["start"]).rlike(NEXT_PHRASE)
        return ahead | behind

    return ~F.exists(M.matches(value, DENIED), denies)


def index(facts: DataFrame, tools: tuple[str, ...] = ()) -> DataFrame:
    """(run, n, fact, kind) of facts (fact, value, kind): the variants that a fact states, of n words, each once a fact.

    Variants are a fact's whole text, runs of two to LONGEST of its words without stop words, and tools among its words; the
    runs only for kinds in WHOLE_RUNS. What the fact denies, or does not have side by side, is none.
    """
    value = F.col("value")
    words = F.filter(F.transform(M.matches(value, WORD), lambda m: F.lower(m["quote"])), lambda w: ~w.isin(*STOP))
    whole = F.btrim(F.lower(F.regexp_replace("value", r"\s+", " ")), F.lit(" ."))
    none = F.array().cast("array<string>")
    runs = F.concat(F.array(whole), F.when(F.col("kind").isin(*WHOLE_RUNS), variants(words, LONGEST)).otherwise(none), F.filter(words, lambda w: w.isin(*tools)) if tools else none)
    rows = facts.withColumn("run", F.explode(F.array_distinct(F.filter(runs, lambda v: ((F.length(v) >= 2) | (v == "r")) & ~v.isin(*STOP, *GENERIC)))))
    pattern = F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}+#])\Q"), F.replace("run", F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E(?![\p{L}\p{N}+#])"))
    rows = rows.withColumn("__q", F.regexp_substr(value, pattern)).where("__q is not null")
    at = F.position("__q", "value") - 1
    rows = rows.where(asserted(value, at, at + F.length("__q")))
    return rows.select("run", F.size(F.regexp_extract_all("run", F.lit(WORD), F.lit(0))).alias("n"), "fact", "kind").where("n > 0")


def matched(contexts: DataFrame, index_: DataFrame, key: str) -> DataFrame:
    """(key, context, found) of contexts (key, context, text): for each the (start, less, end, run, fact, kind) of facts' variants in it,
    in order and apart: of overlapping ones the first and longest, and of facts with one variant the least.

    Only runs as long as some variant are made: how many words variants have is a short list, a fact's text being short.
    """
    facts = stored(index_.groupBy("run", "n").agg(F.min(F.struct("fact", "kind")).alias("f")))
    lengths = sorted(r["n"] for r in facts.select("n").distinct().collect())
    # as they stand in the text but in lower case, with one space for each gap
    runs = M.runs(contexts, [key, "context"], "text", WORD, lengths).withColumn("run", F.lower(F.regexp_replace("run", r"\s+", " ")))
    hits = runs.join(facts.drop("n"), "run").select(key, "context", F.struct("start", (-F.col("end")).alias("less"), "end", "run", "f.fact", "f.kind").alias("hit"))
    return hits.groupBy(key, "context").agg(F.sort_array(F.collect_list("hit")).alias("found")).select(key, "context", M.apart(F.col("found"), FOUND).alias("found"))


def clauses(text: Column) -> Column:
    """The (start, end, quote) of a context's clauses."""

    def of(cuts: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda m: m["end"]))
        ends = F.concat(F.transform(cuts, lambda m: m["start"]), F.array(F.length(text)))
        return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), M.between(text, a, b).alias("quote")))

    return F.filter(M.let(M.matches(text, CLAUSES), of), lambda c: F.btrim(c["quote"]) != "")


def assessed(contexts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """contexts (key, context, source, text) with found, evidence and gaps: whether a fact matches in it, and the clauses that none covers.

    A context that asks for a credential counts as evidence for credentials alone.
    """
    none = F.array().cast(f"array<{FOUND}>")
    rows = contexts.join(found.withColumnRenamed(key, "__k").withColumnRenamed("context", "__c"), (F.col(key) == F.col("__k")) & (F.col("context") == F.col("__c")), "left").drop("__k", "__c")
    rows = rows.withColumn("found", F.coalesce("found", none))
    covers = lambda c: F.exists("found", lambda f: F.greatest(f["start"], c["start"]) < F.least(f["end"], c["end"]))
    return _evident(rows.withColumn("gaps", F.transform(F.filter(clauses(F.col("text")), lambda c: ~covers(c)), lambda c: F.btrim(c["quote"]))))


def _evident(rows: DataFrame) -> DataFrame:
    counts = lambda f: ~F.col("asks_credential") | (f["kind"] == "credential")
    return rows.withColumn("asks_credential", F.col("text").rlike(CREDENTIAL)).withColumn("evidence", F.exists("found", counts))


class _Held:
    """Variants in a worker's memory: (run, n, fact, kind), tried where a text has their first two words, the longest first."""

    def __init__(self, variants_: list[tuple[str, int, str, str]]) -> None:
        self.facts: dict[str, tuple] = {}
        lengths: dict[tuple[str, str], set[int]] = {}
        self.single: set[str] = set()
        for run, _, fact, kind in sorted(variants_, key=lambda v: [(x is not None, x or "") for x in v[2:]], reverse=True):
            low = run.lower()
            if words := _WORD.findall(low.replace("_", " ")):
                self.facts[low] = (run, fact, kind)
                if len(words) > 1:
                    lengths.setdefault((words[0], words[1]), set()).add(len(words))
                else:
                    self.single.add(words[0])
        self.pairs = {w: sorted(n, reverse=True) for w, n in lengths.items()}
        self.lengths = sorted({n for _, n, *_ in variants_}, reverse=True)

    def found(self, text: str) -> list[tuple]:
        """The FOUND of a text."""
        low = text.lower()
        if odd := _ODD.search(text):  # a letter that becomes two marks, which part words otherwise, or one that becomes what those around it make of it
            at = [m.span() for m in _WORD.finditer(text.replace("_", " "))]
            tried = [(i, self.lengths) for i in range(len(at))]
        else:
            parts = _PARTS.split(low.replace("_", " "))
            words = parts[1::2]
            tried = [(i, self.pairs.get(p, ())) for i, p in enumerate(zip(words, [*words[1:], ""])) if p in self.pairs or p[0] in self.single]
            if not tried:
                return []
            ends = list(accumulate(map(len, parts)))
            at = list(zip(ends[::2], ends[1::2]))
        spaced = _SPACED.search(text)
        out, begin = [], 0
        for i, lengths in tried:
            start = at[i][0]
            if start < begin:
                continue
            for n in (*lengths, 1):
                if i + n > len(at):
                    continue
                end = at[i + n - 1][1]
                quote = text[start:end].lower() if odd else low[start:end]
                if fact := self.facts.get(_GAP.sub(" ", quote) if spaced else quote):
                    out.append((start, -end, end, *fact))
                    begin = end
                    break
        return out


def _gaps(text: str, found: list[tuple]) -> list[str]:
    """A text's clauses that none of found covers."""
    out, begin = [], 0
    for end, after in (*(m.span() for m in _CLAUSES.finditer(text)), (len(text), 0)):
        if (said := text[begin:end].strip(" ")) and not any(max(f[0], begin) < min(f[2], end) for f in found):
            out.append(said)
        begin = after
    return out


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("less", pa.int32()), ("end", pa.int32()), ("run", pa.string()), ("fact", pa.string()), ("kind", pa.string())]))


def fitted(contexts: DataFrame, index_: DataFrame, key: str, gaps: bool = True) -> DataFrame:
    """assessed(contexts, matched(contexts, index_)) in one pass over contexts, without a shuffle of their texts, where variants are
    at most MOST_HELD; without gaps there are none to know of."""
    held = index_.groupBy("run", "n").agg(F.min(F.struct("fact", "kind")).alias("f")).select("run", "n", "f.*").limit(MOST_HELD + 1).collect()
    if len(held) > MOST_HELD:
        return assessed(contexts, matched(contexts, index_, key), key)
    known = [tuple(r) for r in held]
    names = [f.name for f in _FOUND.value_type]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = _Held(known)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [facts.found(t) if t else [] for t in texts]
            missing = [None if t is None else _gaps(t, f) for t, f in zip(texts, found)] if gaps else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[dict(zip(names, f)) for f in fs] for fs in found], _FOUND), pa.array(missing, pa.list_(pa.string()))], [*batch.schema.names, "found", "gaps"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contexts.schema)
    return _evident(contexts.mapInArrow(read, f"{kinds}, found array<{FOUND}>, gaps array<string>"))


def verdicts(postings: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, status, blocking, evidence, gaps) of postings (key, verdict, unknown_facts, listing, kind, opportunity, verified): one row each.

    unassessed without a decision, not_suitable where it kills or the listing is closed, needs_review where no fact matches or
    anything blocks, else suitable. blocking says what does, in the order of the alphabet; gaps are the clauses of required
    and preferred contexts that no fact covers, how many.
    """
    required = F.col("source") == "required"
    seen = rows.groupBy(key).agg(
        F.max((F.size("found") > 0)).alias("any"), F.max(required & F.col("evidence")).alias("some"), F.count_if(F.size("found") > 0).alias("evidence"),
        F.sum(F.when(F.col("source").isin("required", "preferred"), F.size("gaps")).otherwise(0)).alias("gaps"),
        F.max(required & F.col("asks_credential") & (~F.exists("found", lambda f: f["kind"] == "credential") | F.exists("gaps", lambda g: g.rlike(CREDENTIAL)))).alias("credential"),
    )
    p = postings.join(seen.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "left").drop("__k")
    no = F.lit(False)
    blocks = {
        "credential": F.coalesce("credential", no), "decision": F.col("verdict").isNull() | F.coalesce("unknown_facts", no), "description_kind": ~F.coalesce(F.col("kind") == "full", no),
        "last_verified_at": F.col("verified").isNull(), "listing_status": ~F.coalesce(F.col("listing").isin("open", "closed"), no), "opportunity_type": ~F.coalesce(F.col("opportunity") == "job", no), "requirement_evidence": ~F.coalesce("some", no),
    }
    blocking = F.array_compact(F.array(*(F.when(c, name) for name, c in blocks.items())))
    excluded = F.coalesce((F.col("verdict") == "kill") | (F.col("listing") == "closed"), no)
    status = F.when(excluded, "not_suitable").when(F.col("verdict").isNull(), "unassessed").when(~F.coalesce("any", no) | (F.size(blocking) > 0), "needs_review").otherwise("suitable")
    zero = F.lit(0).cast("long")
    return p.select(key, status.alias("status"), F.when(~excluded, blocking).otherwise(F.array().cast("array<string>")).alias("blocking"), F.coalesce("evidence", zero).alias("evidence"), F.coalesce("gaps", zero).alias("gaps"))


def broader(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(narrow, broad) of all terms that a term stands for by edges (narrow, broad, passes), over any number of them.

    A relation goes one way. An edge that does not pass on (one of tenure or a credential) holds by itself and as the last of
    others, but nothing goes on from it. Cycles end, a term is not broader than itself, and beyond most_rounds it raises.
    Each round is one join of what the last one found with the edges; a pair is known apart by whether it passes on, and what
    is known is written once.
    """
    kinds = ["narrow", "broad", "passes"]
    e = stored(edges.where("narrow <> broad").select(*kinds).distinct())
    known, new = [e], e
    for _ in range(most_rounds):
        onward = new.where("passes").select("narrow", F.col("broad").alias("via"))
        step = onward.join(e.withColumnRenamed("narrow", "via"), "via").where("narrow <> broad").select(*kinds).distinct()
        every = reduce(DataFrame.union, known)
        fresh = stored(step.join(every, kinds, "left_anti"))
        if fresh.isEmpty():
            return every.select("narrow", "broad").distinct()
        known.append(fresh)
        new = fresh
    raise RuntimeError(f"the relation has not settled in {most_rounds} rounds")


def plain(context: Column, term: str, framing: tuple[str, ...]) -> Column:
    """Whether a context asks for a term without more: no tenure and no credential in it, and a clause that holds the term and
    otherwise only framing words."""
    rest = lambda c: F.regexp_extract_all(F.lower(F.regexp_replace(c["quote"], rf"(?iU)\b(?:{term})\b", " ")), F.lit(r"(?U)[\w+#]+"), F.lit(0))
    bare = lambda c: c["quote"].rlike(rf"(?iU)\b(?:{term})\b") & F.forall(rest(c), lambda w: w.isin(*framing))
    return ~context.rlike(TENURE) & ~context.rlike(CREDENTIAL) & F.exists(clauses(context), bare)
