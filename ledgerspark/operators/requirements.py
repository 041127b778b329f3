"""Requirements in a posting's text as rows of trees, and what evidence says of them.

A text's lines under a heading of requirements, or with wording that obliges, are spans; in a span, years, degrees and
credentials are atoms, and the words between them may join them to a tree of AND and OR. Everything is Columns, windows
and joins, but for the walk down a text's lines and the tree of one span, which small functions in Arrow batches make.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import matches as M
from ledgerspark.sources.scratch import stored

#: Wording that obliges, denies and prefers.
MANDATORY = r"(?iU)\b(?:required|must|minimum|need(?:s)?|at least)\b"
NEGATED = r"(?iU)\b(?:not required|no\b.{0,40}?\brequired|need not)\b"
PREFERRED = r"(?iU)\b(?:preferred|desired|nice to have|bonus|plus|optional)\b"
ELIGIBILITY = r"(?iU)\bemployment\b[^.]{0,60}\bcontingent\b|\bonly\b.{0,200}\beligible for (?:this|the) (?:position|role)\b"
#: Headings of requirements, of duties and of other sections, and the mark of a break between sections.
REQUIREMENTS = (
    r"(?iU)^(?:(?:basic|required|minimum|essential|preferred|desired)\s+)?(?:requirements?|qualifications?|skills?|education|"
    r"experience|licen[cs]es?|certifications?|what you(?:'ll| will) bring|what we(?:'re| are) looking for|"
    r"who you are|about you|what you(?:'ll| will) need(?: to succeed)?)\s*:??$"
)
DUTIES = (
    r"(?iU)^(?:(?:key|main|your|essential)\s+)?(?:responsibilities|duties|what you(?:'ll| will) (?:do|be (?:doing|building))|your (?:role|impact))\s*$|"
    r"^(?:primary|core|job|position|additional)\s+(?:responsibilities|duties)$"
)
OTHER = r"(?iU)^(?:about (?:the role|us|the company)|position summary|pay (?:and|&) benefits|privacy notice)$"
BREAK = "[section break]"
HEADING_OR = r"(?iU)\s*(?:/|&|\band\b)\s*"
#: White space of all scripts, as (?U)\s has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FIRM_HEADING = r"(?iU)\b(?:basic|required|minimum|essential)\b"
#: Sentences on what the employer itself uses, unless they speak of candidates.
EMPLOYER = (
    r"(?iU)^(?:our\s+(?:company|team|platform|product|organization|mission)|we\b|the\s+(?:company|team|platform|product|organization)\b)\b.*"
    r"\b(?:use|uses|build|builds|built|develop|develops|deploy|deploys|operate|operates|run|runs|power|powers|rely|relies|focus|focuses|focused|requires?)\b"
)
CANDIDATE = (
    r"(?iU)\b(?:candidate|applicant|you|experience|skills?|proficien(?:cy|t)|knowledge|ability|qualifications?|familiarity|coursework|"
    r"certificat(?:e|ion)|license|clearance)\b"
)
#: Atoms. What a number, a degree and a credential look like, the ladder of degrees, and what ends a degree's clause.
NUMBER_WORDS = tuple("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())
_NUMBER = r"\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
YEARS = rf"(?iU)\b(?:{_NUMBER})(?:\s*(?:-|–|—|to)\s*(?:{_NUMBER}))?\s*\+?\s*years?\b"
YEARS_PARTS = rf"(?iU)^({_NUMBER})(?:\s*(?:-|–|—|to)\s*({_NUMBER}))?"
SCOPE = r"(?iU)^\s*(?:of|in|with)\s+[^.;,()]{1,90}"
DEGREE = (
    r"(?iU)(?<!\w)(?:high school(?: diploma)?|GED|associate(?:'s)?(?: degree)?|A\.?A\.?S?\.?|bachelor(?:'s)?(?: degree)?|B\.?S\.?c?\.?|B\.?A\.?|BEng|"
    r"master(?:'s)?(?: degree)?|M\.?S\.?c?\.?|M\.?A\.?|MBA|MPH|doctorate|doctoral(?: degree)?|Ph\.?D\.?|DPhil|PharmD|MD|JD)(?!\w)"
)
LADDER = (("high_school", r"^(?:highschool|ged)"), ("associate", r"^(?:associate|aa)"), ("bachelor", r"^(?:bachelor|bs|ba|beng)"), ("master", r"^(?:master|ms|ma|mba|mph)"), ("doctorate", r""))
DEGREE_ENDS = r"(?iU)[;()]|\b(?:and|plus)\b|\bor\b(?!\s+equivalent\b)"
AWARDED = r"(?iU)\b(?:completed|conferred|earned|hold|holds|degree in hand)\b"
EITHER = r"(?iU)\b(?:pursuing|enrolled|working toward|candidate|current student|in progress)\b"
FIELD = r"(?iU)^(?:in|of)\s+([A-Za-z][A-Za-z /&-]{1,90})"
FIELD_ENDS = r"(?iU)\b(?:required|preferred|or|and|with|plus|experience|degree|years?|certification|license)\b"
NO_FIELD = ("a", "an", "the", "related")
CREDENTIAL = r"(?iU)\b(?:certificat(?:e|ion)|licen[cs]e|security clearance|export.control|U\.?S\.? persons?|citizenship|work authori[sz]ation)\b"
NO_CREDENTIAL = r"(?iU)citizenship|persons?|authori[sz]ation|export.control"
CONNECTOR = r"(?iU)\b(?:and|or|with|plus|either)\b|[/+(),;]"
#: Spans are cut at sentence ends where a line is longer than the first, each part of the second at least; and limits of a posting.
LONG_LINE, LEAST_PART, SENTENCE = 400, 250, r"(?<=[.!?])\s+"
MOST_CHARS, MOST_SPANS, MOST_ATOMS = 48_000, 40, 100

ATOM = "struct<start:int,end:int,kind:string,quote:string>"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, start, line) of each line of docs' texts, in code points; a null text has none. One key is one text."""
    each = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(key, "no", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("int").alias("start"), "line")


def spans(each: DataFrame, key: str, marked: Column | None = None) -> DataFrame:
    """(key, span, start, end, text, heading, hint) of lines (key, no, start, line): what a posting asks for, numbered in order.

    A heading says what section its lines belong to until the next one; marked says which lines are headings by their
    markup. hint is required, preferred or unknown. Empty lines, lines on duties and on the employer's own tools are no
    spans; a line of more than LONG_LINE characters is parted at sentence ends. text_spans does the same from whole texts.
    """
    shown = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    label = F.rtrim(shown, F.lit(":"))
    asks = F.forall(F.split(label, HEADING_OR, -1), lambda p: p.rlike(REQUIREMENTS))
    duties = label.rlike(DUTIES)
    heading = (shown == BREAK) | asks | duties | label.rlike(OTHER) | F.coalesce(F.lit(False) if marked is None else marked, F.lit(False))
    section = F.struct(F.when(shown != BREAK, label).alias("heading"), (asks | (label.rlike(PREFERRED) & shown.endswith(":"))).alias("asks"), duties.alias("duties"))
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = each.withColumns({"shown": shown, "is_heading": heading, "section": F.when(heading, section)}).withColumn("section", F.last("section", True).over(w))
    obliges = F.regexp_replace("shown", NEGATED, " ").rlike(MANDATORY) | F.col("shown").rlike(ELIGIBILITY)
    own = F.col("shown").rlike(EMPLOYER) & ~F.col("shown").rlike(CANDIDATE)
    rows = rows.where(~F.col("is_heading") & (F.col("shown") != "") & ~F.coalesce("section.duties", F.lit(False)) & (F.coalesce("section.asks", F.lit(False)) | obliges) & ~own)
    rows = rows.select(key, "no", "start", "line", "section.heading", F.explode(_parts(F.col("line"))).alias("part"))
    # without the white space at its ends
    text = M.between(F.col("line"), F.col("part.start"), F.col("part.end"))
    lead = F.length(F.regexp_extract(text, r"(?U)^\s*", 0))
    rows = rows.select(key, "heading", (F.col("start") + F.col("part.start") + lead).alias("start"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")
    rows = rows.withColumn("span", F.row_number().over(Window.partitionBy(key).orderBy("start")))
    return rows.select(key, "span", "start", (F.col("start") + F.length("text")).alias("end"), "text", "heading", hint(F.col("text"), F.col("heading")).alias("hint"))


def _compiled(pattern: str) -> re.Pattern:
    """One of the patterns above, for what _plain makes of a text."""
    return re.compile(pattern.removeprefix("(?iU)"), re.I)


_PATTERNS = {name: _compiled(globals()[name]) for name in ("MANDATORY", "NEGATED", "PREFERRED", "ELIGIBILITY", "REQUIREMENTS", "DUTIES", "OTHER", "HEADING_OR", "FIRM_HEADING", "EMPLOYER", "CANDIDATE")}
_SENTENCE = re.compile(SENTENCE, re.ASCII)
#: What a text that a pattern matches holds, in lower case, or begins with: looked for first, as that is far cheaper.
_HELD = {"MANDATORY": ("required", "must", "minimum", "need", "at least"), "NEGATED": ("required", "need not"), "PREFERRED": ("preferred", "desired", "nice to have", "bonus", "plus", "optional"), "ELIGIBILITY": ("contingent", "eligible for")}
_BEGUN = {
    "REQUIREMENTS": ("basic", "required", "minimum", "essential", "preferred", "desired", "requirement", "qualification", "skill", "education", "experience", "licen", "certification", "what", "who", "about"),
    "DUTIES": ("key", "main", "your", "essential", "responsibilities", "duties", "what", "primary", "core", "job", "position", "additional"), "OTHER": ("about", "position", "pay", "privacy"), "EMPLOYER": ("our", "we", "the"),
}

_HEADINGS_BEGIN = (*_BEGUN["REQUIREMENTS"], *_BEGUN["DUTIES"], *_BEGUN["OTHER"], BREAK)


def _word(c: str) -> bool:
    """Whether a character is one of Java's (?U)\\w."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or any(a <= c <= b for a, b in ("Ⓐⓩ", "🄰🅉", "🅐🅩", "🅰🆉"))


class _Alike(dict):
    """Of characters that Java's patterns take otherwise than Python's, others that Python takes as Java takes these; the rest as they are."""

    def __missing__(self, i: int) -> str:
        c = chr(i)
        same = _word(c) == (c.isalnum() or c == "_")
        new = "\n" if c in "\r\x85\u2028\u2029" else "\0" if 0x1C <= i < 0x20 else c if same else "_" if _word(c) else "\0"
        self[i] = new
        return new


_ALIKE = _Alike()
#: Characters that may be taken otherwise; most texts have none.
_OTHERWISE = re.compile("[^\t\n\x0b\f -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u02c1\u2010-\u2027]")


def _plain(text: str) -> str:
    return text.translate(_ALIKE) if _OTHERWISE.search(text) else text


class _Read:
    """A text that patterns are asked of, each after the words that it needs."""

    def __init__(self, text: str) -> None:
        self.raw, self.low = text, text.lower()
        if not text.isascii():  # letters that patterns in any case take for s and i
            self.low = self.low.replace("\u017f", "s").replace("\u0131", "i").replace("i\u0307", "i")

    @cached_property
    def text(self) -> str:
        return _plain(self.raw)

    def has(self, name: str) -> bool:
        if name in _BEGUN:
            return self.low.startswith(_BEGUN[name]) and _PATTERNS[name].search(self.text) is not None
        for w in _HELD.get(name, ("",)):
            if w in self.low:
                return _PATTERNS[name].search(self.text) is not None
        return False

    def asks(self) -> bool:
        """Whether a label is a heading of requirements."""
        return self.low.startswith(_BEGUN["REQUIREMENTS"]) and all(_PATTERNS["REQUIREMENTS"].search(p) for p in _PATTERNS["HEADING_OR"].split(self.text))

    def obliges(self) -> bool:
        return self.has("MANDATORY") and (not self.has("NEGATED") or bool(_PATTERNS["MANDATORY"].search(_PATTERNS["NEGATED"].sub(" ", self.text))))


def _hint(read: _Read, obliges: bool, heading: str | None) -> str:
    """hint, of one text."""
    if obliges:
        return "required"
    if read.has("PREFERRED") or read.has("NEGATED") or heading is not None and _Read(heading).has("PREFERRED"):
        return "preferred"
    return "required" if heading is not None and _PATTERNS["FIRM_HEADING"].search(_plain(heading)) else "unknown"


def _walked(text: str) -> Iterator[tuple[int, str, str | None, str]]:
    """The (start, text, heading, hint) of a text's spans."""
    heading, asks, duties, at = None, False, False, 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        if not (shown := line.strip(WHITE)):
            continue
        read = _Read(shown)
        if read.low.startswith(_HEADINGS_BEGIN):
            label = shown.rstrip(":")
            named = read if label == shown else _Read(label)
            wanted, work = named.asks(), named.has("DUTIES")
            if wanted or work or shown == BREAK or named.has("OTHER"):
                heading, asks, duties = None if shown == BREAK else label, wanted or shown.endswith(":") and named.has("PREFERRED"), work
                continue
        if duties or not ((obliges := read.obliges()) or asks or read.has("ELIGIBILITY")) or read.has("EMPLOYER") and not read.has("CANDIDATE"):
            continue
        if len(line) <= LONG_LINE:
            yield begin + line.index(shown), shown, heading, _hint(read, obliges, heading)
            continue
        cut = 0
        for a, e in (*((m.start(), m.end()) for m in _SENTENCE.finditer(line)), (len(line), cut + len(line) + LEAST_PART)):
            if e - cut >= LEAST_PART:
                part, begins, cut = line[cut:a], cut, e
                if said := part.strip(WHITE):
                    read = _Read(said)
                    yield begin + begins + part.index(said), said, heading, _hint(read, read.obliges(), heading)


def text_spans(docs: DataFrame, key: str, text: str, title: bool = False) -> DataFrame:
    """The spans of docs' texts, as spans(lines(docs)) has them, without a shuffle: Arrow batches walk down the lines of a text. With
    title, span 0 is a text's first line as it stands, without a hint; that of a null text is null."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [key, "span", "start", "text", "heading", "hint"])

        for batch in batches:
            at, rows = [], []
            for i, said in enumerate(batch.column(1)):
                said = said.as_py()
                if title:
                    rows.append((0, 0, said and said.partition("\n")[0], None, None))
                if said is not None:
                    rows += [(n, *r) for n, r in enumerate(_walked(said), 1)]
                at += [i] * (len(rows) - len(at))
                if len(rows) >= M.RUNS:
                    yield flush()
                    at, rows = [], []
            yield flush()

    rows = docs.select(key, text).mapInArrow(walk, f"`{key}` {docs.schema[key].dataType.simpleString()}, span int, start int, text string, heading string, hint string")
    return rows.select(key, "span", "start", (F.col("start") + F.length("text")).alias("end"), "text", "heading", "hint")


def _parts(line: Column) -> Column:
    """The (start, end) that a line is parted into: itself, or at sentence ends behind LEAST_PART characters or more."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(line).alias("end")))

    def parted(so_far: Column, m: Column) -> Column:
        return F.when(m["end"] - so_far["at"] >= LEAST_PART, F.struct(m["end"].alias("at"), F.concat(so_far["parts"], F.array(F.struct(so_far["at"].alias("start"), m["start"].alias("end")))).alias("parts"))).otherwise(so_far)

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("parts"))
    cut = F.aggregate(M.matches(line, SENTENCE), none, parted, lambda a: F.concat(a["parts"], F.array(F.struct(a["at"].alias("start"), F.length(line).alias("end")))))
    return F.when(F.length(line) > LONG_LINE, cut).otherwise(whole)


def hint(text: Column, heading: Column) -> Column:
    """How binding a text is: by what obliges in it, else what prefers or denies or a heading that does, else a heading that obliges."""
    return (
        F.when(text.rlike(MANDATORY) & F.regexp_replace(text, NEGATED, " ").rlike(MANDATORY), "required")
        .when(text.rlike(PREFERRED) | text.rlike(NEGATED) | F.coalesce(heading.rlike(PREFERRED), F.lit(False)), "preferred")
        .when(F.coalesce(heading.rlike(FIRM_HEADING), F.lit(False)), "required").otherwise("unknown")
    )


def number(word: Column) -> Column:
    """A number in digits or words; null for anything else."""
    place = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(word)).cast("int")
    return F.when(place > 0, place - 1).otherwise(word.try_cast("int"))


def atoms(spans_: DataFrame, key: str) -> DataFrame:
    """spans with atoms: an array of (start, end, kind, quote, hint and what the kind has), places as in the posting.

    Of atoms that overlap, the first one stays. An atom's own hint is what stands between it and the next one. Years have
    years_min, years_max and scope; degrees level, attainment, fields and or_equivalent.
    """
    text = F.col("text")
    found = lambda pattern, kind: F.transform(M.matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["quote"].alias("quote")))
    credentials = F.filter(found(CREDENTIAL, "credential"), lambda m: ~m["quote"].rlike(NO_CREDENTIAL))
    every = F.sort_array(F.concat(found(YEARS, "years"), found(DEGREE, "degree"), credentials))

    def described(a: Column, starts: Column) -> Column:
        # lambdas evaluate what they name each time it is named, so parts are let once
        nearest = F.array_min(F.filter(starts, lambda s: s >= a["end"]))
        return M.let(F.struct(M.after(text, a["end"]).alias("tail"), nearest.alias("nearest")), lambda x: M.let(M.between(text, a["end"], F.coalesce(x["nearest"], F.length(text))), lambda own: read(a, x["tail"], F.when(own.rlike(r"(?iU)^\s*plus\s*$") & x["nearest"].isNotNull(), "").otherwise(own))))

    def degree(a: Column, tail: Column) -> Column:
        bare = F.regexp_replace(F.lower(a["quote"]), "[^a-z]", "")

        def named(b: Column) -> Column:
            level = F.lit(None).cast("string")
            for name, pattern in reversed(LADDER):
                level = F.when(b.rlike(pattern), name).otherwise(level) if pattern else F.lit(name)
            return level

        def clause(c: Column, rest: Column) -> Column:
            field = M.first_piece(F.regexp_extract(F.regexp_replace(rest, r"(?U)^\s+", ""), FIELD, 1), FIELD_ENDS)
            fields = F.filter(F.transform(F.regexp_extract_all(field, F.lit("[A-Za-z]+"), F.lit(0)), F.lower), lambda w: ~w.isin(*NO_FIELD))
            attainment = F.when(c.rlike(AWARDED), "awarded").when(c.rlike(EITHER), "either").otherwise("unknown")
            return F.struct(M.let(bare, named).alias("level"), attainment.alias("attainment"), fields.alias("fields"), c.rlike(r"(?iU)\bor equivalent\b").alias("or_equivalent"))

        return M.let(M.first_piece(tail, DEGREE_ENDS), lambda rest: M.let(F.concat(M.last_piece(M.before(text, a["start"]), DEGREE_ENDS), a["quote"], rest), lambda c: clause(c, rest)))

    def read(a: Column, tail: Column, own: Column) -> Column:
        is_years = a["kind"] == "years"
        low, high = number(F.regexp_extract(a["quote"], YEARS_PARTS, 1)), number(F.regexp_extract(a["quote"], YEARS_PARTS, 2))
        return M.let(F.when(a["kind"] == "degree", degree(a, tail)), lambda g: F.struct(
            (F.col("start") + a["start"]).alias("start"), (F.col("start") + a["end"]).alias("end"), a["kind"].alias("kind"), a["quote"].alias("quote"), M.let(own, lambda o: hint(o, F.lit(None).cast("string"))).alias("hint"),
            F.when(is_years, low).alias("years_min"), F.when(is_years, high).alias("years_max"), F.when(is_years, F.btrim(F.regexp_extract(tail, SCOPE, 0))).alias("scope"),
            g["level"].alias("level"), g["attainment"].alias("attainment"), g["fields"].alias("fields"), g["or_equivalent"].alias("or_equivalent"),
        ))

    described_all = lambda all_: M.let(F.transform(all_, lambda o: o["start"]), lambda starts: F.transform(M.apart(all_, ATOM), lambda a: described(a, starts)))
    return spans_.withColumn("atoms", M.let(every, described_all))


def _tokens(text: Column, kept: Column, start: Column) -> Column:
    """What joins a span's atoms, in order: the number of each atom and the connectors between them, in capitals; null where
    the span obliges and prefers at once, or where commas stand beside no connector, or two, that say what they mean."""
    said = lambda gap: F.transform(F.regexp_extract_all(gap, F.lit(CONNECTOR), F.lit(0)), F.upper)
    place = lambda i, at: F.get(kept, i)[at] - start
    ends = lambda i: F.when(i == 0, 0).otherwise(place(i - 1, "end"))
    every = F.sequence(F.lit(0), F.size(kept) - 1)
    tokens = F.flatten(F.transform(every, lambda i: F.concat(said(M.between(text, ends(i), place(i, "start"))), F.array(i.cast("string")))))
    tokens = F.concat(tokens, said(M.after(text, place(F.size(kept) - 1, "end"))))
    # a plus between two atoms joins them and prefers nothing
    joins = lambda m: (F.lower(m["quote"]) == "plus") & F.exists(F.sequence(F.lit(1), F.size(kept) - 1), lambda i: (ends(i) <= m["start"]) & (m["end"] <= place(i, "start")))
    mixed = F.regexp_replace(text, NEGATED, " ").rlike(MANDATORY) & F.exists(M.matches(text, PREFERRED), lambda m: ~joins(m))
    explicit = F.array_intersect(tokens, F.array(F.lit("AND"), F.lit("OR")))
    commas = F.exists(tokens, lambda t: t.isin(",", ";"))
    plain = F.filter(F.transform(tokens, lambda t: F.when(t.isin(",", ";"), F.get(explicit, F.lit(0))).when(t.isin("WITH", "PLUS", "+"), "AND").when(t == "/", "OR").otherwise(t)), lambda t: t != "EITHER")
    return F.when((F.size(kept) > 1) & ~mixed & ~(commas & (F.size(explicit) != 1)), plain)


def tree(tokens: list[str]) -> list[tuple[str, list]] | None:
    """The operators (AND or OR, members) of an expression; a member is an atom's number, or an operator's as text, like "n0". AND binds tighter; a run of one operator is one. None for what is no expression."""
    nodes: list[tuple[str, list]] = []
    values: list = []
    waiting: list[str] = []
    rank = {"(": 0, "OR": 1, "AND": 2}

    def join() -> None:
        op, right, left = waiting.pop(), values.pop(), values.pop()
        if isinstance(left, str) and nodes[int(left[1:])][0] == op:
            nodes[int(left[1:])][1].append(right)
            values.append(left)
        else:
            values.append(f"n{len(nodes)}")
            nodes.append((op, [left, right]))

    wants = True  # an atom or a bracket that opens
    for t in tokens:
        if wants and t == "(":
            waiting.append(t)
        elif wants and t.isdigit():
            values.append(int(t))
            wants = False
        elif not wants and t in ("AND", "OR"):
            while waiting and rank[waiting[-1]] >= rank[t]:
                join()
            waiting.append(t)
            wants = True
        elif not wants and t == ")":
            while waiting and waiting[-1] != "(":
                join()
            if not waiting:
                return None
            waiting.pop()
        else:
            return None
    if wants or "(" in waiting:
        return None
    while waiting:
        join()
    return nodes or None


_OPS = pa.list_(pa.struct([("op", pa.string()), ("parent", pa.int32()), ("depth", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
_LEAVES = pa.list_(pa.struct([("parent", pa.int32()), ("depth", pa.int32())]))


def _placed(tokens: list[str] | None, n_atoms: int) -> tuple[list[dict], list[dict]]:
    """Of a span's tree: each operator with what holds it, its depth and its first and last atom; and what holds each atom.
    Operators are -1, -2, ..., the span is 0."""
    made = tree(tokens) if tokens else None
    leaves = [{"parent": 0, "depth": 1} for _ in range(n_atoms)]
    ops = [{} for _ in made or ()]

    def place(i: int, parent: int, depth: int) -> tuple[int, int]:
        op, members = made[i]
        ends = []
        for m in members:
            if isinstance(m, str):
                ends.append(place(int(m[1:]), -1 - i, depth + 1))
            else:
                leaves[m] = {"parent": -1 - i, "depth": depth + 1}
                ends.append((m, m))
        ops[i] = {"op": op, "parent": parent, "depth": depth, "first": min(a for a, _ in ends), "last": max(b for _, b in ends)}
        return ops[i]["first"], ops[i]["last"]

    if made:
        held = {int(m[1:]) for _, members in made for m in members if isinstance(m, str)}
        place(next(i for i in range(len(made)) if i not in held), 0, 1)
    return ops, leaves


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before tokens, and ops and leaves instead of it."""
    for batch in batches:
        placed = [_placed(t.as_py(), len(a)) for t, a in zip(batch.column("tokens"), batch.column("atoms"))]
        kept = [n for n in batch.schema.names if n != "tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array([o for o, _ in placed], _OPS), pa.array([x for _, x in placed], _LEAVES)], [*kept, "ops", "leaves"])


def nodes(with_atoms: DataFrame, key: str) -> DataFrame:
    """(key, span, heading, hint, node, parent, depth, kind, start, end, quote, atom): rows of trees, of spans with atoms.

    The span itself is node 0 at depth 0 and has no parent; operators are nodes below 0, atoms from 1 on. Where a span's
    atoms are no tree, they hang on the span. start and end are places in the posting; those of an operator go from its
    first atom to its last.
    """
    rows = with_atoms.withColumn("tokens", _tokens(F.col("text"), F.col("atoms"), F.col("start")))
    kept = [c for c in rows.columns if c != "tokens"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_atoms.schema)
    rows = rows.select(*kept, "tokens").mapInArrow(_trees, f"{kinds}, ops array<struct<op:string,parent:int,depth:int,first:int,last:int>>, leaves array<struct<parent:int,depth:int>>")
    none = F.lit(None).cast(with_atoms.schema["atoms"].dataType.elementType)

    def node(n: Column, parent: Column, depth: Column, kind: Column, start: Column, end: Column, atom: Column = none) -> Column:
        quote = M.between(F.col("text"), start - F.col("start"), end - F.col("start"))
        return F.struct(n.alias("node"), parent.cast("int").alias("parent"), depth.alias("depth"), kind.alias("kind"), start.alias("start"), end.alias("end"), quote.alias("quote"), atom.alias("atom"))

    whole = node(F.lit(0), F.lit(None), F.lit(0), F.lit("span"), F.col("start"), F.col("end"))
    ops = F.transform("ops", lambda o, i: node(-1 - i, o["parent"], o["depth"], o["op"], F.get("atoms", o["first"])["start"], F.get("atoms", o["last"])["end"]))
    leaves = F.transform("atoms", lambda a, i: node(i + 1, F.get("leaves", i)["parent"], F.get("leaves", i)["depth"], a["kind"], a["start"], a["end"], a))
    return rows.select(key, "span", "heading", "hint", F.explode(F.concat(F.array(whole), ops, leaves)).alias("n")).select(key, "span", "heading", "hint", "n.*")


# Evidence

RANK = {name: i for i, (name, _) in enumerate(LADDER)}
#: What a span asks of authorisation, and how far before and after a word on sponsorship a denial is read.
AUTHORIZATION = (
    ("citizenship_required", r"(?iU)\b(?:citizenship|citizen|U\.?S\.? person)\b"), ("permanent_residency_required", r"(?iU)\b(?:permanent resident|permanent residency|green card)\b"),
    ("clearance_required", r"(?iU)\b(?:security clearance|clearance)\b"), ("export_control", r"(?iU)\b(?:export.control(?:led)?|ITAR|EAR)\b"),
    ("authorization_required", r"(?iU)\b(?:work authori[sz]ation|authorized to work)\b"),
)
SPONSOR, NO_BEFORE, NO_AFTER, SPONSOR_BEFORE, SPONSOR_AFTER = r"(?iU)\bsponsor(?:ship)?\b", r"(?iU)\b(?:no|without|not|unable to|cannot|won't)\b", r"(?iU)\b(?:unavailable|not available)\b", 38, 22
#: When one starts or graduates, the months' names, and wording on recent graduates and on grades.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = r"\d{4}-\d{2}(?:-\d{2})?|(?:" + "|".join(MONTHS) + r")\s+\d{4}"
START = rf"(?iU)\b(?:start(?:ing)?|available|begin(?:ning)?)\s+(?:on|in|by|from)?\s*(?:{_MONTH})"
GRADUATION = rf"(?iU)\bgraduat(?:e|ed|ing|ion)\s+(?:by|in|on|before)?\s*(?:{_MONTH})"
RECENT = r"(?iU)graduated within|recent graduate|within the last\s+\w+\s+years|class of\s+\d{4}|graduating in\s+\d{4}"
GRADES = r"(?iU)\bGPA\b|grade point"


@dataclass(frozen=True)
class Education:
    id: str
    level: str
    status: str = "awarded"
    field: str = ""
    confirmed: bool = True
    withheld: bool = False


@dataclass(frozen=True)
class Profile:
    """What is known of a candidate. Months of experience are a range: those sure, and those touched at all; months of
    availability and graduation are year * 12 + month - 1, None where unknown."""

    sure_months: int = 0
    touched_months: int = 0
    experience_known: bool = True
    education: tuple[Education, ...] = ()
    kill_completed: bool = False
    requires_sponsorship: bool | None = None
    available_from: int | None = None
    available_until: int | None = None
    graduation: int | None = None

    @property
    def education_known(self) -> bool:
        """Whether what is not in education can be taken as not there."""
        return all(e.confirmed and not e.withheld and e.level in RANK and e.status != "unknown" for e in self.education)


def degree_evidence(level: Column, fields: Column, profile: Profile) -> Column:
    """(awarded, in_progress, overlap) for a degree that is asked for: the entries at its level or above, and each one's first
    field of those asked for, or none."""
    kind = "array<struct<id:string,rank:int,status:string,words:array<string>>>"
    held = [F.struct(F.lit(e.id).alias("id"), F.lit(RANK[e.level]).alias("rank"), F.lit(e.status).alias("status"), F.array(*(F.lit(w) for w in e.field.lower().split())).cast("array<string>").alias("words")) for e in profile.education if e.confirmed and not e.withheld and e.level in RANK]
    asked = F.try_element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), level)
    fit = F.filter(F.array(*held).cast(kind), lambda e: e["rank"] >= asked)
    ids = lambda status: F.transform(F.filter(fit, lambda e: e["status"] == status), lambda e: e["id"])
    awarded = F.array().cast("array<string>") if profile.kill_completed else ids("awarded")
    overlap = F.transform(fit, lambda e: F.struct(e["id"].alias("id"), F.coalesce(F.get(F.array_intersect(fields, e["words"]), F.lit(0)), F.lit("none")).alias("field")))
    return F.struct(awarded.alias("awarded"), ids("in_progress").alias("in_progress"), overlap.alias("overlap"))


def authorization_flags(text: Column) -> Column:
    """(kind, quote) of what a span says of authorisation, kind by kind; sponsorship is no_sponsorship where it is denied."""
    flag = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["quote"].alias("quote"))
    flags = [F.transform(M.matches(text, p), flag(kind)) for kind, p in AUTHORIZATION]

    def sponsor(m: Column) -> Column:
        no = M.last_piece(M.before(text, m["start"], SPONSOR_BEFORE), "[.;:]").rlike(NO_BEFORE) | M.after(text, m["end"], SPONSOR_AFTER).rlike(NO_AFTER)
        return F.struct(F.when(no, "no_sponsorship").otherwise("sponsorship_available").alias("kind"), m["quote"].alias("quote"))

    return F.concat(*flags, F.transform(M.matches(text, SPONSOR), sponsor))


def sponsorship_conflict(no_sponsorship: Column, profile: Profile) -> Column:
    """Whether no sponsorship is offered to one who needs it; null where that is not known and matters."""
    if profile.requires_sponsorship is None:
        return F.when(~no_sponsorship, F.lit(False))
    return no_sponsorship & F.lit(profile.requires_sponsorship)


def clauses(text: Column, pattern: str, compatible) -> Column:
    """(quote, comparison) of each date of START or GRADUATION: compatible(month) decides, null being unknown. Days are not compared."""

    def of(m: Column) -> Column:
        said = F.lower(F.regexp_extract(m["quote"], rf"(?i)({_MONTH})$", 1))
        named = F.regexp_extract(said, r"(\d{4})$", 1).try_cast("int") * 12 + F.array_position(F.array(*(F.lit(x) for x in MONTHS)), F.regexp_extract(said, r"^([a-z]+)", 1)).cast("int") - 1
        iso = F.regexp_extract(said, r"^(\d{4})-", 1).try_cast("int") * 12 + F.regexp_extract(said, r"-(\d{2})$", 1).try_cast("int") - 1
        month = F.when(said.rlike(r"^\d{4}-\d{2}$"), iso).when(said.rlike("^[a-z]"), named)
        fits = compatible(month)
        return F.struct(m["quote"].alias("quote"), F.when(fits, "compatible").when(~fits, "incompatible").otherwise("unknown").alias("comparison"))

    return F.transform(M.matches(text, pattern), of)


def availability(text: Column, profile: Profile) -> tuple[Column, Column]:
    """The clauses on first days and on graduations, against the months that the profile has."""
    unknown = lambda month: F.lit(None).cast("boolean")
    begins = unknown if profile.available_from is None else lambda month: (month >= profile.available_from) & (month <= (2**31 - 1 if profile.available_until is None else profile.available_until))
    ends = unknown if profile.graduation is None else lambda month: month >= profile.graduation
    return clauses(text, START, begins), clauses(text, GRADUATION, ends)


#: What an atom or a tree is: they go up, so that AND is the least of its members and OR the greatest.
UNMET, UNKNOWN, MET = 0, 1, 2


def atom_value(atom: Column, profile: Profile) -> Column:
    """UNMET, UNKNOWN or MET: years by months of experience, degrees by entries at their level or above, credentials unknown.
    What is not there is unmet only where the profile is known to be whole."""
    asked = atom["years_min"] * 12
    years = F.when(asked <= profile.sure_months, MET).when((asked > profile.touched_months) & F.lit(profile.experience_known), UNMET).otherwise(UNKNOWN)
    has = degree_evidence(atom["level"], atom["fields"], profile)
    degree = F.when(F.size(has["awarded"]) > 0, MET).when((F.size(has["in_progress"]) > 0) | ~F.lit(profile.education_known) | atom["or_equivalent"], UNKNOWN).otherwise(UNMET)
    return F.when(atom["kind"] == "years", years).when(atom["kind"] == "degree", degree).otherwise(UNKNOWN)


def evaluated(tree_: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """Rows of trees (keys, node, parent, depth, kind, value) with all values: leaves have theirs, AND is the least of its members,
    OR the greatest, and any other inner node has its only member's value, or UNKNOWN where it has several or none.

    One aggregate and one join a level, from the deepest up, each level written once; depth is the deepest level, else it
    is counted.
    """
    rows = stored(tree_)
    deepest = rows.agg(F.max("depth")).first()[0] if depth is None else depth
    levels: list[DataFrame] = []
    for level in range(deepest or 0, -1, -1):
        now = rows.where(F.col("depth") == level)
        if levels:
            below = levels[-1].groupBy(*keys, F.col("parent").alias("node")).agg(F.min("value").alias("__least"), F.max("value").alias("__most"), F.count("*").alias("__n"))
            folded = F.when(F.col("kind") == "AND", F.col("__least")).when(F.col("kind") == "OR", F.col("__most")).when(F.col("__n") == 1, F.col("__least"))
            now = now.join(below, [*keys, "node"], "left").withColumn("value", F.coalesce("value", folded, F.lit(UNKNOWN))).select(*tree_.columns)
        levels.append(stored(now))
    return reduce(DataFrame.union, levels)
