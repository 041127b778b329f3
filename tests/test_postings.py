"""Match positions, work authorisation, requirement spans and evidence: cases, and whole tables against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import matches as M
from ledgerspark.operators import authorization, education, requirements
from ledgerspark.operators.education import Education
from ledgerspark.operators.requirements import MET, UNKNOWN, UNMET
from ledgerspark.plans import catalogue, postings

D = "/root/testdata/sf0.001"


def test_matches(spark):
    texts = ["", "a1b22", "11", "é1 漢22 x", "none", None, "1", "😀12😀3", "1a" * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.matches(F.col("t"), r"\d+").alias("m")).collect()
    for r in rows:
        assert r["t"] is None and r["m"] is None or [tuple(m) for m in r["m"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", r["t"])]
    t = F.lit("a, b; c d")
    found = M.matches(t, "[a-z]")
    joined = M.islands(found, lambda a, b: M.between(t, a["end"], b["start"]).rlike("^[, ]*$"))
    got = spark.range(1).select(joined.alias("j"), M.last_piece(t, "[,;]").alias("l"), M.first_piece(t, "[,;]").alias("f"), M.before(t, F.lit(4), 3).alias("b"), M.after(t, F.lit(7)).alias("a")).first()
    assert [[m["quote"] for m in run] for run in got["j"]] == [["a", "b"], ["c", "d"]]
    assert (got["l"], got["f"], got["b"], got["a"]) == (" c d", "a", ", b", " d")
    some = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("").alias("quote")) for a, b in ((0, 3), (1, 2), (3, 4), (3, 9), (9, 10))))
    assert [tuple(x)[:2] for x in spark.range(1).select(M.apart(some)).first()[0]] == [(0, 3), (3, 4), (9, 10)]


POLICY = authorization.Authorization(
    restrictions=(r"(?iU)\bsecurity clearance\b.{0,45}\brequired\b|\bactive\b.{0,20}\bsecurity clearance\b", r"(?iU)\bgreen card\b.{0,55}\brequired\b", r"(?iU)\bITAR\b.{0,20}\brestricted\b"),
    noted=(r"(?iU)\bno sponsorship\b",), noted_label="sponsorship is limited",
)


@pytest.mark.parametrize("text, status, fact", [
    ("An active U.S. security clearance.", "kill", "restricted"),
    ("A security clearance is required.", "kill", "restricted"),
    ("No security clearance is required for this position.", "pass", "denied"),
    ("A security clearance is not required.", "pass", "denied"),
    ("A green card is not required for this role.", "pass", "denied"),
    ("This position is not ITAR-restricted.", "pass", "denied"),
    ("Ideally an active security clearance.", "pass", "preferred"),
    ("Travel is needed to succeed. Bonus Points For Advanced degree in a relevant discipline Experience at a venture-backed startup Experience selling SaaS Active U.S. security clearance", "pass", "preferred"),
    ("Bonus for a degree. " + "x" * 60 + " You must have an active security clearance", "kill", "restricted"),
    ("A bonus is paid. " + "y " * 60 + "Requirements: an active security clearance", "kill", "restricted"),
    ("No security clearance is required. A green card is required.", "kill", "restricted"),
    ("There is no sponsorship.", "pass", "noted"),
    ("Ideally a security clearance is required, " + "z" * 80 + " no green card is required", "pass", "denied"),
    ("Nothing of the kind.", "pass", "clear"), ("", "pass", "clear"), (None, "pass", "clear"),
])
def test_work_authorization(spark, text, status, fact):
    df = spark.createDataFrame([(text, None), (text, True)], "t string, snippet boolean")
    got = df.select(authorization.work_authorization(F.col("t"), F.col("snippet"), POLICY).alias("f")).select("f.*").collect()
    assert [(r["status"], r["fact"]) for r in got] == [(status, fact), (status, "unassessed" if fact == "clear" else fact)]
    assert ("could not be assessed" in got[1]["reason"]) == (fact not in ("restricted", "noted")) and "could not" not in got[0]["reason"]


def test_work_authorization_none(spark):
    got = spark.range(1).select(authorization.work_authorization(F.lit("citizens only"), F.lit(False), authorization.Authorization()).alias("f")).first()["f"]
    assert tuple(got) == ("pass", "clear", "no explicit restriction")


# --- requirement spans: a plain version by re ---


def compiled(pattern):
    return re.compile(pattern.replace("(?iU)", "").replace("(?U)", ""), re.I)


R = {name: compiled(getattr(requirements, name)) for name in ("MANDATORY", "NEGATED", "PREFERRED", "ELIGIBILITY", "REQUIREMENTS", "DUTIES", "OTHER", "HEADING_OR", "FIRM_HEADING", "EMPLOYER", "CANDIDATE", "YEARS", "YEARS_PARTS", "SCOPE", "DEGREE", "DEGREE_ENDS", "AWARDED", "EITHER", "FIELD", "FIELD_ENDS", "CREDENTIAL", "NO_CREDENTIAL", "CONNECTOR", "SENTENCE")}


def hint(text, heading=None):
    if R["MANDATORY"].search(R["NEGATED"].sub(" ", text)):
        return "required"
    if R["PREFERRED"].search(text) or R["NEGATED"].search(text) or heading and R["PREFERRED"].search(heading):
        return "preferred"
    return "required" if heading and R["FIRM_HEADING"].search(heading) else "unknown"


def plain_spans(text):
    heading, asks, duties, at = None, False, False, 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        shown = line.strip()
        label = shown.rstrip(":")
        wanted, work = all(R["REQUIREMENTS"].search(p) for p in R["HEADING_OR"].split(label)), bool(R["DUTIES"].search(label))
        if shown == requirements.BREAK or wanted or work or R["OTHER"].search(label):
            heading, asks, duties = (None if shown == requirements.BREAK else label), wanted or bool(R["PREFERRED"].search(label)) and shown.endswith(":"), work
            continue
        cue = R["MANDATORY"].search(R["NEGATED"].sub(" ", shown)) or R["ELIGIBILITY"].search(shown)
        if not shown or duties or not (asks or cue) or R["EMPLOYER"].search(shown) and not R["CANDIDATE"].search(shown):
            continue
        cuts = [(0, 0)]
        if len(line) > 400:
            for m in R["SENTENCE"].finditer(line):
                if m.end() - cuts[-1][1] >= 250:
                    cuts.append((m.start(), m.end()))
        for (_, a), (b, _) in zip(cuts, [*cuts[1:], (len(line), 0)]):
            part = line[a:b]
            if part.strip():
                yield begin + a + len(part) - len(part.lstrip()), part.strip(), heading


def number(word):
    return int(word) if word.isdigit() else requirements.NUMBER_WORDS.index(word.lower())


def plain_atoms(text):
    every = [(m.start(), m.end(), kind, m.group()) for kind in ("years", "degree", "credential") for m in R[kind.upper()].finditer(text) if kind != "credential" or not R["NO_CREDENTIAL"].search(m.group())]
    every.sort()
    out = []
    for a, b, kind, quote in every:
        if out and out[-1]["end"] > a:
            continue
        nearest = min((s for s, *_ in every if s >= b), default=None)
        own = text[b : len(text) if nearest is None else nearest]
        atom = {"start": a, "end": b, "kind": kind, "quote": quote, "hint": hint("" if nearest is not None and re.fullmatch(r"\s*plus\s*", own, re.I) else own)}
        if kind == "years":
            low, high = R["YEARS_PARTS"].search(quote).groups()
            scope = R["SCOPE"].search(text[b:])
            atom |= {"years_min": number(low), "years_max": number(high) if high else None, "scope": scope.group().strip(" ") if scope else ""}
        if kind == "degree":
            bare = re.sub("[^a-z]", "", quote.lower())
            rest = R["DEGREE_ENDS"].split(text[b:])[0]
            clause = R["DEGREE_ENDS"].split(text[:a])[-1] + quote + rest
            field = R["FIELD"].search(rest.lstrip())
            words = re.findall("[A-Za-z]+", R["FIELD_ENDS"].split(field.group(1))[0]) if field else []
            atom |= {"level": next(name for name, p in requirements.LADDER if re.search(p, bare)), "attainment": "awarded" if R["AWARDED"].search(clause) else "either" if R["EITHER"].search(clause) else "unknown", "fields": [w.lower() for w in words if w.lower() not in requirements.NO_FIELD], "or_equivalent": bool(re.search(r"\bor equivalent\b", clause, re.I))}
        out.append(atom)
    return out


def plain_tree(text, found):
    """Nested lists ["AND", ...] of atoms' numbers, or None: brackets are taken apart first, then OR, then AND."""
    if len(found) < 2:
        return None
    between = [m for m in R["PREFERRED"].finditer(text) if not (m.group().lower() == "plus" and any(a["end"] <= m.start() and m.end() <= b["start"] for a, b in zip(found, found[1:])))]
    if between and R["MANDATORY"].search(R["NEGATED"].sub(" ", text)):
        return None
    tokens, at = [], 0
    for i, a in enumerate(found):
        tokens += [t.upper() for t in R["CONNECTOR"].findall(text[at : a["start"]])] + [i]
        at = a["end"]
    tokens += [t.upper() for t in R["CONNECTOR"].findall(text[at:])]
    said = {t for t in tokens if t in ("AND", "OR")}
    if {",", ";"} & set(tokens):
        if len(said) != 1:
            return None
        tokens = [said.copy().pop() if t in (",", ";") else t for t in tokens]
    tokens = [{"WITH": "AND", "PLUS": "AND", "+": "AND", "/": "OR"}.get(t, t) for t in tokens if t != "EITHER"]

    def parse(part):
        for op in ("OR", "AND"):
            depth, pieces = 0, [[]]
            for t in part:
                depth += (t == "(") - (t == ")")
                if depth < 0:
                    raise ValueError
                if t == op and depth == 0:
                    pieces.append([])
                else:
                    pieces[-1].append(t)
            if depth:
                raise ValueError
            if len(pieces) > 1:
                first, *rest = [parse(p) for p in pieces]
                return [*first, *rest] if isinstance(first, list) and first[0] == op else [op, first, *rest]
        if len(part) == 1 and isinstance(part[0], int):
            return part[0]
        if len(part) > 2 and part[0] == "(" and part[-1] == ")":
            return parse(part[1:-1])
        raise ValueError

    try:
        out = parse(tokens)
    except ValueError:
        return None
    return out if isinstance(out, list) else None


def spelled(rows):
    """A span's tree of rows as nested lists, members in order of their places."""
    kids = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r)

    def of(r):
        below = [of(k) for k in sorted(kids.get(r["node"], []), key=lambda k: k["start"])]
        return [r["kind"], *below] if r["node"] < 0 else r["node"] - 1

    top = kids.get(0, [])
    return of(top[0]) if len(top) == 1 and top[0]["node"] < 0 else None


ATOM_FIELDS = ("years_min", "years_max", "scope", "level", "attainment", "or_equivalent")


def check_spans(texts, rows):
    by = {}
    for r in rows:
        by.setdefault((r["key"], r["span"]), []).append(r)
    seen = 0
    for key, text in texts.items():
        for i, (start, said, heading) in enumerate(plain_spans(text or ""), 1):
            some = by.pop((key, i))
            seen += len(some)
            assert all(text[r["start"] : r["end"]] == r["quote"] for r in some)
            whole = next(r for r in some if r["node"] == 0)
            assert (whole["start"], whole["quote"], whole["heading"], whole["hint"], whole["depth"]) == (start, said, heading, hint(said, heading), 0)
            found = plain_atoms(said)
            leaves = sorted((r for r in some if r["node"] > 0), key=lambda r: r["node"])
            assert [(r["start"] - start, r["end"] - start, r["kind"], r["quote"], r["atom"]["hint"]) for r in leaves] == [(a["start"], a["end"], a["kind"], a["quote"], a["hint"]) for a in found]
            for r, a in zip(leaves, found):
                assert {f: r["atom"][f] for f in ATOM_FIELDS} == {f: a.get(f) for f in ATOM_FIELDS} and r["atom"]["fields"] == a.get("fields")
            assert spelled(some) == plain_tree(said, found), said
    assert not by and seen == len(rows)


def node_rows(docs):
    out = requirements.nodes(requirements.atoms(requirements.spans(requirements.lines(docs, "key", "text"), "key"), "key"), "key")
    return out.collect()


def test_requirement_spans(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select(F.col("doc_id").alias("key"), postings.posting(F.col("text")).alias("text"))
    rows = node_rows(docs)
    check_spans({r["key"]: r["text"] for r in docs.collect()}, rows)
    assert {"AND", "OR", "years", "degree", "credential", "span"} == {r["kind"] for r in rows}
    own = postings.requirement_spans(spark, D)
    assert own.count() == len(rows)


LINES = [
    "BS and MS required", "BS or MS and 5 years", "(BS or MS) and 5 years", "BS and (MS and PhD)", "(BS and MS) and PhD", "BS, MS, or PhD", "BS, MS or PhD", "BS, MS and PhD or GED", "BS / MS with 2 years", "either BS or MS", "BS plus 5 years required", "BS required or MS preferred",
    "((BS or MS)", "BS MS", "BS) or MS", "A plus 5 years", "BS preferred", "No degree required", "five to seven years of Python, and a Bachelor's degree in computer science or equivalent experience", "Note:", "Laboratory experience", "Our platform requires Python.",
    "The team needs you to build tools.", "currently pursuing a PhD in the related field of biology & chemistry", "completed Master's degree in statistics; certification", "U.S. citizenship and a license and security clearance", "high school diploma or GED (or equivalent)", "20 years in sales; 3+ years with teams.", "must", "",
]


def test_requirement_cases(spark):
    heads = ["Required Qualifications", "Preferred:", "Requirements", "Responsibilities", "About the role", "[section break]", "Skills & Education", "Who you are:"]
    long = " ".join(f"You must hold {w} of years and a BS or MS number {w}." for w in requirements.NUMBER_WORDS)
    texts = {i: "\n".join([f"Intro {i}", h, *LINES, "  " + long + "  ", "é must é BS"]) for i, h in enumerate(heads)} | {100: None, 101: "", 102: "Requirements:\n" + long + " " + "x" * 300, 103: "\n\n"}
    docs = spark.createDataFrame(list(texts.items()), "key long, text string")
    rows = node_rows(docs)
    check_spans(texts, rows)
    said = {r["quote"] for r in rows if r["key"] == 2 and r["kind"] == "span"}
    assert "Our platform requires Python." not in said and "The team needs you to build tools." in said and "Laboratory experience" in said
    duties = {r["quote"] for r in rows if r["key"] == 3 and r["kind"] == "span"}
    assert not duties  # what one will do asks for nothing, must or not
    hints = {r["quote"]: r["hint"] for r in rows if r["key"] == 0 and r["kind"] == "span"}
    assert (hints["BS plus 5 years required"], hints["A plus 5 years"], hints["BS preferred"], hints["No degree required"], hints["Note:"]) == ("required", "preferred", "preferred", "preferred", "required")
    trees = {r["quote"]: r["span"] for r in rows if r["key"] == 2 and r["kind"] == "span"}
    tree = lambda q: spelled([r for r in rows if r["key"] == 2 and r["span"] == trees[q]])
    assert tree("BS or MS and 5 years") == ["OR", 0, ["AND", 1, 2]] and tree("(BS or MS) and 5 years") == ["AND", ["OR", 0, 1], 2] and tree("BS required or MS preferred") is None
    assert tree("BS and (MS and PhD)") == ["AND", 0, ["AND", 1, 2]] and tree("(BS and MS) and PhD") == ["AND", 0, 1, 2] and tree("BS, MS or PhD") == ["OR", 0, 1, 2] and tree("BS, MS, or PhD") is None
    assert node_rows(docs.limit(0)) == []


def test_requirement_marked(spark):
    docs = spark.createDataFrame([(1, "Duties we love\nMust sing\nQualifications\nBS")], "key long, text string")
    lines = requirements.lines(docs, "key", "text")
    got = requirements.spans(lines, "key", F.col("line") == "Duties we love").orderBy("span").collect()
    assert [(r["text"], r["heading"]) for r in got] == [("Must sing", "Duties we love"), ("BS", "Qualifications")]


def test_tree_random():
    import random

    r = random.Random(1)
    for _ in range(3000):
        tokens = [r.choice(["AND", "OR", "(", ")", "0"]) if r.random() < 0.3 else None for _ in range(r.randrange(1, 12))]
        n = 0
        for i, t in enumerate(tokens):
            if t in (None, "0"):
                tokens[i] = str(n) if i % 2 == 0 or t == "0" else r.choice(["AND", "OR"])
                n += tokens[i].isdigit()
        got = requirements.tree(tokens)
        # Python's own grammar decides what an expression is
        try:
            ok = bool(tokens) and eval(" ".join({"AND": "and", "OR": "or"}.get(t, t) for t in tokens)) is not None and "( )" not in " ".join(tokens) and not re.search(r"\d+ \(|\) \(|\) \d", " ".join(tokens))
        except (SyntaxError, TypeError):
            ok = False
        assert (got is not None) == (ok and any(t in ("AND", "OR") for t in tokens)), tokens


# --- evidence ---


def test_degree_lattice(spark):
    rows = spark.createDataFrame([(level, ["biology", "law"]) for level in requirements.RANK], "level string, fields array<string>")
    profile = requirements.Profile(education=(requirements.Education("b", "bachelor", field="molecular Biology"), requirements.Education("m", "master", "in_progress"), requirements.Education("x", "doctorate", confirmed=False), requirements.Education("y", "doctorate", withheld=True)))
    of = lambda p: {r["level"]: r["e"] for r in rows.select("level", requirements.degree_evidence(F.col("level"), F.col("fields"), p).alias("e")).collect()}
    got = of(profile)
    assert {k: (e["awarded"], e["in_progress"]) for k, e in got.items()} == {"high_school": (["b"], ["m"]), "associate": (["b"], ["m"]), "bachelor": (["b"], ["m"]), "master": ([], ["m"]), "doctorate": ([], [])}
    assert [tuple(o) for o in got["bachelor"]["overlap"]] == [("b", "biology"), ("m", "none")]
    assert not profile.education_known and requirements.Profile().education_known
    assert of(requirements.Profile(education=profile.education, kill_completed=True))["bachelor"]["awarded"] == []


def test_authorization_flags(spark):
    cases = {"U.S. person or green card": ["citizenship_required", "permanent_residency_required"], "security clearance": ["clearance_required"], "subject to ITAR": ["export_control"], "authorized to work": ["authorization_required"], "No visa sponsorship": ["no_sponsorship"], "sponsorship is not available": ["no_sponsorship"], "not here; sponsorship": ["sponsorship_available"], "we sponsor": ["sponsorship_available"], "": []}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", requirements.authorization_flags(F.col("t")).alias("f")).collect()
    assert {r["t"]: [f["kind"] for f in r["f"]] for r in rows} == cases
    conflict = lambda no, p: spark.range(1).select(requirements.sponsorship_conflict(F.lit(no), p)).first()[0]
    needs, not_, open_ = requirements.Profile(requires_sponsorship=True), requirements.Profile(requires_sponsorship=False), requirements.Profile()
    assert [conflict(True, needs), conflict(True, not_), conflict(True, open_), conflict(False, open_)] == [True, False, None, False]


def test_availability(spark):
    p = requirements.Profile(available_from=2026 * 12 + 5, available_until=2026 * 12 + 8, graduation=2026 * 12 + 4)
    cases = {"starting June 2026": "compatible", "start in May 2026": "incompatible", "available from 2026-09": "compatible", "begin 2026-10": "incompatible", "starting 2026-06-15": "unknown", "graduating by May 2026": "compatible", "graduated in 2026-04": "incompatible", "nothing": None}
    text = F.col("t")
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    both = lambda profile: {r["t"]: ([*r["b"], *r["e"]] or [{"comparison": None}])[0]["comparison"] for r in rows.select("t", requirements.availability(text, profile)[0].alias("b"), requirements.availability(text, profile)[1].alias("e")).collect()}
    assert both(p) == cases
    assert set(both(requirements.Profile()).values()) == {"unknown", None}


def test_evaluated(spark):
    """Three values under AND and OR, a span of one atom, of several without a tree, and of none."""
    rows = []
    for a in (UNMET, UNKNOWN, MET):
        for b in (UNMET, UNKNOWN, MET):
            for op in ("AND", "OR"):
                k = f"{op}{a}{b}"
                rows += [(k, 0, None, 0, "span", None), (k, -1, 0, 1, op, None), (k, 1, -1, 2, "years", a), (k, 2, -1, 2, "years", b)]
    rows += [("one", 0, None, 0, "span", None), ("one", 1, 0, 1, "years", UNMET), ("none", 0, None, 0, "span", None), ("two", 0, None, 0, "span", None), ("two", 1, 0, 1, "years", MET), ("two", 2, 0, 1, "years", MET)]
    rows += [("deep", 0, None, 0, "span", None), ("deep", -1, 0, 1, "AND", None), ("deep", -2, -1, 2, "OR", None), ("deep", 1, -1, 2, "years", MET), ("deep", 2, -2, 3, "years", UNMET), ("deep", 3, -2, 3, "years", UNKNOWN)]
    df = spark.createDataFrame(rows, "key string, node int, parent int, depth int, kind string, value int")
    got = {r["key"]: r["value"] for r in requirements.evaluated(df, ["key"]).where("node = 0").collect()}
    want = {f"{op}{a}{b}": (min if op == "AND" else max)(a, b) for op in ("AND", "OR") for a in (UNMET, UNKNOWN, MET) for b in (UNMET, UNKNOWN, MET)}
    assert got == want | {"one": UNMET, "none": UNKNOWN, "two": UNKNOWN, "deep": UNKNOWN}
    assert requirements.evaluated(df, ["key"]).count() == len(rows) and requirements.evaluated(df.limit(0), ["key"]).count() == 0


def test_requirement_verdicts(spark):
    """Each span's value from the plain version's tree and the profile's months and degrees."""
    p, rank = postings.CANDIDATE, requirements.RANK

    def value(a):
        if a["kind"] == "years":
            return MET if 12 * a["years_min"] <= p.sure_months else UNMET if 12 * a["years_min"] > p.touched_months else UNKNOWN
        if a["kind"] == "credential":
            return UNKNOWN
        has = {e.status for e in p.education if rank[e.level] >= rank[a["level"]]}
        return MET if "awarded" in has else UNKNOWN if has or a["or_equivalent"] else UNMET

    def of(tree, found):
        return value(found[tree]) if isinstance(tree, int) else (min if tree[0] == "AND" else max)(of(t, found) for t in tree[1:])

    texts = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", postings.posting(F.col("text")).alias("text")).collect()
    want = {}
    for r in texts:
        for i, (_, said, _) in enumerate(plain_spans(r["text"] or ""), 1):
            found = plain_atoms(said)
            tree = plain_tree(said, found)
            want[r["doc_id"], i] = of(tree, found) if tree else value(found[0]) if len(found) == 1 else UNKNOWN
    got = {(r["doc_id"], r["span"]): r["value"] for r in postings.requirement_verdicts(spark, D).where("node = 0").collect()}
    assert got == want and set(want.values()) == {UNMET, UNKNOWN, MET}


# --- education ---

S, H, HP, D_, N, Y = Education(kill_completed=True, years_kill=3), Education(holds="bachelor", years_kill=3), Education(holds="bachelor", in_progress="master"), Education(holds="doctorate"), Education(), Education(years_kill=2)
EDUCATION = [
    (S,"Currently pursuing a bachelor's degree.","pass"),(S,"Bachelor's degree preferred, not required.","pass"),(S,"Two years of laboratory experience.","pass"),
    (S,"The ideal candidate may have up to 5 years of experience.","pass"),
    (S,"Technician I (L3): 1+ years of hands-on instrument maintenance experience\nTechnician II (L4): 3+ years of hands-on instrument maintenance experience, with","pass"),
    (S,"Required 1-5+ years of laboratory experience","pass"),(S,"Required 5-10+ years of laboratory experience","kill"),
    (S,"Requirements: 4 years of collective IT experience, with 2 years of direct support experience.","kill"),
    (S,"We hire people who enjoy a BS in Biology. 2 years of laboratory experience.","pass"),
    (S,"Nice to have: a BS in Biology. 2 years of laboratory experience.","pass"),
    (S,"A bachelor's degree is a plus. 1 year of laboratory experience.","pass"),
    (S,"You do not need a PhD to succeed here. Qualifications: curiosity.","pass"),
    (S,"We will consider applicants without a bachelor's degree. Requirements: attention to detail.","pass"),
    (HP,"Requirements: Bachelor's degree in Marketing.","degree_met"),(HP,"Requirements: Master's degree in Marketing.","degree_unplaced"),(HP,"Requirements: PhD in Marketing.","kill"),
    (H,"Requirements: Master's degree in Marketing.","kill"),(H,"Requirements: Bachelor's or Master's degree in Marketing.","degree_met"),
    (H,"You hold a degree (BSc, MSc or PhD) in Computer Science.","degree_met"),(H,"Requirements: a degree in a related field.","degree_unplaced"),
    (D_,"Requirements: PhD in Chemistry.","degree_met"),
    (H,"Requirements: Master's degree with 2 years of experience.","kill"),(H,"Requirements: Bachelor's degree with 2 years of experience.","met"),(H,"Requirements: Bachelor's or Master's degree with 2 years of experience.","met"),
    (S,"Requirements: Bachelor's or Master's degree in Marketing.","kill"),
    (S,"Requirements: Master's degree or equivalent experience.","optional_degree"),(S,"Requirements: a Master's degree or the equivalent.","optional_degree"),(S,"Qualifications: Master's degree, or equivalent combination of education and experience.","optional_degree"),(S,"Requirements: Bachelor's degree or equivalent work history.","optional_degree"),
    (S,"QUALIFICATIONS Bachelor's degree in Business, Finance, Accounting, Economics or equivalent area","kill"),(S,"Qualifications Required MD, MD/PhD, or equivalent medical degree with board certification","kill"),(S,"Requirements: Master's degree in Marketing or equivalent field.","kill"),
    (S,"Requirements: a Master's degree in Marketing. Five years of agency work or equivalent.","kill"),
    (H,"Requirements: PhD in Chemistry. Qualifications: Bachelor's degree or equivalent in Biology.","optional_degree"),(S,"Requirements: PhD in Chemistry. Qualifications: Bachelor's degree or equivalent in Biology.","kill"),
    (S,"A Bachelor's degree is preferred. Requirements: attention to detail.","optional_degree"),(S,"A Master's degree in Marketing is strongly preferred.","optional_degree"),(S,"Requirements: a Bachelor's degree (strongly preferred) in Marketing.","optional_degree"),(S,"Requirements: a Bachelor's degree (preferred).","optional_degree"),
    (S,"Bachelor's degree required, Salesforce experience a plus.","kill"),(S,"Requirements: a Master's degree in Marketing. Familiarity with SEO is a plus.","kill"),(S,"Qualifications: BS degree in a technical discipline (Engineering preferred) 10+ years' experience leading maintenance personnel.","kill"),(S,"Requirements: a Master's degree (Chemistry preferred) in a science.","kill"),
    (S,"Experience with MS Office is required.","clear"),(N,"Requirements: PhD","unconfigured"),
    (Y,"<2 years of relevant experience required","met"),(Y,"with over 25 years of experience in business","clear"),(Y,"2 years of experience or 1 year of lab experience","met"),
    (S,"Requirements:\nPhD in a related discipline with 0-2 years of postdoctoral or industry experience","kill"),
    (Education(kill_completed=True,student="undergraduate"),"Currently enrolled in a Master's program in Biology","enrolment"),(Education(kill_completed=True),"Pursuing a PhD","enroll_unknown"),(Education(kill_completed=True,student="undergraduate"),"You will be enrolled in a Master's program","enroll_unknown"),
    (Education(kill_completed=True,student="graduate"),"Currently enrolled in a Master's program","optional_degree"),
]


@pytest.mark.parametrize("rules", dict.fromkeys(r for r, _, _ in EDUCATION), ids=str)
def test_education(spark, rules):
    """What a text asks for and how it says so; the last of each case is how it is found, or a fact."""
    cases = [(i, t, w) for i, (r, t, w) in enumerate(EDUCATION) if r == rules]
    df = spark.createDataFrame([(i, t, False) for i, t, _ in cases], "i int, t string, s boolean")
    got = {r["i"]: r["education"] for r in education.education(df, "t", "s", rules).collect()}
    assert [w if w in (got[i]["status"], got[i]["fact"]) else tuple(got[i]) for i, _, w in cases] == [w for _, _, w in cases]


def test_education_reasons(spark):
    text = "Requirements: Master's degree with 2 years of experience."
    df = spark.createDataFrame([(text, False), ("Nothing", True), (None, None), ("Required: 1 year of lab experience or 9 years of field experience", False)], "t string, s boolean")
    got = [tuple(r["education"]) for r in education.education(df, "t", "s", H).collect()]
    assert got[0][2] == "requires a completed master's degree above the bachelor's degree the Profile states the Owner holds alongside 2 years of experience, and no stated alternative asks for less: 'Requirements: Master's degree with 2 years of experience.'"
    assert got[1][:2] == ("pass", "unassessed") and "could not be assessed" in got[1][2] and got[2] == ("pass", "clear", "no completed-degree requirement above the bachelor's degree the Profile states the Owner holds or 3+ year experience minimum") and got[3][1] == "met"


def test_education_years(spark):
    """Over a whole table, minima alone: joined ones count as their largest, and the least of all requirements decides."""
    rules = Education(years_kill=4)
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", postings.posting(F.col("text")).alias("t"), F.lit(False).alias("s"))
    got = {r["doc_id"]: r["education"]["status"] for r in education.education(docs, "t", "s", rules).collect()}
    joined = docs.select("doc_id", "t", education.minima(F.col("t"), education.sections(F.col("t")), rules).alias("m")).collect()
    p = {n: compiled(getattr(education, n)) for n in ("JOINED", "ALTERNATIVE")}
    want, several = {}, 0
    for r in joined:
        groups = []
        for m in r["m"]:
            gap = r["t"][groups[-1][-1]["end"] : m["start"]] if groups else None
            if gap is not None and len(gap) <= 40 and p["JOINED"].search(gap) and not p["ALTERNATIVE"].search(gap):
                groups[-1].append(m)
            else:
                groups.append([m])
        several += len(groups) > 1
        want[r["doc_id"]] = "kill" if groups and min(max(m["years"] for m in g) for g in groups) >= 4 else "pass"
    assert got == want and set(want.values()) == {"kill", "pass"} and several > 5


def test_rules_education_stays_native(spark):
    plan = postings.rules_education(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_registered():
    assert {"rules_education", "rules_work_auth", "requirement_spans", "requirement_verdicts", "requirement_evidence", "evidence_tree"} <= set(catalogue.QUERIES)
