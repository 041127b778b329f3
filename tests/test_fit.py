"""Facts in postings, gaps, verdicts and the broader relation: cases, and a whole table against loops over all facts."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import assessment as A
from ledgerspark.plans import postings

D = "/root/testdata/sf0.001"


def compiled(pattern):
    return re.compile(pattern.replace("(?iU)", "").replace("(?U)", ""), re.I)


WORD = re.compile(r"(?:[^\W_]|[+#])+(?:[-.'’](?:[^\W_]|[+#])+)*")


def asserted(value, start, end):
    for m in compiled(A.DENIED).finditer(value):
        if m.end() <= start and not compiled(A.DENIAL_ENDS).search(value[m.end() : start]):
            return False
        if m.start() >= end and not compiled(A.NEXT_PHRASE).search(value[end : m.start()]):
            return False
    return True


def plain_index(facts, tools=()):
    out = set()
    for fact, value, kind in facts:
        words = [w.lower() for w in WORD.findall(value) if w.lower() not in A.STOP]
        runs = {re.sub(r"\s+", " ", value).lower().strip(" .")} | {w for w in words if w in tools}
        if kind in A.WHOLE_RUNS:
            runs |= {" ".join(words[i : i + n]) for n in (2, 3, 4) for i in range(len(words) - n + 1)}
        for run in runs:
            m = re.search(r"(?<![^\W_+#])(?<![+#])" + r"\s+".join(map(re.escape, run.split(" "))) + r"(?![^\W_]|[+#])", value, re.I) if run else None
            if m and (len(run) >= 2 or run == "r") and run not in A.STOP + A.GENERIC and WORD.search(run) and asserted(value, *m.span()):
                out.add((run, len(WORD.findall(run)), fact, kind))
    return out


def plain_found(text, index):
    best = {}
    for run, n, fact, kind in index:
        best[run, n] = min(best.get((run, n), ("~", "")), (fact, kind))
    words = list(WORD.finditer(text))
    hits = []
    for (run, n), (fact, kind) in best.items():
        for i in range(len(words) - n + 1):
            a, b = words[i].start(), words[i + n - 1].end()
            if re.sub(r"\s+", " ", text[a:b]).lower() == run:
                hits.append((a, -b, b, run, fact, kind))
    out = []
    for h in sorted(hits):
        if not out or out[-1][2] <= h[0]:
            out.append(h)
    return out


def plain_gaps(text, found):
    cuts = list(compiled(A.CLAUSES).finditer(text))
    begins, ends = [0, *(m.end() for m in cuts)], [*(m.start() for m in cuts), len(text)]
    return [text[a:b].strip(" ") for a, b in zip(begins, ends) if text[a:b].strip(" ") and not any(max(a, f[0]) < min(b, f[2]) for f in found)]


FACTS = [
    ("1", "Python", "skill"), ("2", "machine learning and data analysis", "skill"), ("3", "Observed CRISPR, but built RNA pipelines", "skill"), ("4", "No experience with deep learning", "skill"), ("5", "Led a team that used Docker and wrote reports.", "experience"),
    ("6", "not only Java but Kotlin coroutines", "skill"), ("7", "RN license", "credential"), ("8", "of the", "skill"), ("9", "C++, C#", "skill"), ("a", "Python", "skill"), ("b", "R", "skill"), ("c", "intern", "role"),
]


def test_index(spark):
    df = spark.createDataFrame(FACTS, "fact string, value string, kind string")
    got = {tuple(r) for r in A.index(df, ("docker",)).collect()}
    assert got == plain_index(FACTS, ("docker",))
    runs = {r[0] for r in got}
    assert {"python", "machine learning", "rna pipelines", "docker", "rn license", "kotlin coroutines", "r", "c++, c#"} <= runs
    assert not {"crispr", "deep learning", "intern", "learning data", "built rna pipelines crispr"} & runs


def test_matches_and_gaps(spark):
    texts = ["Python and machine  learning, data analysis", "python python", "Machine learning and\nC++, C#", "", "cython pythonic", "RN license or R", "machine, learning", None]
    contexts = spark.createDataFrame([(1, i, "required", t) for i, t in enumerate(texts)], "key long, context int, source string, text string")
    index = A.index(spark.createDataFrame(FACTS, "fact string, value string, kind string"))
    plain = plain_index(FACTS)
    rows = {r["context"]: r for r in A.assessed(contexts, A.matched(contexts, index, "key"), "key").collect()}
    for i, t in enumerate(texts):
        found = plain_found(t or "", plain)
        assert [tuple(f) for f in rows[i]["found"]] == found
        assert (rows[i]["gaps"] or []) == plain_gaps(t or "", found)
    assert [f["run"] for f in rows[0]["found"]] == ["python", "machine learning", "data analysis"] and rows[0]["gaps"] == [] and rows[4]["gaps"] == ["cython pythonic"]
    assert rows[0]["found"][0]["fact"] == "1"  # the least of two facts that say the same
    assert A.matched(contexts, index.limit(0), "key").count() == 0 and A.assessed(contexts.limit(0), A.matched(contexts.limit(0), index, "key"), "key").count() == 0


def test_hot_fact(spark):
    """One fact in all of many contexts, some of them long."""
    contexts = spark.range(3000).select((F.col("id") % 7).alias("key"), F.col("id").cast("int").alias("context"), F.lit("required").alias("source"), F.concat(F.lit("python "), F.repeat(F.lit("or python "), (F.col("id") % 40).cast("int"))).alias("text"))
    index = A.index(spark.createDataFrame([("1", "Python", "skill")], "fact string, value string, kind string"))
    found = A.matched(contexts, index, "key")
    assert found.agg(F.sum(F.size("found"))).first()[0] == sum(1 + i % 40 for i in range(3000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_verdicts(spark):
    full = {"verdict": "pass", "unknown_facts": False, "listing": "open", "kind": "full", "opportunity": "job", "verified": 1}
    cases = {
        1: ({}, "suitable", []), 2: ({"verdict": None}, "unassessed", ["decision"]), 3: ({"verdict": "kill"}, "not_suitable", []), 4: ({"listing": "closed", "verdict": None}, "not_suitable", []), 5: ({"kind": "snippet"}, "needs_review", ["description_kind"]),
        6: ({"opportunity": "program", "listing": None}, "needs_review", ["listing_status", "opportunity_type"]), 7: ({"verified": None, "unknown_facts": True}, "needs_review", ["decision", "last_verified_at"]), 8: ({}, "needs_review", ["requirement_evidence"]),
        9: ({}, "needs_review", ["credential"]), 10: ({}, "needs_review", ["requirement_evidence"]), 11: ({}, "needs_review", ["requirement_evidence"]), 12: ({}, "suitable", []),
    }
    df = spark.createDataFrame([tuple({"key": k, **full, **c}.values()) for k, (c, _, _) in cases.items()], "key long, verdict string, unknown_facts boolean, listing string, kind string, opportunity string, verified long")
    texts = {9: [("required", "Python and a security clearance"), ("required", "Python")], 10: [("preferred", "Python")], 11: [("title", "Python")], 12: [("required", "RN license"), ("required", "Python, singing and dancing")]}
    contexts = spark.createDataFrame([(k, i, s, t) for k in cases if k != 8 for i, (s, t) in enumerate(texts.get(k, [("required", "Python")]))], "key long, context int, source string, text string")
    index = A.index(spark.createDataFrame(FACTS, "fact string, value string, kind string"))
    got = {r["key"]: r for r in A.verdicts(df, A.assessed(contexts, A.matched(contexts, index, "key"), "key"), "key").collect()}
    assert {k: (r["status"], r["blocking"]) for k, r in got.items()} == {k: (s, b) for k, (_, s, b) in cases.items()}
    assert (got[12]["evidence"], got[12]["gaps"], got[8]["evidence"]) == (2, 2, 0)


def test_assessment(spark):
    """A whole table: evidence by loops over contexts, facts and variants."""
    facts = [tuple(r) for r in postings.fit_facts(spark, D).collect()]
    index = plain_index(facts)
    contexts = defaultdict(list)
    for r in postings.fit_contexts(spark, D).collect():
        contexts[r["doc_id"]].append(r)
    evidence, want = set(), {}
    for p in postings.fit_postings(spark, D).collect():
        n = gaps = 0
        some = any_ = credential = False
        for c in contexts[p["doc_id"]]:
            found = plain_found(c["text"] or "", index)
            evidence |= {(p["doc_id"], c["context"], c["source"], *f[:1], *f[2:]) for f in found}
            missing = plain_gaps(c["text"] or "", found)
            n, any_ = n + bool(found), any_ or bool(found)
            gaps += len(missing) if c["source"] != "title" else 0
            asks = bool(compiled(A.CREDENTIAL).search(c["text"] or ""))
            if c["source"] == "required":
                some |= any(not asks or f[5] == "credential" for f in found)
                credential |= asks and (not any(f[5] == "credential" for f in found) or any(compiled(A.CREDENTIAL).search(g) for g in missing))
        blocks = {"credential": credential, "decision": p["verdict"] is None or p["unknown_facts"], "description_kind": p["kind"] != "full", "last_verified_at": p["verified"] is None, "listing_status": p["listing"] not in ("open", "closed"), "opportunity_type": p["opportunity"] != "job", "requirement_evidence": not some}
        blocking = [b for b, holds in blocks.items() if holds]
        out = p["verdict"] == "kill" or p["listing"] == "closed"
        status = "not_suitable" if out else "unassessed" if p["verdict"] is None else "needs_review" if blocking or not any_ else "suitable"
        want[p["doc_id"]] = (status, "" if out else " ".join(blocking), n, gaps)
    assert {tuple(r) for r in postings.assessment_evidence(spark, D).collect()} == evidence and len(evidence) > 500
    assert {r["doc_id"]: tuple(r)[1:] for r in postings.assessment(spark, D).collect()} == want and len({w[0] for w in want.values()}) == 4


def closure(edges):
    out = set()
    for start in {a for a, _, _ in edges}:
        todo, seen = [start], set()
        while todo:
            at = todo.pop()
            for a, b, passes in edges:
                if a == at and b != start:
                    out.add((start, b))
                    if passes and b not in seen:
                        seen.add(b)
                        todo.append(b)
    return out


@pytest.mark.parametrize("edges", [
    [("python", "coding", True), ("coding", "work", True), ("work", "coding", True), ("react", "frontend", True), ("frontend", "coding", True)],
    [("python", "5 years", False), ("5 years", "senior", True), ("python", "coding", True), ("coding", "5 years", False)],
    [("a", "b", False), ("a", "c", True), ("c", "b", True), ("b", "d", True), ("a", "a", True), ("d", "a", True)],  # b is known by an edge that blocks, and passes on by another way
    [],
])
def test_broader(spark, edges):
    df = spark.createDataFrame(edges, "narrow string, broad string, passes boolean")
    assert {tuple(r) for r in A.broader(df).collect()} == closure(edges)
    if ("python", "5 years", False) in edges:
        assert ("python", "senior") not in closure(edges) and ("5 years", "senior") in closure(edges)


def test_broader_rounds(spark):
    chain = spark.range(12).select(F.col("id").cast("string").alias("narrow"), (F.col("id") + 1).cast("string").alias("broad"), F.lit(True).alias("passes"))
    assert A.broader(chain).count() == 78
    with pytest.raises(RuntimeError):
        A.broader(chain, most_rounds=3)


def test_plain_contexts(spark):
    framing = ("experience", "with", "skills", "required", "in")
    cases = {"Experience with coding required": True, "Python and coding": True, "CNC coding experience": False, "five years of coding": False, "coding certification": False, "decoding skills": False, "coding, teamwork": True}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", A.plain(F.col("t"), "programming|coding", framing).alias("p")).collect()} == cases
