"""Scopes of sites, employers that vouch, facets that roll up, and the filter by place."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import places as P
from ledgerspark.operators.entries import Page, asked
from ledgerspark.plans import postings

D = "/root/testdata/sf0.001"
GAZETTEER = [("Cambridge", "MA"), ("cambridge", "country:GB"), ("Lenexa", "KS"), ("county:middlesex county", "MA"), ("county:middlesex county", "NJ"), ("Nashua", "NH"), ("Springfield", "IL"), ("Springfield", "MO")]


@pytest.fixture(scope="module")
def gazetteer(spark):
    return spark.createDataFrame(GAZETTEER, "name string, place string").persist()


SITES = [
    ("Boston, MA", "ma"), ("Boston, Massachusetts, USA", "ma"), ("Providence, Rhode Island", "new_england"), ("San Diego, CA", "outside"), ("Remote", "remote"), ("US-wide", "remote"), ("Remote - Canada", "outside"), ("Remote, MA", "ma"), ("MA - Boston", "ma"),
    ("Lebanon, NH", "new_england"), ("Beirut, Lebanon", "outside"), ("Toronto, Canada", "outside"), ("Canada, Toronto", "outside"), ("2 Locations", "unreadable"), ("US, Lenexa KCIB (PRA)", "outside"), ("Lenexa", "outside"), ("Cambridge", "ma"), ("Cambridge (site)", "ma"),
    ("San Juan, Puerto Rico", "outside"), ("North Middlesex County", "unreadable"), ("Middlesex County", "ma"), ("Nashua office", "new_england"), ("Springfield", "outside"), ("Somewhere", "unreadable"), ("USA", "remote"), ("", "unreadable"), (None, "unreadable"),
    ("Somewhere; Nashua", "new_england"), ("Toronto, Canada | Boston, MA", "ma"), ("Remote; Lenexa", "remote"), ("India-Pune", "outside"),
]


def test_scope(spark, gazetteer):
    """Each site of an employer that has a local one, too."""
    rows = [r for i, (site, _) in enumerate(SITES) for r in ((i, f"e{i}", site), (-1 - i, f"e{i}", "Boston, MA"))]
    df = spark.createDataFrame(rows, "key long, employer string, location string").withColumn("title", F.lit(None).cast("string"))
    got = {r["key"]: r["scope"] for r in P.location_scope(df, "key", "employer", "title", "location", gazetteer).collect()}
    assert [(s, got[i]) for i, (s, _) in enumerate(SITES)] == SITES and all(got[-1 - i] == "ma" for i in range(len(SITES)))


def test_region(spark, gazetteer):
    df = spark.createDataFrame([(1, "San Diego, California"), (2, "Boston, MA"), (3, "Lenexa")], "key long, location string").withColumns({"title": F.lit(""), "employer": F.lit("e")})
    of = lambda *states: [r["scope"] for r in P.location_scope(df, "key", "employer", "title", "location", gazetteer, P.Region(states=states)).orderBy("key").collect()]
    assert of("CA") == ["in_region", "outside", "outside"] and of("KS", "MA") == ["outside", "ma", "in_region"] and of(*P.NEW_ENGLAND) == ["outside", "ma", "outside"]


def test_employers_vouch(spark, gazetteer):
    rows = [
        (1, "near", None, "Site 9"), (2, "near", None, "Boston, MA"), (3, "far", None, "Site 9"), (4, "far", None, "Lenexa"), (5, "anywhere", None, "Site 9"), (6, "anywhere", None, "Remote, MA"), (7, None, None, "Site 9"), (8, None, None, "Boston, MA"), (9, "far", None, "3 Locations"),
        (10, "near", "Chemist - Nashua, NH", "Site 9"), (11, "far", "Chemist - Nashua, NH", "Site 9"), (12, "near", "Chemist (Austin, TX)", "Site 9"), (13, "near", "Chemist - Austin, TX", "Boston, MA"), (14, "near", "Chemist - Springfield, MA", "Springfield"), (15, "far", None, None),
    ]
    df = spark.createDataFrame(rows, "key long, employer string, title string, location string")
    got = {r["key"]: r["scope"] for r in P.location_scope(df, "key", "employer", "title", "location", gazetteer).collect()}
    assert got == {1: "unreadable", 2: "ma", 3: "outside", 4: "outside", 5: "outside", 6: "ma", 7: "outside", 8: "ma", 9: "unreadable", 10: "new_england", 11: "outside", 12: "outside", 13: "ma", 14: "outside", 15: "outside"}
    assert P.location_scope(df.limit(0), "key", "employer", "title", "location", gazetteer).count() == 0


def test_facets(spark, gazetteer):
    rows = [(1, "Boston, MA; cambridge, MA; Remote"), (2, "Boston, Massachusetts"), (3, None), (4, "2 Locations"), (5, "2 Locations; Toronto, Canada"), (6, "Moon Base"), (7, "Remote"), (8, "Nashua"), (9, "Springfield"), (10, "NH"), (11, "Boston, MA | Boston, MA"), (12, "")]
    chosen = P.choices(spark.createDataFrame(rows, "key long, location string"), "key", "location", gazetteer)
    got = {r["choice"]: (r["label"], r["parent"], r["n"]) for r in P.facets(chosen).collect()}
    assert got == {
        "state:MA": ("Massachusetts", None, 3), "city:boston,MA": ("Boston, MA", "state:MA", 3), "city:cambridge,MA": ("Cambridge, MA", "state:MA", 1), "remote": ("Remote", None, 2), "none": ("No location", None, 2), "several": ("Several locations", None, 1), "country:CA": ("CA", None, 1),
        "city:toronto,CA": ("Toronto", "country:CA", 1), "other": ("Other places", None, 2), "place:moon base": ("Moon Base", "other", 1), "state:NH": ("New Hampshire", None, 2), "city:nashua,NH": ("Nashua, NH", "state:NH", 1), "place:springfield": ("Springfield", "other", 1),
    }
    entries = chosen.groupBy("key").agg(F.collect_set("choice").alias("places"))
    keys = lambda *p: sorted(r["key"] for r in asked(entries, Page(places=p)).collect())
    assert keys("state:MA") == [1, 2, 11] and keys("state:NH", "remote") == [1, 7, 8, 10] and keys() == [*range(1, 13)] and keys("country:XX") == []


def test_queries(spark):
    """Whole tables: one scope a posting, parents count at least as much as each child and no more than all of them."""
    docs = spark.read.parquet(f"{D}/documents.parquet").count()
    scopes = postings.location_scope(spark, D)
    assert scopes.count() == docs == scopes.select("doc_id").distinct().count() and {r["scope"] for r in scopes.select("scope").distinct().collect()} <= set(P.SCOPES)
    rows = {r["choice"]: r for r in postings.place_facets(spark, D).collect()}
    for r in rows.values():
        if r["parent"]:
            assert r["n"] <= rows[r["parent"]]["n"] <= docs
    plan = scopes._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
