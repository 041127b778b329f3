"""Places of postings: what scope their sites have for a candidate's states, and facets of states and cities that roll up.

A posting's location is a text of one site or several. What a site says of country and state is read off its text; a city
without them is looked up in a gazetteer (name, place), a name of which can have several readings, by an equi-join of a
site's candidates. A second pass lets an employer's sites that are read vouch for those that are not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states, by code and name, and New England.
STATES = dict(zip(
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split(),
    (
        "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|"
        "Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|"
        "South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming|District of Columbia"
    ).split("|"), strict=True,
))
HOME, NEW_ENGLAND = "MA", ("MA", "RI", "NH", "CT", "VT", "ME")
#: Countries by name and code, as far as boards in wide use write them; more can be given.
COUNTRIES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US", "canada": "CA", "mexico": "MX", "brazil": "BR", "uk": "GB", "gb": "GB", "united kingdom": "GB", "england": "GB", "scotland": "GB", "wales": "GB",
    "northern ireland": "GB", "ireland": "IE", "germany": "DE", "france": "FR", "spain": "ES", "italy": "IT", "netherlands": "NL", "belgium": "BE", "switzerland": "CH", "austria": "AT", "sweden": "SE", "denmark": "DK", "norway": "NO", "finland": "FI", "poland": "PL",
    "portugal": "PT", "turkey": "TR", "russia": "RU", "india": "IN", "china": "CN", "japan": "JP", "south korea": "KR", "singapore": "SG", "malaysia": "MY", "australia": "AU", "new zealand": "NZ", "taiwan": "TW", "vietnam": "VN", "lebanon": "LB", "israel": "IL",
}
TERRITORIES = r"(?i)\b(?:Puerto Rico|Guam|American Samoa|Northern Mariana Islands|US Virgin Islands)\b"
SITES, COUNT, REMOTE, ANYWHERE = r"\s*[;|]\s*", r"(?i)^\d+\s+locations?$", r"(?i)\bremote\b", r"(?i)^(?:remote|(?:US|USA|United States)(?:[ -]?wide| nationwide)?)$"
PARTS, SUFFIX, US_FIRST = r"[,;]|\s+[-–—]\s+", r"(?i)\s*\([^)]*\)$|\s+(?:office|site|campus)$", r"(?i)^(?:US|USA|United States)\s*[,\-]\s*|^City of "
_NAMES = "|".join(re.escape(n) for n in sorted(STATES.values(), key=len, reverse=True))
STATE_NAME = rf"(?i)(?:^|[,;|\-/]\s*|\s+)({_NAMES})(?=\s*(?:[,;|\-/]|$|\bUSA\b|\bUnited States\b))"
STATE_CODE = r"(?:^|[\s,;|\-/])(" + "|".join(STATES) + r")(?=$|[\s,;|\-/])"
COUNTY = r"(?i)\b[\w ]+?\s+County\b"
#: Places in a title: after a slash or dash or in brackets, a city with a state or country.
TITLE = r"(?:\s/\s|\s[-–—]\s|\()\s*([A-Za-z][A-Za-z .'-]+?,\s*(?:[A-Z]{2}|[A-Za-z][A-Za-z ]+?))(?=\s*(?:\)|\(|[-–—/]|$))"
#: Scopes, the first of a posting's sites counts.
SCOPES = ("ma", "new_england", "in_region", "remote", "unreadable", "outside")
LOCAL = SCOPES[:3]


def _lookup(pairs: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), F.lower(F.btrim(name)))


_BY_NAME = {n.lower(): c for c, n in STATES.items()}
_STATE_OF = _BY_NAME | {c.lower(): c for c in STATES}


@dataclass(frozen=True)
class Region:
    """The states that count as the candidate's, and the countries' names."""

    states: tuple[str, ...] = NEW_ENGLAND
    countries: tuple[tuple[str, str], ...] = tuple(COUNTRIES.items())


def state(name: Column) -> Column:
    """The code of the state that a site names: the last full name, else the first code in capitals; null if there is none."""
    named = F.try_element_at(F.regexp_extract_all(name, F.lit(STATE_NAME), F.lit(1)), F.lit(-1))
    code = F.regexp_extract(name, STATE_CODE, 1)
    return F.coalesce(_lookup(_BY_NAME, named), F.when(code != "", code))


def country(name: Column, region: Region) -> Column:
    """The code of the country that a site names as a whole part, at its end or at its beginning; a state of that name comes first."""
    pairs = dict(region.countries)
    parts = lambda text: F.transform(F.split(text, PARTS, -1), lambda p: F.btrim(F.regexp_replace(p, r"\s*\([^)]*\)$", ""), F.lit(" ,-/")))
    own, bare = parts(name), parts(F.regexp_replace(name, r"(?i)\bremote\b(?:\s+location)?", ""))
    last = F.element_at(own, -1)
    prefix = F.regexp_extract(name, r"^([A-Za-z]{3,30})-", 1)
    every = F.when(_lookup(_STATE_OF, last).isNotNull(), F.array(last)).otherwise(F.concat(F.array(last, own[0], prefix), bare))
    codes = F.transform(F.filter(every, lambda p: (_lookup({k: v for k, v in pairs.items() if v == "US"}, p) == "US") | _lookup(_STATE_OF, p).isNull()), lambda p: _lookup(pairs, p))
    return F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))


def sites(postings: DataFrame, key: str, location: str) -> DataFrame:
    """(key, no, name) of each site of each location, blank ones left out; a posting without any has one row, with a null name."""
    names = F.filter(F.transform(F.split(location, SITES, -1), lambda n: F.btrim(F.regexp_replace(n, r"\s+", " "))), lambda n: n != "")
    return postings.select(key, F.posexplode_outer(names).alias("no", "name")).select(key, F.coalesce("no", F.lit(0)).alias("no"), "name")


def candidates(name: Column) -> Column:
    """The names to look a site up by, the most telling first: counties in it, the whole of it without what is no city, and what stands before its first comma."""
    city = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, US_FIRST, ""), SUFFIX, ""), r"(?i)\s+(?:KCIB|Affiliate|Job Posting Location|Posting Location|Job Location)\b.*$", ""))
    counties = F.transform(F.regexp_extract_all(name, F.lit(COUNTY), F.lit(0)), lambda c: F.concat(F.lit("county:"), F.lower(F.btrim(c))))
    return F.array_distinct(F.concat(counties, F.array(F.lower(city), F.lower(F.btrim(F.substring_index(city, ",", 1))))))


def looked_up(rows: DataFrame, gazetteer: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, name) with places: the readings, in order, of the first candidate that the gazetteer (name, place) has, or null.

    Candidates are rows and meet the gazetteer's names in one equi-join; Spark sends the gazetteer to all tasks only where
    its measured size is below the session's threshold.
    """
    names = gazetteer.groupBy(F.lower("name").alias("__name")).agg(F.array_sort(F.collect_set("place")).alias("__places"))
    each = rows.select(*keys, F.posexplode(candidates(F.col("name"))).alias("__i", "__name")).join(names, "__name")
    best = each.groupBy(*keys).agg(F.min_by("__places", "__i").alias("places"))
    return rows.join(best, keys, "left")


def scoped(places: Column, region: Region) -> Column:
    """The scope of a place with these readings: a reading in the region counts before one outside."""
    local = lambda wanted: F.arrays_overlap(places, F.array(*map(F.lit, wanted)))
    mine = lambda names: tuple(s for s in names if s in region.states)
    out = F.lit("outside")
    for name, wanted in (("in_region", region.states), ("new_england", mine(NEW_ENGLAND)), ("ma", mine((HOME,)))):
        out = F.when(local(wanted), name).otherwise(out) if wanted else out
    return out


def site_scope(name: Column, places: Column, region: Region) -> Column:
    """One site's scope: its country, then its state, then whether it is remote, then the gazetteer's readings."""
    nation, code = country(name, region), state(name)
    city = F.btrim(F.regexp_replace(F.regexp_replace(name, US_FIRST, ""), SUFFIX, ""))
    return (
        F.when(name.isNull() | (name == "") | name.rlike(COUNT), "unreadable").when(nation != "US", "outside").when(code.isNotNull(), scoped(F.array(code), region)).when(name.rlike(REMOTE), "remote")
        .when(name.rlike(TERRITORIES), "outside").when(name.rlike(ANYWHERE), "remote").when(places.isNotNull(), scoped(places, region)).when((nation == "US") & (city == ""), "remote").otherwise("unreadable")
    )


def location_scope(postings: DataFrame, key: str, employer: str, title: str, location: str, gazetteer: DataFrame, region: Region = Region()) -> DataFrame:
    """(key, scope) of postings, one row a key: the first of SCOPES that a site has.

    Where no site is read, a city with a state in the title counts, if its state is local. What stays unreadable is outside
    where no posting of the employer has a local site that is read, remote ones aside; a mere number of locations stays
    unreadable. A null location is no site; a null employer vouches for none but its own posting.
    """
    rows = looked_up(sites(postings, key, location), gazetteer, [key, "no"])
    name, places = F.col("name"), F.col("places")
    several = (F.size("places") > 1) & state(name).isNull() & ~F.contains(name, F.lit(","))
    rows = rows.select(key, name, site_scope(name, places, region).alias("scope"), F.coalesce(several, F.lit(False)).alias("several"))
    has = lambda s: F.max(F.col("scope") == s)
    found = F.coalesce(*(F.when(has(s), s) for s in SCOPES))
    known = F.max(F.col("scope").isin(*LOCAL, "remote") & ~F.col("several"))
    by = rows.groupBy(F.col(key).alias("__k")).agg(found.alias("scope"), F.coalesce(known, F.lit(False)).alias("known"), F.max("several").alias("several"), has("outside").alias("has_outside"), has("unreadable").alias("has_unreadable"), F.max(F.col("scope").isin(*LOCAL) & ~name.rlike(REMOTE)).alias("local"), F.min(name.isNull() | name.rlike(COUNT)).alias("uncounted"))
    p = postings.select(key, employer, title, location).join(by, F.col(key) == F.col("__k")).drop("__k")

    # an employer's local sites, counted once and joined back by its name
    vouched = p.where("local").select(F.col(employer).alias("__e")).where("__e is not null").distinct().withColumn("__local", F.lit(True))
    p = p.join(vouched, F.col(employer) == F.col("__e"), "left").withColumn("__local", F.coalesce("__local", F.col("local"), F.lit(False)))
    hints = F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(TITLE), F.lit(1)), lambda h: F.coalesce(state(h), country(h, region)).isNotNull())
    scopes = F.transform(hints, lambda h: site_scope(h, F.lit(None).cast("array<string>"), region))
    hint = F.get(F.filter(scopes, lambda s: (s == "outside") | (s.isin(*LOCAL) & ~F.col("has_outside") & F.col("__local"))), F.lit(0))
    unsure = (F.col("several") | F.col("has_unreadable")) & ~F.col("known")
    scope = F.when(unsure & hint.isNotNull(), hint).when((F.col("scope") == "unreadable") & ~F.col("__local") & ~(F.col("uncounted") & F.col(location).isNotNull()), "outside").otherwise(F.col("scope"))
    return p.select(key, scope.alias("scope"))


# Facets


def choices(postings: DataFrame, key: str, location: str, gazetteer: DataFrame, region: Region = Region()) -> DataFrame:
    """(key, choice, label, parent): the places that a posting counts for, each once: remote, states and countries, cities below
    them, other places below `other`; none without a location, several where it only says how many.
    """
    rows = looked_up(sites(postings, key, location), gazetteer, [key, "no"])
    name = F.col("name")
    local = F.btrim(F.regexp_replace(F.regexp_replace(name, r"(?i)\(?\s*\bremote\b\s*\)?|\s+or\s+remote\b", " "), US_FIRST, ""), F.lit(" ,-–—/()"))
    nation, code = country(local, region), F.coalesce(state(local), F.when(F.size("places") == 1, F.when(F.get("places", F.lit(0)).isin(*STATES), F.get("places", F.lit(0)))))
    first = F.btrim(F.regexp_replace(F.substring_index(local, ",", 1), SUFFIX, ""))
    bare = F.when(_lookup(_STATE_OF, first).isNotNull() | _lookup(dict(region.countries), first).isNotNull(), "").otherwise(F.btrim(F.regexp_replace(first, rf"(?:^|[\s,;|\-/])(?:{'|'.join(STATES)})$", "")))
    one = lambda choice, label, parent=None: F.struct(choice.alias("choice"), label.alias("label"), (F.lit(None).cast("string") if parent is None else parent).alias("parent"))
    labels = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    in_state = F.concat(F.lit("state:"), code)
    in_nation = F.concat(F.lit("country:"), nation)
    remote = F.when(name.rlike(REMOTE), one(F.lit("remote"), F.lit("Remote")))
    states = F.array(one(in_state, F.try_element_at(labels, code)), F.when(bare != "", one(F.concat(F.lit("city:"), F.lower(bare), F.lit(","), code), F.concat(F.initcap(F.lower(bare)), F.lit(", "), code), in_state)))
    nations = F.array(one(in_nation, nation), F.when(bare != "", one(F.concat(F.lit("city:"), F.lower(bare), F.lit(","), nation), F.initcap(F.lower(bare)), in_nation)))
    others = F.array(one(F.lit("other"), F.lit("Other places")), one(F.concat(F.lit("place:"), F.lower(local)), F.initcap(F.lower(local)), F.lit("other")))
    placed = F.when(local == "", F.array()).when(code.isNotNull(), states).when(nation.isNotNull(), nations).when(name.rlike(REMOTE), F.array()).otherwise(others)
    every = F.when(name.isNull(), F.array(one(F.lit("none"), F.lit("No location")))).when(name.rlike(COUNT), F.array(one(F.lit("several"), F.lit("Several locations")))).otherwise(F.concat(F.array(remote), placed))
    rows = rows.select(key, F.explode(F.array_compact(every)).alias("c")).select(key, "c.*").distinct()
    # a number of locations says nothing beside locations
    named = rows.groupBy(F.col(key).alias("__k")).agg(F.max(F.col("choice") != "several").alias("__named"))
    return rows.join(named, F.col(key) == F.col("__k")).where((F.col("choice") != "several") | ~F.col("__named")).drop("__k", "__named")


def facets(chosen: DataFrame) -> DataFrame:
    """(choice, label, parent, n): how many postings have each; a posting with several cities of a state counts once for the state."""
    return chosen.groupBy("choice").agg(F.min("label").alias("label"), F.min("parent").alias("parent"), F.count("*").alias("n"))
