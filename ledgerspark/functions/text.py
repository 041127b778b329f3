"""Text, URL and HTML functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only attribute visits, as names and as a prefix.
TRACKING = (
    "_ga", "_gl", "dclid", "fbclid", "gclid", "igshid", "li_fat_id", "mc_cid", "mc_eid", "msclkid", "twclid", "vero_conv", "vero_id", "wbraid", "yclid",
)
TRACKING_PREFIX = "utm_"
#: Legal forms at the end of an employer's name, and marks at the edges of titles and names.
LEGAL = ("inc", "llc", "ltd", "corp", "plc", "s.a")
EDGE = " \t\r\n -–—,.;:/\\|·•*&_+()[]{}'\"“”‘’"
#: Web and mail addresses and telephone numbers.
CONTACT = (
    r"https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|"
    r"(?<!\d)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?!\d)"
)
#: What each of these has somewhere; texts without it need no closer look.
CONTACT_HINT = r"://|@|[wW]{3}\.|\d{3}"
#: Entities that descriptions are escaped with, in the order they are decoded.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Words in a source's own status, workplace and opportunity fields.
CLOSED = ("closed", "archived", "inactive", "unlisted", "filled", "cancelled", "canceled")
OPEN = ("open", "active", "listed", "published")
WORKPLACES = {
    "hybrid": ("hybrid", "flexible", "partially remote"),
    "remote": ("remote", "work from home", "distributed", "virtual"),
    "onsite": ("on-site", "onsite", "on site", "office", "in-person", "in person"),
}
JOBS = ("job", "jobs", "employment", "position", "role", "full_time", "part_time", "internship")
POOLS = ("talent_pool", "talentpool", "general_application", "evergreen", "future_opportunity")
PROGRAMS = ("program", "fellowship", "apprenticeship", "rotational")
POOL_WORDS = r"\b(talent\s+pool|general\s+application|future\s+opportunit(?:y|ies))\b"
PROGRAM_WORDS = r"\b(fellowship|apprenticeship|rotational\s+program|internship\s+program)\b"


def folded(text: Column) -> Column:
    """Lower case, runs of white space one space. functions.unicode has the same with compatibility forms and full case folding."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def title(text: Column) -> Column:
    """folded, without marks at the edges."""
    return F.btrim(folded(text), F.lit(EDGE))


def employer(name: Column) -> Column:
    """title, without one legal form at the end."""
    return F.btrim(F.regexp_replace(title(name), rf"(?<=.) ({'|'.join(map(re.escape, LEGAL))})$", ""), F.lit(EDGE))


def label(text: Column) -> Column:
    """A form label's words: lower case, & as and, no `required` at the end, only letters and digits."""
    out = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"\(required\)\s*$", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"\brequired\s*$", ""), "[^a-z0-9]+", " "))


def alphanumeric(text: Column) -> Column:
    """Lower-case letters and digits, nothing between."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def grounded(value: Column, document: Column, prose: Column, longest: int = 120) -> Column:
    """Whether value is spelled out of document: prose and long values as a whole, others by each of their runs of two or
    more letters and digits; what has no such run is not. document is alphanumeric() already."""
    runs = F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    words = (F.size(runs) > 0) & F.forall(runs, lambda r: F.contains(document, alphanumeric(r)))
    whole = F.contains(document, alphanumeric(value))
    return F.coalesce((alphanumeric(value) != "") & F.when(prose | (F.length(value) > longest), whole).otherwise(words), F.lit(False))


def excerpt(text: Column, start: Column, end: Column, radius: int = 70) -> Column:
    """text around [start, end), white space as one space, with an ellipsis where something is left out."""
    a, b = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    inner = F.btrim(F.regexp_replace(F.substr(text, a + 1, b - a), r"\s+", " "))
    return F.concat(F.when(a > 0, "…").otherwise(""), inner, F.when(b < F.length(text), "…").otherwise(""))


def concise(text: Column, most: int = 300) -> Column:
    """White space as one space, most characters at most."""
    return F.substr(F.btrim(F.regexp_replace(text, r"\s+", " ")), F.lit(1), F.lit(most))


def numbers(text: Column) -> Column:
    """The number tokens of text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*%?"), F.lit(0)))


def introduced_numbers(text: Column, originals: Column) -> Column:
    """The number tokens that text has and originals do not, in order."""
    return F.sort_array(F.array_except(numbers(text), numbers(originals)))


def destination(url: Column) -> Column:
    """One spelling of a URL: lower scheme and host, no default port, fragment, tracking parameter or last slash; other
    parameters in order. Texts that are no URL lose slashes at the end only."""
    raw = F.btrim(url)
    bare = F.regexp_replace(raw, "#.*$", "")
    base, query = F.substring_index(bare, "?", 1), F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", ""))
    host = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")
    path = F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    name = lambda p: F.lower(F.btrim(F.substring_index(p, "=", 1)))
    kept = F.filter(F.split(query, "&"), lambda p: ~(name(p).startswith(TRACKING_PREFIX) | name(p).isin(*TRACKING) | (p == "")))
    kept = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    whole = F.concat(host, path, F.when(F.coalesce(kept, F.lit("")) != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host == "", F.when(raw == "/", raw).otherwise(F.regexp_replace(raw, "/+$", ""))).otherwise(whole)


def decoded(text: Column) -> Column:
    """Entities decoded once."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_text(html: Column) -> Column:
    """Visible text of simple HTML: no comments, scripts, styles or tags, the commonest entities decoded."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    return F.btrim(F.regexp_replace(decoded(F.regexp_replace(out, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def description_html(raw: Column) -> Column:
    """A description as HTML: escaped markup decoded, three times at most, until tags appear; plain text as paragraphs."""
    out = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\r\n"))
    for _ in range(3):
        out = F.when(~F.contains(out, F.lit("<")) & out.rlike(r"&(lt|amp|gt|quot|#\d+);"), decoded(out)).otherwise(out)
    escaped = F.replace(F.replace(F.replace(out, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.transform(F.split(escaped, r"\n{2,}"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.when(out == "", "").when(F.contains(out, F.lit("<")), out).otherwise(F.array_join(paragraphs, ""))


def scrubbed(text: Column, identity: tuple[str, ...] = ()) -> Column:
    """Addresses and telephone numbers, and then the names in identity, longest first, removed; white space as one space."""
    out = F.when(text.rlike(CONTACT_HINT), F.regexp_replace(text, f"(?i){CONTACT}", "[contact removed]")).otherwise(text)
    for term in sorted(identity, key=len, reverse=True):
        out = F.regexp_replace(out, "(?i)" + re.escape(term), "[identity removed]")
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def listing_status(said: Column) -> Column:
    """open, closed or unknown, from a source's own word."""
    word = F.btrim(F.replace(F.lower(said), F.lit("_"), F.lit("-")))
    return F.when(word.isin(*CLOSED), "closed").when(word.isin(*OPEN), "open").otherwise("unknown")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def workplace(said: Column) -> Column:
    """hybrid, remote, onsite or unknown, the first whose words come in said."""
    raw = F.replace(F.lower(F.btrim(said)), F.lit("_"), F.lit("-"))
    out = F.when(F.coalesce(raw, F.lit("")) == "", "unknown")
    for kind, words in WORKPLACES.items():
        out = out.when(_has(raw, words), kind)
    return out.otherwise("unknown")


def opportunity(said: Column, title: Column, description: Column) -> Column:
    """job, talent_pool, program or unknown: from the source's own word, and only without one from title and description."""
    raw = F.regexp_replace(F.lower(F.btrim(F.coalesce(said, F.lit("")))), "[- ]", "_")
    both = F.lower(F.concat_ws(" ", title, description))
    return (
        F.when(raw.isin(*JOBS), "job").when(_has(raw, POOLS), "talent_pool").when(_has(raw, PROGRAMS), "program").when(raw.isin("unknown", "other", "none"), "unknown")
        .when(both.rlike(POOL_WORDS), "talent_pool").when(both.rlike(PROGRAM_WORDS), "program").otherwise(F.when(raw == "", "job").otherwise("unknown"))
    )
