"""Names replaced by placeholders in one pass, the longest first, and texts withheld by what they then still say.

Names are rows, however many there are, and so are the runs of words in a text that are as long as some name; they meet in
one equi-join. A placeholder that has been put in is not read again, so a name like "Institution" rewrites none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerspark.functions import matches as M
from ledgerspark.sources.scratch import stored

#: What a name is made of, and terms that withhold a text, by class.
WORD = r"(?U)\w+"
PRONOUNS = ("he", "she", "him", "her", "hers", "his", "himself", "herself")
PROTECTED = (
    "religion", "religious", "christian", "christianity", "muslim", "islam", "jewish", "judaism", "hindu", "hinduism", "buddhist", "buddhism", "church", "mosque", "synagogue", "temple", "prayer", "worship",
    "ethnicity", "ethnic", "race", "racial", "nationality", "citizenship", "turkish", "danish", "hispanic", "latino", "latina", "asian", "black", "white",
    "disability", "disabled", "diagnosis", "diagnosed", "autism", "adhd", "depression", "anxiety", "diabetes", "cancer", "medical condition",
    "age", "aged", "birth", "birthday", "born", "minor", "elderly", "married", "spouse", "husband", "wife", "children", "child", "parent", "mother", "father", "pregnant", "pregnancy", "maternity", "paternity",
    "women in science", "women in tech", "society of women engineers", "girls who code", "women's association", "men's association",
)
WITHHELD = "[withheld]"


def letters(index: Column) -> Column:
    """A, B, ..., Z, AA, AB, ... of 0, 1, ...; up to four letters."""
    letter = lambda i: F.chr(i % 26 + 65)
    up = lambda i: F.floor(i / 26).cast("int") - 1
    out, i = letter(index), index
    for _ in range(3):
        i = up(i)
        out = F.when(i >= 0, F.concat(letter(i), out)).otherwise(out)
    return out


def named(names: DataFrame, order: str) -> DataFrame:
    """(name, placeholder) of names (kind, name, order): kind and a letter in the order of first mention, each name once whatever its case.

    A name of several kinds keeps the one that is last in the alphabet. Numbers run within a kind; a kind's names are parted
    by range of their order and counted, so that none needs a task of its own.
    """
    from ledgerspark.operators.temporal import running_total

    first = names.where("name is not null and trim(name) <> ''").groupBy("kind", F.lower("name").alias("name")).agg(F.min(order).alias("at"))
    ranked = running_total(first, "kind", "at", F.lit(1).cast("long"))
    return ranked.groupBy("name").agg(F.max_by(F.concat(F.col("kind"), F.lit(" "), letters((F.col("spent") - 1).cast("int"))), "kind").alias("placeholder"))


def replaced(rows: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, text) of rows with names (name, placeholder) replaced: whole words, whatever the case, at each place the longest name.

    Keys are unique. A null text stays null; texts without a name are not joined twice. How many words names have is a short
    list; a name begins and ends with a letter, digit or underscore, others are not found.
    """
    known = stored(names.select(F.lower("name").alias("run"), "placeholder").where(F.col("run").rlike(r"(?sU)^\w(?:.*\w)?\z")).groupBy("run").agg(F.min("placeholder").alias("placeholder")).withColumn("n", F.size(F.regexp_extract_all("run", F.lit(WORD), F.lit(0)))))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
    t = F.col(text)

    hits = M.runs(rows, [key], text, WORD, lengths).withColumn("run", F.lower("run")).join(known.drop("n"), "run")
    found = hits.groupBy(F.col(key).alias("__k")).agg(*(F.collect_list(c).alias(f"__{c}") for c in ("start", "end", "placeholder")))
    return rows.select(key, text).join(found, F.col(key) == F.col("__k"), "left").select(key, F.when(F.col("__k").isNull(), t).otherwise(_put(t, "__start", "__end", "__placeholder")).alias(text))


@F.pandas_udf(StringType())
def _put(text: pd.Series, start: pd.Series, end: pd.Series, placeholder: pd.Series) -> pd.Series:
    """Texts with placeholders in the places found: of those that overlap the first, and of those that begin alike the longest."""

    def put(t: str | None, starts: Sequence[int] | None, ends: Sequence[int], placeholders: Sequence[str]) -> str | None:
        if t is None or starts is None:
            return t
        out, at = [], 0
        for a, _, b, said in sorted(zip(starts, (-b for b in ends), ends, placeholders)):
            if a >= at:
                out += [t[at:a], said]
                at = b
        return "".join(out) + t[at:]

    return pd.Series([put(*x) for x in zip(text, start, end, placeholder)], dtype=object)


def denied(text: Column) -> Column:
    """pronoun or protected_term where a text has such a word or phrase; null where it has none."""
    has = lambda terms: text.rlike(r"(?iU)(?<!\w)(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + r")(?!\w)")
    return F.when(has(PRONOUNS), "pronoun").when(has(PROTECTED), "protected_term")


def scrubbed(rows: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, text, withheld): names replaced, and then the whole text withheld where it says what is not to be said."""
    out = replaced(rows, key, text, names).withColumn("withheld", denied(F.col(text)))
    return out.withColumn(text, F.when(F.col("withheld").isNotNull(), WITHHELD).otherwise(F.col(text)))
