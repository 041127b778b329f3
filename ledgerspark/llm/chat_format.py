"""Chat formatting: prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it as context, its text as the only
trainable part. Where a conversation does not end with an assistant turn, one more row holds all its turns and
trains nothing, so that no turn is lost. A turn is written

    <s>ROLE newline TEXT </s>

and inside roles and texts each backslash is doubled and each control string gets a backslash behind its first
character, which unescape() takes away again; a newline in a role becomes a backslash and NEWLINE. Everything is
Column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, NEWLINE = "<s>", "</s>", "\u240a"
#: Strings that templates in wide use give a meaning; none of them is left whole inside a text.
CONTROL = (OPEN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>", "<pad>")


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    pattern = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(doubled, f"({pattern})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\" + NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, rf"(?<!\\)((?:\\\\)*)\\{NEWLINE}", "$1\n"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, trains, last) for turns (conv_id, turn, role, text).

    text[loss_start:loss_end], in code points with the end exclusive, is the trainable part, still escaped; the
    two are equal where trains is false. example counts a conversation's rows from 0 and last marks the one that
    holds all its turns. Null roles and texts are empty; turns go by turn, nulls first, then role and text, so
    that ties and repeated rows keep a fixed order; a null conv_id is a conversation of its own; an empty table
    gives no rows; other columns are ignored. A conversation is gathered in one row: its last example holds all
    of it anyway.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x"), (F.col("role") == "assistant").alias("a"), F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE)).alias("s"), F.length(text).alias("n"))
    chats = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "r", "x", "a", "s", "n"))).alias("t"))
    upto = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.coalesce(F.col("t")[i - 1]["a"], F.lit(False)) | (i == F.size("t")))
    rows = chats.select("conv_id", "t", F.posexplode(upto).alias("example", "i"))
    whole = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("i")), lambda x: x["s"]), "")
    trains = F.coalesce(F.col("t")[F.col("i") - 1]["a"], F.lit(False))
    rows = rows.select("conv_id", "example", whole.alias("text"), trains.alias("trains"), F.col("t")[F.col("i") - 1]["n"].alias("n"), (F.col("i") == F.size("t")).alias("last"))
    end = F.length("text") - len(CLOSE)
    return rows.select("conv_id", "example", "text", (end - F.when(F.col("trains"), F.col("n")).otherwise(0)).alias("loss_start"), end.alias("loss_end"), "trains", "last")


def read_back(text: Column) -> Column:
    """The (role, text) of each turn in an example's text."""
    body = F.split(text, re.escape(CLOSE))
    turns = F.transform(F.slice(body, F.lit(1), F.size(body) - 1), lambda s: F.substr(s, F.lit(len(OPEN) + 1)))
    return F.transform(turns, lambda s: F.struct(unescape_role(F.substring_index(s, "\n", 1)).alias("role"), unescape(F.substr(s, F.length(F.substring_index(s, "\n", 1)) + 2)).alias("text")))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's examples say, read back from them: digests of all turns and of all trainable text."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    rows = examples(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(own))
    turns = F.when(F.col("last"), read_back(F.col("text")))
    loss = unescape(F.substr(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = rows.select("conv_id", "example", turns.alias("turns"), F.when(F.col("trains"), loss).alias("loss"), F.length("text").cast("long").alias("chars"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    rows = rows.select("conv_id", "example", "loss", "chars", F.size("turns").cast("long").alias("n"), F.when(F.col("turns").isNotNull(), digest).alias("digest"))
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "")
    out = rows.groupBy("conv_id").agg(F.max(F.when(F.col("digest").isNotNull(), F.col("n"))).alias("n_turns"), F.max("digest").alias("turns_sha256"), losses.alias("loss"), F.count("*").alias("n_examples"), F.sum("chars").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: Lengths as escape() leaves them: a character more for each backslash and each control string.
_ESCAPED = "length({c}) + length({c}) - length(replace({c}, '\\', '')) + length(regexp_replace({c}, '" + "|".join(re.escape(c).replace("'", "''") for c in CONTROL) + "', '\x01\\0', 'g')) - length({c})"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, 8 + {_ESCAPED.format(c="role")} + {_ESCAPED.format(c="text")} AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS m
  FROM t
), s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = m))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR i = m) AS n_examples
FROM s GROUP BY conv_id
"""
