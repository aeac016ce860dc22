r"""Operator 7: relational chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text);
adjacent turns of one role merge into one block with an array aggregation, and the blocks
are concatenated:

    \n### <Role>:\n<text>\n</turn><text>\n</turn>\n### <Role>:\n...

Each text ends with ``\n</turn>``, so a merged block keeps its turns apart. Inside texts
a backslash, ``###`` and ``</turn>`` get a backslash before them, so that neither ``\n### ``
nor ``\n</turn>`` can occur there; roles are URL-encoded. ``read_back`` undoes both exactly.

Null texts and roles are empty; a null conv_id is a conversation of its own; null turns sort
first; repeated rows stay, as turns of their own. An empty table gives an empty result. Very long
texts are formatted whole, and the spans are found in time that grows with the text and the
number of turns. Other columns, whatever their names, are not read.
A conversation is one output value, as the format asks for, so its rows meet in one row of
one task; conversations are otherwise spread by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cuts, hex_sha256, running, table

HEAD, COLON, END = "\n### ", ":\n", "\n</turn>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length in code points, of the
    assistant texts as they stand in formatted) from rows conv_id, turn, role, text."""
    rows = turns.select(
        turns["conv_id"].cast("bigint").alias("conv_id"),
        F.struct(
            turns["turn"].cast("bigint").alias("turn"),
            F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # a turn of another role than the one before opens a block
    opened = grouped.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                F.when((i > 0) & (F.get("ts", i - 1)["role"] == t["role"]), F.lit("")).otherwise(F.concat(F.lit(HEAD), F.url_encode(t["role"]), F.lit(COLON))).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ).alias("parts"),
    )
    merged = opened.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform(
            F.filter(
                F.zip_with("parts", running(F.col("parts"), F.lit(0), lambda at, p: at + F.length(p["head"]) + F.length(p["body"]) + len(END)), lambda p, at: F.struct(p["loss"].alias("loss"), (at + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("len"))),
                lambda x: x["loss"],
            ),
            lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len")),
        ).alias("loss_spans"),
    )
    return merged


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_texts, read from formatted and loss_spans alone."""
    blocks = F.slice(F.split("formatted", HEAD), 2, F.size(F.split("formatted", HEAD)))
    body = lambda b: F.substr(b, F.instr(b, F.lit(COLON)) + F.lit(len(COLON)))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.slice(F.split(body(b), END), 1, F.size(F.split(body(b), END)) - 1),
                lambda x: F.struct(F.url_decode(F.substring_index(b, COLON, 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    cut = chats.select("conv_id", "formatted", "loss_spans", Cuts(F.col("formatted")).blocks.alias("_blocks"))
    loss = F.transform("loss_spans", lambda s: unescape(Cuts(F.col("formatted")).part(s["start"], s["start"] + s["len"], F.col("_blocks"))))
    return cut.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


#: A conversation whose texts hold the template's own control strings.
PROBE = (-7, r"\### Assistant: </turn> ok")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE[0]).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE[1]).alias("text"),
    )
    back = read_back(format_chats(rows.unionByName(probe)))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        hex_sha256(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(F.array_join("loss_texts", "")).cast("bigint").alias("loss_chars"),
        hex_sha256(F.array_join("loss_texts", "")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), seen AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS was,
    length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 AS body,
    length(url_encode(role)) + 7 AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN was IS DISTINCT FROM role THEN head ELSE 0 END) AS BIGINT) AS formatted_chars
FROM seen GROUP BY conv_id
"""
