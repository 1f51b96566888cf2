"""Chat formatting by prefix-target expansion, with DataFrame functions.

A conversation is rendered once: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed per turn.
Every assistant turn makes one example: the rendering up to and with that turn, of which only the turn's own text is
trainable (its span is given in code points). Turns behind the last assistant turn make one more example without a
trainable span, so that the output holds every turn.

Control strings inside texts are escaped so that no ``<|`` of a text remains: a backslash is doubled and ``<|`` becomes
``<\\|``. Roles are treated alike, and their line feeds become ``\\n``. Both can be read back exactly.

Defined results: null text or role is empty; turns go by turn, role, text, null turns first; repeated rows are turns of
their own; null conv_id is a conversation; a conversation without rows doesn't exist; an empty table gives an empty
result. Other columns are not read. A conversation is one row of the output and so must fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    pieces = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(unescape(p), F.lit("\\n"), F.lit("\n"))), "\\")


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_end (code points; both null without a trainable span)."""
    told = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("said"),
    )
    told = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    head = lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))
    shown = told.select(
        "conv_id",
        F.transform("said", lambda x: F.struct(
            (x["role"] == "assistant").alias("target"), F.length(head(x)).alias("head"), F.length(escape(x["text"])).alias("body"),
            F.concat(head(x), escape(x["text"]), F.lit(END)).alias("shown"),
        )).alias("said"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<target:boolean,start:int,end:int,stop:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin, stop = acc["at"] + x["head"], acc["at"] + F.length(x["shown"])
        span = F.struct(x["target"].alias("target"), begin.alias("start"), (begin + x["body"]).alias("end"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    laid = shown.select(
        "conv_id", F.array_join(F.transform("said", lambda x: x["shown"]), "").alias("whole"), F.aggregate("said", start, step).alias("laid")
    )
    spans = F.filter("laid.spans", lambda s: s["target"])
    rest = F.when(~F.element_at("laid.spans", -1)["target"], F.slice("laid.spans", -1, 1)).otherwise(F.slice("laid.spans", 1, 0))
    return laid.select("conv_id", "whole", F.posexplode(F.concat(spans, rest)).alias("example", "span")).select(
        "conv_id", "example", F.substring(F.col("whole"), F.lit(1), F.col("span.stop")).alias("formatted"),
        F.when(F.col("span.target"), F.col("span.start")).alias("loss_start"), F.when(F.col("span.target"), F.col("span.end")).alias("loss_end"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a rendering, as an array of (role, text)."""
    pattern = r"(?s)<\|im_start\|>.*?<\|im_end\|>\n"
    turns = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def parse(turn: Column) -> Column:
        inner = F.substring(turn, F.lit(len(START) + 1), F.length(turn) - len(START) - len(END))
        at = F.instr(inner, "\n")
        return F.struct(unescape_role(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substring(inner, at + 1, F.length(inner))).alias("text"))

    return F.transform(turns, parse)
