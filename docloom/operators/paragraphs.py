"""Paragraph extraction, locators, summaries and paging.

A document's text is a sequence of paragraphs separated by line feeds. Null text is an empty document with one empty
paragraph. Paragraph indexes start at 0. Locator hashes are SHA-256 over the text with CRLF read as LF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a word is a run of letters, digits, underscores, apostrophes and hyphens that begins and ends at a word boundary.
WORD = r"(?U)\b[\w’'-]+\b"


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """One row per paragraph: id, kept columns, idx, text."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    return docs.select(id_col, *keep, F.posexplode(parts).alias("idx", "text"))


def locator_hash(text: Column) -> Column:
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def with_locator(rows: DataFrame, story: str = "body") -> DataFrame:
    return rows.withColumn(
        "locator",
        F.struct(F.lit(story).alias("story"), F.col("idx").alias("paragraph_index"), locator_hash(F.col("text")).alias("paragraph_hash")),
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def is_heading_style(style: Column, outline_level: Column | None = None) -> Column:
    """The style name, lower-cased and without spaces, begins with "heading", or an outline level is set."""
    named = F.startswith(F.replace(F.lower(F.coalesce(style, F.lit(""))), F.lit(" "), F.lit("")), F.lit("heading"))
    return named if outline_level is None else named | outline_level.isNotNull()


def document_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of a document. A plain text's headings are its short paragraphs without a closing full stop.

    Counted inside the row, without exploding: paragraphs stay where the text is and nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(text, "\n", -1)
    short = lambda p: F.length(p).between(1, 60) & ~F.endswith(p, F.lit("."))
    return docs.select(
        id_col,
        F.size(parts).cast("long").alias("paragraphs"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + word_count(p)).alias("words"),
        (F.length(text) - F.size(parts) + 1).cast("long").alias("characters"),
        F.size(F.filter(parts, short)).cast("long").alias("headings"),
        F.sha2(text, 256).alias("sha256"),
    )


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of the total order; both bounds are checked before a plan is made."""
    if offset < 0 or not 1 <= limit <= 1000:
        raise ValueError("offset must be 0 or more and limit between 1 and 1000")
    return rows.orderBy(*order).offset(offset).limit(limit)
