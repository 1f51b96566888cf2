"""Shared pieces of the document queries: paragraphs of ``documents`` in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import paragraphs as P
from docloom.session import table

PARAGRAPHS = """
  SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx
  FROM documents
"""

#: Occurrences of "the": non-overlapping, from the lengths of the pieces around them.
HITS = f"""
  SELECT doc_id, idx, k AS occurrence, start FROM (
    SELECT doc_id, idx, k, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, idx ORDER BY k) + (k - 1) * 3 AS BIGINT) AS start,
           count(*) OVER (PARTITION BY doc_id, idx) AS pieces
    FROM (SELECT doc_id, idx, unnest(string_split(text, 'the')) AS piece, generate_subscripts(string_split(text, 'the'), 1) AS k FROM ({PARAGRAPHS})))
  WHERE k < pieces
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paragraphs(documents(spark, sf_dir), keep=["source", "lang"])


def long(name: str):
    return F.col(name).cast("long").alias(name)
