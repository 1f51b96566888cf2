"""Paragraphs, locator hashes and per-document summaries over the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import paragraphs as P
from docloom.session import table


def a01_document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.document_summary(table(spark, sf_dir, "documents")).select(
        "doc_id", "paragraphs", "words", "characters", "headings", "sha256"
    )


def p08_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "idx", "text")


def p06_locator_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_locator(P.paragraphs(table(spark, sf_dir, "documents"))).select(
        "doc_id", F.col("locator.paragraph_index").alias("idx"), F.col("locator.paragraph_hash").alias("paragraph_hash")
    )


def t01_inspect_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story filter, total order, page: the second hundred paragraphs of documents from one source."""
    rows = P.paragraphs(table(spark, sf_dir, "documents"), keep=["source"]).filter(F.col("source") == "src3")
    return P.page(P.with_locator(rows), ["doc_id", "idx"], offset=100, limit=200).select(
        "doc_id", "idx", "text", F.col("locator.paragraph_hash").alias("paragraph_hash")
    )


QUERIES = {f.__name__: f for f in (a01_document_summary, p08_paragraphs, p06_locator_hash, t01_inspect_page)}

_PARAGRAPHS = """
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx
  FROM documents
"""

ORACLES = {
    "a01_document_summary": f"""
        WITH p AS ({_PARAGRAPHS}),
        w AS (SELECT doc_id, count(*) AS paragraphs,
                     CAST(sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_’''-]*[\\p{{L}}\\p{{N}}\\p{{M}}_][\\p{{L}}\\p{{N}}\\p{{M}}_’''-]*'))) AS BIGINT) AS words,
                     CAST(sum(length(text)) AS BIGINT) AS characters,
                     count(*) FILTER (WHERE length(text) BETWEEN 1 AND 60 AND text NOT LIKE '%.') AS headings
              FROM p GROUP BY doc_id)
        SELECT w.doc_id, paragraphs, words, characters, headings, sha256(coalesce(d.text, '')) AS sha256
        FROM w JOIN documents d ON d.doc_id = w.doc_id""",
    "p08_paragraphs": f"SELECT doc_id, idx, text FROM ({_PARAGRAPHS})",
    "p06_locator_hash": f"SELECT doc_id, idx, sha256(replace(text, chr(13) || chr(10), chr(10))) AS paragraph_hash FROM ({_PARAGRAPHS})",
    "t01_inspect_page": f"""
        SELECT doc_id, idx, text, sha256(replace(text, chr(13) || chr(10), chr(10))) AS paragraph_hash
        FROM ({_PARAGRAPHS}) WHERE source = 'src3' ORDER BY doc_id, idx LIMIT 200 OFFSET 100""",
}
