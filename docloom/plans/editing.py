"""Queries that edit text: single edits, new paragraphs, ordered batches, free ids, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import edits, locate
from docloom.plans.common import PARAGRAPHS, documents, long, paragraphs
from docloom.session import table


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("doc_id", "idx", "text")


def e01_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the start, the end, or before or after the first "the", by turns; without a place the text stays null."""
    text = F.col("text")
    at = locate.nth_occurrence(text, F.lit("the"), F.lit(1))
    position = F.element_at(F.array(*map(F.lit, ("start", "end", "before", "after"))), ((F.col("doc_id") + F.col("idx")) % 4 + 1).cast("int"))
    point = edits.insertion_point(position, at, at + 3, F.length(text))
    return _targets(spark, sf_dir).select("doc_id", long("idx"), edits.insert_at(text, point, F.lit(" Added.")).alias("text"))


def e02_replace_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = edits.replace_nth(F.col("text"), F.lit("the"), F.lit("THE"), F.lit(2))
    return _targets(spark, sf_dir).select("doc_id", long("idx"), changed.alias("text")).filter("text IS NOT NULL")


def e03_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = edits.delete_nth(F.col("text"), F.lit("the"), F.lit(1))
    return _targets(spark, sf_dir).select("doc_id", long("idx"), changed.alias("text")).filter("text IS NOT NULL")


def e02_tracked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every first "the" replaced as a tracked change: a deletion and an insertion, numbered within the document after 41."""
    hits = _targets(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    changes = hits.select("doc_id", F.col("idx").alias("place"), F.lit("the").alias("deleted"), F.when(F.col("idx") % 3 != 0, "oak").alias("inserted"), F.lit("editor").alias("author"))
    used = documents(spark, sf_dir).filter("doc_id % 2 = 0").select("doc_id", F.lit("41").alias("revision_id"))
    return edits.revisions(changes, used, ["doc_id"]).select("doc_id", long("place"), "kind", "text", "author", "revision_id")


def e04_insert_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select("doc_id", "idx", "text")
    added = rows.filter("idx = 0").select("doc_id", "idx", F.when(F.col("doc_id") % 2 == 0, "before").otherwise("after").alias("position"), F.lit("New paragraph").alias("text"))
    return edits.insert_paragraphs(rows, added).select("doc_id", long("idx"), "text", "added")


def e16_edit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three operations on every document, each on what the one before left; a document without the texts keeps its own."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = [("replace_text", "the", "oak", None, 1), ("insert_text", "oak", " Added.", "after", 1), ("delete_text", "and", "", None, 1)]
    operations = docs.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("op_index"), *[F.lit(v).cast(t).alias(n) for n, v, t in zip(("type", "text", "replacement", "position", "occurrence"), s, ("string",) * 4 + ("int",), strict=True)])
        for k, s in enumerate(steps)
    ])).alias("op")).select("doc_id", "op.*")
    done = edits.apply_batch(docs, operations, ["doc_id"])
    return done.select("doc_id", F.sha2("text", 256).alias("sha256"), "error", long("applied"))


def k05_lowest_free_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship ids in use per order: its lines' numbers without each third."""
    used = table(spark, sf_dir, "lineitem").filter("(l_orderkey + l_linenumber) % 3 <> 0").select("l_orderkey", "l_linenumber")
    return edits.lowest_free(used, ["l_orderkey"], "l_linenumber").select("l_orderkey", long("free_id"))


def e09_next_revision_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are texts; those that are no number don't count."""
    ids = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("x"), F.col("o_orderkey"))).otherwise(F.col("o_orderkey").cast("string")).alias("id"))
    return edits.next_id(ids, ["o_custkey"], "id")


def e15_instruction_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(edits.instruction_chunks(F.col("text"))).alias("k", "chunk"))
    return rows.select("doc_id", long("k"), F.sha2("chunk", 256).alias("chunk_sha256"))


QUERIES = {
    f.__name__: f
    for f in (e01_insert, e02_replace_nth, e02_tracked_rows, e03_delete, e04_insert_paragraph, e16_edit_batch, k05_lowest_free_id, e09_next_revision_id, e15_instruction_chunks)
}

_TARGETS = f"SELECT doc_id, idx, text, string_split(text, 'the') AS parts FROM ({PARAGRAPHS})"

ORACLES = {
    "e01_insert": f"""
        SELECT doc_id, idx, CASE (doc_id + idx) % 4 WHEN 0 THEN ' Added.' || text WHEN 1 THEN text || ' Added.'
               WHEN 2 THEN CASE WHEN len(parts) > 1 THEN parts[1] || ' Added.the' || array_to_string(parts[2:], 'the') END
               ELSE CASE WHEN len(parts) > 1 THEN parts[1] || 'the Added.' || array_to_string(parts[2:], 'the') END END AS text
        FROM ({_TARGETS})""",
    "e02_replace_nth": f"SELECT doc_id, idx, array_to_string(parts[1:2], 'the') || 'THE' || array_to_string(parts[3:], 'the') AS text FROM ({_TARGETS}) WHERE len(parts) > 2",
    "e02_tracked_rows": f"""
        WITH r AS (SELECT doc_id, idx AS place, unnest([{{'k': 0, 'kind': 'del', 'text': 'the'}}, {{'k': 1, 'kind': 'ins', 'text': 'oak'}}]) AS r FROM ({PARAGRAPHS}) WHERE contains(text, 'the'))
        SELECT doc_id, place, r.kind AS kind, r.text AS text, 'editor' AS author,
               CASE WHEN doc_id % 2 = 0 THEN 42 ELSE 0 END + row_number() OVER (PARTITION BY doc_id ORDER BY place, r.k) - 1 AS revision_id
        FROM r WHERE r.k = 0 OR place % 3 <> 0""",
    "e03_delete": f"SELECT doc_id, idx, parts[1] || array_to_string(parts[2:], 'the') AS text FROM ({_TARGETS}) WHERE len(parts) > 1",
    "e04_insert_paragraph": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS idx, text, added
        FROM (SELECT doc_id, idx * 3 + 1 AS place, text, false AS added FROM ({PARAGRAPHS})
              UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 2 END, 'New paragraph', true FROM documents)""",
    "e16_edit_batch": """
        WITH a AS (SELECT doc_id, coalesce(text, '') AS text, strpos(coalesce(text, ''), 'the') AS p FROM documents),
        b AS (SELECT doc_id, text, p, CASE WHEN p > 0 THEN left(text, p - 1) || 'oak' || substr(text, p + 3) END AS t1 FROM a),
        c AS (SELECT doc_id, text, p, CASE WHEN p > 0 THEN left(t1, strpos(t1, 'oak') + 2) || ' Added.' || substr(t1, strpos(t1, 'oak') + 3) END AS t2 FROM b),
        d AS (SELECT doc_id, text, p, strpos(t2, 'and') AS q, t2 FROM c)
        SELECT doc_id, sha256(CASE WHEN p > 0 AND q > 0 THEN left(t2, q - 1) || substr(t2, q + 3) ELSE text END) AS sha256,
               CASE WHEN p > 0 AND q > 0 THEN NULL ELSE 'ANCHOR_NOT_FOUND' END AS error, CAST(CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN 2 ELSE 3 END AS BIGINT) AS applied
        FROM d""",
    "k05_lowest_free_id": """
        WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey + l_linenumber) % 3 <> 0),
        g AS (SELECT l_orderkey, unnest(generate_series(1, max(l_linenumber) + 1)) AS id FROM u GROUP BY l_orderkey)
        SELECT l_orderkey, min(id) AS free_id FROM g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.l_orderkey = g.l_orderkey AND u.l_linenumber = g.id) GROUP BY l_orderkey""",
    "e09_next_revision_id": """
        SELECT o_custkey, coalesce(max(try_cast(CASE WHEN o_orderkey % 4 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS BIGINT)), -1) + 1 AS next_id
        FROM orders GROUP BY o_custkey""",
    "e15_instruction_chunks": """
        SELECT doc_id, k, sha256(chunk) AS chunk_sha256
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).{1,240}')) AS chunk, generate_subscripts(regexp_extract_all(text, '(?s).{1,240}'), 1) - 1 AS k FROM documents)""",
}
