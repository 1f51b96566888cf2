"""Queries over protected ranges, guards, field paragraphs, drawings, comments, preferences and payload rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import citations, fields, locate, protection, validation
from docloom.plans import structures
from docloom.plans.common import HITS, PARAGRAPHS, documents, long, paragraphs
from docloom.session import table


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as tokens: every "the" of a paragraph is a bookmark's begin or end by turns; bookmarks are numbered per paragraph."""
    rows = paragraphs(spark, sf_dir).select("doc_id", F.col("idx").alias("paragraph"), F.posexplode(locate.pieces(F.col("text"), F.lit("the"))).alias("k", "piece"))
    text = rows.select("doc_id", "paragraph", (F.col("k") * 2).alias("seq"), F.lit("text").alias("kind"), F.col("piece").alias("value"), F.lit(None).cast("string").alias("mark_id"))
    kind = F.when(F.col("k") % 2 == 1, "bookmark start").otherwise("bookmark end")
    mark = F.concat_ws("/", F.col("paragraph").cast("string"), F.floor((F.col("k") - 1) / 2).cast("string"))
    marks = rows.filter("k > 0").select("doc_id", "paragraph", (F.col("k") * 2 - 1).alias("seq"), kind.alias("kind"), F.lit("").alias("value"), mark.alias("mark_id"))
    return text.unionByName(marks)


def p10_protected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protection.protected_ranges(_tokens(spark, sf_dir)).select("doc_id", long("idx"), long("start"), long("end"), "kind")


def e11_insertion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in every paragraph, and whether it lies inside a "the"."""
    rows = paragraphs(spark, sf_dir).withColumn("at", ((F.col("doc_id") + F.col("idx")) % 90).cast("int"))
    hits = rows.select("doc_id", "idx", "at", F.explode_outer(locate.occurrences(F.col("text"), F.lit("the"))).alias("start"))
    error = protection.insertion_error(F.col("at"), F.col("start"), F.col("start") + 3)
    return hits.groupBy("doc_id", "idx", "at").agg(F.max(error).alias("error")).select("doc_id", long("idx"), long("at"), "error")


def e13_editable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items and paragraphs of pages as fields; the guard's other answers go by their number."""
    found = fields.nested(fields.markers(table(spark, sf_dir, "pages"), "page_id", F.col("html"), "(?:div|p|b|ul|li)"))
    error = protection.field_error(F.col("end_seq").isNotNull(), F.col("depth"), F.lit(1) + (F.col("ordinal") % 7 == 0).cast("int"), F.col("ordinal") % 5 != 0)
    return found.select(F.col("stream").alias("page_id"), long("begin_seq"), error.alias("error"))


def e14_append_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select("doc_id", "idx", "text")
    added = rows.filter("idx = 0").select("doc_id", "idx", F.when(F.col("doc_id") % 2 == 0, "References").alias("heading"), F.lit("[field]").alias("text"))
    return protection.append_fields(rows, added).select("doc_id", long("idx"), "text")


def e05_set_alt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for an order's drawings."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("description"), F.col("l_linestatus").alias("title"))
    changes = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("new").alias("description"), F.when(F.col("o_orderkey") % 2 == 0, "title").alias("title"))
    drawings = rows.groupBy("doc_id", "ordinal").agg(F.min("description").alias("description"), F.min("title").alias("title"))
    return protection.set_alt_text(drawings, changes)


def e06_add_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation are its comments; customers add theirs."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").cast("string").alias("comment_id"), F.col("s_name").alias("text"))
    new = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("place"), F.col("c_name").alias("text"))
    return protection.add_comments(old, new)


def j13_written_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document's text replaces its preference chunks; other properties stay."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = F.explode(F.array(*map(F.lit, ("ZOTERO_PREF_1", "ZOTERO_PREF_9", "Company")))).alias("name")
    properties = docs.select("doc_id", names, F.lit("old").alias("value"))
    values = docs.filter("doc_id % 3 = 0").select("doc_id", F.col("text").alias("value"))
    return citations.written_preferences(properties, values, "doc_id")


def _payload_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per document: every line is an item, sound where it ends with a full stop; lengths decide what else is wrong."""
    text = F.coalesce("text", F.lit(""))
    item = lambda line: (
        F.when(F.endswith(line, F.lit(".")), '{"id":1}').when(line == "", "5").when(F.length(line) % 3 == 0, '{"x":1}').when(F.length(line) % 3 == 1, '{"uris":"u"}').otherwise('{"itemData":[]}')
    )
    items = F.when(text == "", "").otherwise(F.array_join(F.transform(F.split(text, "\n", -1), item), ","))
    whole = F.concat(F.lit('{"citationItems":['), items, F.lit("]"), F.when(F.length(text) % 5 == 1, ',"properties":3').otherwise(""), F.lit("}"))
    payload = F.when(F.length(text) % 11 == 2, "[1]").when(F.length(text) % 11 == 3, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    found = citations.payload_findings(documents(spark, sf_dir).select("doc_id", payload.alias("payload")), ["doc_id"])
    return found.select("doc_id", long("item"), "message")


def v04_payload_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payload_findings(spark, sf_dir)


def v05_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers in one report: relationships of orders, marks of line items and fields of pages, payloads of documents."""
    rels, parts = structures._relationships(spark, sf_dir)
    marks = structures._marks(spark, sf_dir)
    balances = fields.balance(structures._markers(spark, sf_dir)).select(F.col("stream").cast("string").alias("doc_path"), F.lit("body").alias("story"), "unmatched_ends", "unclosed")
    payloads = validation.finding(_payload_findings(spark, sf_dir).withColumn("doc_path", F.col("doc_id").cast("string")), "zotero", "error", F.col("message"))
    found = validation.united([validation.dangling(rels, parts), validation.external(rels), validation.semantic(marks), validation.field_findings(balances), payloads])
    paths = [rels.select("doc_path"), marks.select("doc_path"), balances.select("doc_path"), documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_path"))]
    return validation.report(found, validation.united(paths).distinct())


def v02_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as revisions: some without an id, some without an author."""
    kinds = F.element_at(F.array(*map(F.lit, ("ins", "del", "moveFrom", "moveTo", "bookmark start"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_path"), F.concat(F.lit("story "), "l_linestatus").alias("story"), kinds.alias("kind"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey").cast("string")).alias("mark_id"), F.when(F.col("l_suppkey") % 3 != 0, "someone").alias("author"),
    )
    return validation.revision_findings(rows)


QUERIES = {
    f.__name__: f
    for f in (p10_protected_ranges, e11_insertion_guard, e13_editable_fields, e14_append_fields, e05_set_alt_text, e06_add_comments, j13_written_preferences, v04_payload_findings, v05_report, v02_revisions)
}

#: Offsets in a text without its "the"s.
_MARKS = f"SELECT doc_id, idx, occurrence AS k, start - 3 * (occurrence - 1) AS spot FROM ({HITS})"

ORACLES = {
    "p10_protected_ranges": f"""
        WITH m AS ({_MARKS}),
        p AS (SELECT doc_id, idx, length(replace(text, 'the', '')) AS size, max(idx) OVER (PARTITION BY doc_id) AS last FROM ({PARAGRAPHS})),
        b AS (SELECT s.doc_id, s.idx, s.spot AS first_at, e.spot AS last_at FROM m s LEFT JOIN m e ON e.doc_id = s.doc_id AND e.idx = s.idx AND e.k = s.k + 1 WHERE s.k % 2 = 1)
        SELECT DISTINCT * FROM (
          SELECT b.doc_id, b.idx, first_at AS start, last_at AS "end", 'bookmark' AS kind FROM b WHERE last_at IS NOT NULL
          UNION ALL SELECT b.doc_id, p.idx, CASE WHEN p.idx = b.idx THEN first_at ELSE 0 END, p.size, 'unbalanced-bookmark'
            FROM b JOIN p ON p.doc_id = b.doc_id AND p.idx >= b.idx WHERE last_at IS NULL
          UNION ALL SELECT doc_id, idx, spot, spot, 'bookmark-boundary' FROM m)""",
    "e11_insertion_guard": f"""
        SELECT p.doc_id, p.idx, (p.doc_id + p.idx) % 90 AS at, max(CASE WHEN start < (p.doc_id + p.idx) % 90 AND (p.doc_id + p.idx) % 90 < start + 3 THEN 'PROTECTED_BOUNDARY' END) AS error
        FROM ({PARAGRAPHS}) p LEFT JOIN ({HITS}) h ON h.doc_id = p.doc_id AND h.idx = p.idx GROUP BY p.doc_id, p.idx""",
    "e13_editable_fields": f"""
        SELECT page_id, begin_seq, CASE WHEN end_seq < 0 OR depth > 0 OR ordinal % 7 = 0 OR ordinal % 5 = 0 THEN 'PROTECTED_BOUNDARY' END AS error
        FROM ({structures.ORACLES["f01_nested_fields"]})""",
    "e14_append_fields": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS idx, text
        FROM (SELECT doc_id, idx * 3 AS place, text FROM ({PARAGRAPHS}) UNION ALL SELECT doc_id, 1, 'References' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2, '[field]' FROM documents)""",
    "e05_set_alt_text": """
        WITH d AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, min(l_returnflag) AS description, min(l_linestatus) AS title FROM lineitem GROUP BY 1, 2),
        f AS (SELECT *, doc_id % 3 = 0 AND doc_id IN (SELECT o_orderkey FROM orders) AND ordinal = min(ordinal) OVER (PARTITION BY doc_id) AS hit FROM d)
        SELECT doc_id, ordinal, CASE WHEN hit THEN 'new' ELSE description END AS description, CASE WHEN hit THEN CASE WHEN doc_id % 2 = 0 THEN 'title' END ELSE title END AS title FROM f""",
    "e06_add_comments": """
        WITH n AS (SELECT s_nationkey, max(s_suppkey) + 1 AS next FROM supplier GROUP BY 1)
        SELECT s_nationkey AS doc_id, CAST(s_suppkey AS VARCHAR) AS comment_id, s_name AS text FROM supplier
        UNION ALL SELECT c_nationkey, CAST(coalesce(next, 0) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS VARCHAR), c_name
        FROM customer LEFT JOIN n ON s_nationkey = c_nationkey""",
    "j13_written_preferences": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, name, 'old' AS value FROM (SELECT doc_id, unnest(['ZOTERO_PREF_1', 'ZOTERO_PREF_9', 'Company']) AS name FROM d) WHERE doc_id % 3 <> 0 OR name = 'Company'
        UNION ALL SELECT doc_id, 'ZOTERO_PREF_' || k, value
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).{1,255}')) AS value, generate_subscripts(regexp_extract_all(text, '(?s).{1,255}'), 1) AS k FROM d WHERE doc_id % 3 = 0 AND text <> '')
        UNION ALL SELECT doc_id, 'ZOTERO_PREF_1', '' FROM d WHERE doc_id % 3 = 0 AND text = ''""",
    "v04_payload_findings": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents), w AS (SELECT * FROM d WHERE n % 11 NOT IN (2, 3))
        SELECT doc_id, CAST(-1 AS BIGINT) AS item, 'payload is not an object' AS message FROM d WHERE n % 11 IN (2, 3)
        UNION ALL SELECT doc_id, -1, 'citationItems is empty' FROM w WHERE text = ''
        UNION ALL SELECT doc_id, -1, 'properties is not an object' FROM w WHERE n % 5 = 1
        UNION ALL SELECT p.doc_id, idx, CASE WHEN p.text = '' THEN 'item is not an object' ELSE ['item without id, uris or itemData', 'uris is not an array', 'itemData is not an object'][length(p.text) % 3 + 1] END
          FROM ({PARAGRAPHS}) p JOIN w ON w.doc_id = p.doc_id WHERE w.text <> '' AND p.text NOT LIKE '%.'""",
}
ORACLES["v05_report"] = f"""
    WITH f AS ({structures.ORACLES["v01_dangling"]}
      UNION ALL (SELECT * FROM ({structures.ORACLES["v02_marker_diff"]}))
      UNION ALL SELECT CAST(page_id AS VARCHAR), 'semantic', 'error', 'body: field ends without a begin: ' || unmatched_ends FROM ({structures.ORACLES["f02_field_balance"]}) WHERE unmatched_ends > 0
      UNION ALL SELECT CAST(page_id AS VARCHAR), 'semantic', 'error', 'body: fields not closed: ' || unclosed FROM ({structures.ORACLES["f02_field_balance"]}) WHERE unclosed > 0
      UNION ALL SELECT CAST(doc_id AS VARCHAR), 'zotero', 'error', message FROM ({ORACLES["v04_payload_findings"]})),
    r AS (SELECT doc_path, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
                 array_to_string(list_sort(list(DISTINCT layer || ': ' || message) FILTER (WHERE severity = 'error'))[1:5], '; ') AS summary FROM f GROUP BY doc_path),
    p AS (SELECT DISTINCT * FROM (SELECT CAST(o_orderkey AS VARCHAR) AS doc_path FROM orders UNION ALL SELECT CAST(l_orderkey % 500 AS VARCHAR) FROM lineitem
          UNION ALL SELECT CAST(page_id AS VARCHAR) FROM ({structures.ORACLES["f02_field_balance"]}) UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents))
    SELECT p.doc_path, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(summary, '') AS summary FROM p LEFT JOIN r ON r.doc_path = p.doc_path"""
ORACLES["v02_revisions"] = """
    WITH m AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_path, 'story ' || l_linestatus AS story, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS id, l_suppkey % 3 <> 0 AS named FROM lineitem WHERE l_linenumber % 5 <> 4)
    SELECT doc_path, 'semantic' AS layer, 'error' AS severity, story || ': revision without an id' AS message FROM m WHERE id IS NULL
    UNION ALL SELECT doc_path, 'semantic', 'warning', story || ': revision without an author: ' || coalesce(id, '?') FROM m WHERE NOT named"""
