"""Queries over structure: nested fields, packages and their parts, validation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import fields, validation
from docloom.plans.common import PARAGRAPHS, documents, long
from docloom.session import table
from docloom.sources import packages


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.markers(table(spark, sf_dir, "pages"), "page_id", F.col("html"), "(?:div|p|b|ul|li)")


def f02_field_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.balance(_markers(spark, sf_dir)).withColumnRenamed("stream", "page_id")


def f01_nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fields.nested(_markers(spark, sf_dir))
    return found.select(F.col("stream").alias("page_id"), long("begin_seq"), F.coalesce(long("end_seq"), F.lit(-1)).alias("end_seq"), "depth", long("ordinal"))


def f03_field_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.warnings(_markers(spark, sf_dir)).select(F.col("stream").alias("page_id"), long("seq"), "warning")


def f04_strict_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fields.strict(_markers(spark, sf_dir)).withColumn("error", F.coalesce("error", F.lit("")))
    return found.groupBy(F.col("stream").alias("page_id"), "error").agg(F.count("begin_seq").alias("fields"))


def f06_unique_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields are line items known by their part; each part is asked for, some beyond those there are."""
    wanted = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("l_partkey"))
    return fields.unique(table(spark, sf_dir, "lineitem").select("l_partkey"), wanted, "l_partkey")


def l06_shown_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as token streams: some tags begin and end fields, a link separates, a heading or an item of a list begins a paragraph."""
    kinds = [(r"^<(?:div|p|b|ul|li)[\s>]", "field begin"), (r"^</(?:div|p|b|ul|li)>", "field end"), (r"^<a\s", "field separate"), ("^[^<]", "text")]
    value = F.col("value")
    kind = F.coalesce(*[F.when(F.regexp_like(value, F.lit(pattern)), name) for pattern, name in kinds], F.lit("other"))
    pieces = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<[^>]*>|[^<]+"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_path"), F.lit("html").alias("part_name"), F.posexplode(pieces).alias("seq", "value"))
    begun = F.sum(F.regexp_like(value, F.lit(r"^<(?:h\d|li)[\s>]")).cast("int")).over(Window.partitionBy("doc_path").orderBy("seq"))
    found = packages.shown_paragraphs(rows.select("doc_path", "part_name", "seq", "value", kind.alias("kind"), begun.alias("paragraph"), F.lit(False).alias("deleted")))
    return found.select(F.col("doc_path").cast("long").alias("page_id"), long("idx"), "text")


def s01_package_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as packages, opened again, their main parts found and read."""
    opened = packages.parts(packages.packages_of(documents(spark, sf_dir)))
    found = packages.paragraph_texts(opened.filter("part_name = 'word/document.xml'"))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), long("idx"), F.sha2("text", 256).alias("text_sha256"))


def k01_rewritten_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is added to every third package; the others keep their bytes."""
    whole = packages.packages_of(documents(spark, sf_dir))
    changes = whole.filter(F.col("doc_path").cast("long") % 3 == 0).select("doc_path", F.lit("docProps/note.xml").alias("part_name"), F.encode(F.lit("<n/>"), "UTF-8").alias("data"))
    written = packages.rewritten(whole, changes)
    after = packages.parts(written).groupBy("doc_path").agg(F.count("part_name").alias("parts"))
    same = whole.select("doc_path", F.sha2("content", 256).alias("before")).join(written.select("doc_path", F.sha2("content", 256).alias("after")), "doc_path")
    return same.join(after, "doc_path").select(F.col("doc_path").cast("long").alias("doc_id"), "parts", (F.col("before") == F.col("after")).alias("unchanged"))


def s10_resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, taken as relative to the page's own path, and its letters beyond ASCII escaped."""
    found = F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="/?([^"]*)"'), F.lit(1))).alias("k", "target")
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^:]*://[^/?#]*/?([^?#]*)", 1).alias("path"), found)
    escaped = F.replace(F.url_encode("target"), F.lit("+"), F.lit("%20"))
    return rows.select("page_id", long("k"), packages.resolved_target(F.col("path"), F.col("target")).alias("part_name"), packages.resolved_target(F.col("path"), escaped).alias("from_escaped"))


def _relationships(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order is a package; its customer is a part it points to, which only orders of open status hold."""
    orders = table(spark, sf_dir, "orders")
    path = F.col("o_orderkey").cast("string").alias("doc_path")
    rels = orders.select(path, F.concat(F.lit("rId"), "o_custkey").alias("rel_id"), F.concat(F.lit("word/c"), "o_custkey", F.lit(".xml")).alias("part_name"), F.concat(F.lit("c"), "o_custkey").alias("target"), F.when(F.col("o_orderkey") % 10 == 0, "External").alias("target_mode"))
    parts = orders.filter("o_orderstatus <> 'F'").select(path, F.concat(F.lit("word/c"), "o_custkey", F.lit(".xml")).alias("part_name"))
    return rels, parts


def v01_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels, parts = _relationships(spark, sf_dir)
    return validation.united([validation.dangling(rels, parts), validation.external(rels)])


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of line items: the kind by line number and key, the id by supplier."""
    kinds = ["comment", "comment start", "comment end", "comment reference", "bookmark start", "bookmark end"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5, F.lit(6)) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).cast("string").alias("doc_path"), (F.col("l_suppkey") % 9).cast("string").alias("mark_id"), kind.alias("kind"))


def v02_marker_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.semantic(_marks(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (f02_field_balance, f01_nested_fields, f03_field_warnings, f04_strict_fields, f06_unique_field, l06_shown_paragraphs, s01_package_paragraphs, k01_rewritten_packages, s10_resolved_targets, v01_dangling, v02_marker_diff)
}

_TAGS = r"'</?(?:div|p|b|ul|li)(?:\s[^>]*)?>'"
_DEPTHS = f"""
  WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, {_TAGS})) AS m, generate_subscripts(regexp_extract_all(html, {_TAGS}), 1) - 1 AS seq FROM pages),
  s AS (SELECT page_id, seq, CASE WHEN starts_with(m, '</') THEN -1 ELSE 1 END AS step FROM t),
  u AS (SELECT *, CAST(sum(step) OVER (PARTITION BY page_id ORDER BY seq) AS BIGINT) AS total FROM s),
  v AS (SELECT *, least(0, min(total) OVER (PARTITION BY page_id ORDER BY seq)) AS low FROM u),
  d AS (SELECT *, total - low AS depth, step < 0 AND low < coalesce(lag(low) OVER (PARTITION BY page_id ORDER BY seq), 0) AS stray FROM v)
"""
_MARKS = """
  SELECT CAST(l_orderkey % 500 AS VARCHAR) AS doc_path, CAST(l_suppkey % 9 AS VARCHAR) AS mark_id,
         ['comment', 'comment start', 'comment end', 'comment reference', 'bookmark start', 'bookmark end'][(l_orderkey * 7 + l_linenumber * 5) % 6 + 1] AS kind
  FROM lineitem"""
_SEMANTIC = f"""
  WITH m AS ({_MARKS}),
  k AS (SELECT doc_path, mark_id, count(*) FILTER (WHERE kind = 'comment') AS c, count(*) FILTER (WHERE kind = 'comment start') > 0 AS cs, count(*) FILTER (WHERE kind = 'comment end') > 0 AS ce,
               count(*) FILTER (WHERE kind = 'comment reference') > 0 AS cr, count(*) FILTER (WHERE kind = 'bookmark start') > 0 AS bs, count(*) FILTER (WHERE kind = 'bookmark end') > 0 AS be
        FROM m GROUP BY doc_path, mark_id)
  SELECT doc_path, 'semantic' AS layer, 'error' AS severity, 'duplicate comment id ' || mark_id AS message FROM k WHERE c > 1
  UNION ALL SELECT doc_path, 'semantic', 'error', 'comment marker without a comment ' || mark_id FROM k WHERE (cs OR ce OR cr) AND c = 0
  UNION ALL SELECT doc_path, 'semantic', 'warning', 'comment without a reference ' || mark_id FROM k WHERE c > 0 AND NOT cr
  UNION ALL SELECT doc_path, 'semantic', 'error', 'comment range with one end ' || mark_id FROM k WHERE cs <> ce
  UNION ALL SELECT doc_path, 'semantic', 'error', 'bookmark with one end ' || mark_id FROM k WHERE bs <> be"""

ORACLES = {
    "f02_field_balance": f"""
        {_DEPTHS} SELECT page_id, count(*) AS markers, count(*) FILTER (WHERE stray) AS unmatched_ends, max_by(depth, seq) AS unclosed, max(depth) AS max_depth FROM d GROUP BY page_id""",
    "f01_nested_fields": f"""
        {_DEPTHS}, k AS (SELECT *, CASE WHEN step > 0 THEN depth ELSE depth + 1 END AS level FROM d WHERE NOT stray),
        n AS (SELECT *, lead(step) OVER w AS next_step, lead(seq) OVER w AS next_seq FROM k WINDOW w AS (PARTITION BY page_id, level ORDER BY seq))
        SELECT page_id, seq AS begin_seq, CASE WHEN next_step < 0 THEN next_seq ELSE -1 END AS end_seq, level - 1 AS depth, row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1 AS ordinal
        FROM n WHERE step > 0""",
    "f03_field_warnings": f"""
        {_DEPTHS}, k AS (SELECT *, CASE WHEN step > 0 THEN depth ELSE depth + 1 END AS level FROM d WHERE NOT stray),
        n AS (SELECT *, lead(step) OVER (PARTITION BY page_id, level ORDER BY seq) AS next_step FROM k)
        SELECT page_id, seq, 'end without a begin' AS warning FROM d WHERE stray
        UNION ALL SELECT page_id, seq, 'begin without an end' FROM n WHERE step > 0 AND coalesce(next_step, 1) > 0""",
    "f04_strict_fields": f"""
        {_DEPTHS}, b AS (SELECT page_id, count(*) FILTER (WHERE stray) + max_by(depth, seq) > 0 AS bad, count(*) FILTER (WHERE step > 0) AS begins FROM d GROUP BY page_id)
        SELECT page_id, CASE WHEN bad THEN 'PROTECTED_BOUNDARY' ELSE '' END AS error, CASE WHEN bad THEN 0 ELSE begins END AS fields FROM b WHERE bad OR begins > 0""",
    "f06_unique_field": """
        SELECT p_partkey * 2 AS l_partkey, count(l.l_partkey) AS fields,
               CASE WHEN count(l.l_partkey) = 0 THEN 'REFERENCE_UNRESOLVED' WHEN count(l.l_partkey) > 1 THEN 'ANCHOR_AMBIGUOUS' END AS error
        FROM part LEFT JOIN lineitem l ON l.l_partkey = p_partkey * 2 GROUP BY p_partkey""",
    "l06_shown_paragraphs": """
        WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[^>]*>|[^<]+')) AS v, generate_subscripts(regexp_extract_all(html, '<[^>]*>|[^<]+'), 1) AS seq FROM pages),
        k AS (SELECT *, CASE WHEN regexp_matches(v, '^<(div|p|b|ul|li)[\\s>]') THEN 1 WHEN regexp_matches(v, '^</(div|p|b|ul|li)>') THEN -1 ELSE 0 END AS step, regexp_matches(v, '^<a\\s') AS parts,
                     sum(regexp_matches(v, '^<(h\\d|li)[\\s>]')::INT) OVER (PARTITION BY page_id ORDER BY seq) AS idx FROM t),
        u AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY seq) AS total FROM k),
        d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY seq)) AS depth FROM u),
        -- A begin lasts until the depth falls below its own; its separator is the first one at its depth until then.
        b AS (SELECT page_id, seq, depth FROM d WHERE step = 1),
        e AS (SELECT b.page_id, b.seq, min(CASE WHEN d.depth < b.depth OR d.parts AND d.depth = b.depth THEN d.seq END) AS until
              FROM b JOIN d ON d.page_id = b.page_id AND d.seq > b.seq GROUP BY b.page_id, b.seq)
        SELECT d.page_id, CAST(idx AS BIGINT) AS idx, string_agg(CASE WHEN v NOT LIKE '<%' AND NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = d.page_id AND e.seq < d.seq AND (e.until IS NULL OR e.until > d.seq)) THEN v ELSE '' END, '' ORDER BY d.seq) AS text
        FROM d GROUP BY d.page_id, idx""",
    "s01_package_paragraphs": f"SELECT doc_id, idx, sha256(text) AS text_sha256 FROM ({PARAGRAPHS})",
    "k01_rewritten_packages": "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END AS BIGINT) AS parts, doc_id % 3 <> 0 AS unchanged FROM documents",
    "s10_resolved_targets": """
        SELECT page_id, k, CASE WHEN NOT regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN folder || regexp_replace(target, '[?#].*$', '') END AS part_name, folder || target AS from_escaped
        FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1), '^(.*/)?', 0) AS folder, unnest(regexp_extract_all(html, 'href="/?([^"]*)"', 1)) AS target,
                     generate_subscripts(regexp_extract_all(html, 'href="/?([^"]*)"', 1), 1) - 1 AS k FROM pages)""",
    "v01_dangling": """
        SELECT CAST(o_orderkey AS VARCHAR) AS doc_path, 'package' AS layer, 'error' AS severity, 'relationship rId' || o_custkey || ' targets a missing part: word/c' || o_custkey || '.xml' AS message
        FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 <> 0
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'package', 'warning', 'external relationship not fetched: rId' || o_custkey FROM orders WHERE o_orderkey % 10 = 0""",
    "v02_marker_diff": _SEMANTIC,
}
