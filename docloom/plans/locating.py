"""Queries that locate text: occurrences, locators, overlaps, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import locate
from docloom.operators.paragraphs import locator_hash
from docloom.plans.common import HITS, PARAGRAPHS, documents, long, paragraphs


def l01_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    hits = rows.select("doc_id", "idx", F.posexplode(locate.occurrences(F.col("text"), F.lit("the"))).alias("k", "start"))
    return hits.select("doc_id", long("idx"), (F.col("k") + 1).cast("long").alias("occurrence"), long("start"))


def l02_resolve_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per document, without a span (-1) where it fails: some with the right hash, some with an old one, some for a story that isn't there."""
    rows = paragraphs(spark, sf_dir).withColumn("story", F.lit("body")).withColumn("paragraph_hash", locator_hash(F.col("text")))
    docs = rows.filter("idx = 0").select("doc_id").distinct()
    hashes = rows.select("doc_id", F.col("idx").alias("paragraph_index"), F.col("paragraph_hash").alias("right"))
    asked = docs.select(
        F.col("doc_id").alias("req_id"), "doc_id", F.when(F.col("doc_id") % 11 == 0, "header").otherwise("body").alias("story"), (F.col("doc_id") % 7).cast("int").alias("paragraph_index"),
        F.when(F.col("doc_id") % 5 != 0, "the").alias("exact_text"), (F.col("doc_id") % 4 + 1).cast("int").alias("occurrence"),
        F.when(F.col("doc_id") % 2 == 0, " ").alias("prefix"), F.when(F.col("doc_id") % 3 == 0, " ").alias("suffix"),
    ).join(hashes, ["doc_id", "paragraph_index"], "left")
    kind = F.col("doc_id") % 6
    asked = asked.withColumn("paragraph_hash", F.when(kind == 1, F.col("right")).when(kind == 2, F.lit("0" * 64)).when(kind == 3, F.upper(F.substring("right", 1, 16)))).drop("right")
    stories = docs.withColumn("story", F.lit("body")).withColumn("parts", F.lit(1))
    return locate.resolve(asked, rows, stories).select("req_id", "error", F.coalesce(long("start"), F.lit(-1)).alias("start"), F.coalesce(long("end"), F.lit(-1)).alias("end"))


def l07_locator_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators as JSON, good and bad ones, and the parts their stories mean."""
    n = F.col("n_chars")
    story = F.element_at(F.array(*map(F.lit, ("body", "footnote", "endnote", "header"))), (n % 4 + 1).cast("int"))
    told = F.element_at(F.array(*map(F.lit, (None, "document.xml", "/word/footnotes.xml", ""))), (n % 5).cast("int") % 4 + 1)
    digest = F.when(n % 3 == 0, F.upper(F.substring(F.sha2("text", 256), 1, 16))).when(n % 3 == 1, "abc")
    said = F.struct(story.alias("story"), told.alias("story_part"), (n % 9 - 1).alias("paragraph_index"), digest.alias("paragraph_hash"), F.when(n % 7 == 0, n % 2).alias("occurrence"))
    rows = documents(spark, sf_dir).select("doc_id", locate.locator_mapping(F.to_json(said)).alias("l"))
    part = locate.story_part(F.col("l.story"), F.col("l.story_part"))
    return rows.select("doc_id", "l.story", F.col("l.paragraph_index").cast("long").alias("paragraph_index"), "l.paragraph_hash", F.col("l.occurrence").cast("long").alias("occurrence"), F.col("l.error").alias("error"), part["part_name"].alias("part_name"), part["error"].alias("part_error"))


def l03_nth_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).withColumn("start", locate.nth_occurrence(F.col("text"), F.lit("the"), F.lit(3)))
    return rows.filter("start IS NOT NULL").select("doc_id", long("idx"), long("start"), (F.col("start") + 3).cast("long").alias("end"))


def l05_anchor_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second "the" of every paragraph that has one, if a blank stands before it and, by turns, behind it."""
    rows = paragraphs(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    suffix = F.when(F.col("doc_id") % 2 == 0, " ")
    found = rows.select("doc_id", "idx", locate.anchor(F.col("text"), F.lit("the"), F.lit(2), F.lit(" "), suffix).alias("a"))
    return found.select("doc_id", long("idx"), F.coalesce(F.col("a.start"), F.lit(-1)).cast("long").alias("start"), F.coalesce(F.col("a.end"), F.lit(-1)).cast("long").alias("end"), "a.error")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit per paragraph; a quarter of them have no width."""
    a = ((F.col("doc_id") + F.col("idx")) % 50).cast("int")
    return paragraphs(spark, sf_dir).select("doc_id", "idx", a.alias("a"), (a + F.col("doc_id") % 4).cast("int").alias("b"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every "the" is protected; each fourth has a boundary of no width at its begin as well."""
    rows = paragraphs(spark, sf_dir)
    hits = rows.select("doc_id", "idx", F.posexplode(locate.occurrences(F.col("text"), F.lit("the"))).alias("k", "start"))
    wide = hits.select("doc_id", "idx", "start", (F.col("start") + 3).alias("end"), F.lit("field").alias("kind"))
    thin = hits.filter("(k + 1) % 4 = 0").select("doc_id", "idx", "start", F.col("start").alias("end"), F.lit("bookmark-boundary").alias("kind"))
    return wide.unionByName(thin)


def p13_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = locate.overlap_join(_edits(spark, sf_dir), _ranges(spark, sf_dir), ["doc_id", "idx"])
    return met.select("doc_id", long("idx"), long("a"), long("b"), long("start"), long("end"), "kind")


def p14_assert_editable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.editable(_edits(spark, sf_dir), _ranges(spark, sf_dir), ["doc_id", "idx"]).select("doc_id", long("idx"), long("a"), long("b"), "kinds", "error")


def p12_tidy_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges listed twice over come back once and in order."""
    ranges = _ranges(spark, sf_dir)
    rows = ranges.unionByName(ranges).groupBy("doc_id", "idx").agg(locate.tidy_ranges(F.collect_list(F.struct("start", "end", "kind"))).alias("ranges"))
    return rows.select("doc_id", long("idx"), F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"), r["kind"])), ",").alias("ranges"))


def p11_span_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir)
    spans = rows.filter("idx = 0").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("first"), F.lit(2).alias("first_at"), (F.col("doc_id") % 3 + F.col("doc_id") % 5).cast("int").alias("last"), F.lit(9).alias("last_at"), F.lit("bookmark").alias("kind"))
    return locate.split_spans(spans, rows).select("doc_id", long("idx"), long("start"), long("end"), "kind")


QUERIES = {f.__name__: f for f in (l01_occurrences, l02_resolve_locator, l07_locator_mappings, l03_nth_span, l05_anchor_span, p13_overlap_join, p14_assert_editable, p12_tidy_ranges, p11_span_split)}

_EDITS = f"SELECT doc_id, idx, (doc_id + idx) % 50 AS a, (doc_id + idx) % 50 + doc_id % 4 AS b FROM ({PARAGRAPHS})"
_RANGES = f"""
  SELECT doc_id, idx, start, start + 3 AS "end", 'field' AS kind FROM ({HITS})
  UNION ALL SELECT doc_id, idx, start, start, 'bookmark-boundary' FROM ({HITS}) WHERE occurrence % 4 = 0"""
_MET = """CASE WHEN start = "end" THEN a <= start AND start <= b WHEN a = b THEN start <= a AND a <= "end" ELSE a < "end" AND b > start END"""

ORACLES = {
    "l01_occurrences": f"SELECT doc_id, idx, occurrence, start FROM ({HITS})",
    "l02_resolve_locator": f"""
        WITH p AS ({PARAGRAPHS}),
        r AS (SELECT doc_id AS req_id, doc_id % 11 = 0 AS absent, doc_id % 7 AS i, doc_id % 5 <> 0 AS exact, doc_id % 4 + 1 AS n FROM documents),
        c AS (SELECT h.doc_id, h.idx, start, row_number() OVER (PARTITION BY h.doc_id, h.idx ORDER BY start) AS n
              FROM ({HITS}) h JOIN p ON p.doc_id = h.doc_id AND p.idx = h.idx
              WHERE (h.doc_id % 2 <> 0 OR start > 0 AND substr(text, start, 1) = ' ') AND (h.doc_id % 3 <> 0 OR substr(text, start + 4, 1) = ' ')),
        m AS (SELECT req_id, CASE WHEN absent OR p.text IS NULL THEN 'ANCHOR_NOT_FOUND'
                                  WHEN req_id % 6 = 2 THEN 'STALE_REVISION'
                                  WHEN exact AND c.start IS NULL THEN 'ANCHOR_NOT_FOUND' END AS error,
                     CASE WHEN exact THEN c.start ELSE 0 END AS s, CASE WHEN exact THEN c.start + 3 ELSE length(p.text) END AS e
              FROM r LEFT JOIN p ON p.doc_id = req_id AND p.idx = i LEFT JOIN c ON c.doc_id = req_id AND c.idx = i AND c.n = r.n)
        SELECT req_id, error, CASE WHEN error IS NULL THEN s ELSE -1 END AS start, CASE WHEN error IS NULL THEN e ELSE -1 END AS "end" FROM m""",
    "l07_locator_mappings": """
        WITH d AS (SELECT doc_id, n_chars AS n, ['body', 'footnote', 'endnote', 'header'][n_chars % 4 + 1] AS story, [NULL, 'document.xml', '/word/footnotes.xml', ''][(n_chars % 5) % 4 + 1] AS told,
                          CASE n_chars % 3 WHEN 0 THEN lower(sha256(text)[1:16]) WHEN 1 THEN 'abc' END AS h, CASE WHEN n_chars % 7 = 0 THEN n_chars % 2 ELSE 1 END AS occurrence FROM documents),
        p AS (SELECT *, CASE story WHEN 'body' THEN 'word/document.xml' WHEN 'footnote' THEN 'word/footnotes.xml' WHEN 'endnote' THEN 'word/endnotes.xml' END AS own,
                     CASE told WHEN 'document.xml' THEN 'word/document.xml' WHEN '/word/footnotes.xml' THEN 'word/footnotes.xml' END AS meant FROM d),
        q AS (SELECT *, own IS NULL OR meant IS NOT NULL AND meant <> own AS wrong FROM p)
        SELECT doc_id, story, n % 9 - 1 AS paragraph_index, h AS paragraph_hash, occurrence, CASE WHEN n % 9 = 0 OR occurrence < 1 OR n % 3 = 1 THEN 'INVALID_REQUEST' END AS error,
               CASE WHEN NOT wrong THEN own END AS part_name, CASE WHEN wrong THEN 'INVALID_REQUEST' END AS part_error FROM q""",
    "l03_nth_span": f'SELECT doc_id, idx, start, start + 3 AS "end" FROM ({HITS}) WHERE occurrence = 3',
    "l05_anchor_span": f"""
        SELECT doc_id, idx, CASE WHEN ok THEN start ELSE -1 END AS start, CASE WHEN ok THEN start + 3 ELSE -1 END AS "end", CASE WHEN NOT ok THEN 'ANCHOR_NOT_FOUND' END AS error
        FROM (SELECT p.doc_id, p.idx, h.start,
                     coalesce(h.start > 0 AND substr(text, h.start, 1) = ' ' AND (p.doc_id % 2 <> 0 OR substr(text, h.start + 4, 1) = ' '), false) AS ok
              FROM ({PARAGRAPHS}) p LEFT JOIN (SELECT * FROM ({HITS}) WHERE occurrence = 2) h ON h.doc_id = p.doc_id AND h.idx = p.idx WHERE contains(text, 'the'))""",
    "p13_overlap_join": f'SELECT e.doc_id, e.idx, a, b, start, "end", kind FROM ({_EDITS}) e JOIN ({_RANGES}) r ON e.doc_id = r.doc_id AND e.idx = r.idx AND {_MET}',
    "p14_assert_editable": f"""
        SELECT e.doc_id, e.idx, a, b, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS kinds, CASE WHEN count(kind) > 0 THEN 'PROTECTED_BOUNDARY' END AS error
        FROM ({_EDITS}) e LEFT JOIN ({_RANGES}) r ON e.doc_id = r.doc_id AND e.idx = r.idx AND {_MET} GROUP BY e.doc_id, e.idx, a, b""",
    "p12_tidy_ranges": f"""
        SELECT doc_id, idx, string_agg(start || ':' || "end" || ':' || kind, ',' ORDER BY start, "end", kind) AS ranges FROM (SELECT DISTINCT * FROM ({_RANGES})) GROUP BY doc_id, idx""",
    "p11_span_split": f"""
        SELECT p.doc_id, idx, CAST(CASE WHEN idx = p.doc_id % 3 THEN 2 ELSE 0 END AS BIGINT) AS start,
               CASE WHEN idx = p.doc_id % 3 + p.doc_id % 5 THEN 9 ELSE length(text) END AS "end", 'bookmark' AS kind
        FROM ({PARAGRAPHS}) p WHERE idx BETWEEN p.doc_id % 3 AND p.doc_id % 3 + p.doc_id % 5""",
}
