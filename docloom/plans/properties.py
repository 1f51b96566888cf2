"""Queries over what a package says about itself: names, XML that can't be read, core properties, styles, links.

Every document becomes a styled part, a styles part and core properties, written by expressions from its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.paragraphs import is_heading_style
from docloom.plans.common import PARAGRAPHS, documents, long
from docloom.plans.packaging import NAMESPACE, escaped, said
from docloom.session import table
from docloom.sources import packages


def _styled(line: Column) -> Column:
    """A short line without a closing full stop has the title's style, one that ends with a question or an exclamation its own, others none."""
    style = F.when(F.regexp_like(line, F.lit(r"[!?]$")), "Loud").when((F.length(line) <= 60) & ~F.endswith(line, F.lit(".")), "T1")
    head = F.coalesce(F.concat(F.lit('<w:pPr><w:pStyle w:val="'), style, F.lit('"/></w:pPr>')), F.lit(""))
    return F.concat(F.lit("<w:p>"), head, F.lit('<w:r><w:t xml:space="preserve">'), escaped(line), F.lit("</w:t></w:r></w:p>"))


def _parts(docs: DataFrame) -> DataFrame:
    """doc_path, part_name, data: the main part, its styles and the core properties.

    The title's style is a heading in documents of some languages, has no name in others; a document without a source has no creator.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    name = F.when(F.col("lang").isin("en", "de"), '<w:name w:val="heading 1"/>').when(F.col("lang") == "fr", '<w:name w:val="Body &amp; more"/>').otherwise("")
    told = [
        ("word/document.xml", said(f"<w:document {NAMESPACE}><w:body>", F.array_join(F.transform(lines, _styled), ""), "</w:body></w:document>")),
        ("word/styles.xml", said(f'<w:styles {NAMESPACE}><w:style w:type="paragraph" w:styleId="T1">', name, '<w:rPr/></w:style><w:style w:styleId="Loud"><w:name w:val="Loud"/></w:style></w:styles>')),
        ("docProps/core.xml", said("<cp:coreProperties><dc:title>", escaped(lines[0]), "</dc:title><dc:creator>", F.coalesce("source", F.lit("")), "</dc:creator><cp:lastModifiedBy>", F.coalesce("lang", F.lit("")), '</cp:lastModifiedBy><dcterms:created xsi:type="dcterms:W3CDTF"> 2024 </dcterms:created></cp:coreProperties>')),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(part).alias("part_name"), xml.alias("xml")) for part, xml in told])).alias("p")
    return docs.select(F.col("doc_id").cast("string").alias("doc_path"), each).select("doc_path", "p.part_name", F.encode("p.xml", "UTF-8").alias("data"))


def s02_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a page's host as a member's name, in four forms."""
    name = F.regexp_extract("url", "(?s)^[^:]*://[^/]*/?(.*)$", 1)
    forms = F.array(name, F.concat(F.lit("/"), name), F.replace(name, F.lit("/"), F.lit("/%2E./")), F.replace(name, F.lit("/"), F.lit("\\")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "name"))
    return rows.select("page_id", long("form"), "name", packages.safe_name(F.col("name")).alias("safe"))


def s03_xml_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as XML parts: as they are, without their document type, and their text alone, escaped."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, "(?i)<!\\s*(?:doctype|entity)[^>]*>", "")
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("part_name"), F.encode(x, "UTF-8").alias("data")) for n, x in (("a.xml", html), ("b.XML", F.concat(F.lit("<a>"), bare)), ("c.rels", F.concat(F.lit("<a>"), escaped(bare), F.lit("</a>"))), ("d.bin", html))])).alias("p")
    found = packages.xml_findings(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_path"), told).select("doc_path", "p.*"))
    return found.select(F.col("doc_path").cast("long").alias("page_id"), "part_name", "error", "reason")


def s10_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, from the package's top and from a part below a folder, which it leaves by one step."""
    found = F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("k", "target")
    rows = table(spark, sf_dir, "pages").select("page_id", found)
    below = packages.resolved_target(F.lit("word/document.xml"), F.concat(F.lit("../x"), F.col("target")))
    beyond = packages.resolved_target(F.lit("word/document.xml"), F.concat(F.lit("../.."), F.col("target")))
    return rows.select("page_id", long("k"), packages.resolved_target(F.lit(""), F.col("target")).alias("part_name"), below.alias("below"), beyond.alias("beyond"))


def s12_core_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packages.core_properties(_parts(documents(spark, sf_dir)))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "name", "value")


def p03_style_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packages.style_names(_parts(documents(spark, sf_dir)))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "style_id", "style_name")


def p04_paragraph_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph with the name of its style, and whether that makes it a heading."""
    rows = _parts(documents(spark, sf_dir))
    styles = packages.style_names(rows).withColumnRenamed("style_id", "style")
    seen = packages.paragraph_texts(rows.filter("part_name = 'word/document.xml'")).join(styles, ["doc_path", "style"], "left")
    return seen.select(F.col("doc_path").cast("long").alias("doc_id"), long("idx"), "style_name", is_heading_style(F.col("style_name")).alias("heading"), F.length("text").cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (s02_safe_names, s03_xml_errors, s10_page_links, s12_core_properties, p03_style_names, p04_paragraph_styles)}

_STYLES = """
  SELECT doc_id, 'T1' AS style_id, CASE WHEN lang IN ('en', 'de') THEN 'heading 1' WHEN lang = 'fr' THEN 'Body & more' ELSE 'T1' END AS style_name FROM documents
  UNION ALL SELECT doc_id, 'Loud', 'Loud' FROM documents"""
_NAMES = "SELECT page_id, regexp_extract(url, '(?s)^[^:]*://[^/]*/?(.*)$', 1) AS name FROM pages"
_FORMS = f"""
  SELECT page_id, CAST(0 AS BIGINT) AS form, name, name AS said FROM ({_NAMES}) UNION ALL SELECT page_id, 1, '/' || name, '/' || name FROM ({_NAMES})
  UNION ALL SELECT page_id, 2, replace(name, '/', '/%2E./'), replace(name, '/', '/../') FROM ({_NAMES}) UNION ALL SELECT page_id, 3, replace(name, '/', '\\'), replace(name, '/', '\\') FROM ({_NAMES})"""

ORACLES = {
    "s02_safe_names": f"""
        SELECT page_id, form, name, raw <> '' AND NOT (contains(raw, '\\') OR contains(pieces[1], ':') OR len([x FOR x IN pieces[:-2] IF x = '']) > 0 OR len([x FOR x IN pieces IF x IN ('.', '..')]) > 0) AS safe
        FROM (SELECT *, CASE WHEN name LIKE '/%' THEN substr(name, 2) ELSE name END AS raw, string_split(CASE WHEN said LIKE '/%' THEN substr(said, 2) ELSE said END, '/') AS pieces FROM ({_FORMS}))""",
    # A page with a document type is refused by it; one without, or whose document type was taken out, has elements that never end.
    "s03_xml_errors": """
        SELECT page_id, 'a.xml' AS part_name, 'UNSAFE_PACKAGE' AS error, CASE WHEN regexp_matches(html, '(?i)<!\\s*(doctype|entity)\\b') THEN 'DECLARATION' ELSE 'MALFORMED' END AS reason FROM pages
        UNION ALL SELECT page_id, 'b.XML', 'UNSAFE_PACKAGE', CASE WHEN regexp_matches(regexp_replace(html, '(?i)<!\\s*(doctype|entity)[^>]*>', '', 'g'), '(?i)<!\\s*(doctype|entity)\\b') THEN 'DECLARATION' ELSE 'MALFORMED' END FROM pages""",
    "s10_page_links": """
        SELECT page_id, k, substr(target, 2) AS part_name, 'x' || target AS below, CAST(NULL AS VARCHAR) AS beyond
        FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS k FROM pages)""",
    "s12_core_properties": f"""
        SELECT doc_id, name, value FROM (
          SELECT doc_id, 'title' AS name, trim(text) AS value FROM ({PARAGRAPHS}) WHERE idx = 0
          UNION ALL SELECT doc_id, 'creator', source FROM documents UNION ALL SELECT doc_id, 'lastModifiedBy', lang FROM documents UNION ALL SELECT doc_id, 'created', '2024' FROM documents)
        WHERE value <> ''""",
    "p03_style_names": _STYLES,
    "p04_paragraph_styles": f"""
        SELECT p.doc_id, idx, style_name, coalesce(starts_with(style_name, 'heading'), false) AS heading, length(text) AS chars
        FROM (SELECT *, CASE WHEN regexp_matches(text, '[!?]$') THEN 'Loud' WHEN length(text) <= 60 AND text NOT LIKE '%.' THEN 'T1' END AS style_id FROM ({PARAGRAPHS})) p
        LEFT JOIN ({_STYLES}) s ON s.doc_id = p.doc_id AND s.style_id = p.style_id""",
}
