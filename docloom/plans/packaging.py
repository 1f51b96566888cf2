"""Queries over the parts of packages: stories, their paragraphs and summaries, content types, rules.

Every document becomes the parts of a package, written by expressions: its lines are the body, its first line also a
header, its last one a footnote or a comment. What a package has besides goes by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.common import PARAGRAPHS, documents, long
from docloom.sources import package_rules, packages

NAMESPACE = f'xmlns:w="{packages.W[1:-1]}"'
_BASE = packages.OFFICE_DOCUMENT.rpartition("/")[0]
_TYPES, _RELS = "http://schemas.openxmlformats.org/package/2006/content-types", "http://schemas.openxmlformats.org/package/2006/relationships"
_FIELD = (
    '<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:instrText> ADDIN ZOTERO_ITEM CSL_CITATION {} </w:instrText><w:fldChar w:fldCharType="separate"/><w:t>cited</w:t><w:fldChar w:fldCharType="end"/></w:r></w:p>'
)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _paragraph(text: Column) -> Column:
    runs = F.replace(escaped(text), F.lit("\t"), F.lit('</w:t><w:tab/><w:t xml:space="preserve">'))
    return F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), runs, F.lit("</w:t></w:r></w:p>"))


def said(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def parts_of(docs: DataFrame) -> DataFrame:
    """doc_path, ordinal, part_name, data, error as ``packages.parts`` gives them, without a ZIP between."""
    # As columns they are made once; inside the array of parts each use would make them again.
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.split(text, "\n", -1).alias("lines"), F.length(text).alias("n"))
    lines, n = F.col("lines"), F.col("n")
    main = F.when(n % 5 == 0, "word/main.xml").otherwise("word/document.xml")
    body = said(f"<w:document {NAMESPACE}><w:body>", F.array_join(F.transform(lines, _paragraph), ""), F.when(n % 7 == 0, _FIELD).otherwise(""), "</w:body></w:document>")
    header = F.when(n % 2 == 0, said(f"<w:hdr {NAMESPACE}>", _paragraph(lines[0]), "</w:hdr>"))
    notes = F.when(n % 3 == 0, said(f'<w:footnotes {NAMESPACE}><w:footnote w:type="separator" w:id="-1"><w:p/></w:footnote><w:footnote w:id="1">', _paragraph(F.element_at(lines, -1)), "</w:footnote></w:footnotes>"))
    comments = F.when(n % 4 == 0, said(f'<w:comments {NAMESPACE}><w:comment w:id="0">', _paragraph(F.element_at(lines, -1)), "</w:comment></w:comments>"))
    link = lambda k, kind, target, more="": said(f'<Relationship Id="rId{k}" Type="{_BASE}/{kind}" Target="', target, f'"{more}/>')
    roots = said(f'<Relationships xmlns="{_RELS}">', link(1, "officeDocument", main), F.when(n % 11 == 4, link(1, "extra", main)).otherwise(""), "</Relationships>")
    inner = said(
        f'<Relationships xmlns="{_RELS}">', link(1, "header", "header1.xml"), link(2, "footnotes", "/word/footnotes.xml"), link(3, "comments", "./comments.xml"), link(4, "hyperlink", "https://example.com/", ' TargetMode="External"'),
        F.when(n % 11 == 5, link(5, "image", "x.png", ' TargetMode="Inside"')).otherwise(""), "</Relationships>",
    )
    own_type = F.when(n % 11 == 6, "application/vnd.ms-word.document.macroEnabled.main+xml").otherwise(packages.MAIN_TYPE)
    override = said('<Override PartName="/', main, '" ContentType="', own_type, '"/>')
    types = said(
        f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="XML" ContentType="application/xml"/>',
        override, F.when(n % 11 == 3, override).otherwise(""), "</Types>",
    )
    told = [
        (F.lit("[Content_Types].xml"), types), (F.lit("_rels/.rels"), F.when(n % 11 != 1, roots)), (main, body), (F.replace(main, F.lit("word/"), F.lit("word/_rels/")), inner), (F.lit("word/header1.xml"), header),
        (F.lit("word/footnotes.xml"), notes), (F.lit("word/comments.xml"), comments), (F.lit("word/vbaProject.bin"), F.when(n % 11 == 2, "macro")),
    ]
    named = [(F.concat(name, F.lit(".rels")) if k == 3 else name, xml) for k, (name, xml) in enumerate(told)]
    rows = F.filter(F.array(*[F.struct(name.alias("part_name"), xml.alias("xml")) for name, xml in named]), lambda p: p["xml"].isNotNull())
    each = docs.select(F.col("doc_id").cast("string").alias("doc_path"), F.posexplode(rows).alias("ordinal", "p"))
    return each.select("doc_path", "ordinal", "p.part_name", F.encode("p.xml", "UTF-8").alias("data"), F.lit(None).cast("string").alias("error"))


def _stories(rows: DataFrame) -> DataFrame:
    return packages.stories(packages.relationships(rows), rows.select("doc_path", "part_name"))


def p02_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stories(parts_of(documents(spark, sf_dir)))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "part_name", "kind", long("place"))


def p09_story_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts_of(documents(spark, sf_dir))
    found = packages.story_paragraphs(rows, _stories(rows))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "kind", long("idx"), F.sha2("text", 256).alias("text_sha256"))


def a01_package_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packages.summaries(parts_of(documents(spark, sf_dir)))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "stories", "paragraphs", "words", "footnotes", "comments", "revisions", "citations", "has_bibliography", "external")


def s06_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts_of(documents(spark, sf_dir))
    found = packages.declared_types(rows.select("doc_path", "part_name"), packages.content_type_rows(rows))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "part_name", "content_type")


def s07_package_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = package_rules.findings(parts_of(documents(spark, sf_dir)))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "severity", "message")


def k06_added_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every header and footnotes part gets a type of its own; those of XML parts so far come from the default."""
    rows = parts_of(documents(spark, sf_dir))
    wanted = rows.filter("part_name IN ('word/header1.xml', 'word/footnotes.xml')").select("doc_path", "part_name", F.when(F.contains("part_name", F.lit("header")), "application/header").otherwise("application/xml").alias("content_type"))
    found = packages.added_types(rows, packages.content_type_rows(rows), wanted)
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "part_name", "content_type", "new")


def k05_ensured_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main part's relationship to its comments is there already; one to a settings part is new."""
    rels = packages.relationships(parts_of(documents(spark, sf_dir)))
    asked = rels.filter("source_part <> ''").select("doc_path", "source_part").distinct()
    told = F.explode(F.array(*[F.struct(F.lit(f"{_BASE}/{kind}").alias("rel_type"), F.lit(target).alias("target")) for kind, target in (("comments", "./comments.xml"), ("settings", "settings.xml"))]))
    found = packages.ensured_relationships(rels, asked.select("*", told.alias("r")).select("doc_path", "source_part", "r.*"))
    return found.select(F.col("doc_path").cast("long").alias("doc_id"), "target", "rel_id", "new")


QUERIES = {f.__name__: f for f in (p02_stories, p09_story_paragraphs, a01_package_summary, s06_content_type, s07_package_findings, k06_added_types, k05_ensured_relationships)}

_DOCS = "SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, CASE WHEN length(coalesce(text, '')) % 5 = 0 THEN 'word/main.xml' ELSE 'word/document.xml' END AS main FROM documents"
_STORIES = f"""
  SELECT doc_id, main AS part_name, 'body' AS kind, CAST(0 AS BIGINT) AS place FROM ({_DOCS}) WHERE n % 11 <> 1
  UNION ALL SELECT doc_id, 'word/header1.xml', 'header', 1 FROM ({_DOCS}) WHERE n % 11 <> 1 AND n % 2 = 0
  UNION ALL SELECT doc_id, 'word/footnotes.xml', 'footnote', 2 FROM ({_DOCS}) WHERE n % 11 <> 1 AND n % 3 = 0
  UNION ALL SELECT doc_id, 'word/comments.xml', 'comment', 3 FROM ({_DOCS}) WHERE n % 11 <> 1 AND n % 4 = 0"""
_STORY_PARAGRAPHS = f"""
  SELECT s.doc_id, kind, CASE WHEN kind = 'body' THEN idx ELSE 0 END AS idx, text
  FROM ({_STORIES}) s JOIN (SELECT *, max(idx) OVER (PARTITION BY doc_id) AS last FROM ({PARAGRAPHS})) p ON p.doc_id = s.doc_id
  WHERE kind = 'body' OR kind = 'header' AND idx = 0 OR kind IN ('footnote', 'comment') AND idx = last
  UNION ALL SELECT doc_id, 'body', len(string_split(text, chr(10))), 'cited' FROM ({_DOCS}) WHERE n % 11 <> 1 AND n % 7 = 0"""
_MACRO = "application/vnd.ms-word.document.macroEnabled.main+xml"

ORACLES = {
    "p02_stories": _STORIES,
    "p09_story_paragraphs": f"SELECT doc_id, kind, idx, sha256(text) AS text_sha256 FROM ({_STORY_PARAGRAPHS})",
    "a01_package_summary": f"""
        WITH t AS (SELECT doc_id, count(*) AS paragraphs, CAST(sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_’''-]*[\\p{{L}}\\p{{N}}\\p{{M}}_][\\p{{L}}\\p{{N}}\\p{{M}}_’''-]*'))) AS BIGINT) AS words
                   FROM ({_STORY_PARAGRAPHS}) GROUP BY doc_id)
        SELECT d.doc_id, CAST(1 + (n % 2 = 0)::INT + (n % 3 = 0)::INT + (n % 4 = 0)::INT AS BIGINT) AS stories, paragraphs, words, CAST((n % 3 = 0)::INT AS BIGINT) AS footnotes, CAST((n % 4 = 0)::INT AS BIGINT) AS comments,
               CAST(0 AS BIGINT) AS revisions, CAST((n % 7 = 0)::INT AS BIGINT) AS citations, false AS has_bibliography, CAST(1 AS BIGINT) AS external
        FROM ({_DOCS}) d JOIN t ON t.doc_id = d.doc_id""",
    "s06_content_type": f"""
        SELECT doc_id, part_name, CASE WHEN part_name = main THEN CASE WHEN n % 11 = 6 THEN '{_MACRO}' ELSE '{packages.MAIN_TYPE}' END WHEN ends_with(part_name, '.rels') THEN 'application/vnd.openxmlformats-package.relationships+xml'
                                         WHEN ends_with(part_name, '.xml') THEN 'application/xml' END AS content_type
        FROM (SELECT doc_id, n, main, unnest([x FOR x IN ['[Content_Types].xml', CASE WHEN n % 11 <> 1 THEN '_rels/.rels' END, main, replace(main, 'word/', 'word/_rels/') || '.rels', CASE WHEN n % 2 = 0 THEN 'word/header1.xml' END,
                     CASE WHEN n % 3 = 0 THEN 'word/footnotes.xml' END, CASE WHEN n % 4 = 0 THEN 'word/comments.xml' END, CASE WHEN n % 11 = 2 THEN 'word/vbaProject.bin' END] IF x IS NOT NULL]) AS part_name FROM ({_DOCS}))""",
    "k06_added_types": f"SELECT doc_id, 'word/header1.xml' AS part_name, 'application/header' AS content_type, false AS new FROM ({_DOCS}) WHERE n % 2 = 0",
    "k05_ensured_relationships": f"""
        SELECT doc_id, './comments.xml' AS target, 'rId3' AS rel_id, false AS new FROM ({_DOCS})
        UNION ALL SELECT doc_id, 'settings.xml', CASE WHEN n % 11 = 5 THEN 'rId6' ELSE 'rId5' END, true FROM ({_DOCS})""",
    "s07_package_findings": f"""
        SELECT doc_id, 'error' AS severity, unnest([x FOR x IN [
            CASE WHEN n % 11 = 1 THEN 'no root relationships part' END, CASE WHEN n % 11 = 1 THEN 'not exactly one office document relationship' END, CASE WHEN n % 11 = 2 THEN 'macro part: word/vbaProject.bin' END,
            CASE WHEN n % 11 = 2 THEN 'part without content type: word/vbaProject.bin' END, CASE WHEN n % 11 = 3 THEN 'duplicate content type override: /' || main END, CASE WHEN n % 11 = 4 THEN 'duplicate relationship id: rId1' END,
            CASE WHEN n % 11 = 5 THEN 'invalid relationship target mode: rId5' END, CASE WHEN n % 11 = 5 THEN 'relationship to a missing part: rId5' END,
            CASE WHEN n % 11 = 6 THEN 'strict or macro-enabled part: [Content_Types].xml' END, CASE WHEN n % 11 = 6 THEN 'macro-enabled content type: /' || main END,
            CASE WHEN n % 11 = 6 THEN 'unsupported main document type: {_MACRO}' END,
            CASE WHEN n % 2 <> 0 THEN 'relationship to a missing part: rId1' END, CASE WHEN n % 3 <> 0 THEN 'relationship to a missing part: rId2' END, CASE WHEN n % 4 <> 0 THEN 'relationship to a missing part: rId3' END
          ] IF x IS NOT NULL]) AS message
        FROM ({_DOCS})""",
}
