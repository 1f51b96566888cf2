"""Rules of names, XML, preferences, ids and marks, case by case."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.operators import citations, fields, items, validation
from docloom.plans import citing, properties
from docloom.sources import package_rules, packages


def said(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("name", "safe"),
    [
        ("word/document.xml", True), ("/word/document.xml", True), ("word/", True), ("[Content_Types].xml", True), ("a+b%.xml", True), ("x/ab:c", True), ("", False), ("/", False), ("//a", False), ("a//b", False),
        ("a/./b", False), ("../a", False), ("a/..", False), ("%2e%2e/a", False), ("%2Fa", False), ("a\\b", False), ("a\x00", False), ("C:/x", False), ("ab:c/x", False), ("C%3A/x", False), (None, None),
    ],
)
def test_safe_names(spark, name, safe):
    assert said(spark, packages.safe_name(F.lit(name).cast("string"))) == safe


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("media/bild%C3%BC.png", "word/media/bild\u00fc.png"), ("a+b.png?x#y", "word/a+b.png"), ("100%.png", "word/100%.png"), ("%2e%2e/a.xml", "a.xml"), ("..%2F..%2Fa.xml", None), ("%5Ca", None), ("b:/a", None),
        ("/b%3Aa/c", None), ("//host/a", None), ("x%2500y", "word/x%00y"), (None, None),
    ],
)
def test_targets_read_every_escape(spark, target, want):
    assert said(spark, packages.resolved_target(F.lit("word/document.xml"), F.lit(target).cast("string"))) == want


def test_properties_and_styles_are_read_as_xml(spark):
    core = (
        "<cp:p xmlns:cp='u' xmlns:dc='v' xmlns:x='w'><dc:title><![CDATA[a<b]]></dc:title><!-- <dc:subject>no</dc:subject> --><dc:creator>&#220; &amp;</dc:creator>"
        "<dc:created x:type='t'> 2024 </dc:created><dc:keywords/><dc:language> </dc:language><dc:description>one</dc:description><dc:description>two</dc:description><dc:version>null</dc:version></cp:p>"
    )
    styles = "<w:s xmlns:w='u'><w:style w:styleId='B'><w:name w:val='Body &#220;'/></w:style><w:style w:styleId=\"C\"/><!--<w:style w:styleId='D'/>--><w:style/><w:style w:styleId='E'><w:rPr/><w:name w:val=''/></w:style></w:s>"
    entity = "<!DOCTYPE a [<!ENTITY e 'x'>]><p><title>&e;</title></p>"
    rows = [("a", "docProps/core.xml", core.encode()), ("a", "word/styles.xml", styles.encode()), ("b", "docProps/core.xml", b"<p><title>a"), ("c", "docProps/core.xml", entity.encode()), ("d", "docProps/core.xml", None), ("e", "word/styles.xml", b"")]
    parts = spark.createDataFrame(rows, "doc_path string, part_name string, data binary")
    assert {tuple(r) for r in packages.core_properties(parts).collect()} == {
        ("a", "title", "a<b"), ("a", "creator", "\u00dc &"), ("a", "created", "2024"), ("a", "description", "two"), ("a", "version", "null"),
    }
    assert {tuple(r) for r in packages.style_names(parts).collect()} == {("a", "B", "Body \u00dc"), ("a", "C", "C"), ("a", "E", "E")}


def test_xml_that_does_not_parse_is_unsafe(spark):
    parts = spark.createDataFrame([("a", "x.xml", b"<a>"), ("a", "y.xml", b"<a/>"), ("a", "z.RELS", b"<!DOCTYPE a><a/>")], "doc_path string, part_name string, data binary")
    assert {tuple(r) for r in packages.xml_errors(parts).collect()} == {("a", "x.xml", "UNSAFE_PACKAGE"), ("a", "z.RELS", "UNSAFE_PACKAGE")}


def test_pages_are_refused_by_what_they_hold(spark, tmp_path):
    """F1 of round 3: the query's result depends on each page's text, as its SQL does."""
    pages = [(1, "<!DOCTYPE html><p><br>"), (2, "<p><br>"), (3, "<p><! ENTITY x>"), (4, None), (5, "<p><!doctype a"), (6, "<p>\u00e9 <!doctypes>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted(map(tuple, properties.QUERIES["s03_xml_errors"](spark, str(tmp_path)).collect()))
    declared = {(1, "a.xml"), (3, "a.xml"), (5, "a.xml"), (5, "b.XML")}
    assert found == [(k, part, "UNSAFE_PACKAGE", "DECLARATION" if (k, part) in declared else "MALFORMED") for k, _ in pages for part in ("a.xml", "b.XML")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(properties.ORACLES["s03_xml_errors"]).fetchall()) == found


def test_pages_keep_entities_that_nothing_closes(spark, tmp_path):
    """F1 of round 4: the query resolves what its SQL does, and the operator by itself all that HTML does."""
    texts = [
        "<p>a &amp</p>b", "a &am<i>p; &a<b>&", "x&amp;amp;quot; &quot &quot;", "&amp;lt;&lt;b&gt;&copy;&middot;", "&nbsp;&#65;&eacute;&copyx&Amp;&QUOT;", "\u00a0 \x0b\u2003 a \x1c\x85\u3000", "\t\r\n\f a \n b\n\f ", "\x0b\n", " <", "a<b\n>c", "<p", "&<>amp;", "\U0001f600&amp;\U0001f600", "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    rows.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted(map(tuple, citing.QUERIES["j09_plain_formatted"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(citing.ORACLES["j09_plain_formatted"]).fetchall()) == found
    assert [r.t for r in rows.orderBy("page_id").limit(2).select(citations.plain_formatted(F.col("html")).alias("t")).collect()] == ["a &b", "a & &a&"]


def test_texts_are_chunked_as_in_sql(spark, tmp_path):
    """F2 of round 4: null and empty texts, and characters beyond the first plane."""
    texts = [None, "", "a", "\n", "b" * 255, "c" * 256, "\u00e9\n" * 400, "\U0001f600" * 300, "d" * 254 + "\U0001f600e", "f\r\n\u0301\u2028\x85" * 100, " " * 511]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, citing.QUERIES["j10_chunk"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(citing.ORACLES["j10_chunk"]).fetchall()) == found
    plain = rows.filter("text <> '' AND doc_id NOT IN (7, 8)").select(citations.chunk_points(F.col("text")).alias("p"), citations.chunk_utf16(F.col("text")).alias("u")).collect()
    assert len(plain) == 7 and all(r.p == r.u for r in plain)


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ("<data data-version = '3'><!-- <style id='no'/> --><style id=\"a'b &amp;c\" locale='&#220;' hasBibliography='TRUE'/><session id=' s '/><prefs><pref name='FieldType' value='Field'/></prefs></data>", ("3", "a'b &c", "\u00dc", " s ", True, "Field", None)),
        ("<data><style id='q'/><style id='r' locale='x'/><inner><session id='no'/></inner><pref name='fieldType' value='no'/></data>", (None, "q", None, None, False, None, None)),
        ("<n:data xmlns:n='u' data-version='3'><n:style id='null'/></n:data>", ("3", "null", None, None, False, None, None)),
        ("<!-- <data/> --><old data-version='2'/>", ("2", None, None, None, False, None, "legacy root")),
        ("<data", (None, None, None, None, False, None, "invalid XML")), ("<data/>x", (None, None, None, None, False, None, "invalid XML")), ("", (None, None, None, None, False, None, "invalid XML")),
        ("<!DOCTYPE a><data data-version='3'/>", (None, None, None, None, False, None, "invalid XML")), (None, (None, None, None, None, False, None, "invalid XML")),
    ],
)
def test_preferences_are_read_as_xml(spark, xml, want):
    rows = spark.createDataFrame([(1, xml)], "doc_id int, value string")
    assert tuple(citations.decoded_preferences(rows, "doc_id").first())[1:] == want


def test_preferences_come_back_as_written(spark):
    odd = "<a href=\"x\">'&amp;&</a>"
    xml = citations.preference_document(F.lit(odd), F.lit(odd), F.lit(odd), F.lit(True), F.lit(odd))
    found = citations.decoded_preferences(spark.range(1).select("id", xml.alias("value")), "id").first()
    assert tuple(found)[1:] == ("3", odd, odd, odd, True, odd, None)


@pytest.mark.parametrize(
    ("instruction", "want"),
    [
        (' ADDIN ZOTERO_ITEM CSL_CITATION {"citationID":"abc","x":1} ', "abc"), (' addin zotero_item {"citationID":17}', "17"), (' ADDIN XCSL_CITATION {"citationID" : "abc", broken', "abc"),
        (' ADDIN ZOTERO_ITEM {"citationID":"","x":1}', "body:3"), (' ADDIN ZOTERO_ITEM {"citationID":1.5}', "body:3"), (" ADDIN zotero_bibl {} CSL_BIBLIOGRAPHY ", "bibliography"),
        (' ADDIN ZOTERO_BIBL CSL_CITATION {"citationID":"c"}', "c"), (' PAGE {"citationID":"abc"}', "body:3"), (" ADDIN ZOTERO_ITEM CSL_CITATION", "body:3"), (None, "body:3"),
    ],
)
def test_field_ids(spark, instruction, want):
    assert said(spark, citations.field_id(F.lit(instruction).cast("string"), F.lit("body"), F.lit(3))) == want


@pytest.mark.parametrize(
    ("payload", "hint", "want"),
    [
        ('{"key":"ABCD2345","version":3}', None, ("ABCD2345", 3, None)), ('{"key":"bad"}', None, (None, None, "ZOTERO_INCOMPATIBLE")), ('{"key":"","itemKey":"ABCD2345","data":{"version":"7"}}', None, ("ABCD2345", 7, None)),
        ('{"key":23456789}', "ABCD2345", (None, None, "ZOTERO_INCOMPATIBLE")), ('{"key":null,"version":"x"}', "ABCD2345", ("ABCD2345", None, None)), ('{"key":0,"version":true}', "ABCD2345", ("ABCD2345", None, None)),
        ("{}", None, (None, None, "ZOTERO_INCOMPATIBLE")), ("{", None, (None, None, "ZOTERO_INCOMPATIBLE")), (None, None, (None, None, "ZOTERO_INCOMPATIBLE")),
    ],
)
def test_records_need_a_key(spark, payload, hint, want):
    rows = spark.createDataFrame([(payload, hint)], "p string, h string").select(*items.normalised(F.col("p"), F.col("h")))
    assert (lambda r: (r.item_key, r.version, r.error))(rows.first()) == want


def test_marks_without_an_id(spark):
    marks = [("a", None, "comment"), ("a", None, "comment"), ("a", None, "bookmark start"), ("a", "1", "comment"), ("a", "1", "comment reference"), ("a", "2", "bookmark end"), ("b", None, "comment end")]
    found = validation.semantic(spark.createDataFrame(marks, "doc_path string, mark_id string, kind string")).collect()
    assert sorted((r.doc_path, r.severity, r.message) for r in found) == [("a", "error", "bookmark with one end 2")] + [("a", "error", "comment without an id")] * 2


def test_rules_read_their_input_once(spark, tmp_path):
    spark.createDataFrame([("a", "1", "comment", 1, 1, "x")], "doc_path string, mark_id string, kind string, seq int, step int, stream string").write.parquet(f"{tmp_path}/m")
    rows = spark.read.parquet(f"{tmp_path}/m")
    for found in (validation.semantic(rows), fields.strict(rows), fields.warnings(rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_package_rules_read_their_parts_once(spark, tmp_path):
    """F3 of round 4: one scan, one pass of Python over types and relationships, one exchange."""
    types = (
        "<T><Default Extension='rels' ContentType='r'/><Override PartName='/a.bin' ContentType='x'/><Override PartName='a.bin' ContentType='y'/><Override PartName='/b.bin' ContentType='x'/>"
        "<Override PartName='/b.bin' ContentType='y'/><Override PartName='/b.bin' ContentType='z'/><Override PartName='/main' ContentType='first'/><Override PartName='main' ContentType='%s'/></T>" % packages.MAIN_TYPE
    )
    rel = lambda k, target: f"<R Id='{k}' Type='{packages.OFFICE_DOCUMENT}' Target='{target}'/>"
    told = {"[Content_Types].xml": types, "_rels/.rels": f"<R>{rel('r', 'main')}</R>", "main": "", "_rels/main.rels": f"<R>{rel('r', 'a.bin')}{rel('s', 'b.bin')}</R>", "main.rels": f"<R>{rel('r', '../x')}{rel('r', 'b.bin')}</R>", "a.bin": "", "b.bin": ""}
    rows = [("p", k, name, xml.encode(), None) for k, (name, xml) in enumerate(told.items())] + [("q", 0, "word/", None, None), ("r", None, None, None, "UNSAFE_PACKAGE")]
    spark.createDataFrame(rows, packages.PARTS).write.parquet(f"{tmp_path}/p")
    found = package_rules.findings(spark.read.parquet(f"{tmp_path}/p"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapIn") == 1 and plan.count("Exchange ") == 1
    assert sorted((r.doc_path, r.message) for r in found.collect()) == [
        ("p", "duplicate content type override: /b.bin"), ("p", "duplicate relationship id: r"), ("p", "invalid content type part name: a.bin"), ("p", "invalid content type part name: main"),
        ("p", "relationship to a missing part: r"), ("p", "unsupported main document type: first"), ("q", "no content types part"), ("q", "no root relationships part"), ("q", "not exactly one office document relationship"),
        ("r", "package can't be opened: UNSAFE_PACKAGE"),
    ]


def test_payloads_that_are_no_objects_are_error_rows(spark):
    held = spark.createDataFrame([("g", "1", "[1]"), ("g", "2", '{"citationItems":3,"properties":[]}'), ("g", "3", "{")], "g string, citation_id string, payload string")
    asked = spark.createDataFrame([("g", k, '[{"id":1}]', "t") for k in "123"], "g string, citation_id string, items string, formatted string")
    found = {r.citation_id: (r.error, r.payload is None) for r in citations.update_citations(held, asked, "g").collect()}
    assert found == {"1": ("INVALID_REQUEST", True), "2": (None, False), "3": ("INVALID_REQUEST", True)}
