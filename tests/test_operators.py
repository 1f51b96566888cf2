"""Golden values and random checks of the document operators."""

import io
import random
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import citations, edits, fields, items, locate, protection, transactions, validation
from docloom.operators import paragraphs as P
from docloom.sources import package_rules, packages


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_occurrences_do_not_overlap(spark):
    rng = random.Random(1)
    data = [("".join(rng.choice("ab😀") for _ in range(rng.randint(0, 30))), "".join(rng.choice("ab😀") for _ in range(rng.randint(0, 3)))) for _ in range(300)]
    data += [("a\\Eb\\E", "\\E"), ("(x)(x)", "(x)")]

    def slow(text, needle):
        out, at = [], text.find(needle) if needle else -1
        while at >= 0:
            out.append(at)
            at = text.find(needle, at + len(needle))
        return out

    for r in spark.createDataFrame(data, "t string, n string").select("t", "n", locate.occurrences(F.col("t"), F.col("n")).alias("o")).collect():
        assert r.o == slow(r.t, r.n)


def test_locator_ladder(spark):
    rows = P.with_locator(P.paragraphs(spark.createDataFrame([(1, "Introduction\nAlpha beta alpha.")], "doc_id long, text string")))
    rows = rows.select("doc_id", F.lit("body").alias("story"), "idx", "text", F.col("locator.paragraph_hash").alias("paragraph_hash"))
    asked = [
        (1, "body", 1, None, "alpha", 1, "beta ", "."), (2, "body", 1, None, "a", 2, None, None), (3, "body", 9, None, None, 1, None, None),
        (4, "body", 1, "0" * 64, None, 1, None, None), (5, "footer", 0, None, None, 1, None, None), (6, "header", 0, None, None, 1, None, None),
        (7, "body", 0, None, None, 1, None, None), (8, "body", 1, None, "alpha", 2, None, None),
    ]
    schema = "req_id long, story string, paragraph_index int, paragraph_hash string, exact_text string, occurrence int, prefix string, suffix string"
    asked = spark.createDataFrame(asked, schema).withColumn("doc_id", F.lit(1).cast("long"))
    stories = spark.createDataFrame([(1, "body", 1), (1, "header", 2)], "doc_id long, story string, parts int")
    found = {r.req_id: (r.error, r.start, r.end) for r in locate.resolve(asked, rows, stories).collect()}
    assert found == {
        1: (None, 11, 16), 2: (None, 9, 10), 3: ("ANCHOR_NOT_FOUND", None, None), 4: ("STALE_REVISION", None, None), 5: ("ANCHOR_NOT_FOUND", None, None),
        6: ("ANCHOR_AMBIGUOUS", None, None), 7: (None, 0, 12), 8: ("ANCHOR_NOT_FOUND", None, None),
    }


def test_overlap_of_ranges_without_width(spark):
    lit = lambda *x: locate.overlaps(*map(F.lit, x))
    assert list(one(spark, lit(5, 5, 2, 5), lit(5, 5, 6, 9), lit(2, 8, 8, 8), lit(2, 8, 9, 9), lit(2, 8, 8, 9), lit(2, 8, 7, 9))) == [True, False, True, False, False, True]


def test_edits(spark):
    text = F.lit("Alpha beta alpha.")
    assert one(spark, edits.replace_nth(text, F.lit("beta"), F.lit("gamma"), F.lit(1)))[0] == "Alpha gamma alpha."
    assert one(spark, edits.delete_nth(text, F.lit("beta"), F.lit(1)))[0] == "Alpha  alpha."
    assert one(spark, edits.replace_nth(text, F.lit("beta"), F.lit("x"), F.lit(2)))[0] is None
    used = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", 1)], "g string, n int")
    assert {r.g: r.free_id for r in edits.lowest_free(used, ["g"], "n").collect()} == {"a": 3, "b": 1, "c": 2}
    assert {r.g: r.free_id for r in edits.lowest_free(used, ["g"], "n", 2).collect()} == {"a": 3, "b": 3, "c": 2}


def test_a_batch_fails_as_a_whole(spark):
    targets = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b"), (4, "a b")], "doc_id long, text string")
    operations = spark.createDataFrame(
        [(1, 1, "replace_text", "c", "d", None, 1), (1, 0, "replace_text", "b", "c", None, 1), (2, 0, "replace_text", "b", "c", None, 1), (2, 1, "replace_text", "x", "c", None, 1), (3, 0, "insert_text", None, "!", "after", 1)],
        "doc_id long, op_index int, type string, text string, replacement string, position string, occurrence int",
    )
    found = {r.doc_id: (r.text, r.error, r.applied) for r in edits.apply_batch(targets, operations, ["doc_id"]).collect()}
    assert found == {1: ("a d", None, 2), 2: ("a b", "ANCHOR_NOT_FOUND", 1), 3: ("a b", "INVALID_REQUEST", 0), 4: ("a b", None, 0)}
    assert {r.error for r in edits.apply_batch(targets.limit(1), operations, ["doc_id"], 1).collect()} == {"RESOURCE_LIMIT"}


def test_windows_match_a_stack(spark):
    rng = random.Random(2)
    streams = [[rng.choice([1, -1]) for _ in range(rng.randint(1, 25))] for _ in range(200)]
    rows = spark.createDataFrame([(s, k, x) for s, xs in enumerate(streams) for k, x in enumerate(xs)], "stream long, seq int, step int")
    want, balances = set(), {}
    for s, xs in enumerate(streams):
        stack, stray = [], 0
        for k, x in enumerate(xs):
            if x > 0:
                stack.append(k)
            elif stack:
                begin = stack.pop()
                want.add((s, begin, k, len(stack)))
            else:
                stray += 1
        want |= {(s, begin, None, d) for d, begin in enumerate(stack)}
        balances[s] = (stray, len(stack))
    assert {(r.stream, r.begin_seq, r.end_seq, r.depth) for r in fields.nested(rows).collect()} == want
    assert {r.stream: (r.unmatched_ends, r.unclosed) for r in fields.balance(rows).collect()} == balances


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60), min_size=1, max_size=8), st.integers(2, 9))
def test_chunks_are_lossless_and_bounded(spark, texts, limit):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", citations.chunk_utf16(F.col("t"), limit).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == r.t and all(len(c.encode("utf-16-le")) // 2 <= limit for c in r.c) and len(r.c) >= 1


def test_chunk_golden(spark):
    assert one(spark, citations.chunk_utf16(F.lit("a" * 254 + "😀b")))[0] == ["a" * 254, "😀b"]


def test_payload_members_survive(spark):
    old = '{"citationID":"x","private":{"a":1.0},"citationItems":[{"id":"1","plugin":true,"prefix":"p"}]}'
    columns = [F.lit(old), F.lit("x"), F.lit('[{"id":"1","prefix":"","locator":"5"}]'), F.lit("<b>A &amp; B</b>")]
    found = one(spark, citations.merged_payload(*columns))[0]
    assert found.startswith('{"citationID":"x","private":{"a":1.0},"citationItems":[{"id":"1","plugin":true,"prefix":"p","locator":"5"}]')
    assert '"plainCitation":"A & B"' in found and '"noteIndex":0' in found


def test_instructions(spark):
    rows = [(' ADDIN ZOTERO_ITEM CSL_CITATION {"a":{}} tail',), (' ADDIN ZOTERO_ITEM {"a":1}',), (" ADDIN ZOTERO_ITEM {",), (' ADDIN ZOTERO_BIBL {"a":1} CSL_BIBLIOGRAPHY ',), (None,)]
    i = F.col("i")
    found = [tuple(r) for r in spark.createDataFrame(rows, "i string").select(citations.instruction_kind(i), citations.payload(i), citations.is_legacy(i)).collect()]
    assert found[:4] == [("citation", '{"a":{}}', False), ("citation", '{"a":1}', True), (None, None, True), ("bibliography", '{"a":1}', True)]


def test_plain_citations(spark):
    text = "xSmith (2020) García (2024) saw [1, 2–3] and [4-5, 6], [7] (Doe et al., 1999a; Roe 2001)"
    rows = citations.plain_citations(spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string"), ["doc_id"]).collect()
    assert all(text[r.start : r.end] == r.found for r in rows)
    assert [r.found for r in rows] == ["(Doe et al., 1999a; Roe 2001)", "García (2024)", "[4-5, 6]", "[7]"]


def test_items_keep_the_requested_order(spark):
    asked = spark.createDataFrame([(1, ["B", "A", "B", "Z"])], "req_id long, keys array<string>")
    library = spark.createDataFrame([("A", 1), ("B", 2)], "item_key string, n int")
    assert [(r.item_key) for r in items.get_items(asked, library).orderBy("place").collect()] == ["B", "A"]
    assert [r.item_key for r in items.missing_keys(asked, library).collect()] == ["Z"]
    assert list(one(spark, *[items.valid_key(F.lit(k)) for k in ("ABCD2345", "ABCD234O", "ABCD2341", "IL234567", "ABC")])) == [True, False, False, True, False]
    with pytest.raises(ValueError):
        items.search(library, limit=101)


def test_expiry_and_first_request(spark):
    rows = spark.createDataFrame([("k", 2, "new"), ("k", 1, "old"), ("l", 3, "x")], "key string, at int, body string")
    assert {(r["key"], r.body) for r in transactions.first_per_key(rows, ["key"], ["at"]).collect()} == {("k", "old"), ("l", "x")}
    created = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01 00:00:00'), (2, TIMESTAMP_NTZ '2024-01-01 00:00:01') AS t(id, created_at)")
    assert [r.id for r in transactions.live(created, F.expr("TIMESTAMP_NTZ '2024-01-01 01:00:00'")).collect()] == [2]


def test_semantic_rules(spark):
    marks = spark.createDataFrame([("d", "55", "comment start"), ("d", "9", "bookmark start"), ("d", "1", "comment"), ("d", "1", "comment reference"), ("e", "2", "comment")], "doc_path string, mark_id string, kind string")
    found = validation.semantic(marks)
    report = {r.doc_path: r for r in validation.report(found, marks.select("doc_path").distinct()).collect()}
    assert report["d"].errors == 3 and not report["d"].valid and report["e"].valid and report["e"].warnings == 1
    assert report["d"].summary.startswith("semantic: bookmark with one end 9; ")


@pytest.mark.parametrize("source, target, want", [
    ("word/document.xml", "../docProps/core.xml", "docProps/core.xml"), ("word/document.xml", "/word/document.xml", "word/document.xml"),
    ("word/document.xml", "media/image%201.png#fragment", "word/media/image 1.png"), ("word/document.xml", "../../../outside.xml", None),
    ("word/document.xml", "..\\outside.xml", None), ("word/document.xml", "file:///etc", None), ("word/document.xml", "%2e%2e/%2e%2e/x", None),
])
def test_relationship_targets(spark, source, target, want):
    assert one(spark, packages.resolved_target(F.lit(source), F.lit(target)))[0] == want


def document(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Type="t" Target="media/x.png"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{packages.W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_package_parts_and_visible_text(spark, tmp_path):
    body = '<w:p><w:r><w:t>a</w:t><w:tab/><w:br/></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>b</w:t></w:r></w:ins><w:r><w:instrText>PAGE</w:instrText></w:r></w:p><w:p/>'
    (tmp_path / "one.docx").write_bytes(document(body))
    (tmp_path / "~$one.docx").write_bytes(b"owner")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    doctype = io.BytesIO()
    with zipfile.ZipFile(doctype, "w") as z:
        z.writestr("word/document.xml", '<!DOCTYPE x [<!ENTITY a "boom">]><x>&a;</x>')
        z.writestr("../evil.xml", "<x/>")
    (tmp_path / "unsafe.docx").write_bytes(doctype.getvalue())
    files = packages.read_files(spark, str(tmp_path))
    assert {r.doc_path.rsplit("/", 1)[-1]: r.open_elsewhere for r in files.collect()} == {"one.docx": True, "broken.docx": False, "unsafe.docx": False}
    parts = packages.parts(files)
    errors = {(r.doc_path.rsplit("/", 1)[-1], r.part_name): r.error for r in parts.filter("error IS NOT NULL").collect()}
    assert errors == {("broken.docx", None): "UNSAFE_PACKAGE", ("unsafe.docx", "../evil.xml"): "UNSAFE_PACKAGE"}
    assert [(r.part_name, r.error) for r in packages.xml_errors(parts).collect()] == [("word/document.xml", "UNSAFE_PACKAGE")]
    text = packages.visible_paragraphs(packages.tokens(parts)).orderBy("idx").collect()
    assert [r.text for r in text] == ["a\t\nb", ""]
    rel = packages.relationships(parts).first()
    assert (rel.source_part, rel.rel_id, rel.target) == ("word/document.xml", "rId1", "media/x.png")


def test_rewriting_adds_and_removes_parts(spark):
    whole = spark.createDataFrame([("a", document("<w:p/>")), ("b", document(""))], "doc_path string, content binary")
    changes = spark.createDataFrame([("a", "new.xml", b"<n/>"), ("a", "[Content_Types].xml", None)], "doc_path string, part_name string, data binary")
    written = packages.rewritten(whole, changes)
    same = {r.doc_path: bytes(r.content) for r in written.collect()}
    assert same["b"] == bytes(whole.filter("doc_path = 'b'").first().content)
    assert [r.part_name for r in packages.parts(written).filter("doc_path = 'a'").orderBy("ordinal").collect()] == ["word/_rels/document.xml.rels", "word/document.xml", "new.xml"]


BASE = packages.OFFICE_DOCUMENT.rpartition("/")[0]
FIELD = '<w:r><w:fldChar w:fldCharType="begin"/><w:instrText>%s</w:instrText><w:fldChar w:fldCharType="separate"/><w:fldChar w:fldCharType="end"/></w:r>'


def test_damaged_packages_stop_no_others(spark):
    good = document("<w:p/>")
    # The deflated bytes of the last member are overwritten.
    at = good.rindex(b"word/document.xml", 0, good.rindex(b"PK\x01\x02")) + len("word/document.xml")
    damaged = good[:at] + b"\xff" * 40 + good[at + 40 :]
    whole = spark.createDataFrame([("good", good), ("null", None), ("damaged", damaged), ("no zip", b"x")], "doc_path string, content binary")
    found = packages.parts(whole)
    assert {r.doc_path: r.error for r in found.filter("part_name IS NULL").collect()} == {"null": "UNSUPPORTED_DOCUMENT", "damaged": "UNSAFE_PACKAGE", "no zip": "UNSAFE_PACKAGE"}
    assert found.filter("doc_path = 'good'").count() == 3
    changes = spark.createDataFrame([(d, "new.xml", b"<n/>") for d in ("good", "null", "damaged")] + [("no zip", "new.xml", b"<!DOCTYPE x><x/>")], "doc_path string, part_name string, data binary")
    after = {r.doc_path: r.content and bytes(r.content) for r in packages.rewritten(whole, changes).collect()}
    assert after["null"] is None and after["damaged"] == damaged and after["no zip"] == b"x" and after["good"] != good
    unsafe = spark.createDataFrame([("good", "new.xml", b"<broken")], "doc_path string, part_name string, data binary")
    assert {r.doc_path: r.content and bytes(r.content) for r in packages.rewritten(whole, unsafe).collect()}["good"] == good


def test_package_rules(spark):
    main = "word/document.xml"
    types = lambda more="", kind=packages.MAIN_TYPE: f'<Types xmlns="t"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="r"/><Override PartName="/{main}" ContentType="{kind}"/>{more}</Types>'
    rel = lambda k="r1", kind=packages.OFFICE_DOCUMENT, target=main, more="": f'<Relationship Id="{k}" Type="{kind}" Target="{target}"{more}/>'
    cases = {
        "fine": {}, "macro": {"word/vbaProject.bin": "x"}, "signed": {"_xmlsignatures/a.xml": "<a/>"}, "strict": {"word/a.xml": '<a xmlns="http://purl.oclc.org/ooxml/x"/>'},
        "twice": {"[Content_Types].xml": types('<Default Extension="XML" ContentType="z"/>')}, "type": {"[Content_Types].xml": types(kind="text/plain")}, "no types": {"[Content_Types].xml": None},
        "two offices": {"_rels/.rels": rel() + rel("r2")}, "same id": {"_rels/.rels": rel() + rel(kind="k")}, "mode": {"_rels/.rels": rel() + rel("r2", "k", main, ' TargetMode="Internal"')}, "malformed": {"_rels/.rels": rel() + rel("", "k")},
        "missing": {"_rels/.rels": rel(target="word/none.xml")}, "outside": {"_rels/.rels": rel() + rel("r2", "k", "https://x", ' TargetMode="external"')},
    }
    rows = []
    for name, changed in cases.items():
        parts = {"[Content_Types].xml": types(), "_rels/.rels": rel(), main: "<d/>"} | changed
        parts["_rels/.rels"] = f"<Relationships>{parts['_rels/.rels']}</Relationships>"
        rows += [(name, k, n, x.encode(), None) for k, (n, x) in enumerate(parts.items()) if x is not None]
    found = {}
    for r in package_rules.findings(spark.createDataFrame(rows, packages.PARTS)).collect():
        found.setdefault(r.doc_path, set()).add(r.message)
    assert "fine" not in found and "outside" not in found
    assert found.pop("no types") >= {"no content types part"}
    assert found == {
        "macro": {"macro part: word/vbaProject.bin", "part without content type: word/vbaProject.bin"}, "signed": {"signature part: _xmlsignatures/a.xml"}, "strict": {"strict or macro-enabled part: word/a.xml"},
        "twice": {"duplicate default content type: xml"}, "type": {"unsupported main document type: text/plain"}, "two offices": {"not exactly one office document relationship"}, "same id": {"duplicate relationship id: r1"},
        "mode": {"invalid relationship target mode: r2"}, "malformed": {"malformed relationship of: "}, "missing": {"relationship to a missing part: r1", "main document part is missing"},
    }


def test_markers_are_whole_words_in_any_case(spark):
    rows = [(' addin zotero_item csl_citation {"a":1}',), ('XZOTERO_ITEMS {"a":1}',), (' {"no":1} ZOTERO_ITEM CSL_CITATION {"a":2}',), ("ADDIN ZOTERO_BIBL",), (' ADDIN CSL_CITATION {"citationID":"q"}',)]
    i = F.col("i")
    df = spark.createDataFrame(rows, "i string")
    assert [tuple(r) for r in df.select(citations.instruction_kind(i), citations.payload(i), citations.is_legacy(i)).collect()] == [
        ("citation", '{"a":1}', False), (None, None, True), ("citation", '{"a":2}', False), ("bibliography", "{}", True), ("citation", '{"citationID":"q"}', True),
    ]
    listed = citations.listing(df.select(F.lit("g").alias("g"), F.monotonically_increasing_id().alias("ordinal"), F.col("i").alias("instruction")), "g").collect()
    assert sorted(str(r.citation_id) for r in listed) == ["None", "None", "q"]


def test_controls_and_revisions_are_protected(spark):
    kinds = [("text", "abc", None), ("content-control start", "", "1"), ("text", "def", None), ("revision start", "", "9"), ("text", "gh", None), ("revision end", "", "9"), ("content-control end", "", "1"), ("bookmark start", "", "1"), ("text", "i", None)]
    rows = spark.createDataFrame([(1, 0, k, kind, value, mark) for k, (kind, value, mark) in enumerate(kinds)], "doc_id long, paragraph int, seq int, kind string, value string, mark_id string")
    assert {(r.start, r.end, r.kind) for r in protection.protected_ranges(rows).collect()} == {(3, 8, "content-control"), (6, 8, "revision"), (8, 9, "unbalanced-bookmark"), (8, 8, "bookmark-boundary")}


def test_long_texts_with_many_hits(spark):
    text = "ab " * 20_000
    found = spark.createDataFrame([(text,)], "t string").select(locate.occurrences(F.col("t"), F.lit("b")).alias("o"), locate.nth_occurrence(F.col("t"), F.lit("b"), F.lit(20_000)).alias("n")).first()
    assert found.o == list(range(1, 60_000, 3)) and found.n == 59_998


def test_package_summary_properties_and_styles(spark):
    w = f'xmlns:w="{packages.W[1:-1]}"'
    rows = [
        ("word/document.xml", f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Two words</w:t></w:r></w:p><w:tbl><w:tblPr/><w:p/></w:tbl><w:p><w:ins><w:r/></w:ins><w:del/>{FIELD % "ADDIN ZOTERO_ITEM CSL_CITATION {}"}{FIELD % "ADDIN ZOTERO_BIBL {}"}</w:p><w:drawing/></w:document>'),
        ("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:type="separator" w:id="-1"><w:p/></w:footnote><w:footnote w:id="1"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'),
        ("word/comments.xml", f'<w:comments {w}><w:comment w:id="0"><w:p><w:r><w:t>said here</w:t></w:r></w:p></w:comment></w:comments>'),
        ("word/_rels/document.xml.rels", '<Relationships><Relationship TargetMode="External"/></Relationships>'),
        ("docProps/core.xml", "<cp:coreProperties><dc:title>Title</dc:title><dc:creator></dc:creator><dcterms:created xsi:type='x'> 2024 </dcterms:created></cp:coreProperties>"),
        ("word/styles.xml", '<w:styles><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="X"><w:pPr/></w:style></w:styles>'),
    ]
    parts = spark.createDataFrame([("d", n, x.encode()) for n, x in rows], "doc_path string, part_name string, data binary")
    links = [("_rels/.rels", f'<Relationship Id="r1" Type="{packages.OFFICE_DOCUMENT}" Target="word/document.xml"/>'), ("word/_rels/document.xml.rels", "".join(
        f'<Relationship Id="r{k}" Type="{BASE}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate((("footnotes", "footnotes.xml"), ("comments", "/word/comments.xml"), ("header", "missing.xml"), ("footnotes", "footnotes.xml")))
    ) + f'<Relationship Id="x" Type="{BASE}/hyperlink" Target="https://example.com" TargetMode="External"/>')]
    rows = [r for r in rows if not r[0].endswith(".rels")] + [(n, f"<Relationships>{x}</Relationships>") for n, x in links]
    parts = spark.createDataFrame([("d", k, n, x.encode(), None) for k, (n, x) in enumerate(rows)], packages.PARTS)
    rels = packages.relationships(parts)
    assert [(r.kind, r.part_name) for r in packages.stories(rels, parts).orderBy("place").collect()] == [("body", "word/document.xml"), ("footnote", "word/footnotes.xml"), ("comment", "word/comments.xml")]
    found = packages.summaries(parts).first().asDict()
    assert found == {
        "doc_path": "d", "stories": 3, "paragraphs": 5, "words": 5, "headings": 1, "tables": 1, "figures": 1, "footnotes": 1, "endnotes": 0, "comments": 1, "revisions": 2, "citations": 1, "has_bibliography": True, "external": 1,
    }
    assert {(r.name, r.value) for r in packages.core_properties(parts).collect()} == {("title", "Title"), ("created", "2024")}
    assert {(r.style_id, r.style_name) for r in packages.style_names(parts).collect()} == {("H1", "heading 1"), ("X", "X")}


def test_text_in_fields_counts_behind_all_separators(spark):
    """Random streams of marks and texts against a stack; deleted marks count nothing."""
    import random

    rng = random.Random(5)
    rows, expected = [], {}
    for doc in range(60):
        stack, texts = [], {0: ""}
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choice(["field begin", "field separate", "field end", "text", "text", "tab", "instruction", "empty"])
            gone = rng.random() < 0.1
            rows.append((str(doc), "p", seq // 7, seq, kind, f"{seq}.", gone))
            texts.setdefault(seq // 7, "")
            if gone:
                continue
            if kind == "field begin":
                stack.append(False)
            elif kind == "field separate" and stack:
                stack[-1] = True
            elif kind == "field end" and stack:
                stack.pop()
            elif kind in ("text", "tab") and all(stack):
                texts[seq // 7] += f"{seq}."
        expected |= {(str(doc), k): t for k, t in texts.items()}
    found = packages.shown_paragraphs(spark.createDataFrame(rows, packages.TOKENS))
    assert {(r.doc_path, r.idx): r.text for r in found.collect()} == expected
    assert packages.shown_paragraphs(spark.createDataFrame([], packages.TOKENS)).count() == 0
