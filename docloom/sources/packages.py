"""Word-processing packages as rows: files, parts, relationships, content types, text tokens, and packages written again.

A package is one row (doc_path, sha256, length, content); a part is one row (doc_path, ordinal, part_name, data). Only
opening a ZIP, walking one part's XML and writing a ZIP need Python, in Arrow batches; all else is joins and expressions.
A package that breaks a rule becomes a row with an error and never stops the others.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.edits import lowest_free
from docloom.operators.fields import covered
from docloom.operators.paragraphs import is_heading_style, word_count
from docloom.sources.xml import read_xml

# Limits, names and namespaces of the format.
MAX_DOCUMENT_BYTES, MAX_EXPANDED_BYTES, MAX_MEMBERS = 104_857_600, 536_870_912, 10_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
UNSAFE_XML = re.compile(rb"<!\s*(?:DOCTYPE|ENTITY)\b", re.I)
OFFICE_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
HIDDEN = (f"{W}del", f"{W}moveFrom")
SEPARATORS = ("separator", "continuationSeparator", "continuationNotice")
STORIES = {"header": "header", "footer": "footer", "footnotes": "footnote", "endnotes": "endnote", "comments": "comment"}
#: A frame of results holds about so many bytes of members.
FRAME_BYTES = 16_000_000
#: And a frame of facts about so many rows.
FRAME_ROWS = 20_000

PARTS = "doc_path string, ordinal int, part_name string, data binary, error string"
RELATIONSHIPS = "doc_path string, source_part string, ordinal int, rel_id string, rel_type string, target string, target_mode string"
FACTS = "doc_path string, fact string, ordinal int, name string, kind string, content_type string, source_part string, rel_type string, target string, target_mode string, marked boolean, error string"
FACT_NAMES = [column.split()[0] for column in FACTS.split(", ")]
FACT_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[column.split()[1]] for column in FACTS.split(", ")]
TOKENS = "doc_path string, part_name string, paragraph int, seq int, kind string, value string, deleted boolean"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path that Spark can read, hashed; owner files (~$name) mark documents that are open elsewhere."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.col("path").alias("doc_path"), F.sha2("content", 256).alias("sha256"), "length", "content")
    name = F.element_at(F.split("doc_path", "/"), -1)
    owners = rows.filter(F.startswith(name, F.lit("~$"))).select(F.regexp_replace("doc_path", r"/~\$(?=[^/]*$)", "/").alias("doc_path")).withColumn("open_elsewhere", F.lit(True))
    return rows.filter(~F.startswith(name, F.lit("~$"))).join(owners, "doc_path", "left").withColumn("open_elsewhere", F.coalesce("open_elsewhere", F.lit(False)))


def checked_hashes(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files (doc_path, sha256), expected (doc_path, expected_sha256) -> with the error of a file that isn't there or has changed; no expectation asks nothing."""
    met = expected.join(files.select("doc_path", "sha256"), "doc_path", "left")
    changed = F.lower("expected_sha256") != F.col("sha256")
    return met.withColumn("error", F.when(F.col("sha256").isNull(), "DOCUMENT_NOT_FOUND").when(changed, "STALE_REVISION"))


def percent_decoded(text: Column) -> Column:
    """Percent escapes read as UTF-8; what is no escape stays, and so does a plus sign."""
    kept = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(kept)


def safe_name(name: Column) -> Column:
    """Whether a member may have the name. One leading slash, and a closing one as folders have it, are allowed.

    Not allowed are the empty name, a NUL or backslash as written, and, once escapes are read, a leading slash, an empty
    component before the last, ``.`` or ``..`` anywhere, and a colon in the first component. A null name is null.
    """
    raw = F.regexp_replace(name, "^/", "")
    spoiled = F.regexp_like(raw, F.lit(r"[\x00\\]|^/"))
    walks = F.regexp_like(percent_decoded(raw), F.lit(r"(^|/)\.{0,2}/|(^|/)\.{1,2}$|^[^/]*:"))
    return (raw != "") & ~spoiled & ~walks


def _members(content: bytes | None) -> tuple[list[tuple[str, bytes]], str | None]:
    """A package's members in order, or none and an error: what can't be opened is unsafe, as is a member that is twice there or encrypted."""
    if content is None:
        return [], "UNSUPPORTED_DOCUMENT"
    if len(content) > MAX_DOCUMENT_BYTES:
        return [], "RESOURCE_LIMIT"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
            if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_EXPANDED_BYTES:
                return [], "RESOURCE_LIMIT"
            if len({i.filename for i in infos}) < len(infos) or any(i.flag_bits & 1 for i in infos):
                return [], "UNSAFE_PACKAGE"
            return [(i.filename, archive.read(i)) for i in infos], None
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
        return [], "UNSAFE_PACKAGE"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_path", "ordinal", "part_name", "data", "error"]).astype({"ordinal": "Int32"})


def parts(packages: DataFrame) -> DataFrame:
    """One row per member; a package that can't be opened, or is null, is one row with an error and no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch["doc_path"], batch["content"], strict=True):
                found, error = _members(content)
                held += [(path, k, name, data, None) for k, (name, data) in enumerate(found)] if error is None else [(path, None, None, None, error)]
                size += sum(len(data) for _, data in found)
                if size > FRAME_BYTES:
                    yield _frame(held)
                    held, size = [], 0
            yield _frame(held)
            held, size = [], 0

    rows = packages.select("doc_path", "content").mapInPandas(run, PARTS)
    return rows.withColumn("error", F.coalesce("error", F.when(~safe_name(F.col("part_name")), "UNSAFE_PACKAGE")))


def _tree(data: bytes) -> ElementTree.Element | None:
    """Parsed XML; None if it holds a document type or an entity, or doesn't parse."""
    if UNSAFE_XML.search(data):
        return None
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return None


def xml_findings(part_rows: DataFrame) -> DataFrame:
    """XML parts that hold a document type or an entity, or don't parse: doc_path, part_name, error, reason. All of them are unsafe, by the first rule that refuses them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = [_tree(d) is None for d in batch["data"]]
            reasons = ["DECLARATION" if UNSAFE_XML.search(d) else "MALFORMED" for d in batch["data"]]
            yield batch[["doc_path", "part_name"]].assign(error="UNSAFE_PACKAGE", reason=reasons)[bad]

    named = part_rows.filter(F.col("data").isNotNull() & F.regexp_like("part_name", F.lit(r"(?i)\.(xml|rels)$")))
    return named.select("doc_path", "part_name", "data").mapInPandas(run, "doc_path string, part_name string, error string, reason string")


def xml_errors(part_rows: DataFrame) -> DataFrame:
    """doc_path, part_name, error of ``xml_findings``."""
    return xml_findings(part_rows).drop("reason")


def _relationships_in(name: str, data: bytes) -> Iterator[tuple[str, int, str | None, str | None, str | None, str | None]]:
    tree = _tree(data)
    folder, _, file = name.removesuffix(".rels").rpartition("_rels/")
    for k, r in enumerate(tree if tree is not None else []):
        yield folder + file, k, r.get("Id"), r.get("Type"), r.get("Target"), r.get("TargetMode")


def relationships(part_rows: DataFrame) -> DataFrame:
    """All relationships of the relationship parts in their order, each with the part it starts from ("" for the package)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name, data in zip(batch["doc_path"], batch["part_name"], batch["data"], strict=True):
                rows += [(path, *r) for r in _relationships_in(name, data)]
            yield pd.DataFrame(rows, columns=["doc_path", "source_part", "ordinal", "rel_id", "rel_type", "target", "target_mode"])

    return part_rows.filter(F.endswith("part_name", F.lit(".rels"))).select("doc_path", "part_name", "data").mapInPandas(run, RELATIONSHIPS)


def resolved_target(source: Column, target: Column) -> Column:
    """The part a relative or absolute target means: query and fragment dropped, escapes read, ``.`` and ``..`` walked; null if it leaves the package or is no safe name.

    A fold over the path's components, so no Python is needed; what comes of it is judged at its end, so it runs once.
    """
    said = F.regexp_replace(target, r"(?s)[?#].*$", "")
    bare = percent_decoded(said)
    folder = F.regexp_replace(source, "[^/]*$", "")
    path = F.when(F.startswith(bare, F.lit("/")), F.substring(bare, F.lit(2), F.length(bare))).otherwise(F.concat(folder, bare))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(acc: Column, piece: Column) -> Column:
        up = piece == ".."
        at = F.when(up, F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).when(piece.isin("", "."), acc["at"]).otherwise(F.concat(acc["at"], F.array(piece)))
        return F.struct(at.alias("at"), (acc["inside"] & ~(up & (F.size(acc["at"]) == 0))).alias("inside"))

    def reached(acc: Column) -> Column:
        name = F.array_join(acc["at"], "/")
        return F.when(acc["inside"] & (F.size(acc["at"]) > 0) & safe_name(name), name)

    unsafe = F.regexp_like(said, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:|^//")) | F.regexp_like(bare, F.lit(r"[\x00\\]"))
    return F.when(~unsafe, F.aggregate(F.split(path, "/", -1), start, step, reached))


def extension(part_name: Column) -> Column:
    return F.lower(F.regexp_extract(part_name, r"\.([^./]*)$", 1))


def content_types(part_names: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """part_names (doc_path, part_name) with their type: an override by name, else the default of the extension."""
    rows = part_names.withColumn("extension", extension(F.col("part_name")))
    rows = rows.join(overrides.withColumnRenamed("content_type", "__override"), ["doc_path", "part_name"], "left")
    rows = rows.join(defaults.withColumnRenamed("content_type", "__default"), ["doc_path", "extension"], "left")
    return rows.select("doc_path", "part_name", F.coalesce("__override", "__default").alias("content_type"))


KINDS = {f"{W}t": "text", f"{W}delText": "deleted text", f"{W}instrText": "instruction", f"{W}tab": "tab", f"{W}br": "break", f"{W}cr": "break"}
SAID = {"tab": "\t", "break": "\n"}


def _walk(node: ElementTree.Element, hidden: bool) -> Iterator[tuple[str, str, bool]]:
    """The tokens below a node, but for those of paragraphs inside it: kind, value, deleted."""
    for child in node:
        if child.tag == f"{W}p" or child.tag == f"{W}pPr":
            continue
        gone = hidden or child.tag in HIDDEN
        if child.tag in KINDS:
            yield KINDS[child.tag], SAID.get(KINDS[child.tag], child.text or ""), gone
        elif child.tag == f"{W}fldChar":
            yield f"field {child.get(f'{W}fldCharType')}", "", gone
        else:
            yield from _walk(child, gone)


def _paragraphs(tree: ElementTree.Element | None) -> Iterator[ElementTree.Element]:
    """All paragraphs of a part in order, without those of notes that only separate others."""
    if tree is None:
        return
    if tree.tag == f"{W}p":
        yield tree
    for child in tree:
        if child.tag in (f"{W}footnote", f"{W}endnote") and (child.get(f"{W}type") in SEPARATORS or (child.get(f"{W}id") or "").startswith("-")):
            continue
        yield from _paragraphs(child)


def paragraph_texts(part_rows: DataFrame) -> DataFrame:
    """doc_path, part_name, idx, text, style, outline: the visible paragraphs of the given parts, joined where they are parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name, data in zip(batch["doc_path"], batch["part_name"], batch["data"], strict=True):
                for k, p in enumerate(_paragraphs(_tree(data))):
                    text = "".join(value for kind, value, gone in _walk(p, False) if not gone and kind in ("text", "tab", "break"))
                    style, outline = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}pPr/{W}outlineLvl")
                    rows.append((path, name, k, text, None if style is None else style.get(f"{W}val"), outline is not None))
            yield pd.DataFrame(rows, columns=["doc_path", "part_name", "idx", "text", "style", "outline"])

    return part_rows.filter("data IS NOT NULL").select("doc_path", "part_name", "data").mapInPandas(run, "doc_path string, part_name string, idx int, text string, style string, outline boolean")


def main_parts(rels: DataFrame) -> DataFrame:
    """doc_path, part_name: the target of a package's first internal office document relationship."""
    own = rels.filter((F.col("source_part") == "") & (F.col("rel_type") == OFFICE_DOCUMENT) & ~is_external(F.col("target_mode")))
    named = own.withColumn("part_name", resolved_target(F.lit(""), F.col("target"))).filter("part_name IS NOT NULL")
    return named.groupBy("doc_path").agg(F.min_by("part_name", "ordinal").alias("part_name"))


def is_external(target_mode: Column) -> Column:
    return F.lower(F.coalesce(target_mode, F.lit(""))) == "external"


def stories(rels: DataFrame, part_names: DataFrame) -> DataFrame:
    """doc_path, part_name, kind, place: the main part, then the headers, footers, notes and comments it points to, each part once.

    rels as ``relationships`` gives them, part_names (doc_path, part_name). External targets and parts that aren't there are no story.
    """
    main = main_parts(rels)
    base = OFFICE_DOCUMENT.rpartition("/")[0]
    kinds = F.coalesce(*[F.when(F.col("rel_type") == f"{base}/{name}", kind) for name, kind in STORIES.items()])
    pointed = rels.join(main.withColumnRenamed("part_name", "source_part"), ["doc_path", "source_part"]).filter(~is_external(F.col("target_mode")))
    pointed = pointed.select("doc_path", resolved_target(F.col("source_part"), F.col("target")).alias("part_name"), kinds.alias("kind"), (F.col("ordinal") + 1).alias("place"))
    every = main.select("doc_path", "part_name", F.lit("body").alias("kind"), F.lit(0).alias("place")).unionByName(pointed.filter("kind IS NOT NULL"))
    first = every.groupBy("doc_path", "part_name").agg(F.min(F.struct("place", "kind")).alias("first")).select("doc_path", "part_name", "first.kind", "first.place")
    there = part_names.select("doc_path", "part_name", F.lit(True).alias("there"))
    return first.join(there, ["doc_path", "part_name"], "left").filter("there OR kind = 'body'").drop("there")


def story_paragraphs(part_rows: DataFrame, story_rows: DataFrame) -> DataFrame:
    """The paragraphs of every story: doc_path, kind, place, part_name, idx, text, style, outline."""
    wanted = part_rows.select("doc_path", "part_name", "data").join(story_rows.select("doc_path", "part_name"), ["doc_path", "part_name"], "left_semi")
    return paragraph_texts(wanted).join(story_rows, ["doc_path", "part_name"])


def _types_in(data: bytes) -> Iterator[tuple[str, str | None, str | None, int]]:
    tree = _tree(data)
    for k, e in enumerate(tree if tree is not None else []):
        kind = e.tag.rpartition("}")[2]
        yield kind, e.get("Extension" if kind == "Default" else "PartName"), e.get("ContentType"), k


def content_type_rows(part_rows: DataFrame) -> DataFrame:
    """What the content types part declares: doc_path, kind (Default or Override), name (extension or part), content_type, ordinal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["doc_path"], batch["data"], strict=True):
                rows += [(path, *t) for t in _types_in(data)]
            yield pd.DataFrame(rows, columns=["doc_path", "kind", "name", "content_type", "ordinal"])

    named = part_rows.filter("part_name = '[Content_Types].xml' AND data IS NOT NULL").select("doc_path", "data")
    return named.mapInPandas(run, "doc_path string, kind string, name string, content_type string, ordinal int")


def facts(part_rows: DataFrame, marked: Column) -> DataFrame:
    """Everything a package says of its parts, in one pass: a row for each part (name, error, and whether ``marked`` holds), declared type and relationship (name: its id).

    The column fact tells them apart. Only the types part and relationship parts bring their bytes to Python.
    """

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), FACT_TYPES, strict=True)], names=FACT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, part, error, mark, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append((path, "part", None, part, None, None, None, None, None, None, mark, error))
                if data is not None and part.endswith(".rels"):
                    rows += [(path, "relationship", k, rel_id, None, None, source, kind, target, mode, None, None) for source, k, rel_id, kind, target, mode in _relationships_in(part, data)]
                elif data is not None:
                    rows += [(path, "type", k, name, kind, content_type, None, None, None, None, None, None) for kind, name, content_type, k in _types_in(data)]
                if len(rows) > FRAME_ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    read = (F.col("part_name") == "[Content_Types].xml") | F.endswith("part_name", F.lit(".rels"))
    return part_rows.select("doc_path", "part_name", "error", marked.alias("marked"), F.when(read, F.col("data")).alias("data")).mapInArrow(run, FACTS)


def declared_types(part_names: DataFrame, declared: DataFrame) -> DataFrame:
    """part_names with their types as declared; of a name that is declared twice the first counts (``rules`` finds it)."""
    usable = declared.filter("name IS NOT NULL AND content_type IS NOT NULL")
    name = F.when(F.col("kind") == "Override", F.regexp_replace("name", "^/", "")).otherwise(F.lower("name"))
    one = usable.groupBy("doc_path", "kind", name.alias("name")).agg(F.min_by("content_type", "ordinal").alias("content_type"))
    overrides = one.filter("kind = 'Override'").select("doc_path", F.col("name").alias("part_name"), "content_type")
    defaults = one.filter("kind = 'Default'").select("doc_path", F.col("name").alias("extension"), "content_type")
    return content_types(part_names, overrides, defaults)


def added_types(part_names: DataFrame, declared: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_path, part_name, content_type) -> the overrides to declare: those whose part has another type, or none, so far."""
    known = declared_types(wanted.select("doc_path", "part_name"), declared).withColumnRenamed("content_type", "known")
    met = wanted.join(part_names.select("doc_path", "part_name"), ["doc_path", "part_name"], "left_semi").join(known, ["doc_path", "part_name"])
    return met.filter(~F.col("known").eqNullSafe(F.col("content_type"))).select("doc_path", "part_name", "content_type", F.col("known").isNull().alias("new"))


def ensured_relationships(rels: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_path, source_part, rel_type, target) -> with rel_id and whether it is new: an internal one that is there is used again, else rId and the lowest free number."""
    key = ["doc_path", "source_part"]
    same = rels.filter(~is_external(F.col("target_mode"))).groupBy(*key, "rel_type", "target").agg(F.min_by("rel_id", "ordinal").alias("known"))
    numbers = rels.select(*key, F.regexp_extract("rel_id", r"^rId(\d+)$", 1).try_cast("int").alias("n"))
    free = lowest_free(numbers, key, "n")
    met = wanted.join(same, [*key, "rel_type", "target"], "left").join(free, key, "left")
    return met.select(*key, "rel_type", "target", F.coalesce("known", F.concat(F.lit("rId"), F.coalesce("free_id", F.lit(1)).cast("string"))).alias("rel_id"), F.col("known").isNull().alias("new"))


def tokens(part_rows: DataFrame, part: str = "word/document.xml") -> DataFrame:
    """Text tokens of a part's paragraphs in order: text, tab, break, instruction, and field begin, separate, end.

    What stands in deletions and moves away is marked, as are instructions by their kind, so visibility is a filter. A
    paragraph without a token has one of kind ``empty``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows, size = ["doc_path", "part_name", "paragraph", "seq", "kind", "value", "deleted"], [], 0
        for batch in batches:
            for path, name, data in zip(batch["doc_path"], batch["part_name"], batch["data"], strict=True):
                tree = _tree(data)
                rows += [
                    (path, name, k, seq, *token)
                    for k, p in enumerate(tree.iter(f"{W}p") if tree is not None else [])
                    for seq, token in enumerate(list(_walk(p, False)) or [("empty", "", False)])
                ]
                size += len(data)
                if size > FRAME_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return part_rows.filter(F.col("part_name") == part).select("doc_path", "part_name", "data").mapInPandas(run, TOKENS)


def visible_paragraphs(token_rows: DataFrame) -> DataFrame:
    """doc_path, part_name, idx, text: tokens joined in order, without deletions and instructions."""
    seen = F.when(~F.col("deleted") & F.col("kind").isin("text", "tab", "break"), F.col("value")).otherwise("")
    return token_rows.groupBy("doc_path", "part_name", F.col("paragraph").alias("idx")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", seen.alias("value")))), lambda x: x["value"]), "").alias("text")
    )


def shown_paragraphs(token_rows: DataFrame) -> DataFrame:
    """doc_path, part_name, idx, text as edits of citations see it: of a field only the result counts, and only if those around it have come to theirs."""
    kind = F.when(F.col("deleted"), "deleted").otherwise(F.col("kind"))
    rows = token_rows.select(F.struct("doc_path", "part_name").alias("stream"), F.struct("paragraph", "seq").alias("seq"), kind.alias("kind"), "value")
    seen = F.when(~F.col("covered") & F.col("kind").isin("text", "tab", "break"), F.col("value")).otherwise("")
    found = covered(rows).groupBy("stream", F.col("seq.paragraph").alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("seq.seq").alias("seq"), seen.alias("value")))).alias("said"))
    return found.select("stream.doc_path", "stream.part_name", "idx", F.array_join(F.transform("said", lambda x: x["value"]), "").alias("text"))


def _paragraph_xml(text: str) -> str:
    pieces = [f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in text.split("\t")]
    return f"<w:p><w:r>{'<w:tab/>'.join(pieces)}</w:r></w:p>"


def packages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Minimal packages, one per document, a paragraph for each line: doc_path (the id), content."""
    types = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{MAIN_TYPE}"/></Types>'
    rels = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{OFFICE_DOCUMENT}" Target="word/document.xml"/></Relationships>'

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text in batch["text"]:
                body = "".join(_paragraph_xml(line) for line in (text or "").split("\n"))
                document = f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'
                rows = [(k, n, d.encode()) for k, (n, d) in enumerate([("[Content_Types].xml", types), ("_rels/.rels", rels), ("word/document.xml", document)])]
                made.append(_zip(rows))
            yield pd.DataFrame({"doc_path": batch["doc_path"], "content": made})

    return docs.select(F.col(id_col).cast("string").alias("doc_path"), F.col(text_col).alias("text")).mapInPandas(run, "doc_path string, content binary")


def _zip(rows: list[tuple[int, str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for _, name, data in sorted(rows):
            archive.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rewritten(packages: DataFrame, changes: DataFrame) -> DataFrame:
    """packages (doc_path, content) with changed parts (doc_path, part_name, data; null data removes): doc_path, content.

    Packages without a change keep their bytes, as do those that can't be opened. A changed XML part that is unsafe or
    doesn't parse changes nothing either. A package's members meet in one task, as its bytes already did.
    """
    gathered = changes.groupBy("doc_path").agg(F.collect_list(F.struct("part_name", "data")).alias("changes"))
    met = packages.select("doc_path", "content").join(gathered, "doc_path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for content, own in zip(batch["content"], batch["changes"], strict=True):
                new = {c["part_name"]: c["data"] for c in own}
                old, error = _members(content)
                unsafe = any(d is not None and n.lower().endswith((".xml", ".rels")) and _tree(d) is None for n, d in new.items())
                if error or unsafe:
                    made.append(content)
                    continue
                names = {n for n, _ in old}
                rows = [(n, new.get(n, d)) for n, d in old] + [(n, d) for n, d in new.items() if n not in names]
                made.append(_zip([(k, n, d) for k, (n, d) in enumerate(rows) if d is not None]))
            yield pd.DataFrame({"doc_path": batch["doc_path"], "content": made})

    same = met.filter("changes IS NULL").select("doc_path", "content")
    return same.unionByName(met.filter("changes IS NOT NULL").mapInPandas(run, "doc_path string, content binary"))


def _tags(xml: Column, names: str, attributes: str = "") -> Column:
    """How many elements of these local names begin, whatever their prefix."""
    return F.regexp_count(xml, F.lit(rf"<(?:\w+:)?(?:{names})(?=[\s/>]){attributes}"))


def summaries(part_rows: DataFrame) -> DataFrame:
    """Per package, over all its stories: stories, paragraphs, words, headings, tables, figures, footnotes, endnotes, comments, revisions, citations, has_bibliography, external.

    Elements and fields are counted in the parts' text; only paragraphs are parsed. Notes that merely separate don't count.
    """
    rels = relationships(part_rows)
    told = stories(rels, part_rows.filter("data IS NOT NULL").select("doc_path", "part_name"))
    xml = F.decode("data", "UTF-8")
    note = r"(?![^>]*\btype=\"(?:separator|continuationSeparator|continuationNotice)\")(?![^>]*\bid=\"-)"
    of = lambda kind, names, attributes="": F.sum(F.when(F.col("kind") == kind, _tags(xml, names, attributes)).otherwise(0)).cast("long")
    every = lambda names: F.sum(_tags(xml, names)).cast("long")
    fields = F.regexp_extract_all(xml, F.lit(r'(?s)fldCharType="begin".*?fldCharType="(?:separate|end)"'), F.lit(0))
    said = F.transform(fields, lambda f: F.upper(F.regexp_replace(f, "<[^>]*>", "")))
    cites = F.size(F.filter(said, lambda f: F.contains(f, F.lit("ZOTERO_ITEM")) | F.contains(f, F.lit("CSL_CITATION"))))
    counts = part_rows.filter("data IS NOT NULL").join(told, ["doc_path", "part_name"]).groupBy("doc_path").agg(
        F.count(F.lit(1)).alias("stories"), every("tbl").alias("tables"), every("drawing|pict|object").alias("figures"), of("footnote", "footnote", note).alias("footnotes"),
        of("endnote", "endnote", note).alias("endnotes"), of("comment", "comment").alias("comments"), every("ins|del|moveFrom|moveTo").alias("revisions"), F.sum(cites).cast("long").alias("citations"),
        F.bool_or(F.exists(said, lambda f: F.contains(f, F.lit("ZOTERO_BIBL")))).alias("has_bibliography"),
    )
    styles = style_names(part_rows).withColumnRenamed("style_id", "style")
    seen = story_paragraphs(part_rows, told).join(styles, ["doc_path", "style"], "left")
    heading = is_heading_style(F.coalesce("style_name", "style")) | F.col("outline")
    texts = seen.groupBy("doc_path").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(word_count(F.col("text"))).cast("long").alias("words"), F.count_if(heading).alias("headings"),
    )
    outside = rels.groupBy("doc_path").agg(F.count_if(is_external(F.col("target_mode"))).alias("external"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    met = counts.join(texts, "doc_path", "left").join(outside, "doc_path", "left")
    return met.select("doc_path", "stories", zero("paragraphs"), zero("words"), zero("headings"), "tables", "figures", "footnotes", "endnotes", "comments", "revisions", "citations", "has_bibliography", zero("external"))


#: The names of core properties.
CORE_PROPERTIES = (
    "category", "contentStatus", "contentType", "created", "creator", "description", "identifier", "keywords", "language", "lastModifiedBy", "lastPrinted", "modified", "revision", "subject", "title", "version",
)


def core_properties(part_rows: DataFrame) -> DataFrame:
    """doc_path, name, value: the core properties that have a text, by local name; of several of a name the last counts. Names the format doesn't know are none."""
    schema = ", ".join(f"{name} array<struct<_VALUE: string>>" for name in CORE_PROPERTIES)
    rows = part_rows.filter("part_name = 'docProps/core.xml'").select("doc_path", read_xml(F.decode("data", "UTF-8"), schema).alias("p"))
    told = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.trim(F.try_element_at(F.filter(F.col(f"p.{name}._VALUE"), lambda v: F.trim(v) != ""), F.lit(-1))).alias("value")) for name in CORE_PROPERTIES]))
    return rows.select("doc_path", told.alias("e")).select("doc_path", "e.name", "e.value").filter("value <> ''")


def style_names(part_rows: DataFrame) -> DataFrame:
    """doc_path, style_id, style_name: the name of each style, its id where it has none; a style without an id is none."""
    read = read_xml(F.decode("data", "UTF-8"), "style array<struct<_styleId: string, name: array<struct<_val: string>>>>")
    rows = part_rows.filter("part_name = 'word/styles.xml'").select("doc_path", F.explode(read["style"]).alias("s")).filter("coalesce(s._styleId, '') <> ''")
    return rows.select("doc_path", F.col("s._styleId").alias("style_id"), F.coalesce(F.nullif(F.get(F.col("s.name"), 0)["_val"], F.lit("")), F.col("s._styleId")).alias("style_name"))
