"""Citation fields: instructions and their JSON payloads, listing, merging, hydration, preference chunks, plain citations.

Payloads stay text. They are read with JSON path functions and changed in Arrow batches with Python's ``json``, which
keeps the order of members, unknown members and the spelling of numbers as the parser can.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from docloom.sources.xml import read_xml

# Markers of field instructions, the payload's schema, and the citation patterns.
CITATION_MARK, CSL_MARK, BIBLIOGRAPHY_MARK, BIBLIOGRAPHY_END = "ZOTERO_ITEM", "CSL_CITATION", "ZOTERO_BIBL", "CSL_BIBLIOGRAPHY"
SCHEMA_URL = "https://github.com/citation-style-language/schema/raw/master/csl-citation.json"
AUTHOR_YEAR = r"\((?:[A-Z][\w'’-]+(?:\s+et\s+al\.)?,?\s+\d{4}[a-z]?(?:;\s*)?)+\)"
NARRATIVE = r"\b[A-Z][\w'’-]+(?:\s+et\s+al\.)?\s+\(\d{4}[a-z]?\)"
NUMERIC = r"\[(?:\d+(?:\s*[-–]\s*\d+)?)(?:\s*,\s*\d+)*\]"
PLAIN = (("author-year", AUTHOR_YEAR), ("narrative", NARRATIVE), ("numeric", NUMERIC))


def _mark(name: str) -> str:
    """The marker as a whole word in any case, as a pattern."""
    return rf"(?is)\b{name}\b"


def _after(instruction: Column, name: str) -> Column:
    """What stands behind the first such marker; null without one."""
    return F.when(F.regexp_like(instruction, F.lit(_mark(name))), F.regexp_replace(instruction, rf"(?is)^.*?\b{name}\b", ""))


def _marked(instruction: Column) -> Column:
    """What stands behind the marker that counts: of a bibliography, else of a citation's field, else of its payload."""
    return F.coalesce(*[_after(instruction, m) for m in (BIBLIOGRAPHY_MARK, CITATION_MARK, CSL_MARK)])


def is_bibliography(instruction: Column) -> Column:
    return F.regexp_like(instruction, F.lit(_mark(BIBLIOGRAPHY_MARK)))


def is_cited(instruction: Column) -> Column:
    """A citation's marker stands in it, be its payload readable or not, and no bibliography's."""
    return F.regexp_like(instruction, F.lit(_mark(f"(?:{CITATION_MARK}|{CSL_MARK})"))) & ~is_bibliography(instruction)


def instruction_kind(instruction: Column) -> Column:
    """bibliography wins over citation; a citation needs a JSON object."""
    return F.when(is_bibliography(instruction), "bibliography").when(is_cited(instruction) & json_object(_marked(instruction)).isNotNull(), "citation")


def is_legacy(instruction: Column) -> Column:
    """A citation without the payload's marker between the field's marker and the JSON."""
    between = F.regexp_extract(_after(instruction, CITATION_MARK), r"(?s)^[^{]*", 0)
    return F.coalesce(~F.regexp_like(between, F.lit(_mark(CSL_MARK))), F.lit(True))


def payload(instruction: Column) -> Column:
    """The first JSON object behind the marker, trailing text allowed; a bibliography without one has an empty object, all else null."""
    found = json_object(_marked(instruction))
    return F.coalesce(found, F.when(is_bibliography(instruction), "{}"))


@F.pandas_udf(StringType())
def json_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def first(text: str | None) -> str | None:
        at = text.find("{") if text else -1
        if at < 0:
            return None
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            return None
        return text[at:end] if isinstance(value, dict) else None

    return texts.map(first)


def field_id(instruction: Column, story: Column, ordinal: Column) -> Column:
    """A field's id: a citation's own, if it is text or a whole number; ``bibliography`` for one; else story and ordinal.

    Markers count anywhere and in any case. Where a citation's JSON is broken, the member is sought in its text. An empty
    id is none.
    """
    upper = F.upper(instruction)
    marked = F.contains(upper, F.lit(CITATION_MARK)) | F.contains(upper, F.lit(CSL_MARK))
    read = F.try_parse_json(json_object(instruction))
    whole = F.schema_of_variant(F.try_variant_get(read, "$.citationID", "variant")).isin("STRING", "BIGINT")
    torn = F.regexp_extract(instruction, r'"citationID"\s*:\s*"([^"]+)"', 1)
    named = F.when(read.isNotNull(), F.when(whole, F.try_variant_get(read, "$.citationID", "string"))).when(F.contains(instruction, F.lit("{")), torn)
    listed = F.when(F.contains(upper, F.lit(BIBLIOGRAPHY_MARK)), "bibliography")
    return F.coalesce(F.nullif(F.when(marked, named), F.lit("")), listed, F.concat_ws(":", story, ordinal.cast("string")))


def citation_instruction(body: Column) -> Column:
    return F.concat(F.lit(f" ADDIN {CITATION_MARK} {CSL_MARK} "), body, F.lit(" "))


def bibliography_instruction(body: Column) -> Column:
    return F.concat(F.lit(f" ADDIN {BIBLIOGRAPHY_MARK} "), body, F.lit(f" {BIBLIOGRAPHY_END} "))


def listing(fields: DataFrame, group: str) -> DataFrame:
    """fields (group, ordinal, instruction) -> citation fields with id, legacy flag and a warning.

    The first warning that holds: unreadable, missing id, duplicate id within the group, legacy. Ids are counted before
    they are joined back, so fields without one, or with a very common one, meet in no window.
    """
    rows = fields.filter(is_cited(F.col("instruction"))).withColumn("payload", payload(F.col("instruction")))
    rows = rows.withColumn("citation_id", F.get_json_object("payload", "$.citationID")).withColumn("legacy", is_legacy(F.col("instruction")))
    rows = rows.withColumn("spread", F.xxhash64(group, "citation_id"))
    twice = rows.filter("citation_id <> ''").groupBy(group, "citation_id").count().filter("count > 1").select(group, "citation_id", F.lit(True).alias("again"))
    met = rows.join(twice.withColumn("spread", F.xxhash64(group, "citation_id")), [group, "citation_id", "spread"], "left")
    warning = (
        F.when(F.col("payload").isNull(), "unreadable").when(F.coalesce("citation_id", F.lit("")) == "", "missing id").when(F.col("again"), "duplicate id").when(F.col("legacy"), "legacy")
    )
    return met.select(group, "ordinal", "citation_id", "legacy", warning.alias("warning"))


def bibliography_warnings(fields: DataFrame, group: str) -> DataFrame:
    """fields (group, instruction) -> group, bibliographies, warning where there is more than one."""
    counted = fields.filter(is_bibliography(F.col("instruction"))).groupBy(group).agg(F.count(F.lit(1)).alias("bibliographies"))
    return counted.withColumn("warning", F.when(F.col("bibliographies") > 1, "several bibliographies"))


def fallback_text(keys: Column) -> Column:
    return F.concat(F.lit("[Citation: "), F.array_join(keys, "; "), F.lit("]"))


def plain_formatted(text: Column, entities: Mapping[str, str] | None = None) -> Column:
    """Tags removed, entities resolved, white space at the ends dropped.

    Without ``entities`` all of HTML's are resolved, unclosed ones too, and white space is Unicode's. With them (name to
    character) just these are, where a semicolon closes them, and white space is ASCII's; no Python is needed then.
    """
    bare = F.regexp_replace(text, "<[^>]*>", "")
    if entities is not None:
        # The ampersand comes last: what it makes is read no second time.
        for name in sorted(entities, key=lambda n: entities[n] == "&"):
            bare = F.replace(bare, F.lit(f"&{name};"), F.lit(entities[name]))
        return F.regexp_replace(bare, r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")
    said = F.when(F.contains(bare, F.lit("&")), _unescaped(bare)).otherwise(bare)
    return F.regexp_replace(said, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t else t)


def chunk_points(text: Column, limit: int = 255) -> Column:
    """Greedy pieces of at most ``limit`` code points; the empty text has none. Of text within the first plane, ``chunk_utf16``'s pieces."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))


def chunk_utf16(text: Column, limit: int = 255) -> Column:
    """Greedy pieces of at most ``limit`` UTF-16 units that never split a pair; the empty text is one empty piece."""
    if limit < 2:
        raise ValueError("a pair needs two units")
    units = F.octet_length(F.encode(text, "UTF-16LE")) / 2
    wide = _chunk(text, F.lit(limit))
    return F.when(text == "", F.array(F.lit(""))).when(units == F.length(text), chunk_points(text, limit)).otherwise(wide)


@F.pandas_udf(ArrayType(StringType()))
def _chunk(texts: pd.Series, limits: pd.Series) -> pd.Series:
    def cut(text: str | None, limit: int) -> list[str] | None:
        if text is None:
            return None
        out, size = [""], 0
        for c in text:
            own = 1 + (ord(c) > 0xFFFF)
            if size + own > limit:
                out.append("")
                size = 0
            out[-1] += c
            size += own
        return out

    return pd.Series([cut(t, k) for t, k in zip(texts, limits, strict=True)])


def joined_preferences(chunks: DataFrame, group: str) -> DataFrame:
    """chunks (group, idx, chunk) -> value in order, and whether the indexes are exactly 1..n."""
    return chunks.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk"))), lambda x: x["chunk"]), "").alias("value"),
        ((F.count("idx") == F.count_distinct("idx")) & (F.min("idx") == 1) & (F.max("idx") == F.count("idx"))).alias("contiguous"),
    )


def decoded_preferences(joined: DataFrame, group: str, value: str = "value") -> DataFrame:
    """joined (group, value) -> the document preferences they spell: data_version, style, locale, session, has_bibliography, field_type, warning.

    The XML is read by a schema: children of the root and of ``prefs`` by local name, the first of several. What doesn't
    parse, or holds a document type, is a warning and no values; so is an older root's name, with its values.
    """
    schema = "`_data-version` string, style array<struct<_id: string, _locale: string, _hasBibliography: string>>, session array<struct<_id: string>>, prefs array<struct<pref: array<struct<_name: string, _value: string>>>>"
    root = F.regexp_extract(value, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    rows = joined.select(group, F.when(well_formed(F.col(value)), read_xml(F.col(value), schema)).alias("p"), root.alias("root"))
    style, session = F.get("p.style", 0), F.get("p.session", 0)
    field_type = F.get(F.filter(F.get("p.prefs", 0)["pref"], lambda p: F.lower(p["_name"]) == "fieldtype"), 0)["_value"]
    return rows.select(
        group, F.col("p.`_data-version`").alias("data_version"), style["_id"].alias("style"), style["_locale"].alias("locale"), session["_id"].alias("session"),
        F.coalesce(F.lower(style["_hasBibliography"]).isin("1", "true", "yes"), F.lit(False)).alias("has_bibliography"), field_type.alias("field_type"),
        F.when(F.col("p").isNull(), "invalid XML").when(F.col("root") != "data", "legacy root").alias("warning"),
    )


@F.pandas_udf(BooleanType())
def well_formed(texts: pd.Series) -> pd.Series:
    def parses(text: str | None) -> bool:
        try:
            ElementTree.fromstring((text or "").encode())
        except (ElementTree.ParseError, ValueError):
            return False
        return True

    return texts.map(parses)


def preference_document(style: Column, locale: Column, session: Column, has_bibliography: Column, field_type: Column) -> Column:
    """The XML of document preferences, which ``decoded_preferences`` reads; to be written in chunks."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(
        F.lit('<data data-version="3"><session id="'), safe(session), F.lit('"/><style id="'), safe(style), F.lit('" locale="'), safe(locale), F.lit('" hasBibliography="'),
        F.when(has_bibliography, "1").otherwise("0"), F.lit('"/><prefs><pref name="fieldType" value="'), safe(field_type), F.lit('"/></prefs></data>'),
    )


def inserted_citations(requests: DataFrame, fields: DataFrame, group: str) -> DataFrame:
    """requests (group, place, items, formatted), fields (group, citation_id): new citation fields with ids of their own.

    An id is a digest of the request, and of a number where a field of the group has it already or another request asks
    for the same. Returns group, place, citation_id, instruction, visible.
    """
    order = Window.partitionBy(group, "base").orderBy("place")
    base = F.substring(F.sha2(F.concat_ws("\x1f", F.col(group).cast("string"), "items", "formatted"), 256), 1, 8)
    rows = requests.withColumn("base", base).withColumn("n", F.row_number().over(order) - 1)
    used = fields.select(group, F.substring("citation_id", 1, 8).alias("base"), F.coalesce(F.regexp_extract("citation_id", r"^.{8}-(\d+)$", 1).try_cast("int"), F.lit(0)).alias("k"))
    last = used.filter(F.length("base") == 8).groupBy(group, "base").agg((F.max("k") + 1).alias("free"))
    met = rows.join(last, [group, "base"], "left").withColumn("n", F.col("n") + F.coalesce("free", F.lit(0)))
    named = met.withColumn("citation_id", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))))
    made = named.withColumn("payload", merged_payload(F.lit(None).cast("string"), "citation_id", "items", "formatted"))
    return made.select(group, "place", "citation_id", citation_instruction(F.col("payload")).alias("instruction"), plain_formatted(F.col("formatted")).alias("visible"))


def written_preferences(properties: DataFrame, values: DataFrame, group: str, prefix: str = "ZOTERO_PREF_", limit: int = 255) -> DataFrame:
    """properties (group, name, value) with each given value (group, value) as chunks 1..n; a group's older chunks go, all else stays."""
    old = F.startswith("name", F.lit(prefix))
    kept = properties.join(values.select(group, F.lit(True).alias("__new")), group, "left").filter(~old | F.col("__new").isNull()).drop("__new")
    rows = values.select(group, F.posexplode(chunk_utf16(F.col("value"), limit)).alias("k", "value"))
    return kept.unionByName(rows.select(group, F.concat(F.lit(prefix), (F.col("k") + 1).cast("string")).alias("name"), "value"))


def payload_findings(fields: DataFrame, keep: list[str]) -> DataFrame:
    """fields (keep..., payload) -> one row per broken rule of a citation's payload, with the item's place where there is one."""
    members = F.try_parse_json("payload")
    kind = lambda v, path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    items = F.try_variant_get(members, "$.citationItems", "array<variant>")
    rows = fields.select(*keep, kind(members, "$").alias("root"), kind(members, "$.properties").alias("properties"), items.alias("items"))
    whole = F.array_compact(F.array(
        F.when(~F.startswith("root", F.lit("OBJECT")), "payload is not an object"),
        F.when(F.startswith("root", F.lit("OBJECT")) & (F.coalesce(F.size("items"), F.lit(0)) <= 0), "citationItems is empty"),
        F.when(~F.col("properties").isin("VOID") & ~F.startswith("properties", F.lit("OBJECT")), "properties is not an object"),
    ))
    of_rows = rows.select(*keep, F.lit(-1).alias("item"), F.explode(whole).alias("message"))
    each = rows.select(*keep, F.posexplode("items").alias("item", "value"))
    own = kind(F.col("value"), "$")
    told = lambda name: kind(F.col("value"), f"$.{name}")
    is_object = F.startswith(own, F.lit("OBJECT"))
    of_items = F.array_compact(F.array(
        F.when(~is_object, "item is not an object"),
        F.when(is_object & (told("id") == "VOID") & (told("uris") == "VOID") & (told("itemData") == "VOID"), "item without id, uris or itemData"),
        F.when(is_object & (told("uris") != "VOID") & ~F.startswith(told("uris"), F.lit("ARRAY")), "uris is not an array"),
        F.when(is_object & (told("itemData") != "VOID") & ~F.startswith(told("itemData"), F.lit("OBJECT")), "itemData is not an object"),
    ))
    return of_rows.unionByName(each.select(*keep, "item", F.explode(of_items).alias("message")))


def missing_indexes(chunks: DataFrame, group: str) -> DataFrame:
    """Indexes between 1 and a group's largest that it lacks."""
    wanted = chunks.groupBy(group).agg(F.max("idx").alias("last")).select(group, F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias("idx"))
    return wanted.join(chunks.select(group, F.col("idx").cast("int").alias("idx")).distinct(), [group, "idx"], "left_anti")


def hydrate(items: DataFrame, library: DataFrame, key: str = "item_key") -> DataFrame:
    """items (key, uri, csl_json) with what the library has where they lack it: the caller's values win, empty is lacking."""
    own = library.select(F.col(key), F.col("uri").alias("__uri"), F.col("csl_json").alias("__csl"))
    met = items.join(own, key, "left")
    filled = met.withColumn("uri", F.coalesce(F.nullif("uri", F.lit("")), "__uri")).withColumn("csl_json", F.coalesce(F.nullif("csl_json", F.lit("")), "__csl"))
    return filled.drop("__uri", "__csl").withColumn("error", F.when(F.col("uri").isNull() | F.col("csl_json").isNull(), "REFERENCE_UNRESOLVED"))


def unresolved(items: DataFrame, library: DataFrame, key: str = "item_key") -> DataFrame:
    lacking = F.coalesce(F.nullif("uri", F.lit("")), F.lit(None)).isNull() | F.coalesce(F.nullif("csl_json", F.lit("")), F.lit(None)).isNull()
    return items.filter(lacking).join(library.select(key), key, "left_anti")


@F.pandas_udf(StringType())
def merged_payload(existing: pd.Series, citation_id: pd.Series, items: pd.Series, formatted: pd.Series) -> pd.Series:
    """A citation payload over an existing one (JSON or null). items: JSON array of id, uris, itemData and options.

    Members that aren't set here stay, of the payload and of items with the same id alike. Null where the payload is no
    JSON object or the items are no list of objects.
    """

    def merge(old: str | None, name: str, items_text: str | None, text: str | None) -> str | None:
        try:
            base, asked = json.loads(old) if old else {}, json.loads(items_text) if items_text is not None else []
        except ValueError:
            return None
        if not isinstance(base, dict) or not isinstance(asked, list) or not all(isinstance(x, dict) for x in asked):
            return None
        held = base.get("citationItems")
        before = {str(x.get("id")): x for x in (held if isinstance(held, list) else []) if isinstance(x, dict)}
        base["citationID"] = name
        if items_text is not None:
            base["citationItems"] = [before.get(str(x.get("id")), {}) | {k: v for k, v in x.items() if v not in (None, "")} for x in asked]
        held = base.get("properties")
        properties = dict(held) if isinstance(held, dict) else {}
        if text is not None:
            properties |= {"formattedCitation": text, "plainCitation": html.unescape(re.sub("<[^>]*>", "", text)).strip()}
        properties.setdefault("noteIndex", 0)
        base["properties"], base["schema"] = properties, SCHEMA_URL
        return json.dumps(base, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([merge(*row) for row in zip(existing, citation_id, items, formatted, strict=True)])


def update_citations(fields: DataFrame, updates: DataFrame, group: str) -> DataFrame:
    """updates (group, citation_id, items, formatted) rewrite the one field with that id; none or several is an error, as is a payload that is no object."""
    counted = fields.groupBy(group, "citation_id").agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"))
    met = updates.join(counted, [group, "citation_id"], "left")
    error = F.when(F.col("n").isNull(), "REFERENCE_UNRESOLVED").when(F.col("n") > 1, "ANCHOR_AMBIGUOUS")
    told = met.withColumn("error", error).withColumn("payload", F.when(F.col("error").isNull(), merged_payload("payload", "citation_id", "items", "formatted")))
    return told.select(group, "citation_id", F.coalesce("error", F.when(F.col("payload").isNull(), "INVALID_REQUEST")).alias("error"), "payload")


def remove_citations(fields: DataFrame, removals: DataFrame, group: str) -> DataFrame:
    """removals (group, citation_id, keep_visible): fields that stay, and removed ones as plain text where it is kept."""
    met = fields.join(removals.withColumn("removed", F.lit(True)), [group, "citation_id"], "left")
    kept = met.filter(F.col("removed").isNull() | F.col("keep_visible"))
    return kept.select(group, "ordinal", F.when(F.col("removed").isNull(), F.col("citation_id")).alias("citation_id"), "visible")


def sync_bibliographies(documents: DataFrame, fields: DataFrame, group: str) -> DataFrame:
    """documents (group, has_locator): several bibliographies are ambiguous, one is updated, none is appended at a locator."""
    counted = fields.filter("kind = 'bibliography'").groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    action = F.when(n > 1, "ANCHOR_AMBIGUOUS").when(n == 1, "update").when(~F.col("has_locator"), "INVALID_REQUEST").otherwise("append")
    return documents.join(counted, group, "left").select(group, action.alias("action"))


def plain_citations(paragraphs: DataFrame, keep: list[str]) -> DataFrame:
    """Candidates in paragraphs (keep..., text): kind, found, start, end, in the order of kinds and offsets.

    Rows without a bracket and a digit never reach Python. Offsets come from the matcher: searching for the found text
    could hit an earlier place.
    """
    patterns = [(kind, re.compile(p)) for kind, p in PLAIN]
    schema = ", ".join(f"{paragraphs.schema[c].name} {paragraphs.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, kind, m[0], m.start(), m.end()) for k, text in enumerate(batch["text"]) for kind, p in patterns for m in p.finditer(text)
            ]
            found = pd.DataFrame(rows, columns=["row", "kind", "found", "start", "end"])
            yield pd.concat([batch[list(keep)].iloc[found["row"]].reset_index(drop=True), found.drop(columns="row")], axis=1)

    likely = paragraphs.filter(F.regexp_like("text", F.lit(r"[(\[].*\d")))
    return likely.select(*keep, "text").mapInPandas(scan, f"{schema}, kind string, found string, start int, end int")
