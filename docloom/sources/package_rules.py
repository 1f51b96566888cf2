"""Rules a package must keep, as DataFrames of findings: whole packages, content types, relationships.

A finding is (doc_path, layer, severity, message). Rules look at names, declared types and relationships as rows; only the
markers of strict and macro-enabled documents are sought in the bytes of XML parts. Parts are read once and their facts
dealt once, by package: what rules ask of other facts, windows answer within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.validation import finding
from docloom.sources import packages

# Names, prefixes and markers of what isn't supported.
TYPES_PART, ROOT_RELATIONSHIPS = "[Content_Types].xml", "_rels/.rels"
MACRO_NAMES = ("word/vbaproject.bin", "word/vbadata.xml", "word/activex")
SIGNATURE_PREFIXES = ("_xmlsignatures/", "package/services/digital-signature/")
STRICT_MARKERS = ("http://purl.oclc.org/ooxml/", "application/vnd.ms-word.document.macroenabled")
MAIN_TYPE_MARK = "wordprocessingml.document.main+xml"


def _told(holds: Column, text: str, *more: str) -> Column:
    return F.when(holds, F.concat(F.lit(text), *[F.coalesce(F.col(c), F.lit("")) for c in more]))


def strict_marker(part_name: Column, data: Column) -> Column:
    """Whether an XML part names what only strict or macro-enabled documents have."""
    text = F.lower(F.decode(data, "ISO-8859-1"))
    return F.when(F.regexp_like(F.lower(part_name), F.lit(r"\.(xml|rels)$")), F.contains(text, F.lit(STRICT_MARKERS[0])) | F.contains(text, F.lit(STRICT_MARKERS[1])))


def part_rules() -> list[Column]:
    """What a part may not be by its own name and bytes; columns as ``packages.facts`` gives them."""
    part, name = F.col("fact") == "part", F.lower("name")
    macro = name.isin(*MACRO_NAMES) | F.startswith(name, F.lit("word/activex/")) | F.contains(name, F.lit("vbaproject"))
    signed = F.startswith(name, F.lit(SIGNATURE_PREFIXES[0])) | F.startswith(name, F.lit(SIGNATURE_PREFIXES[1]))
    return [
        _told(part & macro, "macro part: ", "name"), _told(part & signed, "signature part: ", "name"), _told(part & F.col("marked"), "strict or macro-enabled part: ", "name"),
        _told(part & F.col("name").isNotNull() & F.col("error").isNotNull(), "unsafe part name: ", "name"),
    ]


def _usable() -> Column:
    return (F.col("fact") == "type") & (F.coalesce("name", F.lit("")) != "") & (F.coalesce("content_type", F.lit("")) != "")


def type_rules() -> list[Column]:
    """What a declared type may not be by itself."""
    default, override, kind = _usable() & (F.col("kind") == "Default"), _usable() & (F.col("kind") == "Override"), F.lower("content_type")
    return [
        _told(default & F.regexp_like("name", F.lit(r"[/\\]")), "unsafe content type extension: ", "name"), _told(override & ~F.startswith("name", F.lit("/")), "invalid content type part name: ", "name"),
        _told(_usable() & F.contains(kind, F.lit("macroenabled")), "macro-enabled content type: ", "name"), _told(_usable() & F.contains(kind, F.lit("digital-signature")), "signature content type: ", "name"),
    ]


def relationship_rules() -> list[Column]:
    """What a relationship may not be by itself."""
    rel = F.col("fact") == "relationship"
    lacking = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("rel_type", F.lit("")) == "") | F.col("target").isNull()
    return [
        _told(rel & lacking, "malformed relationship of: ", "source_part"), _told(rel & (F.lower("target_mode") != "external"), "invalid relationship target mode: ", "name"),
        _told(rel & F.contains(F.lower("rel_type"), F.lit("/digital-signature/")), "signature relationship: ", "name"),
    ]


def _placed(rows: DataFrame) -> DataFrame:
    """Facts with what they say by themselves and with their keys in the package.

    part_key: the part that is meant; extension: whose default type counts; again: what may be there once only.
    """
    fact, kind = F.col("fact"), F.col("kind")
    inside = (fact == "relationship") & ~packages.is_external(F.col("target_mode")) & F.col("target").isNotNull()
    rows = rows.withColumn("inside", inside).withColumn("reached", F.when(inside, packages.resolved_target(F.col("source_part"), F.col("target"))))
    office = F.col("inside") & (F.col("source_part") == "") & F.col("rel_type").eqNullSafe(packages.OFFICE_DOCUMENT)
    part_key = F.when(fact == "part", F.col("name")).when(kind == "Override", F.regexp_replace("name", "^/", "")).otherwise(F.col("reached"))
    extension = F.when(fact == "part", packages.extension(F.col("name"))).when(kind == "Default", F.lower("name")).when(office, packages.extension(F.col("reached")))
    once = F.struct(F.coalesce("kind", "fact").alias("kind"), F.coalesce("source_part", F.lit("")).alias("within"), F.when(kind == "Default", F.lower("name")).otherwise(F.col("name")).alias("key"))
    again = F.when((_usable() & kind.isin("Default", "Override")) | ((fact == "relationship") & (F.col("name") != "")), once)
    own = F.array_compact(F.array(*part_rules(), *type_rules(), *relationship_rules()))
    return rows.select(
        "doc_path", "fact", "ordinal", "name", "kind", "content_type", "inside", office.alias("office"), part_key.alias("part_key"), extension.alias("extension"), again.alias("again"), "error", own.alias("own"),
    )


def _met(rows: DataFrame) -> DataFrame:
    """Facts of whole packages, each with whether its part is there, with that part's type, and with its place among those that should be one."""
    fact, per = F.col("fact"), lambda key: Window.partitionBy("doc_path", key)
    declared = lambda kind: F.min(F.when((fact == "type") & (F.col("kind") == kind) & F.col("name").isNotNull() & F.col("content_type").isNotNull(), F.struct("ordinal", "content_type")))
    # Dealt by package, the facts need no further exchange for windows by package and key.
    rows = rows.repartition("doc_path")
    rows = rows.withColumn("there", F.count_if((fact == "part") & F.col("part_key").isNotNull()).over(per("part_key")) > 0).withColumn("override", declared("Override").over(per("part_key")))
    rows = rows.withColumn("default", declared("Default").over(per("extension"))).withColumn("nth", F.row_number().over(per("again").orderBy("ordinal")))
    return rows.withColumn("type", F.coalesce("override", "default")["content_type"])


def findings(part_rows: DataFrame) -> DataFrame:
    """All rules over the parts of all packages. part_rows as ``packages.parts`` gives them."""
    rows = _met(_placed(packages.facts(part_rows, strict_marker(F.col("part_name"), F.col("data")))))
    part = F.col("fact") == "part"
    named = part & F.col("name").isNotNull() & (F.col("name") != TYPES_PART) & ~F.endswith("name", F.lit("/"))
    twice = lambda kind: (F.col("nth") == 2) & (F.col("again.kind") == kind)
    among = F.array_compact(F.array(
        _told(twice("Default"), "duplicate default content type: ", "again.key"), _told(twice("Override"), "duplicate content type override: ", "again.key"), _told(twice("relationship"), "duplicate relationship id: ", "again.key"),
        _told(named & F.col("type").isNull(), "part without content type: ", "name"), _told(F.col("inside") & ~F.col("there"), "relationship to a missing part: ", "name"),
    ))
    wrong = ~F.contains(F.lower(F.coalesce("type", F.lit(""))), F.lit(MAIN_TYPE_MARK))
    main = F.coalesce(F.when(~F.col("there"), "main document part is missing"), _told(wrong, "unsupported main document type: ", "type"))
    said = F.concat("own", among)
    per = rows.groupBy("doc_path").agg(
        F.count(F.when(part, F.col("name"))).alias("parts"), F.count_if(part & (F.col("name") == TYPES_PART)).alias("types"), F.count_if(part & (F.col("name") == ROOT_RELATIONSHIPS)).alias("roots"), F.max("error").alias("error"),
        F.count_if("office").alias("offices"), F.max(F.when(F.col("office"), main)).alias("main"), F.collect_list(F.when(F.size(said) > 0, said)).alias("said"),
    )
    opened = F.col("parts") > 0
    whole = F.array_compact(F.array(
        _told(~opened, "package can't be opened: ", "error"), _told(opened & (F.col("types") == 0), "no content types part"), _told(opened & (F.col("roots") == 0), "no root relationships part"),
        _told(opened & (F.col("offices") != 1), "not exactly one office document relationship"), F.when(F.col("offices") == 1, F.col("main")),
    ))
    return finding(per.select("doc_path", F.explode(F.concat(F.flatten("said"), whole)).alias("message")), "package", "error", F.col("message"))
