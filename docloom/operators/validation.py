"""Validation rules as DataFrames of findings (doc_path, layer, severity, message), united and summed up per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding(rows: DataFrame, layer: str, severity: str | Column, message: Column) -> DataFrame:
    return rows.select("doc_path", F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), message.alias("message"))


def dangling(relationships: DataFrame, part_names: DataFrame) -> DataFrame:
    """Internal relationships whose resolved target (column part_name) is no part of the package."""
    internal = relationships.filter(F.lower(F.coalesce("target_mode", F.lit(""))) != "external")
    lost = internal.join(part_names.select("doc_path", "part_name"), ["doc_path", "part_name"], "left_anti")
    return finding(lost, "package", "error", F.concat(F.lit("relationship "), "rel_id", F.lit(" targets a missing part: "), F.coalesce("part_name", "target")))


def external(relationships: DataFrame) -> DataFrame:
    rows = relationships.filter(F.lower("target_mode") == "external")
    return finding(rows, "package", "warning", F.concat(F.lit("external relationship not fetched: "), "rel_id"))


def untyped(types: DataFrame) -> DataFrame:
    rows = types.filter("content_type IS NULL")
    return finding(rows, "package", "error", F.concat(F.lit("part without content type: "), "part_name"))


def semantic(marks: DataFrame) -> DataFrame:
    """Comment and bookmark rules over marks (doc_path, mark_id, kind) of the kinds comment, comment start, comment end, comment reference, bookmark start, bookmark end.

    One grouping counts the kinds of every id, one array per id holds what is wrong with it. A comment without an id is an
    error each time; other marks without one say nothing.
    """
    kinds = {"comment": "comments", "comment start": "starts", "comment end": "ends", "comment reference": "references", "bookmark start": "opened", "bookmark end": "closed"}
    counted = marks.groupBy("doc_path", "mark_id").agg(*[F.count_if(F.col("kind") == kind).alias(name) for kind, name in kinds.items()])
    met = {name: F.col(name) > 0 for name in kinds.values()}
    told = lambda holds, severity, text: F.when(F.col("mark_id").isNotNull() & holds, F.struct(F.lit(severity).alias("severity"), F.concat(F.lit(f"{text} "), "mark_id").alias("message")))
    unnamed = F.struct(F.lit("error").alias("severity"), F.lit("comment without an id").alias("message"))
    wrong = F.array_compact(F.array(
        told(F.col("comments") > 1, "error", "duplicate comment id"),
        told((met["starts"] | met["ends"] | met["references"]) & ~met["comments"], "error", "comment marker without a comment"),
        told(met["comments"] & ~met["references"], "warning", "comment without a reference"),
        told(met["starts"] != met["ends"], "error", "comment range with one end"),
        told(met["opened"] != met["closed"], "error", "bookmark with one end"),
    ))
    times = F.when(F.col("mark_id").isNull(), F.col("comments")).otherwise(0).cast("int")
    each = counted.select("doc_path", F.explode(F.concat(wrong, F.array_repeat(unnamed, times))).alias("e"))
    return finding(each.select("doc_path", "e.*"), "semantic", F.col("severity"), F.col("message"))


def revision_findings(marks: DataFrame) -> DataFrame:
    """marks (doc_path, story, kind, mark_id, author): revisions need an id, and should have an author."""
    rows = marks.filter(F.col("kind").isin("ins", "del", "moveFrom", "moveTo"))
    return united([
        finding(rows.filter("mark_id IS NULL"), "semantic", "error", F.concat("story", F.lit(": revision without an id"))),
        finding(rows.filter("author IS NULL"), "semantic", "warning", F.concat("story", F.lit(": revision without an author: "), F.coalesce("mark_id", F.lit("?")))),
    ])


def field_findings(balances: DataFrame) -> DataFrame:
    """balances (doc_path, story, unmatched_ends, unclosed), as ``fields.balance`` counts them."""
    return united([
        finding(balances.filter("unmatched_ends > 0"), "semantic", "error", F.concat("story", F.lit(": field ends without a begin: "), F.col("unmatched_ends").cast("string"))),
        finding(balances.filter("unclosed > 0"), "semantic", "error", F.concat("story", F.lit(": fields not closed: "), F.col("unclosed").cast("string"))),
    ])


def united(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def report(findings: DataFrame, documents: DataFrame, shown: int = 5) -> DataFrame:
    """documents (doc_path) with valid, number of errors and warnings, and the first errors with their layer, in order."""
    error = F.col("severity") == "error"
    text = F.when(error, F.concat("layer", F.lit(": "), "message"))
    told = findings.select("doc_path", error.alias("is_error"), text.alias("text")).groupBy("doc_path", "text").agg(F.count_if("is_error").alias("errors"), F.count_if(~F.col("is_error")).alias("warnings"))
    place = F.row_number().over(Window.partitionBy("doc_path").orderBy(F.asc_nulls_last("text")))
    first = F.when((F.col("place") <= shown) & F.col("text").isNotNull(), F.struct("place", "text"))
    rows = told.withColumn("place", place).groupBy("doc_path").agg(
        F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda e: e["text"]), "; ").alias("summary")
    )
    met = documents.select("doc_path").join(rows, "doc_path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return met.select("doc_path", (zero("errors") == 0).alias("valid"), zero("errors").alias("errors"), zero("warnings").alias("warnings"), F.coalesce("summary", F.lit("")).alias("summary"))
