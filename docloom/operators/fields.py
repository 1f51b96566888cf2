"""Nested fields in a stream of begin and end markers, by window functions.

Where a stack machine would push and pop, the depth is a running sum that is reflected at zero: an end without a begin
doesn't count. A begin is closed by the next end at its depth, so matching is one ``lead`` over (stream, depth).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def markers(docs: DataFrame, id_col: str, text: Column, tag: str) -> DataFrame:
    """``<tag ...>`` and ``</tag>`` in order: id, seq (from 0), step (1 or -1)."""
    found = F.regexp_extract_all(text, F.lit(rf"</?{tag}(?:\s[^>]*)?>"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("stream"), F.posexplode(found).alias("seq", "marker"))
    return rows.select("stream", "seq", F.when(F.startswith("marker", F.lit("</")), -1).otherwise(1).alias("step"))


def _depths(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("stream").orderBy("seq")
    summed = rows.withColumn("sum", F.sum("step").over(order))
    low = F.least(F.lit(0), F.min("sum").over(order))
    before = F.least(F.lit(0), F.coalesce(F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return summed.withColumn("low", low).withColumn("stray", (F.col("step") < 0) & (low < before)).withColumn("depth", F.col("sum") - F.col("low"))


def balance(rows: DataFrame) -> DataFrame:
    """Per stream: markers, ends without a begin, begins without an end, greatest depth."""
    return _depths(rows).groupBy("stream").agg(
        F.count(F.lit(1)).alias("markers"), F.count_if("stray").alias("unmatched_ends"),
        F.max_by("depth", "seq").cast("long").alias("unclosed"), F.max("depth").cast("long").alias("max_depth"),
    )


def _paired(rows: DataFrame) -> DataFrame:
    """rows with level, end_seq of begins, and the warning of ends without a begin and begins without an end. All windows share one exchange."""
    level = F.when(~F.col("stray"), F.when(F.col("step") > 0, F.col("depth")).otherwise(F.col("depth") + 1))
    order = Window.partitionBy("stream", "level").orderBy("seq")
    known = _depths(rows).withColumn("level", level).withColumn("end_seq", F.when((F.col("step") > 0) & (F.lead("step").over(order) < 0), F.lead("seq").over(order)))
    return known.withColumn("warning", F.when(F.col("stray"), "end without a begin").when((F.col("step") > 0) & F.col("end_seq").isNull(), "begin without an end"))


def nested(rows: DataFrame) -> DataFrame:
    """One row per begin: stream, begin_seq, end_seq (null if never closed), depth (from 0), ordinal among the begins."""
    ordinal = F.row_number().over(Window.partitionBy("stream").orderBy("seq")) - 1
    return _paired(rows).filter("step > 0").select("stream", F.col("seq").alias("begin_seq"), "end_seq", (F.col("level") - 1).alias("depth"), ordinal.alias("ordinal"))


def warnings(rows: DataFrame) -> DataFrame:
    """stream, seq, warning: every end without a begin and every begin without an end."""
    return _paired(rows).filter("warning IS NOT NULL").select("stream", "seq", "warning")


def strict(rows: DataFrame) -> DataFrame:
    """The fields of ``nested``, where a stream with a warning has the error PROTECTED_BOUNDARY and its first warning instead."""
    first = F.min(F.when(F.col("warning").isNotNull(), F.struct("seq", "warning"))).over(Window.partitionBy("stream"))
    met = _paired(rows).withColumn("first", first).filter("first.seq = seq OR first IS NULL AND step > 0")
    fine = lambda c: F.when(F.col("first").isNull(), c)
    return met.select(
        "stream", fine(F.col("seq")).alias("begin_seq"), fine(F.col("end_seq")).alias("end_seq"), fine(F.col("level") - 1).alias("depth"), F.when(F.col("first").isNotNull(), "PROTECTED_BOUNDARY").alias("error"),
        F.col("first.warning").alias("warning"),
    )


def field_spans(fields: DataFrame, markers: DataFrame) -> DataFrame:
    """fields (stream, begin_seq, end_seq), markers (stream, seq, paragraph, at) -> stream, begin_seq, paragraph, start, end of fields inside one paragraph."""
    side = lambda seq, at: markers.select("stream", F.col("seq").alias(seq), F.col("paragraph").alias(f"{at}_paragraph"), F.col("at").alias(at))
    met = fields.filter("end_seq IS NOT NULL").join(side("begin_seq", "start"), ["stream", "begin_seq"]).join(side("end_seq", "end"), ["stream", "end_seq"])
    return met.filter("start_paragraph = end_paragraph").select("stream", "begin_seq", F.col("start_paragraph").alias("paragraph"), "start", "end")


def covered(rows: DataFrame) -> DataFrame:
    """rows (stream, seq, kind and others) with ``covered``: some field open there hasn't come to its separator yet.

    Kinds that matter are ``field begin``, ``field separate`` and ``field end``. Of one depth, a separator counts if a begin
    comes right before it, and an end closes a field without a result if a begin does; ends and separators outside every
    field count nothing.
    """
    kind = F.col("kind")
    step = F.when(kind == "field begin", 1).when(kind == "field end", -1).otherwise(0)
    known = _depths(rows.withColumn("step", step))
    known = known.withColumn("level", F.when(kind.isin("field begin", "field separate"), F.col("depth")).when((kind == "field end") & ~F.col("stray"), F.col("depth") + 1))
    last = F.lag("kind").over(Window.partitionBy("stream", "level").orderBy("seq"))
    resolved = (F.col("level") > 0) & kind.isin("field separate", "field end") & (last == "field begin")
    change = F.when(kind == "field begin", 1).when(resolved, -1).otherwise(0)
    pending = F.sum("change").over(Window.partitionBy("stream").orderBy("seq"))
    return known.withColumn("change", change).withColumn("covered", pending > 0).select(*rows.columns, "covered")


def unique(fields: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """wanted ids with the number of fields that carry them: none is REFERENCE_UNRESOLVED, several are ANCHOR_AMBIGUOUS."""
    counts = fields.groupBy(id_col).agg(F.count(F.lit(1)).alias("fields"))
    met = wanted.join(counts, id_col, "left").withColumn("fields", F.coalesce("fields", F.lit(0)))
    return met.withColumn("error", F.when(F.col("fields") == 0, "REFERENCE_UNRESOLVED").when(F.col("fields") > 1, "ANCHOR_AMBIGUOUS"))
