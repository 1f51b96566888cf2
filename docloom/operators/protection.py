"""Protected ranges from a document's token stream, guards for fields, and edits of whole fields and drawings.

Tokens (doc_id, paragraph, seq, kind, value, mark_id): text that is seen, and markers of no width. Spans between a marker
and its partner become one range per paragraph; a marker without a partner protects to the end of the story.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import edits, fields, locate


#: What has a start and an end with one id.
PAIRED = ("bookmark", "content-control", "revision")


def placed(tokens: DataFrame) -> DataFrame:
    """Tokens with the offset in their paragraph at which they stand: a running sum of what is seen before."""
    seen = F.when(F.col("kind") == "text", F.length("value")).otherwise(0)
    before = Window.partitionBy("doc_id", "paragraph").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("at", F.coalesce(F.sum(seen).over(before), F.lit(0)).cast("int"))


def paragraph_sizes(tokens: DataFrame) -> DataFrame:
    """doc_id, idx, text: the paragraphs the tokens make."""
    seen = F.when(F.col("kind") == "text", F.col("value")).otherwise("")
    return tokens.groupBy("doc_id", F.col("paragraph").alias("idx")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", seen.alias("value")))), lambda x: x["value"]), "").alias("text")
    )


def _spans(pairs: DataFrame, last: DataFrame, kind: str) -> DataFrame:
    """pairs (doc_id, first, first_at, last, last_at; last null if never closed) -> spans with their kind."""
    met = pairs.join(last, "doc_id")
    open_end = F.col("last").isNull()
    return met.select(
        "doc_id", "first", "first_at", F.coalesce("last", "end_idx").alias("last"), F.coalesce("last_at", "end_size").alias("last_at"),
        F.when(open_end, f"unbalanced-{kind}").otherwise(kind).alias("kind"),
    )


def protected_ranges(tokens: DataFrame) -> DataFrame:
    """doc_id, idx, start, end, kind: bookmarks, content controls and revisions by id, fields by nesting, and the boundaries of bookmarks and fields, distinct."""
    rows = placed(tokens)
    texts = paragraph_sizes(tokens)
    last = texts.groupBy("doc_id").agg(F.max_by(F.length("text"), "idx").alias("end_size"), F.max("idx").alias("end_idx"))
    side = lambda kind, name: rows.filter(F.col("kind") == kind).groupBy("doc_id", "mark_id").agg(
        F.min(F.struct(F.col("paragraph").alias("idx"), "at")).alias(name))

    def paired(kind: str) -> DataFrame:
        marks = side(f"{kind} start", "s").join(side(f"{kind} end", "e"), ["doc_id", "mark_id"], "left")
        pairs = marks.select("doc_id", F.col("s.idx").alias("first"), F.col("s.at").alias("first_at"), F.col("e.idx").alias("last"), F.col("e.at").alias("last_at"))
        return _spans(pairs, last, kind)

    numbered = rows.filter(F.col("kind").isin("field begin", "field end")).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph", "seq")) - 1)
    stream = numbered.select(F.col("doc_id").alias("stream"), F.col("place").alias("seq"), F.when(F.col("kind") == "field begin", 1).otherwise(-1).alias("step"))
    at = numbered.select(F.col("doc_id").alias("stream"), F.col("place").alias("begin_seq"), F.col("paragraph").alias("first"), F.col("at").alias("first_at"))
    end = at.toDF("stream", "end_seq", "last", "last_at")
    nested = fields.nested(stream).join(at, ["stream", "begin_seq"]).join(end, ["stream", "end_seq"], "left")
    fields_of = nested.select(F.col("stream").alias("doc_id"), "first", "first_at", "last", "last_at")

    spans = _spans(fields_of, last, "field")
    for kind in PAIRED:
        spans = spans.unionByName(paired(kind))
    wide = locate.split_spans(spans, texts)
    edge = F.when(F.startswith("kind", F.lit("bookmark")), "bookmark-boundary").otherwise("field-boundary")
    thin = rows.filter(F.col("kind").isin("bookmark start", "bookmark end", "field begin", "field separate", "field end")).select("doc_id", F.col("paragraph").alias("idx"), F.col("at").alias("start"), F.col("at").alias("end"), edge.alias("kind"))
    return wide.unionByName(thin).distinct()


def insertion_error(at: Column, start: Column, end: Column) -> Column:
    """Inside a field nothing may be inserted; at its edges it may."""
    return F.when((start < at) & (at < end), "PROTECTED_BOUNDARY")


def field_error(separated: Column, depth: Column, paragraphs: Column, boundary_clean: Column) -> Column:
    """Why a field can't be rewritten: no separator, nested, over several paragraphs, or a boundary shared with text."""
    bad = ~separated | (depth > 0) | (paragraphs > 1) | ~boundary_clean
    return F.when(bad, "PROTECTED_BOUNDARY")


def append_fields(paragraphs: DataFrame, added: DataFrame) -> DataFrame:
    """added (doc_id, idx, heading, text): after that paragraph an optional heading, then the field's own paragraph."""
    both = F.filter(F.array(F.col("heading"), F.col("text")), lambda x: x.isNotNull())
    rows = added.select("doc_id", "idx", F.posexplode(both).alias("k", "text"))
    own = paragraphs.select("doc_id", (F.col("idx") * 3).alias("place"), "text")
    new = rows.select("doc_id", (F.col("idx") * 3 + 1 + F.col("k")).alias("place"), "text")
    order = Window.partitionBy("doc_id").orderBy("place")
    return own.unionByName(new).select("doc_id", (F.row_number().over(order) - 1).alias("idx"), "text")


def set_alt_text(drawings: DataFrame, changes: DataFrame) -> DataFrame:
    """drawings (doc_id, ordinal, description, title), changes (doc_id, description, title): a document's first drawing changes; no title clears an old one."""
    first = drawings.groupBy("doc_id").agg(F.min("ordinal").alias("ordinal"))
    new = changes.select("doc_id", F.col("description").alias("__description"), F.col("title").alias("__title"), F.lit(True).alias("__changed")).join(first, "doc_id")
    met = drawings.join(new, ["doc_id", "ordinal"], "left")
    changed = F.coalesce("__changed", F.lit(False))
    return met.select("doc_id", "ordinal", *[F.when(changed, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("description", "title")])


def add_comments(comments: DataFrame, added: DataFrame) -> DataFrame:
    """comments (doc_id, comment_id, text) and new ones (doc_id, place, text): ids go on after the largest, in order of place."""
    last = edits.next_id(comments, ["doc_id"], "comment_id")
    met = added.join(last, "doc_id", "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    new = met.select("doc_id", (F.coalesce("next_id", F.lit(0).cast("long")) + place).cast("string").alias("comment_id"), "text")
    return comments.select("doc_id", "comment_id", "text").unionByName(new)
