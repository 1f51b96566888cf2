"""Locating text: literal occurrences, locators with their error ladder, interval overlap, spans over paragraphs.

Offsets count code points from 0; intervals are half-open. Occurrences don't overlap and are found from left to right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(text: Column, needle: Column) -> Column:
    """The text between the occurrences of a literal; one piece if there is none or the literal is empty."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(F.length(needle) > 0, F.split(text, quoted, -1)).otherwise(F.array(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def occurrences(text: Column, needle: Column) -> Column:
    """Start offsets of a literal, from the lengths of the pieces around it.

    Offsets are running sums. They are made in blocks of about the square root of their number, first over the blocks and
    then inside each, so that no long array is copied for every hit.
    """
    size = F.length(needle)

    def sums(gaps: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(gaps))).cast("int"), F.lit(1))
        count = F.ceil(F.size(gaps) / width).cast("int")
        blocks = F.when(F.size(gaps) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(gaps, k * width + 1, width)))
        none = F.array().cast("array<int>")

        def ahead(acc: Column, gap: Column) -> Column:
            return F.struct((acc["at"] + gap + size).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + gap)).alias("starts"))

        def next_block(acc: Column, block: Column) -> Column:
            whole = F.aggregate(block, F.lit(0), lambda n, gap: n + gap + size)
            return F.struct((acc["at"] + whole).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

        start = lambda at: F.struct(at.alias("at"), none.alias("starts"))
        begins = F.aggregate(blocks, start(F.lit(0)), next_block, lambda acc: acc["starts"])
        each = F.zip_with(blocks, begins, lambda block, at: F.aggregate(block, start(at), ahead, lambda acc: acc["starts"]))
        return F.coalesce(F.flatten(each), none)

    return F.when(text.isNotNull() & needle.isNotNull(), bound(F.transform(pieces(text, needle), F.length), lambda n: sums(F.slice(n, 1, F.size(n) - 1))))


def nth_occurrence(text: Column, needle: Column, n: Column) -> Column:
    """Start of the n-th occurrence (from 1), else null: the lengths of the first n pieces and of the literals between them."""

    def start(parts: Column) -> Column:
        sizes = F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda at, piece: at + F.length(piece))
        return F.when((n > 0) & (F.size(parts) > n), sizes + (n - 1) * F.length(needle))

    return bound(pieces(text, needle), start)


def in_context(text: Column, start: Column, end: Column, prefix: Column, suffix: Column) -> Column:
    """Whether the text before ``start`` ends in the prefix and the text from ``end`` on begins with the suffix; null asks nothing."""
    before = F.substring(text, F.greatest(start - F.length(prefix), F.lit(0)) + 1, F.least(F.length(prefix), start))
    after = F.substring(text, end + 1, F.length(suffix))
    return (prefix.isNull() | (before == prefix)) & (suffix.isNull() | (after == suffix))


def anchor(text: Column, needle: Column, n: Column, prefix: Column, suffix: Column) -> Column:
    """(start, end, error): the n-th occurrence first, its context then; ``resolve`` filters by context before it counts."""

    def told(at: Column) -> Column:
        end = at + F.length(needle)
        error = F.when(at.isNull() | ~in_context(text, at, end, prefix, suffix), "ANCHOR_NOT_FOUND")
        return F.struct(F.when(error.isNull(), at).alias("start"), F.when(error.isNull(), end).alias("end"), error.alias("error"))

    return bound(nth_occurrence(text, needle, n), told)


def same_hash(told: Column, own: Column) -> Column:
    """A locator's hash in any case, whole or its first 16 digits."""
    return F.lower(told).isin(own, F.substring(own, 1, 16))


#: The stories citations are supported in, with the part of each.
STORY_PARTS = {"body": "word/document.xml", "footnote": "word/footnotes.xml", "endnote": "word/endnotes.xml"}


def story_part(story: Column, told: Column) -> Column:
    """(part_name, error) of a locator: the story's own part, which a told part (a leading slash and ``word/`` may lack) must be."""
    own = F.coalesce(*[F.when(story == name, part) for name, part in STORY_PARTS.items()])
    bare = F.regexp_replace(told, "^/+", "")
    named = F.when(F.contains(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("word/"), bare))
    wrong = own.isNull() | (F.coalesce(told, F.lit("")) != "") & (named != own)
    return F.struct(F.when(~wrong, own).alias("part_name"), F.when(wrong, "INVALID_REQUEST").alias("error"))


def locator_mapping(json_text: Column) -> Column:
    """A locator from a JSON mapping, with the error of one that lacks an index or has a bad index, hash or occurrence."""
    schema = "story STRING, story_part STRING, paragraph_index STRING, paragraph_hash STRING, exact_text STRING, prefix STRING, suffix STRING, occurrence STRING"
    read = F.from_json(json_text, schema)
    index, n = read["paragraph_index"].try_cast("int"), F.coalesce(read["occurrence"], F.lit("1")).try_cast("int")
    hashed = read["paragraph_hash"].isNull() | F.regexp_like(read["paragraph_hash"], F.lit("^([0-9a-fA-F]{16}|[0-9a-fA-F]{64})$"))
    bad = read.isNull() | index.isNull() | (index < 0) | n.isNull() | (n < 1) | ~hashed
    return F.struct(
        F.coalesce(read["story"], F.lit("body")).alias("story"), read["story_part"].alias("story_part"), index.alias("paragraph_index"), F.lower(read["paragraph_hash"]).alias("paragraph_hash"),
        read["exact_text"].alias("exact_text"), read["prefix"].alias("prefix"), read["suffix"].alias("suffix"), n.alias("occurrence"), F.when(F.coalesce(bad, F.lit(True)), "INVALID_REQUEST").alias("error"),
    )


def resolve(requests: DataFrame, paragraphs: DataFrame, stories: DataFrame) -> DataFrame:
    """requests (req_id, doc_id, story, paragraph_index, paragraph_hash, exact_text, occurrence, prefix, suffix) -> error, start, end.

    The first step that fails decides: story unknown, story ambiguous, index beyond the end, hash of an older revision,
    occurrence not found. Context filters occurrences before they are counted. Without an exact text the whole paragraph
    is meant. stories (doc_id, story, parts); paragraphs (doc_id, story, idx, text, paragraph_hash).
    """
    said = requests.join(stories, ["doc_id", "story"], "left")
    own = paragraphs.select("doc_id", "story", F.col("idx").alias("paragraph_index"), "text", F.col("paragraph_hash").alias("own_hash"))
    met = said.join(own, ["doc_id", "story", "paragraph_index"], "left")
    text, exact = F.col("text"), F.col("exact_text")
    hits = F.filter(occurrences(text, exact), lambda s: in_context(text, s, s + F.length(exact), F.col("prefix"), F.col("suffix")))
    whole = exact.isNull()
    met = met.withColumn("at", F.when(whole, F.lit(0)).otherwise(F.try_element_at(hits, F.col("occurrence"))))
    error = (
        F.when(F.coalesce("parts", F.lit(0)) == 0, "ANCHOR_NOT_FOUND")
        .when(F.col("parts") > 1, "ANCHOR_AMBIGUOUS")
        .when(text.isNull(), "ANCHOR_NOT_FOUND")
        .when(F.col("paragraph_hash").isNotNull() & ~same_hash(F.col("paragraph_hash"), F.col("own_hash")), "STALE_REVISION")
        .when(F.col("at").isNull(), "ANCHOR_NOT_FOUND")
    )
    end = F.when(whole, F.length(text)).otherwise(F.col("at") + F.length(exact))
    return met.withColumn("error", error).select(
        "req_id", "doc_id", "error", F.when(F.col("error").isNull(), F.col("at")).alias("start"), F.when(F.col("error").isNull(), end).alias("end")
    )


def overlaps(start: Column, end: Column, a: Column, b: Column) -> Column:
    """Whether a protected range meets an edit [a, b): ranges and edits of no width touch at their closed bounds."""
    return (
        F.when(start == end, (a <= start) & (start <= b))
        .when(a == b, (start <= a) & (a <= end))
        .otherwise((a < end) & (b > start))
    )


def overlap_join(edits: DataFrame, ranges: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """edits (keys, a, b) with the ranges (keys, start, end, kind) they meet: an equi-join with an interval condition."""
    own = ranges.select(*[F.col(k).alias(f"__{k}") for k in keys], "start", "end", "kind")
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    met = overlaps(F.col("start"), F.col("end"), F.col("a"), F.col("b"))
    return edits.join(own, [*same, met], how).drop(*[f"__{k}" for k in keys])


def editable(edits: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """edits with the error PROTECTED_BOUNDARY and the kinds, sorted and distinct, of the ranges they meet."""
    met = overlap_join(edits, ranges, keys, "left")
    return met.groupBy(*edits.columns).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).withColumn(
        "error", F.when(F.col("kinds") != "", F.lit("PROTECTED_BOUNDARY"))
    )


def split_spans(spans: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """spans (doc_id, first, first_at, last, last_at, kind) over paragraphs -> one range per paragraph they cover."""
    own = paragraphs.select(F.col("doc_id").alias("__doc"), "idx", F.length("text").alias("size"))
    met = spans.join(own, (F.col("doc_id") == F.col("__doc")) & F.col("idx").between(F.col("first"), F.col("last")))
    return met.select(
        "doc_id", "idx", F.when(F.col("idx") == F.col("first"), F.col("first_at")).otherwise(0).alias("start"),
        F.when(F.col("idx") == F.col("last"), F.col("last_at")).otherwise(F.col("size")).alias("end"), "kind",
    )


def tidy_ranges(ranges: Column) -> Column:
    """Distinct ranges (start, end, kind) in order."""
    return F.array_sort(F.array_distinct(ranges))
