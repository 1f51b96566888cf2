"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each text is cut, byte by byte, at content-defined places, once a chunk has a minimum length, and at a maximum length at
the latest. Such a place is a line's or sentence's end, or any where each of the ``WINDOW`` bytes before it lies in a
class of its own: a window's hash in the form of a pattern, so text of any script, with or without punctuation, is cut at
the same places wherever it stands. A chunk's identifier is its 64-bit hash, verified against the chunk's SHA-256: an
identifier that stands for two different digests is replaced by the digests in every text that holds it. Two texts are
equal when their ordered lists of verified identifiers are equal. Texts are read once, where they lie; after that only
identifiers move.

Defined results: null text counts as empty; all empty texts form one group. A null doc_id loses against any other; a
group of null doc_ids only keeps one row, and its keep_id is null. Of rows that repeat both doc_id and text, one stays.
An empty table gives an empty result. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: Each byte is in a window place's class with a probability of one in four, so a window is a boundary once in about 4 ** 5.
WINDOW, SHARE = 5, 64
REPEAT = 4096


def _byte_class(place: int) -> str:
    """The bytes whose digest with the place is low, as a pattern's character class."""
    inside = [b for b in range(256) if hashlib.sha256(bytes([place, b])).digest()[0] < SHARE]
    return "[" + "".join(f"\\x{b:02x}" for b in inside) + "]"


def as_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes, one character for each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text's chunks in order, as strings of bytes; joined, they are the text."""
    window = "".join(map(_byte_class, range(WINDOW)))
    cut_after = rf"(?:(?<=[.!?]\s|\n|{window})|\z)"
    pattern = rf"(?s).{{{least},{most}}}?{cut_after}|.{{{most}}}|.{{1,{least}}}"
    return F.regexp_extract_all(as_bytes(text), F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_sha256 and the recipe, an ordered list of (identifier, digest where the identifier is shared)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = cut(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("parts"))
        .select(
            "doc_id",
            "text_sha256",
            F.transform("parts", lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("parts"),
        )
    )
    pairs = read.select("text_sha256", F.explode("parts").alias("part")).select("text_sha256", "part.id", "part.digest")
    shared = pairs.select("id", "digest").distinct().groupBy("id").count().filter("count > 1").select("id")
    # Two keys: the counts lie by identifier, so both sides are exchanged and a frequent chunk's rows can be split.
    spread = F.hash("id").alias("spread")
    unsure = pairs.select("*", spread).join(shared.select("id", spread), ["id", "spread"], "left_semi")
    own = F.hash("text_sha256").alias("own")
    unsure = unsure.select("text_sha256").distinct().select("text_sha256", own, F.lit(True).alias("unsure"))
    none = F.lit(None).cast("binary")
    return read.select("*", own).join(unsure, ["text_sha256", "own"], "left").select(
        "doc_id",
        "text_sha256",
        F.transform("parts", lambda p: F.struct(p["id"].alias("id"), F.when(F.col("unsure"), p["digest"]).otherwise(none).alias("digest"))).alias("recipe"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The recipe's own hash only spreads groups over partitions; the lists themselves are compared. Grouping is
    pre-aggregated and the join back has an exchange on both sides, so a group with a third of all rows can be split.
    """
    rows = recipes(docs, id_col, text_col).groupBy("doc_id", "text_sha256", "recipe").agg(F.count(F.lit(1)).alias("times"))
    rows = cut(rows)
    spread = F.xxhash64("recipe").alias("spread")
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size"))
    found = rows.select("*", spread).join(groups.select("*", spread), ["spread", "recipe"])
    return repeated(found, "times", "copy").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id"), "text_sha256")
    return only(docs, kept, id_col, text_col)


def repeated(rows: DataFrame, times: str, place: str) -> DataFrame:
    """Each row as often as it says, numbered from 1 on; no array holds more than ``REPEAT`` numbers or the blocks of them."""
    blocks = rows.withColumn(place, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / REPEAT))))
    begin = F.col(place) * REPEAT
    return blocks.withColumn(place, F.explode(F.sequence(begin + 1, F.least(begin + REPEAT, F.col(times).cast("long")))))


def nested(docs: DataFrame) -> Column:
    """A whole row as one value, so that helper columns meet none of its names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def only(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose doc_id and text_sha256 are among the kept ones, one for each.

    Rows that repeat both are merged before they move; a text moves once, to meet the decision about it.
    """
    kept = kept.select(named(F.col("doc_id")).alias("id"), F.col("text_sha256").alias("sha"))
    own = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    rows = docs.select(named(F.col(id_col)).alias("id"), own.alias("sha"), nested(docs)).dropDuplicates(["id", "sha"])
    return rows.join(kept, ["id", "sha"], "left_semi").select("row.*")


def named(value: Column) -> Column:
    """A text for every value, null included, that no other value has."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.lit("+"), value.cast("string")))
