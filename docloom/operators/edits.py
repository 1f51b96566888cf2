"""Edits of paragraph text, single and in ordered batches, and the free ids they need.

A batch is applied in order to the text as it then is; the first error stops it, and the text stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import locate


def replace_nth(text: Column, needle: Column, replacement: Column, n: Column) -> Column:
    """The text with the n-th occurrence replaced; null if there is no such occurrence."""
    put = lambda at: F.concat(F.substring(text, F.lit(1), at), replacement, F.substring(text, at + F.length(needle) + 1, F.length(text)))
    return locate.bound(locate.nth_occurrence(text, needle, n), put)


def delete_nth(text: Column, needle: Column, n: Column) -> Column:
    return replace_nth(text, needle, F.lit(""), n)


def insertion_point(position: Column, start: Column, end: Column, size: Column) -> Column:
    """Offset for start, end, before or after; before and after need a located span, else null."""
    return F.when(position == "start", F.lit(0)).when(position == "end", size).when(position == "before", start).when(position == "after", end)


def insert_at(text: Column, at: Column, added: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at), added, F.substring(text, at + 1, F.length(text)))


def insert_paragraphs(paragraphs: DataFrame, added: DataFrame) -> DataFrame:
    """added (doc_id, idx, position before or after, text) become paragraphs; all of the document are numbered anew."""
    own = paragraphs.select("doc_id", (F.col("idx") * 3 + 1).alias("order"), "text", F.lit(False).alias("added"))
    new = added.select("doc_id", (F.col("idx") * 3 + F.when(F.col("position") == "before", 0).otherwise(2)).alias("order"), "text", F.lit(True).alias("added"))
    order = Window.partitionBy("doc_id").orderBy("order")
    return own.unionByName(new).select("doc_id", (F.row_number().over(order) - 1).alias("idx"), "text", "added")


#: type, needle, added, position, occurrence; as in the edit requests.
OPERATION = "struct<op_index:int,type:string,text:string,replacement:string,position:string,occurrence:int>"


def apply_batch(targets: DataFrame, operations: DataFrame, keys: list[str], most: int = 250) -> DataFrame:
    """targets (keys, text) and operations (keys, op_index, type, text, replacement, position, occurrence) -> text, error, applied.

    The operations of a target are one array of at most ``most``, folded with an expression; longer batches fail whole.
    """
    parts = ["op_index", "type", F.col("text").alias("text"), "replacement", "position", "occurrence"]
    batches = operations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("operations"))
    met = targets.join(batches, keys, "left")

    def changed(text: Column, op: Column, at: Column) -> Column:
        located = F.concat(F.substring(text, F.lit(1), at), op["replacement"], F.substring(text, at + F.length(op["text"]) + 1, F.length(text)))
        point = insertion_point(op["position"], at, at + F.length(op["text"]), F.length(text))
        return F.when(op["type"] == "insert_text", insert_at(text, point, op["replacement"])).when(op["type"].isin("replace_text", "delete_text"), located)

    def outcome(acc: Column, op: Column, new: Column) -> Column:
        error = F.when(new.isNull(), F.when(op["type"] == "insert_text", "INVALID_REQUEST").otherwise("ANCHOR_NOT_FOUND"))
        return F.struct(F.coalesce(new, acc["text"]).alias("text"), error.alias("error"), (acc["applied"] + new.isNotNull().cast("int")).alias("applied"))

    def step(acc: Column, op: Column) -> Column:
        """What is located, and what becomes of it, is computed once and only while there is no error."""
        at = locate.nth_occurrence(acc["text"], op["text"], op["occurrence"])
        done = locate.bound(locate.bound(at, lambda a: changed(acc["text"], op, a)), lambda new: outcome(acc, op, new))
        return F.when(acc["error"].isNotNull(), acc).otherwise(done)

    first = F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("applied"))
    folded = met.withColumn("size", F.coalesce(F.size("operations"), F.lit(0))).withColumn(
        "done", F.when(F.col("size") > most, F.struct(F.col("text").alias("text"), F.lit("RESOURCE_LIMIT").alias("error"), F.lit(0).alias("applied"))).otherwise(
            F.aggregate(F.coalesce("operations", F.array().cast(f"array<{OPERATION}>")), first, step))
    )
    return folded.select(*keys, F.when(F.col("done.error").isNull(), F.col("done.text")).otherwise(F.col("text")).alias("text"), "done.error", "done.applied")


def revisions(edits: DataFrame, used: DataFrame, group: list[str]) -> DataFrame:
    """edits (group, place, deleted, inserted, author) as tracked rows: group, place, kind del or ins, text, author, revision_id.

    What is empty makes no row. Ids go on after the largest in use (used: group, revision_id), in the order of places,
    a deletion before the insertion at its place.
    """
    both = F.array(F.struct(F.lit("del").alias("kind"), F.col("deleted").alias("text")), F.struct(F.lit("ins").alias("kind"), F.col("inserted").alias("text")))
    rows = edits.select(*group, "place", "author", F.posexplode(F.filter(both, lambda r: F.coalesce(r["text"], F.lit("")) != "")).alias("k", "r"))
    last = next_id(used, group, "revision_id")
    order = Window.partitionBy(*group).orderBy("place", "k")
    numbered = rows.withColumn("n", F.row_number().over(order) - 1).join(last, group, "left")
    return numbered.select(*group, "place", F.col("r.kind").alias("kind"), F.col("r.text").alias("text"), "author", (F.coalesce("next_id", F.lit(0).cast("long")) + F.col("n")).alias("revision_id"))


def lowest_free(ids: DataFrame, group: list[str], id_col: str, least: int = 1) -> DataFrame:
    """The lowest id from ``least`` on that a group doesn't use: where a sorted, distinct id first runs ahead of its place."""
    own = ids.filter(F.col(id_col) >= least).select(*group, F.col(id_col).alias("id")).distinct()
    place = F.row_number().over(Window.partitionBy(*group).orderBy("id")) + (least - 1)
    ahead = own.withColumn("place", place).filter(F.col("id") == F.col("place")).groupBy(*group).agg(F.max("id").alias("last"))
    return ids.select(*group).distinct().join(ahead, group, "left").select(*group, F.coalesce(F.col("last") + 1, F.lit(least)).alias("free_id"))


def next_id(ids: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """One more than the largest numeric id, 0 where there is none."""
    return ids.groupBy(*group).agg((F.coalesce(F.max(F.expr(f"try_cast({id_col} AS BIGINT)")), F.lit(-1)) + 1).alias("next_id"))


def instruction_chunks(text: Column, size: int = 240) -> Column:
    """Pieces of at most ``size`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
