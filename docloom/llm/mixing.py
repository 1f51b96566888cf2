"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets an exponential key, -ln(u) / weight: u comes from a hash of its doc_id, the weight from its quality.
A source whose target is e whole epochs and a rest takes every document e times, then documents in the order of their
keys until the rest is met; the document at the edge is taken if that brings the source nearer to its target.

Running totals are never made over all rows of a source. While more than ``SORTED`` rows of a source may hold the edge,
their keys' range is cut into ``RANGES`` and the range with the edge goes on alone, whatever the keys' distribution.
Rows that repeat doc_id, source and text have one key; they are counted first and stay one row until the end.

Defined results: null text has size 0 and is taken with 0 words; null source is a source of its own, in the last place;
a document without a usable weight counts with ``DEFAULT_WEIGHT``; a null doc_id is stood for by its text's digest. Equal
keys go by doc_id, then the text's digest. Of rows that repeat doc_id, source and text as many are taken as the mix takes
words of them; ``mixed_documents`` gives one of them as often as all are taken. A document without words comes at most
``MOST_EPOCHS`` times, like any other. An empty table gives an empty result. Other columns are kept as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.exact_dedup import named, nested, repeated
from docloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
DEFAULT_WEIGHT = 0.75
MOST_EPOCHS = 3
RANGES, SORTED = 256, 1_000
#: 52 bits of a digest make the uniform number.
SEED = "mix-1"


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the md5 digest of the key's text."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight from labels (doc_id, quality 0 or 1); of several labels the best counts."""
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", F.when(F.col("quality") >= 1, 1.0).otherwise(0.5).alias("weight")
    )


def source_targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size, n) -> with weight and target. One row per source comes in, and only those are sorted.

    Water-filling: sources whose cap lies under their share are filled first, in the order of cap by weight.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    all_of = Window.orderBy("ratio", "place")
    before = all_of.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = sizes.withColumn("place", F.row_number().over(named)).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = (
        rows.withColumn("words", F.sum("source_size").over(every) - zero(F.sum("cap").over(before)))
        .withColumn("weights", F.sum("weight").over(every) - zero(F.sum("weight").over(before)))
        .withColumn("full", F.col("cap").cast("double") * F.col("weights") <= F.col("weight") * F.col("words").cast("double"))
    )
    rows = rows.withColumn("left_words", F.sum("source_size").over(every) - zero(F.sum(F.when(F.col("full"), F.col("cap"))).over(every)))
    rows = rows.withColumn("left_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
    share = (F.col("left_words") * F.col("weight")).cast("double") / F.col("left_weight")
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _narrowed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (source, ..., lo, hi, base, n) -> with the range of keys that holds the edge, the words under it and its rows.

    Where all that is open fits into the rest, the range is empty and lies above every key.
    """
    share = (F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    bins = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).otherwise(0).cast("int")
    inside = _with_plan(rows, plan).filter(F.col("at").between(F.col("lo"), F.col("hi"))).withColumn("bin", bins)
    binned = inside.groupBy("source", "bin").agg(
        F.sum(F.col("size") * F.col("times")).alias("words"), F.min("at").alias("least"), F.max("at").alias("most"), F.count(F.lit(1)).alias("own"),
        F.first("base").alias("base"), F.first("rest").alias("rest"),
    )
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    passed = binned.withColumn("upto", upto).filter("upto > rest")
    edge = F.min(F.struct("bin", "least", "most", (F.col("upto") - F.col("words")).alias("base"), "own")).alias("edge")
    edges = passed.groupBy(F.col("source").alias("edge_source")).agg(edge)
    above = F.lit(float("inf"))
    met = plan.join(edges, F.col("source").eqNullSafe(F.col("edge_source")), "left")
    return met.select(
        "source", "source_size", "target", "epochs", "rest", F.coalesce("edge.least", above).alias("lo"), F.coalesce("edge.most", above).alias("hi"),
        F.coalesce("edge.base", "base").alias("base"), F.coalesce("edge.own", F.lit(0).cast("long")).alias("n"),
    )


def _classes(docs: DataFrame, weights: DataFrame | None, id_col: str, text_col: str, source_col: str, most_rows: int) -> DataFrame:
    """One row per doc_id, source and text: times, size, source_size, target, epochs and how many of the times are picked beyond them."""
    text = F.col(text_col).cast("string")
    read = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha"),
    )
    read = read.groupBy("doc_id", "source", "size", "sha").agg(F.count(F.lit(1)).alias("times"))
    if weights is not None:
        read = read.join(weights.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
    else:
        read = read.withColumn("weight", F.lit(None).cast("double"))
    usable = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(DEFAULT_WEIGHT)
    key = -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), "sha")))) / usable
    rows = cut(read.select("doc_id", "source", "size", "sha", "times", key.alias("key"), F.log(key).alias("at")))

    words = F.sum(F.col("size") * F.col("times")).alias("source_size")
    ranges = rows.groupBy("source").agg(words, F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))
    plan = source_targets(ranges.select("source", "source_size")).withColumnRenamed("source", "name")
    plan = ranges.drop("source_size").join(plan, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("base", F.lit(0).cast("long"))
    plan = cut(plan.select("source", "source_size", "target", "epochs", "rest", "lo", "hi", "base", "n"))
    while not plan.filter((F.col("n") > most_rows) & (F.col("lo") < F.col("hi"))).isEmpty():
        plan = cut(_narrowed(rows, plan))

    known = _with_plan(rows, plan)
    order = Window.partitionBy("source").orderBy("key", "doc_id", "sha").rowsBetween(Window.unboundedPreceding, 0)
    open_ = known.filter((F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi")))
    room = F.col("rest") - F.col("base") - F.sum(F.col("size") * F.col("times")).over(order) + F.col("size") * F.col("times")
    fits = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("times")).otherwise(0))
    last = open_.withColumn("picked", F.greatest(F.least(fits, F.col("times")), F.lit(0)).cast("long"))
    rest = known.filter((F.col("at") < F.col("lo")) | (F.col("at") > F.col("hi")))
    return rest.withColumn("picked", F.when(F.col("at") < F.col("lo"), F.col("times")).otherwise(0).cast("long")).unionByName(last)


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_rows: int = SORTED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and epochs as a number of copies. weights (doc_id, weight): the largest counts."""
    each = repeated(_classes(docs, weights, id_col, text_col, source_col, most_rows), "times", "place")
    copies = F.least(F.col("epochs") + (F.col("place") <= F.col("picked")).cast("long"), F.lit(MOST_EPOCHS))
    return each.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One plan row per source; no hint, as the number of sources has no proven bound."""
    return rows.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    copies = F.least(F.col("epochs") * F.col("times") + F.col("picked"), F.col("times") * MOST_EPOCHS)
    taken = _classes(docs, weights, id_col, text_col, source_col, SORTED).select(named(F.col("doc_id")).alias("id"), named(F.col("source")).alias("from"), "sha", copies.alias("copies"))
    own = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    rows = docs.select(named(F.col(id_col)).alias("id"), named(F.col(source_col).cast("string")).alias("from"), own.alias("sha"), nested(docs)).dropDuplicates(["id", "from", "sha"])
    met = rows.join(taken.filter("copies > 0"), ["id", "from", "sha"])
    return repeated(met.select("row", "copies"), "copies", "copy").select("row.*")
