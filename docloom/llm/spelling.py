"""Spelling variants by a trie frontier: states (word, position, node, edits) meet a distributed edge table, level by level.

Two words are near if one code point is inserted, deleted or replaced. An edit lies in a word's second half, and then its first
half is a path from the root, or in its first half, and then the same holds for the reversed words. So there are two tries
in one edge table, and edits are only tried from the middle on, where nodes have few children. A state without an edit is at
the node of the word's own prefix, at every level at once; it meets that node's edges, and branches into states of one edit: a
code point replaced or left out (an inserted one is the other word's left-out one). An edge also tells what follows its
child, so branches that die at the next level are never made. States of one edit go on along exact edges, ``STRIDE`` levels
at a time, until the word's end; there a terminal node is a neighbour, and the words themselves are compared.

Nodes are 64-bit hashes, each of its parent's and its code point, so a path is followed without its text; a collision can add a
path and never hide one, and the comparison of the words removes what it added.

Words of ``DEEP`` code points or more have no trie, whose depth would follow the longest word: each of them gives a hash with
each of its code points left out, and equal hashes at one place (or that of a whole word) make it a neighbour. Their rows are
as many as their code points.

A word's form has twice its count at least, so chains of forms are short; roots are found by doubling the links.

Defined results: null text has no runs; a null doc_id reads as an empty one. Repeated rows count each. Words of any length are
whole. Ties of forms: the smallest word in code-point order. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

LEAST_LENGTH, LEAST_COUNT, EVERY, FACTOR = 5, 3, 97, 2
DEEP, STRIDE = 32, 4
#: Distinct words that a task holds before it hands them on.
HELD = 400_000
#: A word's end among what follows a node; no code point of a run.
END = "$"

#: Latin-1 bytes: A-Z lower-cased, letters as they are, all else a blank.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def damaged(run: str, doc_id: str, every: int = EVERY) -> str:
    """The run, without one code point where the checksum of ``<doc_id>:<run>`` says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()))
    return run if h % every else run[: (k := h % len(run))] + run[k + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST_COUNT, length: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least ``length`` code points and ``least`` occurrences over all texts."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            kept = {w: n for w, n in total.items() if len(w) >= length}
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                if not text.is_valid:
                    continue
                runs = Counter(text.as_py().decode("utf-8", "replace").encode("latin-1", "replace").translate(_RUNS).split())
                base = zlib.crc32(f"{doc_id}:".encode())
                for raw, n in runs.items():
                    run = raw.decode("latin-1")
                    if len(raw) < length:  # deletion only shortens
                        continue
                    h = zlib.crc32(raw if raw.isascii() else run.encode(), base)
                    if h % EVERY == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                    total[run] = total.get(run, 0) + n
                if len(total) >= HELD:
                    yield told()
                    total.clear()
        yield told()

    found = rows.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def path(word: Column, side: Column) -> Column:
    """The nodes of a word's prefixes, the root first: each a hash of its parent and its code point."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(word)), F.array(F.xxhash64(side)),
        lambda acc, k: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), F.substring(word, k, F.lit(1)))),
    )


def follow(node: Column, word: Column, begin: Column, end: Column) -> Column:
    """The node behind the code points [begin, end) of a word, which has ``STRIDE`` of them at most."""
    step = lambda at, k: F.when(begin + k < end, F.xxhash64(at, F.substring(word, begin + k + 1, F.lit(1)))).otherwise(at)
    return F.aggregate(F.sequence(F.lit(0), F.lit(STRIDE - 1)), node, step)


def oriented(words: DataFrame) -> DataFrame:
    """word, n, side, spelled, nodes: each word from its begin (side 0) and from its end (side 1)."""
    both = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    both = both.withColumn("spelled", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))
    return both.withColumn("nodes", path(F.col("spelled"), F.col("side")))


def edge_table(paths: DataFrame) -> DataFrame:
    """node, code, follows: a child's code point and what can follow it. An end is a child without followers.

    Equal steps are merged before they move, and a node has as many children, and a child as many followers, as there are
    letters at most.
    """
    size = F.length("spelled")
    letter = lambda k: F.substring(F.col("spelled"), k + 1, F.lit(1))
    steps = F.transform(F.sequence(F.lit(0), size), lambda k: F.struct(
        F.element_at("nodes", k + 1).alias("node"), F.when(k < size, letter(k)).otherwise(END).alias("code"),
        F.when(k >= size, "").when(k + 1 < size, letter(k + 1)).otherwise(END).alias("follow"),
    ))
    distinct = paths.select(F.explode(steps).alias("step")).select("step.*").distinct()
    return distinct.groupBy("node", "code").agg(F.array_join(F.sort_array(F.collect_list("follow")), "").alias("follows"))


def branches(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """side, spelled, n, at, node: the states of one edit, each with an edge (or the end) before it.

    Of two words that differ in one code point the one with the smaller is replaced, and of words of two lengths the longer
    one loses a code point; in a run of equal ones the last is left out.
    """
    size, half = F.length("spelled"), F.floor(F.length("spelled") / 2).cast("int")
    begin = F.when(F.col("side") == 0, half).otherwise(size - half)
    seeds = paths.select("side", "spelled", "n", "nodes", F.explode(F.sequence(begin, size - 1)).alias("level"))
    seeds = seeds.select("side", "spelled", "n", "level", F.element_at("nodes", F.col("level") + 1).alias("node"))
    children = edges.groupBy("node").agg(F.collect_list(F.struct("code", "follows")).alias("children"))

    letter = lambda k: F.substring(F.col("spelled"), k + 1, F.lit(1))
    own = letter(F.col("level"))
    then = F.when(F.col("level") + 1 < F.length("spelled"), letter(F.col("level") + 1)).otherwise(END)
    met = seeds.join(children, "node").withColumn("own", own).withColumn("then", then)
    replaced = F.transform(
        F.filter("children", lambda c: (c["code"] > F.col("own")) & (F.instr(c["follows"], F.col("then")) > 0)), lambda c: F.xxhash64(F.col("node"), c["code"])
    )
    shorter = (F.col("own") != F.col("then")) & F.exists("children", lambda c: c["code"] == F.col("then"))
    left_out = F.when(shorter, F.array("node")).otherwise(F.array().cast("array<bigint>"))
    return met.select("side", "spelled", "n", (F.col("level") + 1).alias("at"), F.explode(F.concat(replaced, left_out)).alias("node"))


def trie_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: near words of ``DEEP`` code points at most, each pair once at least."""
    paths = cut(oriented(words.filter(F.length("word") <= DEEP)))
    edges = cut(edge_table(paths))
    states = branches(paths, edges)
    ends = F.max(F.col("code") == END).alias("ends")
    nodes = edges.groupBy("node").agg(ends)
    size = F.length("spelled")
    for _ in range(-(-DEEP // 2 // STRIDE) + 1):
        # The new place has a column of its own until the fold has read the old one.
        states = states.withColumn("to", F.least(F.col("at") + STRIDE, size))
        states = states.withColumn("node", follow(F.col("node"), F.col("spelled"), F.col("at"), F.col("to"))).drop("at").withColumnRenamed("to", "at")
        states = states.join(nodes, "node").filter((F.col("at") < size) | F.col("ends")).drop("ends")
    final = paths.select(F.element_at("nodes", -1).alias("node"), F.col("spelled").alias("other"), F.col("n").alias("other_n"))
    found = states.join(final, "node").filter(F.levenshtein("spelled", "other", 1) == 1)
    read = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    return found.select(read("spelled").alias("word"), "n", read("other").alias("other"), "other_n")


def deep_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: near words of ``DEEP`` code points or more, each pair once at least.

    Words that are equal without the code point at one place are as few as there are letters.
    """
    deep = words.filter(F.length("word") >= DEEP).select("word", "n", F.xxhash64("word").alias("id"))

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prime, base = (1 << 61) - 1, 0x1F3D5B79
        for batch in batches:
            for word, key in zip(batch["word"], batch["id"], strict=True):
                code = [ord(c) for c in word]
                n, before, power = len(code), [0], [1]
                for c in code:
                    before.append((before[-1] * base + c) % prime)
                    power.append(power[-1] * base % prime)
                after, out = 0, [0] * n
                for k in range(n - 1, -1, -1):
                    out[k] = (before[k] * power[n - 1 - k] + after) % prime
                    after = (after + code[k] * power[n - 1 - k]) % prime
                yield pd.DataFrame({"id": np.int64(key), "place": np.arange(-1, n, dtype=np.int32), "size": np.int32(n), "h": np.array([before[n], *out], np.int64)})

    rows = cut(deep.select("word", "id").mapInPandas(gaps, "id long, place int, size int, h long"))
    gap, whole = rows.filter("place >= 0"), rows.filter("place < 0")
    other = gap.select(F.col("id").alias("other"), "place", "size", "h")
    replaced = gap.join(other, ["place", "size", "h"]).filter(F.col("id") < F.col("other")).select("id", "other")
    shorter = gap.withColumn("size", F.col("size") - 1).select("id", "size", "h").join(whole.select(F.col("id").alias("other"), "size", "h"), ["size", "h"]).select("id", "other")
    pairs = replaced.unionByName(shorter).distinct()
    found = pairs.join(deep, "id").join(deep.select(F.col("word").alias("to"), F.col("n").alias("other_n"), F.col("id").alias("other")), "other")
    return found.filter(F.levenshtein("word", "to", 1) == 1).select("word", "n", F.col("to").alias("other"), "other_n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each word with each of its near words."""
    pairs = trie_pairs(words).unionByName(deep_pairs(words))
    way = lambda a, m, b, n: F.struct(F.col(a).alias("word"), F.col(m).alias("n"), F.col(b).alias("other"), F.col(n).alias("other_n"))
    both = pairs.select(F.explode(F.array(way("word", "n", "other", "other_n"), way("other", "other_n", "word", "n"))).alias("way")).select("way.*")
    return both.dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last; each round doubles the links' length, until none moves."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST_COUNT, length: int = LEAST_LENGTH, factor: int = FACTOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word; form and form_n are null where no near word is frequent enough."""
    words = cut(word_counts(docs, least, length, id_col, text_col))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    fits = -F.col("best.less") >= factor * F.col("n")
    near = cut(near.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    found = words.join(near, "word", "left").join(roots(near.filter(F.col("form").isNotNull())), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
