"""Phrase collocations by stripes: a prefix keys an associative counter of its next words.

The stripes of level m have prefixes of m - 1 words; those of level 1 have the empty prefix, and their sum is the number of
words. Each task reads its texts once, in chunks of at most ``CHUNK_WORDS`` words, and writes them as numbers of the chunk's
words. Every level counts the chunks and writes one stripe for each prefix of a chunk, many stripes in a block; stripes of
a prefix meet in one place and are added elementwise. So one structure gives a phrase's extensions (its stripe), the totals
of a phrase's parts (entries of earlier levels) and its subsumption maxima (the largest entry of its own stripe to the
right, of the stripes that its last word ends to the left).

In stripes, words and prefixes are 64-bit hashes, and only frequent entries get their words back, from the level before and
the frequent words. Counts are exact but for phrases of one language whose hashes are equal, which are not told apart: among
a million frequent words and a hundred million others, one in about 200,000 such corpora has one. Shuffles are deleted as
soon as a level is written.

Level m only looks at phrases both of whose parts of m - 1 words were frequent. Tasks ask a bitmap of hashes, of
``MOST_BITS`` bits at most, whatever the corpus; what it lets through by mistake is counted and falls by the exact threshold,
so it costs work and never changes a result. Stripes are dealt by their prefix; those of the few prefixes that make up more
than an eighth of a range's share, and the empty prefix's, which holds the whole vocabulary, by their entries, so the stripe
of a frequent word is no single task's.

A phrase is dropped if a longer candidate that holds it is as frequent. A phrase's count is never below that of a longer
phrase around it, so every step on the way to that candidate is as frequent too, and phrases longer by one word decide.

Defined results: null text is empty and has no words; null lang is ``und``. Repeated rows, null doc_ids included, count each;
no id is read. Texts and words of any length are counted whole. Bytes that are no UTF-8 are words' bytes like others until
results are shown. An empty table, or one without a frequent phrase, gives no row. Only the text and lang columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.session import cut_and_free

LONGEST, LEAST, TOP = 5, 100, 2000
CHUNK_WORDS = 2_000_000
#: Words whose stripes meet in one range, and entries that are added at a time.
RANGE_WORDS, ADDED = 2_000_000, 1_000_000
#: Bits of the bitmap for each frequent phrase, and how many it has at least and at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 15, 27
TURN = 11
#: Buckets that a language's phrases are ranked in before they are ranked together.
BUCKETS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MAPPED = bytes.maketrans(f"{_UPPER}\t.,;:!?\x0b\x0c\r".encode(), f"{_LOWER} \n\n\n\n\n\n\n\n\n".encode())


def rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by)) if by else h


class Chunk:
    """Texts of one language as numbers: ``ids`` of words, -1 between pieces."""

    def __init__(self, lang: str):
        self.lang, self.known, self.ids, self.size = lang, {}, [], 0

    def add(self, text: bytes) -> None:
        known, fresh = self.known, count(len(self.known))
        out: list[int] = []
        for piece in text.translate(_MAPPED).split(b"\n"):
            if words := [w for w in piece.split(b" ") if w]:
                for w in words:
                    k = known.get(w)
                    if k is None:
                        known[w] = k = next(fresh)
                    out.append(k)
                out.append(-1)
        self.ids.append(np.array(out, np.int32))
        self.size += len(out)

    def packed(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        compress = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_pydict({"lang": [self.lang], "words": pa.array([compress(b"\n".join(self.known))], pa.binary()), "ids": pa.array([compress(ids.tobytes())], pa.binary())})


def unpacked(row: dict) -> tuple[list[bytes], np.ndarray]:
    """A chunk's words, none of which holds a line feed, and their numbers in its texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    return unpack(row["words"]).split(b"\n"), np.frombuffer(unpack(row["ids"]), np.int32)


def chunks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, words, ids: all texts as numbers of their chunk's words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    most = CHUNK_WORDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Chunk] = {}

        def close() -> Iterator[pa.RecordBatch]:
            for chunk in open_.values():
                if chunk.known:
                    yield chunk.packed()
            open_.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                if text.is_valid:
                    open_.setdefault(lang, Chunk(lang)).add(text.as_py())
                    if sum(c.size for c in open_.values()) >= most:
                        yield from close()
        yield from close()

    return rows.mapInArrow(run, "lang string, words binary, ids binary")


def counted_words(held: DataFrame) -> DataFrame:
    """lang, phrase, f: the empty prefixes' stripes, dealt by word and added."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                words, ids = unpacked(row)
                n = np.bincount(ids[ids >= 0], minlength=len(words))
                yield pa.RecordBatch.from_pydict({"lang": [row["lang"]] * len(words), "word": pa.array(words, pa.binary()), "n": pa.array(n, pa.int64())})

    rows = held.mapInArrow(run, "lang string, word binary, n long")
    return rows.groupBy("lang", F.col("word").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))


def grouped(prefix: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stripes added elementwise, in the order of prefix and word."""
    order = np.lexsort((word, prefix))
    prefix, word, n = prefix[order], word[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])]))
    return prefix[begin], word[begin], np.add.reduceat(n, begin)


def stripes(held: DataFrame, level: int, bitmap: bytes, heavy: np.ndarray, ranges: int) -> DataFrame:
    """range, stripes, entries, block: each chunk's counters; ``bitmap``: frequent phrases one word shorter, ``heavy``: prefixes whose stripes are split."""
    shared = held.sparkSession.sparkContext.broadcast((bitmap, heavy))

    def entries(lang: str, words: list[bytes], ids: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
        ids = np.concatenate([ids, np.full(level, -1, np.int32)])
        word = hashes[ids]
        inside = ids >= 0
        whole = inside.copy()
        for k in range(1, level - 1):
            whole[:-k] &= inside[k:]
            whole[-k:] = False
        h = np.full(len(ids), np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42)))
        for k in range(level - 1):
            h[: len(ids) - k] ^= rotated(word[k:], TURN * (k + 1))
        place = (h >> np.uint64(64 - frequent_bits(frequent))).astype(np.int64)
        often = whole & ((frequent[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
        at = np.flatnonzero(often[:-1] & often[1:])
        own, place = np.unique(h[at], return_inverse=True)
        code, n = np.unique(place.astype(np.int64) << 32 | ids[at + level - 1], return_counts=True)
        return own[code >> 32], hashes[code & 0xFFFFFFFF], n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, split = shared.value
        frequent, compress = np.frombuffer(bits, np.uint8), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                prefix, word, n = entries(row["lang"], *unpacked(row), frequent)
                if not len(n):
                    continue
                dealt = np.where(np.isin(prefix, split), prefix ^ rotated(word, TURN * level), prefix)
                # The upper bits of the product depend on all of the hash.
                at = (((dealt * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
                order = np.lexsort((prefix, at))
                prefix, word, n, at = prefix[order], word[order], n[order].astype(np.uint32), at[order]
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
                sizes, blocks = [], []
                for a, b in zip(bounds, bounds[1:], strict=False):
                    own, length = np.unique(prefix[a:b], return_counts=True)
                    sizes.append(len(own))
                    blocks.append(compress(own.tobytes() + word[a:b].tobytes() + length.astype(np.uint32).tobytes() + n[a:b].tobytes()))
                yield pa.RecordBatch.from_pydict({"range": pa.array(at[bounds[:-1]], pa.int32()), "stripes": pa.array(sizes, pa.int32()), "entries": pa.array(np.diff(bounds), pa.int32()), "block": pa.array(blocks, pa.binary())})

    return held.mapInArrow(run, "range int, stripes int, entries int, block binary")


def merged(rows: DataFrame, ranges: int, least: int) -> DataFrame:
    """prefix, word, f: stripes added elementwise where they meet, entries of at least ``least`` occurrences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        met, fresh = [], 0

        def added() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            return [grouped(*(np.concatenate(x) for x in zip(*met, strict=True)))]

        for batch in batches:
            for k in range(batch.num_rows):
                s, e = batch["stripes"][k].as_py(), batch["entries"][k].as_py()
                data = unpack(batch["block"][k].as_buffer())
                length = np.frombuffer(data, np.uint32, s, 8 * (s + e))
                met.append((np.repeat(np.frombuffer(data, np.uint64, s), length), np.frombuffer(data, np.uint64, e, 8 * s), np.frombuffer(data, np.uint32, e, 12 * s + 8 * e).astype(np.int64)))
                fresh += e
                # What is held grows by half at least before it is sorted again.
                if fresh >= max(ADDED, len(met[0][0]) // 2):
                    met, fresh = added(), 0
        if met:
            prefix, word, f = added()[0]
            often = f >= least
            yield pa.RecordBatch.from_pydict({"prefix": pa.array(prefix[often].view(np.int64)), "word": pa.array(word[often].view(np.int64)), "f": pa.array(f[often], pa.int64())})

    return rows.repartitionById(ranges, F.col("range")).mapInArrow(run, "prefix long, word long, f long")


def frequent_bits(bitmap: np.ndarray) -> int:
    return (len(bitmap) * 8).bit_length() - 1


def turned(h: Column, k: int) -> Column:
    return F.shiftleft(h, k * TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - k * TURN))


def bitmap_of(phrases: DataFrame, n: int) -> bytes:
    """One bit for each phrase's hash: a power of two of bits, ``2 ** MOST_BITS`` at most (16 MB)."""
    bits = min(max((n * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.shiftrightunsigned("hash", 64 - bits) + 1
    blocks = phrases.select(F.bitmap_bucket_number(place).alias("block"), F.bitmap_bit_position(place).alias("bit"))
    held = np.zeros(1 << (bits - 3), np.uint8)
    # At most 2 ** (MOST_BITS - 15) blocks of 4,096 bytes.
    for r in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        held[(r["block"] - 1) * 4096 : r["block"] * 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return held.tobytes()


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """n words per lang (lang, n), and per level the phrases (lang, phrase, f) of at least ``least`` occurrences."""
    held = cut_and_free(chunks(docs, text_col, lang_col))
    words = cut_and_free(counted_words(held))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    all_words = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-all_words // RANGE_WORDS))
    # A phrase's hash: its words', each turned by its place from 1 on, and its language's, which may be a word too.
    first = words.filter(F.col("f") >= least).select("*", F.xxhash64("phrase").alias("word"))
    levels = [cut_and_free(first.select("*", F.xxhash64("lang").bitwiseXOR(turned(F.col("word"), 1)).alias("hash")))]
    known = levels[0].select("lang", F.col("phrase").alias("last"), "word")
    while len(levels) < longest and (n := levels[-1].count()):
        level = len(levels) + 1
        # Their counts sum up to the number of words at most, so there are no more than eight for each range.
        heavy = levels[-1].filter(F.col("f") * (8 * ranges) > all_words).select("hash").collect()
        split = np.array([r["hash"] for r in heavy], np.int64).view(np.uint64)
        found = merged(stripes(held, level, bitmap_of(levels[-1], n), split, ranges), ranges, least)
        prefixes = levels[-1].select("lang", "phrase", F.col("hash").alias("prefix"))
        named = found.join(prefixes, "prefix").join(known, ["lang", "word"])
        hashed = F.col("prefix").bitwiseXOR(turned(F.col("word"), level))
        levels.append(cut_and_free(named.select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "f", hashed.alias("hash"))))
    return total, [x.select("lang", "phrase", "f") for x in levels]


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by the score of their weakest cut.

    Phrases are ranked in ``BUCKETS`` buckets of a language first, then together, so a language with most of the phrases
    needs no sort of all of them in one task.
    """
    total, levels = frequent_phrases(docs, least, longest, text_col, lang_col)
    held = levels[0]
    for level in levels[1:]:
        held = held.unionByName(level)
    candidates = held.filter(F.instr("phrase", " ") > 0)
    words = F.split("phrase", " ")
    size = F.size(words)
    join = lambda xs: F.array_join(xs, " ")

    # Two phrases of one word less lie in each candidate of three words or more.
    inside = candidates.filter(size > 2).select("lang", "f", F.explode(F.array(join(F.slice(words, 1, size - 1)), join(F.slice(words, 2, size - 1)))).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    spread = F.xxhash64("phrase").alias("spread")
    free = candidates.select("*", spread).join(around.select("*", spread), ["lang", "phrase", "spread"], "left")
    free = free.filter(F.coalesce(F.col("longer"), F.lit(0)) < F.col("f")).select("lang", "phrase", F.col("f").alias("a"))

    # The parts of every cut, found among all phrases; then each phrase has its parts' counts together, eight at most.
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), join(F.slice(words, 1, k)).alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), join(F.slice(words, k + 1, size - k)).alias("part")),
    )))
    wanted = free.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.k", "cut.side", "cut.part")
    counts = held.select("lang", F.col("phrase").alias("part"), "f", F.xxhash64("phrase").alias("spread"))
    known = wanted.withColumn("spread", F.xxhash64("part")).join(counts, ["lang", "part", "spread"])
    per = known.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    big = lambda c: F.col(c).cast(T.DecimalType(19, 0))
    scored = per.join(total, "lang").withColumn("over", (F.lit(1000).cast(T.DecimalType(4, 0)) * big("a") * big("n")).cast(T.DecimalType(38, 0)))
    scored = scored.withColumn("score", F.expr("over div cast(cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)) as decimal(38, 0))"))
    least_cut = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    near = flat.withColumn("place", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order))).filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
