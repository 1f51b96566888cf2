"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count c is stored as its level q: the n-gram is put into the filter once for each level 1 to q, so a reader probes level
after level until one is missing. Levels begin at 1, 2, 3 and from eight on lie a quarter apart (``BASE``). A filter never
loses an entry; a false positive raises a count by a level.

Texts are counted in chunks of about ``CHUNK_WORDS`` words; a chunk sends each part of the hash range one row with the sums
of its n-grams. A part adds them up, builds its own piece of the filter with ``BITS`` bits for each entry, and lists its words'
exact counts. So nothing but the pieces is gathered, the filter grows with the corpus, and parts grow in number, not in size
(``PART_BYTES`` of text each). Up to ``MOST_BYTES`` of pieces are broadcast at a time. Where there are more, documents are read
in several passes, each with its own run of parts; between them a document carries one byte for each n-gram and its sums.
Results are the same with one pass or many.

Probability of a word after a context h, order by order: (f + mu * p) / (g + mu), with f the lower bound of the n-gram's
level (g at most), g the upper bound of the context's, p the probability of the order below. The lower bounds of
all words after h sum to g at most, so probabilities sum to 1 at most, but for false positives.

Defined results: null and empty texts have one token, the end. A null doc_id reads as an empty one. Repeated rows count and
are scored each. Texts of any length are whole. An empty table gives no row; with nothing learnt each token has a
probability of 1 / (V + 1), V being 0. Words are known by 64-bit hashes. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

ORDER, FOLDS, HELD = 2, 7, 2
#: Weight of the order below, for bigrams and trigrams.
MU = {2: 100.0, 3: 1.0}
BASE, BITS, PROBES = 1.25, 12, 6
CHUNK_WORDS, PART_BYTES, MOST_BYTES = 2_000_000, 16_000_000, 384_000_000

_MAPPED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BEGIN, END = xxhash.xxh64_intdigest(b" begin"), xxhash.xxh64_intdigest(b" end")


def _levels() -> np.ndarray:
    found = [1]
    while found[-1] < 1 << 50:
        found.append(max(found[-1] + 1, int(found[-1] * BASE)))
    return np.array(found, np.int64)


LEVELS = _levels()
#: Lower and upper bounds of a level's counts; level 0 is none.
LOWER = np.concatenate([[0], LEVELS[:-1]]).astype(np.float64)
UPPER = np.concatenate([[0], LEVELS[1:] - 1]).astype(np.float64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD


def mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of a 64-bit number over all of them."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Texts as word hashes: each a begin, its words and an end."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def read(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All hashes in order, and each one's place in its text."""
        known, hashes, sizes = self.known, [], []
        for text in texts:
            words = text.translate(_MAPPED).split()
            hashes.append(BEGIN)
            for w in words:
                h = known.get(w)
                if h is None:
                    known[w] = h = xxhash.xxh64_intdigest(w)
                hashes.append(h)
            hashes.append(END)
            sizes.append(len(words) + 2)
        sizes = np.array(sizes, np.int64)
        return np.array(hashes, np.uint64), np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def ngrams(hashes: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hash of the n-gram that ends at a place, and where there is one."""
    found = hashes
    yield found, np.ones(len(hashes), bool)
    for n in range(2, order + 1):
        longer = np.zeros_like(found)
        longer[1:] = mixed(found[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:])
        found = longer
        yield found, place >= n - 1


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, so parts in order are hashes in order."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def slices(texts: Iterable[bytes | None], most: int) -> Iterator[list[bytes]]:
    """Runs of texts with about ``most`` bytes at most, or one text."""
    run, size = [], 0
    for text in texts:
        text = text or b""
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def counted(batches: Iterable[pa.RecordBatch], parts: int, order: int) -> Iterator[pa.RecordBatch]:
    """part, h1, c1, hn, cn: the sums of a chunk for each part, words apart from longer n-grams."""

    def told(texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        seen = Words().read(texts)
        sums = [np.unique(h[there], return_counts=True) for h, there in ngrams(*seen, order)]
        h1, c1 = sums[0]
        hn = np.concatenate([h for h, _ in sums[1:]] or [h1[:0]])
        cn = np.concatenate([c for _, c in sums[1:]] or [c1[:0]])
        sort = np.argsort(hn)
        hn, cn = hn[sort], cn[sort]
        to1, ton = (np.searchsorted(part_of(h, parts), np.arange(parts + 1)) for h in (h1, hn))
        cols: list[list] = [[], [], [], [], []]
        for p in range(parts):
            a, b, c, d = to1[p], to1[p + 1], ton[p], ton[p + 1]
            if a < b or c < d:
                values = (p, h1[a:b].tobytes(), c1[a:b].astype(np.uint32).tobytes(), hn[c:d].tobytes(), cn[c:d].astype(np.uint32).tobytes())
                for col, value in zip(cols, values, strict=True):
                    col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "h1", "c1", "hn", "cn"])

    held, size = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(text.as_py() or b"")
            size += len(held[-1]) + 1
            if size >= CHUNK_WORDS * 6:
                yield from told(held)
                held, size = [], 0
    if held:
        yield from told(held)


def added(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(hashes), np.uint64)
    c = np.frombuffer(b"".join(counts), np.uint32)
    own, back = np.unique(h, return_inverse=True)
    return own, np.bincount(back, c, len(own)).astype(np.int64)


def probes(h: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """The places of an n-gram at a level, in a piece of ``size`` bits."""
    one = mixed(h ^ np.uint64((level * 0x9FB21C651E98DF25) % (1 << 64)))
    two = mixed(one) | np.uint64(1)
    for _ in range(PROBES):
        yield (one % size).astype(np.int64)
        one = one + two


def piece(table: pa.Table) -> pa.Table:
    """part, bits, h, c, n, v of one part: its piece of the filter, its words with exact counts, their sum and number."""
    h1, c1 = added(table["h1"].to_pylist(), table["c1"].to_pylist())
    hn, cn = added(table["hn"].to_pylist(), table["cn"].to_pylist())
    level = np.searchsorted(LEVELS, np.concatenate([c1, cn]), side="right")
    size = int(level.sum()) * BITS // 8 * 8 + 64
    bits, every = np.zeros(size, bool), np.concatenate([h1, hn])
    for k in range(1, int(level.max(initial=0)) + 1):
        for at in probes(every[level >= k], k, np.uint64(size)):
            bits[at] = True
    real = h1 != np.uint64(BEGIN)
    h1, c1 = h1[real], c1[real]
    return pa.table({
        "part": pa.array([table["part"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
        "h": pa.array([h1.tobytes()], pa.binary()), "c": pa.array([c1.tobytes()], pa.binary()), "n": pa.array([int(c1.sum())]), "v": pa.array([len(h1)]),
    })


class Model:
    """The pieces in the shared folder and what they sum to: ``parts``, ``n`` tokens, ``v`` words, ``sizes`` (part, bytes)."""

    def __init__(self, pieces: DataFrame, parts: int, order: int):
        self.pieces, self.parts, self.order = pieces, parts, order
        size = (F.octet_length("bits") + F.octet_length("h") + F.octet_length("c")).alias("size")
        rows = pieces.select("part", size, "n", "v").collect()
        self.n, self.v = sum(r["n"] for r in rows), sum(r["v"] for r in rows)
        self.sizes = {r["part"]: r["size"] for r in rows}

    def runs(self, most: int) -> list[tuple[int, int]]:
        """Ranges of parts of at most so many bytes, or one part."""
        found, begin, size = [], 0, 0
        for p in range(self.parts):
            more = self.sizes.get(p, 0)
            if p > begin and size + more > most:
                found.append((begin, p))
                begin, size = p, 0
            size += more
        return [*found, (begin, self.parts)]

    def gathered(self, begin: int, end: int) -> dict:
        """A run of parts: bits and words one behind the other. Bounded by ``MOST_BYTES``."""
        size, offset, known, counts, bits, at = np.ones(end - begin, np.uint64), np.zeros(end - begin, np.int64), [], [], [], 0
        for r in self.pieces.filter(F.col("part").between(begin, end - 1)).orderBy("part").toLocalIterator():
            size[r["part"] - begin], offset[r["part"] - begin] = len(r["bits"]) * 8, at
            at += len(r["bits"]) * 8
            bits.append(np.frombuffer(bytes(r["bits"]), np.uint8))
            known.append(np.frombuffer(bytes(r["h"]), np.uint64))
            counts.append(np.frombuffer(bytes(r["c"]), np.int64))
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(1, kind)[:0]
        return {"begin": begin, "end": end, "size": size, "offset": offset, "bits": join(bits, np.uint8), "known": join(known, np.uint64), "counts": join(counts, np.int64), "parts": self.parts}


def train(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts all documents outside the held-out fold."""
    taught = docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").cast("binary").alias("text"))
    total = taught.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    sums = taught.mapInArrow(lambda batches: counted(batches, parts, order), "part int, h1 binary, c1 binary, hn binary, cn binary")
    return Model(cut(sums.groupBy("part").applyInArrow(piece, "part int, bits binary, h binary, c binary, n long, v long")), parts, order)


def levels_of(h: np.ndarray, held: dict) -> np.ndarray:
    """The level of each n-gram by probing level after level; 0 for those of other parts."""
    own, back = np.unique(h, return_inverse=True)
    part = part_of(own, held["parts"])
    found = np.zeros(len(own), np.uint8)
    open_ = np.flatnonzero((part >= held["begin"]) & (part < held["end"]))
    open_ = open_[held["size"][part[open_] - held["begin"]] > 1]
    for level in range(1, len(LEVELS)):
        if not len(open_):
            break
        near = part[open_] - held["begin"]
        there = np.ones(len(open_), bool)
        for at in probes(own[open_], level, held["size"][near]):
            at = at + held["offset"][near]
            there &= ((held["bits"][at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        open_ = open_[there]
        found[open_] = level
    return found[back]


def score(docs: DataFrame, model: Model, most: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    order, n, v = model.order, model.n, model.v
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"),
        F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.lit(None).cast("binary").alias("levels"),
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    runs = model.runs(most)
    for k, (begin, end) in enumerate(runs):
        held, last = docs.sparkSession.sparkContext.broadcast(model.gathered(begin, end)), k == len(runs) - 1
        out = "doc_id {}, n_tokens long, n_known long, train_tokens long, base_score double, score double" if last else "doc_id {}, text binary, known long, base double, levels binary"
        rows = rows.mapInArrow(_reader(held, order, n, v, last), out.format(id_type))
        if not last:
            rows = cut(rows)
    return rows


def _reader(shared, order: int, n: int, v: int, last: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at = 0
            for texts in slices((t.as_py() for t in batch["text"]), CHUNK_WORDS * 3):
                rows = batch.slice(at, len(texts))
                at += len(texts)
                yield told(held, rows, texts)

    def told(held: dict, rows: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        hashes, place = Words().read(texts)
        token, begin = place > 0, np.flatnonzero(place == 0)
        doc = np.cumsum(place == 0) - 1
        # Exact counts of the words of these parts, for the base.
        own = token & (lambda p: (p >= held["begin"]) & (p < held["end"]))(part_of(hashes, held["parts"]))
        at = np.minimum(np.searchsorted(held["known"], hashes), max(len(held["known"]) - 1, 0))
        count = np.where(held["known"][at] == hashes, held["counts"][at], 0) if len(held["known"]) else np.zeros(len(hashes), np.int64)
        sums = lambda x: np.add.reduceat(x, begin)
        known = rows["known"].to_numpy() + sums((own & (count > 0)).astype(np.int64))
        base = rows["base"].to_numpy() + sums(np.where(own, np.log10((count + 1) / (n + v + 1)), 0.0))
        levels = [np.where(there, levels_of(h, held), 0).astype(np.uint8) for h, there in ngrams(hashes, place, order)]
        if rows["levels"].null_count == 0:
            sizes = np.diff(np.append(begin, len(hashes)))
            before = [np.frombuffer(x.as_py(), np.uint8).reshape(order, -1) for x in rows["levels"]]
            assert [x.shape[1] for x in before] == sizes.tolist()
            levels = list(np.stack(levels) | np.concatenate(before, axis=1))
        if not last:
            ends = [*begin.tolist(), len(hashes)]
            carried = [np.stack([x[a:b] for x in levels]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return pa.RecordBatch.from_arrays([rows["doc_id"], rows["text"], pa.array(known), pa.array(base), pa.array(carried, pa.binary())], names=["doc_id", "text", "known", "base", "levels"])
        p = (LOWER[levels[0]] + 1) / (n + v + 1)
        for k in range(2, order + 1):
            context = np.zeros(len(hashes))
            context[1:] = UPPER[levels[k - 2][:-1]]
            longer = (np.minimum(LOWER[levels[k - 1]], context) + MU[k] * p) / (context + MU[k])
            p = np.where(place >= k - 1, longer, p)
        total = sums(np.where(token, np.log10(p), 0.0))
        tokens = np.bincount(doc[token], minlength=len(texts)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [rows["doc_id"], pa.array(tokens), pa.array(known), pa.array(np.full(len(texts), n, np.int64)), pa.array(base), pa.array(total)],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run
