"""SimHash near-dedup with BK-trees.

A text's fingerprint is a majority vote of its shingles' hashes. Fingerprints that differ in at most ``RADIUS`` bits are
linked, links make components, and a component's id is its smallest doc_id.

Equal fingerprints are one. The 64 bits fall into six blocks; two fingerprints at 4 bits or less agree on two blocks at
least, so each of the 15 pairs of blocks deals the fingerprints into shards, and every link lies inside a shard. With
more fingerprints there are seven or eight blocks, of which three or four agree, so that a shard's expected size stays
bounded; the links are the same. A shard of more than ``SHARD`` fingerprints is dealt into parts. A part becomes a BK-tree (children keyed by their distance to
the parent), which fingerprints search following only edges within the radius: first those of the part, then those of
the shard that its largest component lacks. A search reports no more links than hold its components together. Trees of
all documents have no bound on their size, so trees go to the searching tasks by shuffle, not by broadcast through the
driver.

Components come from alternating large-star and small-star steps, each written to the shared folder.

Defined results: null text and text without words have fingerprint 0, linked like any other. A null doc_id is in a
component but never names it unless nothing else does. Repeated rows get a row each. An empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.exact_dedup import only
from docloom.session import cut

WORDS, RADIUS, SEED = 4, 4, 42
#: Widths of the blocks and how many of them agree at 4 bits or less: keys of 20, 27 and 32 bits at least.
SCHEMES = (((11, 11, 11, 11, 10, 10), 2), ((10, 9, 9, 9, 9, 9, 9), 3), ((8,) * 8, 4))
SHARD, SLICE = 256, 256
#: For groups of similar texts: five words, a Jaccard similarity of 0.8, and bands of minima that agree for such texts
#: with a probability of 1 - (1 - 0.8 ** 3) ** 12 > 0.9998.
SIMILAR_WORDS, SIMILARITY, SIMILAR_RADIUS = 5, 0.8, 20
BANDS, BAND_ROWS = 12, 3
_MULTIPLIERS = [np.uint64(xxhash.xxh64_intdigest(str(k), SEED) | 1) for k in range(BANDS * BAND_ROWS)]


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included. Bytes' own lower() and split() know exactly A-Z and the white space asked for."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(found) - words + 1, 1)
    spans = zip(starts[:n].tolist(), ends[len(found) - n :].tolist(), strict=True)
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima under ``BANDS * BAND_ROWS`` fixed permutations of the hashes; no words, one key."""
    if not len(hashes):
        return [0]
    minima = [(hashes * m).min() for m in _MULTIPLIERS]
    bands = np.array(minima, np.uint64).reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) >> 1 for k, band in enumerate(bands)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: bool = False) -> DataFrame:
    """doc_id, text_sha256, fp (the fingerprint as a signed long) and, if asked for, the keys of its bands.

    With bands, the fingerprint is a vote of the distinct shingles, as the sets that decide hold each once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("text_sha256"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only a slice of a batch becomes Python objects at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                own = batch.slice(at, SLICE)
                hashes = [shingle_hashes(t, words) for t in own.column("text").to_pylist()]
                if bands:
                    hashes = [np.unique(h) for h in hashes]
                found = [pa.array(np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64))]
                if bands:
                    found.append(pa.array([band_keys(h) for h in hashes], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_sha256"), *found], ["doc_id", "text_sha256", "fp", "keys"][: 3 + bands])

    return rows.mapInArrow(run, f"doc_id {id_type}, text_sha256 string, fp long" + ", keys array<bigint>" * bands)


class BKTree:
    """A node is (fingerprint, its places, children); children are keyed by their distance to the parent."""

    def __init__(self):
        self.root: tuple[int, list[int], dict] | None = None

    def add(self, value: int, place: int) -> None:
        if self.root is None:
            self.root = (value, [place], {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            if d not in node[2]:
                node[2][d] = (value, [place], {})
                return
            node = node[2][d]
        node[1].append(place)

    def within(self, value: int, radius: int) -> list[list[int]]:
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            node = open_nodes.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append(node[1])
            for edge, child in node[2].items():
                if d - radius <= edge <= d + radius:
                    open_nodes.append(child)
        return found


def spanning_links(members: list[tuple[int, int]], queries: list[tuple[int, int]], radius: int, sets: Sets | None = None) -> list[tuple[int, int]]:
    """Links that hold together what is linked: members with each other if there are no queries, else queries with members.

    Rows are (fingerprint, place). Without ``sets``, fingerprints within the radius are a link. With them, the sets of two
    places decide: first where fingerprints are within the radius, then wherever places aren't together yet.
    """
    tree, parent, links = BKTree(), {}, []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(value: int, place: int) -> None:
        for others in tree.within(value, radius):
            for other in others:
                a, b = root(place), root(other)
                if a != b and (sets is None or sets.same(place, other)):
                    parent[a] = b
                    links.append((place, other))

    for value, place in members:
        if not queries:
            link(value, place)
        tree.add(value, place)
    for value, place in queries:
        link(value, place)
    if sets is not None and members:
        own, asked = [place for _, place in members], [place for _, place in queries]
        if not queries:
            # Of two places that are apart, one at least is outside the largest component.
            top = Counter(map(root, own)).most_common(1)[0][0]
            asked = [place for place in own if root(place) != top]
        for place, other in sets.alike(asked, own):
            a, b = root(place), root(other)
            if a != b:
                parent[a] = b
                links.append((place, other))
    return links


def scheme_for(count: int, shard: int = SHARD) -> tuple[tuple[int, ...], int]:
    """The fewest blocks with which so many fingerprints make shards of at most the given size, were they spread evenly."""
    fitting = [s for s in SCHEMES if count <= shard << sum(sorted(s[0])[: s[1]])]
    return fitting[0] if fitting else SCHEMES[-1]


def _block_keys(fp: Column, widths: tuple[int, ...], agree: int) -> list[Column]:
    ends = np.cumsum(widths)
    block = [F.shiftrightunsigned(fp, int(64 - e)).bitwiseAND((1 << w) - 1) for e, w in zip(ends, widths, strict=True)]
    keys = []
    for k, chosen in enumerate(combinations(range(len(widths)), agree)):
        key = F.lit(0).cast("long")
        for b in chosen:
            key = F.shiftleft(key, widths[b]) + block[b]
        keys.append(key + (k << 40))
    return keys


def links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD, scheme: tuple[tuple[int, ...], int] | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b), enough of them to hold every component together."""
    widths, agree = scheme or scheme_for(values.count(), shard)
    if radius > len(widths) - agree:
        raise ValueError("so many blocks needn't agree at this radius")
    keyed = values.select(F.col("fp").alias("node"), "fp", F.explode(F.array(*_block_keys(F.col("fp"), widths, agree))).alias("key"))
    return shard_links(_crowded(keyed), radius, shard)


def _crowded(keyed: DataFrame) -> DataFrame:
    """Rows of shards that hold two at least, with the shard's size. Two keys: see ``exact_dedup``."""
    spread = F.xxhash64("key").alias("spread")
    sizes = keyed.groupBy("key").count().filter("count > 1").select("key", "count", spread)
    return keyed.select("*", spread).join(sizes, ["key", "spread"]).drop("spread")


def shard_links(met: DataFrame, radius: int, shard: int = SHARD, sets: DataFrame | None = None, threshold: float = SIMILARITY) -> DataFrame:
    """met (key, count, node, fp) -> links (a, b) between nodes; with sets (node, shingles), their similarity decides.

    First the parts of every shard are searched by themselves. In a shard of several parts, what its largest component
    holds is together already; only the other fingerprints still go to the trees of all its parts. So a group of copies
    costs its size times the number of its stragglers, and not its size squared.
    """
    met = met.withColumn("parts", F.ceil(F.col("count") / shard).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    row = ["key", "node", "fp", "part"]
    alone = met.select(*row, F.lit(0).alias("chunk"), F.lit(False).alias("query"))
    inside = cut(_search(_with_sets(alone, sets), radius, sets is not None, threshold, False))

    wide = met.filter("parts > 1")
    if wide.isEmpty():
        return inside
    rooted = components(inside).select("node", "root", F.xxhash64("node").alias("s"))
    wide = wide.withColumn("s", F.xxhash64("node")).join(rooted, ["node", "s"], "left").withColumn("root", F.coalesce("root", "node"))
    wide = cut(wide.select(*row, "parts", "root"))
    sizes = wide.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("all"))
    split = sizes.filter(F.col("top.count") < F.col("all")).select(
        "key", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.count")) / shard).cast("int").alias("chunks"), F.xxhash64("key").alias("s")
    )
    wide = wide.withColumn("s", F.xxhash64("key")).join(split, ["key", "s"])
    members = wide.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*row, "chunk", F.lit(False).alias("query"))
    asked = wide.filter("root <> top").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    asked = asked.withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part <> own")
    both = _with_sets(members.unionByName(asked.select(*row, "chunk", F.lit(True).alias("query"))), sets)
    across = _search(both, radius, sets is not None, threshold, True)
    return inside.unionByName(across)


def _with_sets(rows: DataFrame, sets: DataFrame | None) -> DataFrame:
    """Sets are fetched for the rows that are searched, and no earlier."""
    return rows if sets is None else rows.withColumn("s", F.xxhash64("node")).join(sets.withColumn("s", F.xxhash64("node")), ["node", "s"]).drop("s")


def _search(rows: DataFrame, radius: int, similar: bool, threshold: float, apart: bool) -> DataFrame:
    """rows (key, part, chunk, node, fp, query[, shingles]): a tree per group of key, part and chunk. ``apart``: only queries search it."""
    node_type = rows.schema["node"].dataType.simpleString()
    group = ["key", "part", "chunk"]
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "query", "node")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _whole_groups(batches, group):
            found = []
            values = list(zip(own["fp"].to_numpy().view(np.uint64).tolist(), range(len(own)), strict=True))
            queries = own["query"].to_numpy()
            sets = Sets(own["shingles"], threshold) if similar else None
            for start, end in _runs(own, group):
                cut_at = start + int((~queries[start:end]).sum())
                if apart and cut_at in (start, end):
                    continue
                found += spanning_links(values[start:cut_at], values[cut_at:end], radius, sets)
            both, nodes = np.array(found, np.int64).reshape(-1, 2), own["node"].to_numpy()
            yield pd.DataFrame({"a": nodes[both[:, 0]], "b": nodes[both[:, 1]]})

    return ordered.mapInPandas(search, f"a {node_type}, b {node_type}").distinct()


class Sets:
    """The shingle sets of places, sorted distinct hashes of 32 bits; two are alike if their Jaccard similarity reaches the threshold."""

    def __init__(self, shingles: Iterable[bytes], threshold: float):
        self.sets, self.threshold = [np.frombuffer(s, np.uint32) for s in shingles], threshold

    def same(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if min(len(x), len(y)) < self.threshold * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= self.threshold * (len(x) + len(y) - both)

    def alike(self, asked: list[int], others: list[int]) -> Iterator[tuple[int, int]]:
        """All pairs that are alike, by one index of the others' hashes."""
        if not asked:
            return
        sizes = np.array([len(self.sets[o]) for o in others])
        hashes, owner = np.concatenate([self.sets[o] for o in others]), np.repeat(np.arange(len(others)), sizes)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        for place in asked:
            x = self.sets[place]
            first, last = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
            found = last - first
            hits = np.repeat(last - np.cumsum(found), found) + np.arange(found.sum())
            both = np.bincount(owner[hits], minlength=len(others))
            for k in np.flatnonzero(both >= self.threshold * (len(x) + sizes - both)).tolist():
                if others[k] != place:
                    yield place, others[k]


def _runs(rows: pd.DataFrame, group: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of two rows or more that agree on the group's columns."""
    change = np.zeros(len(rows), bool)
    for c in group:
        values = rows[c].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    bounds = np.concatenate([[0], np.flatnonzero(change), [len(rows)]])
    wide = np.flatnonzero(np.diff(bounds) > 1)
    return zip(bounds[wide].tolist(), bounds[wide + 1].tolist(), strict=True)


def _whole_groups(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Batches cut anew so that no group of the sorted rows is split; groups have a bounded size."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        same = np.ones(len(rows), bool)
        for c in group:
            same &= (rows[c] == rows[c].iat[-1]).to_numpy()
        first = int(same.argmax())
        held = rows.iloc[first:].reset_index(drop=True)
        if first:
            yield rows.iloc[:first]
    if held is not None:
        yield held


def components(pairs: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, root): the smallest node of each component, for nodes that have a link.

    Edges point from the larger to the smaller node. A step keeps components and ends when no edge changes.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.xxhash64("u").alias("s"))
        big = both.withColumn("s", F.xxhash64("u")).join(low, ["u", "s"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = big.filter("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("s", F.xxhash64("u"))
        small = edges.withColumn("s", F.xxhash64("u")).join(low, ["u", "s"])
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _rooted(rows: DataFrame) -> DataFrame:
    """Rows with fp -> each with its component's root."""
    values = cut(rows.select("fp").distinct())
    linked = components(links(values)).select(F.col("node").alias("fp"), "root", F.xxhash64("node").alias("s"))
    met = rows.withColumn("s", F.xxhash64("fp")).join(linked, ["fp", "s"], "left")
    return met.withColumn("root", F.coalesce("root", "fp")).drop("s")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rooted = cut(_rooted(cut(fingerprints(docs, id_col, text_col, words))))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumn("s", F.xxhash64("root"))
    found = rooted.withColumn("s", F.xxhash64("root")).join(names, ["root", "s"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, text_sha256, root: what texts of a Jaccard similarity of ``threshold`` chain together.

    Fingerprints of texts that similar mostly differ in up to ``SIMILAR_RADIUS`` bits, too many for blocks of bits to
    agree, so minima of the shingles' hashes make the shards. BK-trees search them as above and say which pairs come
    first; then what is not together yet is compared whatever its fingerprints are. A link counts if and only if the two
    sets of shingles are as similar as asked for. Texts are fetched once, for shards that hold two texts at least.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words, bands=True))
    texts_of = rows.select(F.col("text_sha256").alias("node"), "fp", "keys").dropDuplicates(["node"])
    keyed = texts_of.select("node", "fp", F.explode("keys").alias("key"))
    met = cut(_crowded(keyed))
    one = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"))
    asked = met.select(F.col("node").alias("text_sha256")).distinct().join(one, "text_sha256")
    texts = only(docs, asked, id_col, text_col).select(F.col(text_col).cast("string").alias("text"))
    texts = texts.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("node"), "text")

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique((shingle_hashes(t, words) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})

    sets = cut(texts.mapInPandas(shingle, "node string, shingles binary"))
    linked = components(shard_links(met, SIMILAR_RADIUS, SHARD, sets, threshold))
    linked = linked.select(F.col("node").alias("text_sha256"), "root", F.xxhash64("node").alias("s"))
    found = rows.select("doc_id", "text_sha256", F.xxhash64("text_sha256").alias("s")).join(linked, ["text_sha256", "s"], "left")
    return found.select("doc_id", "text_sha256", F.coalesce("root", "text_sha256").alias("root"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """The rows that stay, with all their columns: of each group of similar texts the row with the smallest doc_id, once."""
    groups = similar_groups(docs, id_col, text_col, words, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_sha256")).alias("first")
    kept = groups.groupBy("root").agg(first).select("first.doc_id", "first.text_sha256")
    return only(docs, kept, id_col, text_col)
