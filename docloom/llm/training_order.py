"""Training-order materialisation: token ids in binary shards, in a keyed global order.

Documents are rows of token ids, as an encoder gives them; they become sequences of at most ``LENGTH`` ids. Every
sequence has a number from 0 on, and a keyed Feistel permutation with cycle-walking gives it a global slot. Range
partitions of slots are written as shards of fixed-stride records, so that a reader finds slot s at
``(s - first slot) * STRIDE`` of its shard and can go on from any slot.

A record is the doc_id (64 bits), the sequence's place in its document (32), the number of ids (32), then the ids as
unsigned numbers of ``width`` bytes, padded with zeros. Numbers are little-endian. A null doc_id is written as the
smallest 64-bit number.

Sequences are numbered by content: documents in the order of a hash of doc_id and ids, so the order doesn't depend on how
the input is split. The packed documents are written to the shared folder once, some together in a block; only their
hashes and sizes are sorted, by ranges of the hash, and of ranges only the counts meet. Each document's first number is
written to a table, parted as the documents are, where the task that has the document reads it. So ids move once, to
their shards, and a task that runs again reads the same rows. A shard is written under a passing name and then renamed,
so tasks may run again, or twice at a time.

The shards are written in ``WAVES`` waves of slots that follow each other. Each reads the packed documents, sends what
belongs to its own shards, unpadded, and drops its shuffle when they are written, as the encoder's was dropped when the
documents were. So the disk holds one wave's shuffle beside the documents and the shards.

Defined results: null and empty ids have no sequence; rows that repeat are written each; an id too large for the width is
an error; an empty table gives no shard. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.bpe import Step
from docloom.session import cut_and_free, shared_folder

LENGTH, SHARD_RECORDS, ROUNDS, WAVES = 512, 16_384, 6, 3
NO_ID = -(1 << 63)
#: A task packs as many bytes of ids for the shards at a time. Documents share a block up to so many, or so many bytes.
PACKED_BYTES, SLICE, SLICE_BYTES = 16_000_000, 256, 4_000_000


def record_type(length: int, width: int = 4) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n_tokens", "<i4"), ("tokens", f"<u{width}", (length,))])


def content_order(doc_id: int | None, ids: bytes) -> int:
    """63 bits by which documents are ordered before they are numbered."""
    return xxhash.xxh64_intdigest(f"{doc_id}:".encode() + ids) >> 1


class Permutation:
    """A keyed bijection of [0, size)."""

    def __init__(self, size: int, key: str, rounds: int = ROUNDS):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in self.keys:
            z = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return (left << half) | right

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        """Walks on along the cycle from any value outside until one lies inside."""
        x = self._once(np.asarray(numbers, np.uint64))
        while (outside := x >= self.size).any():
            x[outside] = self._once(x[outside])
        return x.astype(np.int64)


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark resolves it, so that executors open the same file system."""
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/where")
    path = spark.read.parquet(f"{folder}/where").select("_metadata.file_path").first()[0].rsplit("/where/", 1)[0]
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def _numbers(folder: str, part: int) -> np.ndarray:
    """The first numbers of a partition's documents, in the order of its rows."""
    fs, base = pafs.FileSystem.from_uri(f"{folder}/part={part}")
    files = [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet")]
    found = pa.concat_tables([pq.read_table(f.path, filesystem=fs, columns=["row", "first"], partitioning=None) for f in files])
    out = np.zeros(len(found), np.int64)
    out[found["row"].to_numpy()] = found["first"].to_numpy()
    return out


def packing(width: int = 4) -> Step:
    """doc_id (long), ids -> documents packed together: the task, the first one's place in it, of each its order, id and size, and a block of all ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=6).compress
        part, row = TaskContext.get().partitionId(), 0

        def packed(doc_ids: list[int | None], held: list[bytes]) -> pa.RecordBatch:
            wide = np.frombuffer(b"".join(held), "<u4")
            if int(wide.max()) >> (8 * width):
                raise ValueError("an id is too large for the width")
            order = [content_order(d, ids) for d, ids in zip(doc_ids, held, strict=True)]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "row": pa.array([row], pa.int64()), "places": pa.array([order], pa.list_(pa.int64())),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "sizes": pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64())),
                "block": pa.array([compress(wide.astype(f"<u{width}").tobytes())], pa.binary()),
            })

        doc_ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], batch["ids"], strict=True):
                if not (own := ids.as_py()):
                    continue
                doc_ids.append(doc_id.as_py())
                held.append(own)
                size += len(own)
                if len(held) == SLICE or size > SLICE_BYTES:
                    yield packed(doc_ids, held)
                    row += len(held)
                    doc_ids, held, size = [], [], 0
        if held:
            yield packed(doc_ids, held)

    return pack, "part int, row long, places array<long>, doc_ids array<long>, sizes array<long>, block binary"


def materialise(docs: DataFrame, key: str = "order-1", id_col: str = "doc_id", ids_col: str = "ids", folder: str | None = None, length: int = LENGTH, shard_records: int = SHARD_RECORDS, width: int = 4) -> DataFrame:
    """docs (doc_id, ids as little-endian unsigned 32-bit numbers): writes the shards and returns their manifest: shard, path, first_slot, records, length, width."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return materialise_packed(rows.mapInArrow(*packing(width)), key, folder, length, shard_records, width)


def materialise_packed(packed: DataFrame, key: str = "order-1", folder: str | None = None, length: int = LENGTH, shard_records: int = SHARD_RECORDS, width: int = 4) -> DataFrame:
    """``materialise`` of what ``packing`` has made; the packing may so share a worker with the encoder."""
    spark = packed.sparkSession
    folder = _qualified(spark, folder or f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}")
    dealt = cut_and_free(packed)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = dealt.select("part", F.col("row").alias("begin"), F.posexplode(F.arrays_zip(F.col("places").alias("place"), F.col("doc_ids").alias("doc_id"), F.col("sizes").alias("size"))).alias("k", "doc"))
    keys = each.select("part", (F.col("begin") + F.col("k")).alias("row"), "doc.*").select("part", "row", "place", "doc_id", F.ceil(F.col("size") / length).cast("long").alias("n"), F.shiftright(F.shiftright("place", 31) * ranges, 32).cast("int").alias("range"))
    # One row per range of the hash.
    counted = {r["range"]: r["n"] for r in keys.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    begins = np.cumsum([0, *(counted.get(k, 0) for k in range(ranges))]).tolist()
    total = begins[-1]
    shape = "shard int, path string, first_slot long, records long, length int, width int"
    if not total:
        return spark.createDataFrame([], shape)
    before = Window.partitionBy("range").orderBy("place", "doc_id", "part", "row").rowsBetween(Window.unboundedPreceding, 0)
    first = F.element_at(F.lit(begins[:ranges]), F.col("range") + 1) + F.sum("n").over(before) - F.col("n")
    numbers_at = f"{folder}/numbers"
    keys.select("part", "row", first.alias("first")).repartition("part").write.partitionBy("part").parquet(numbers_at)
    shards = -(-total // shard_records)
    order = Permutation(total, key)

    kind = record_type(length, width)
    heads, ids_type = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("seq", "<i4"), ("n_tokens", "<i4")]), np.dtype(f"<u{width}")

    def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of runs that follow each other."""
        return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def number(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Sequences of the shards from ``low`` to below ``high``, packed by shard, a bounded number of bytes at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack, compress = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress

            def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
                head, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                n = head["n_tokens"].astype(np.int64)
                begins = np.cumsum(n) - n
                place = np.argsort(head["slot"])
                head = head[place]
                shard = head["slot"] // shard_records
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(head)]])
                blocks = [compress(head[a:b].tobytes() + ids[runs(begins[place[a:b]], n[place[a:b]])].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                return pa.RecordBatch.from_pydict({"shard": pa.array(shard[bounds[:-1]], pa.int32()), "records": pa.array(np.diff(bounds), pa.int32()), "block": pa.array(blocks, pa.binary())})

            held, size, first, known = [], 0, None, None
            for batch in batches:
                for k in range(batch.num_rows):
                    part, row = batch["part"][k].as_py(), batch["row"][k].as_py()
                    if part != known:
                        first, known = _numbers(numbers_at, part), part
                    sizes = batch["sizes"][k].values.to_numpy()
                    n = -(-sizes // length)
                    seq = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    slots = order(np.repeat(first[row : row + len(sizes)], n) + seq)
                    own = (slots >= low * shard_records) & (slots < high * shard_records)
                    head = np.empty(int(own.sum()), heads)
                    head["slot"], head["seq"] = slots[own], seq[own]
                    head["doc_id"] = np.repeat(batch["doc_ids"][k].values.fill_null(NO_ID).to_numpy(), n)[own]
                    head["n_tokens"] = np.minimum(np.repeat(sizes, n) - seq * length, length)[own]
                    begins = (np.repeat(np.cumsum(sizes) - sizes, n) + seq * length)[own]
                    ids = np.frombuffer(unpack(batch["block"][k].as_buffer()), ids_type)[runs(begins, head["n_tokens"].astype(np.int64))]
                    if len(head):
                        held.append((head, ids))
                        size += head.nbytes + ids.nbytes
                    if size > PACKED_BYTES:
                        yield sent(held)
                        held, size = [], 0
            if held:
                yield sent(held)

        return run

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's blocks come one after the other; a shard is all that is held."""
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        unpack = zstandard.ZstdDecompressor().decompress

        def store(shard: int, records: np.ndarray, filled: int) -> pa.RecordBatch:
            if filled != len(records):
                raise ValueError(f"shard {shard} has {filled} of {len(records)} records")
            passing = f"{base}/passing-{shard}-{uuid.uuid4().hex}"
            with fs.open_output_stream(passing) as stream:
                stream.write(memoryview(records).cast("B"))
            fs.move(passing, f"{base}/shard-{shard:08d}.bin")
            row = {"shard": shard, "path": f"{folder}/shard-{shard:08d}.bin", "first_slot": shard * shard_records, "records": len(records), "length": length, "width": width}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_slot", pa.int64()), ("records", pa.int64()), ("length", pa.int32()), ("width", pa.int32())]))

        shard, records, filled = -1, None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                own, size, data = batch["shard"][k].as_py(), batch["records"][k].as_py(), unpack(batch["block"][k].as_buffer())
                if own != shard:
                    if records is not None:
                        yield store(shard, records, filled)
                    shard, filled = own, 0
                    records = np.zeros(min(shard_records, total - shard * shard_records), kind)
                head = np.frombuffer(data, heads, size)
                made = np.zeros(size, kind)
                made["doc_id"], made["seq"], made["n_tokens"] = head["doc_id"], head["seq"], head["n_tokens"]
                made["tokens"][np.arange(length) < head["n_tokens"][:, None]] = np.frombuffer(data, ids_type, offset=size * heads.itemsize)
                records[head["slot"] - shard * shard_records] = made
                filled += size
        if records is not None:
            yield store(shard, records, filled)

    waves, manifest = min(WAVES, shards), None
    for wave in range(waves):
        low, high = shards * wave // waves, shards * (wave + 1) // waves
        tasks = min(high - low, 20_000)
        numbered = dealt.mapInArrow(number(low, high), "shard int, records int, block binary")
        by_shard = numbered.repartitionById(tasks, F.floor((F.col("shard").cast("long") - low) * tasks / (high - low)).cast("int")).sortWithinPartitions("shard")
        written = cut_and_free(by_shard.mapInArrow(write, shape))
        manifest = written if manifest is None else manifest.unionByName(written)
    return manifest


def read(manifest: DataFrame, from_slot: int = 0) -> DataFrame:
    """Records from a slot on: slot, shard, byte_offset, doc_id, seq, n_tokens, tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in batch.itertuples(index=False):
                kind = record_type(m.length, m.width)
                fs, path = pafs.FileSystem.from_uri(m.path)
                with fs.open_input_file(path) as file:
                    for at in range(max(0, from_slot - m.first_slot), m.records, 4096):
                        n = min(4096, m.records - at)
                        found = np.frombuffer(file.read_at(n * kind.itemsize, at * kind.itemsize), kind)
                        yield pd.DataFrame({
                            "slot": m.first_slot + at + np.arange(n), "shard": m.shard, "byte_offset": (at + np.arange(n)) * kind.itemsize,
                            "doc_id": pd.Series(found["doc_id"], dtype="Int64").mask(found["doc_id"] == NO_ID),
                            "seq": found["seq"], "n_tokens": found["n_tokens"], "tokens": [t[:k].tobytes() for t, k in zip(found["tokens"], found["n_tokens"], strict=True)],
                        })

    wanted = manifest.filter(F.col("first_slot") + F.col("records") > from_slot)
    return wanted.mapInPandas(run, "slot long, shard int, byte_offset long, doc_id long, seq int, n_tokens int, tokens binary")
