"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of one chunk is pre-tokenised where it lies. A longer text is cut into chunks that overlap; the chunks are
pre-tokenised in parallel and stitched: from the first place in the overlap where both neighbours begin a pre-token on,
the later chunk's pre-tokens are the text's own, as a pre-token depends only on what follows its begin. If the overlap
holds no such place, chunks are joined from the last certain place on and read again whenever what is open has doubled, so
even a text of one pre-token is read a few times only. The stitched pieces are then encoded in parallel. Decoding joins
the raw bytes of the ids.

Long texts are handled by their SHA-256, once however often they occur, so no row number is needed that a lost executor
could change.

Defined results: null text is empty text, which has no ids. Repeated rows are encoded one by one (long ones once). An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CHUNK, OVERLAP = 32_768, 512
#: What follows a pre-token's end may change it that far on: a quote and two letters of a contraction.
LOOKAHEAD = 4
SLICE = 256


class Vocabulary:
    """Ranks from a file that every worker can open, or that was sent with ``SparkContext.addFile``."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def __reduce__(self):
        return Vocabulary, (self.path, self.pattern)

    def key(self) -> tuple[str, str]:
        return self.path, self.pattern

    def load(self) -> Coder:
        if self.key() not in _CODERS:
            _CODERS.clear()
            _CODERS[self.key()] = Coder(self)
        return _CODERS[self.key()]


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        try:
            lines = open(vocabulary.path, "rb")
        except FileNotFoundError:
            lines = open(SparkFiles.get(vocabulary.path.rsplit("/", 1)[-1]), "rb")
        with lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # White_Space as Unicode has it, whatever this module's \s takes in.
        self.split = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.pattern = vocabulary.pattern

    @cached_property
    def engine(self) -> tiktoken.Encoding:
        """Only workers that encode or decode need it."""
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.array(self.engine.encode_ordinary(text), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return self.engine.decode_bytes(np.frombuffer(ids, "<u4").tolist())

    def begins(self, text: str, last: bool, start: int = 0) -> np.ndarray:
        """Where pre-tokens begin from ``start`` on; not beyond the first one that the text's end might have cut."""
        found = []
        for m in self.split.finditer(text, start):
            found.append(m.start())
            if not last and m.end() + LOOKAHEAD > len(text):
                break
        return np.array(found, np.int64)


_CODERS: dict[tuple[str, str], Coder] = {}


def over_text(vocabulary: Vocabulary, work: Callable[[Coder, str], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that replaces the last column by ``ids``; only a slice of a batch becomes Python objects at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.load()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                own = batch.slice(at, SLICE)
                ids = pa.array([work(coder, x) for x in own.column(own.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], ids], [*own.schema.names[:-1], "ids"])

    return run


def stitch(vocabulary: Vocabulary) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of one long text: chunks (chunk, start, text, begins) -> pieces (key, piece, text) that begin and end with pre-tokens."""

    def run(chunks: pd.DataFrame) -> pd.DataFrame:
        coder = vocabulary.load()
        rows = chunks.sort_values("chunk").to_dict("records")
        text, start, begins = rows[0]["text"], 0, np.frombuffer(rows[0]["begins"], np.int32).astype(np.int64)
        certain, pieces = 0, []
        pending, end = [], len(text)
        for k, row in enumerate(rows[1:], 1):
            if not pending:
                theirs = np.frombuffer(row["begins"], np.int32) + np.int64(row["start"])
                both = np.intersect1d(begins + start, theirs, assume_unique=True)
                both = both[both >= certain]
                if len(both):
                    pieces.append(text[certain - start : both[0] - start])
                    text, start, begins, certain = row["text"], row["start"], theirs - row["start"], int(both[0])
                    end = start + len(text)
                    continue
            pending.append(row["text"][end - row["start"] :])
            end = row["start"] + len(row["text"])
            known, last = start + len(text) - certain, k == len(rows) - 1
            if last or end - certain >= 2 * known:
                begins = begins[begins >= certain - start] - (certain - start)
                text, start, pending = "".join([text[certain - start :], *pending]), certain, []
                resume = int(begins[-1]) if len(begins) else 0
                begins = np.concatenate([begins[:-1], coder.begins(text, last, resume)])
        pieces.append(text[certain - start :])
        return pd.DataFrame({"key": rows[0]["key"], "piece": np.arange(len(pieces)), "text": pieces})

    return run


#: A mapInArrow function and its schema.
Step = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, then: Step | None = None) -> DataFrame:
    """One row per document: doc_id, ids (binary, little-endian unsigned 32-bit); or what ``then`` makes of them, by the workers that encode short texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    plain = over_text(vocabulary, lambda coder, text: coder.encode(text))
    is_long = F.length("text") > chunk
    step, schema = then or (lambda batches: batches, f"doc_id {id_type}, ids binary")
    short = rows.filter(~is_long).mapInArrow(lambda batches: step(plain(batches)), schema)

    keyed = rows.filter(is_long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))
    parts = keyed.select("key", F.length("text").alias("size"), F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(F.col("text"), s + 1, F.lit(chunk + overlap)).alias("text")))).alias("chunk", "part"))
    parts = parts.select("key", "chunk", "part.start", "part.text", (F.col("part.start") + chunk + overlap >= F.col("size")).alias("last")).dropDuplicates(["key", "chunk"])

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = vocabulary.load()
        for batch in batches:
            found = []
            for text, last in zip(batch["text"], batch["last"], strict=True):
                # Only begins that a neighbour may share, and the last one.
                begins = coder.begins(text, last)
                keep = (begins <= overlap) | (begins >= chunk)
                keep[-1:] = True
                found.append(begins[keep].astype(np.int32).tobytes())
            yield batch.drop(columns="last").assign(begins=found)

    read = parts.mapInPandas(pretokenise, "key string, chunk int, start int, text string, begins binary")
    pieces = read.groupBy("key").applyInPandas(stitch(vocabulary), "key string, piece int, text string")
    coded = pieces.repartition("key", "piece").mapInArrow(plain, "key string, piece int, ids binary")
    whole = coded.groupBy("key").agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY piece)").alias("ids"))
    whole = whole.select("key", F.xxhash64("key").alias("spread"), "ids")
    # Two keys: the ids lie by text, so both sides are exchanged and the copies of one long text can be split.
    long = keyed.select("doc_id", "key", F.xxhash64("key").alias("spread")).join(whole, ["key", "spread"]).select("doc_id", "ids")
    return short.unionByName(long.mapInArrow(*then) if then else long)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The raw bytes of the ids."""

    @F.arrow_udf(BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = vocabulary.load()
        for batch in batches:
            parts = [pa.array([None if x is None else coder.decode(x) for x in batch.slice(at, SLICE).to_pylist()], pa.binary()) for at in range(0, len(batch), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return run(ids)
