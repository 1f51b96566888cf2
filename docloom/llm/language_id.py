"""Language identification by cross-parsing entropy.

Per language, a suffix automaton holds a bounded sample of labelled text. A document is parsed against each automaton
into phrases, each the longest match that begins where the last one ended. A phrase costs log2 of the sample's length;
the language with the lowest cost wins (equal costs: the smaller name).

The sample is the only bounded thing: all labelled texts, however long, are cut into pieces of ``PIECE`` characters, and
pieces are picked by hash, so many per language that they hold about twice ``SAMPLE_CHARS`` letters and spaces, of which
``SAMPLE_CHARS`` are kept. A language with a letter in any of its texts is learnt. Whole texts are parsed, in segments
of ``SEGMENT`` symbols; a segment's end also ends a phrase, in every language alike.

The samples' most frequent letters have a symbol each. Any other letter is two symbols, one for its block of code points
and one for its place in it, both by residue, so scripts with thousands of letters are told apart as well.

Evidence is what the best language saves against noise, in bits: noise costs ``NOISE_BITS`` a symbol.

Defined results: null text and text without a letter give ``und`` with score 0, as does every text when nothing was
learnt. Rows with a null doc_id are never learnt from and not held out. Repeated rows are judged one by one; an empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

SAMPLE_CHARS, PIECE = 20_000, 1_000
SEGMENT = 1024
#: Symbols: 0 is a space (any run of non-letters), then come letters, blocks of other letters and places in a block.
SPACE, OWN, BLOCKS, PLACES, WIDTH = 0, 44, 8, 11, 64
NOISE_BITS = 6.0
BATCH_SYMBOLS, SLICE = 1_000_000, 256
UNKNOWN = "und"
#: A text counts as noise only where noise explains it better by so many bits: the odds before it is read.
PRIOR_BITS = 32.0
FOUND = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("evidence", DoubleType())])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    letters: str
    samples: tuple[bytes, ...]


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def symbol_tables(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Code point -> first and second symbol (0: none); a letter's cases share them."""
    first, second = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for start in range(0, 0x110000, 0x1000):
        if not 0xD800 <= start < 0xE000:
            points = np.arange(start, start + 0x1000)
            letter = np.array([chr(c).isalpha() for c in points])
            first[points] = letter * (1 + OWN + (points >> 8) % BLOCKS)
            second[points] = letter * (1 + OWN + BLOCKS + (points & 0xFF) % PLACES)
    for k, letter in enumerate(letters):
        for form in {letter, letter.upper(), letter.title()}:
            if len(form) == 1:
                first[ord(form)], second[ord(form)] = k + 1, 0
    return first, second


def symbols(text: str, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The text as symbols, with single spaces and none at its ends."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found, more = tables[0][points], tables[1][points]
    if more.any():
        found = np.stack([found, more], 1).ravel()[np.stack([np.ones(len(more), bool), more > 0], 1).ravel()]
    space = found == SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    found = found[keep]
    return found[: len(found) - bool(len(found) and found[-1] == SPACE)][bool(len(found) and found[0] == SPACE) :]


def suffix_automaton(sample: bytes) -> np.ndarray:
    """Transitions of the sample's suffix automaton as (state, symbol) -> state, -1 where there is none; the root is 0."""
    goes, link, length = [{}], [-1], [0]
    last = 0
    for c in sample:
        new = len(goes)
        goes.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(goes)
                goes.append(dict(goes[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.full((len(goes), WIDTH), -1, np.int32)
    for state, row in enumerate(goes):
        for c, to in row.items():
            table[state, c] = to
    return table


class Parser:
    """All languages' automata in one transition table, run in step over many segments at once."""

    def __init__(self, model: Model):
        tables = [suffix_automaton(s) for s in model.samples]
        self.roots = np.cumsum([0, *(len(t) for t in tables)])[:-1].astype(np.int32)[:, None]
        # In place and in 32 bits: copies on the way were several times as large as the table.
        for t, root in zip(tables, self.roots, strict=True):
            t[t >= 0] += root
        first = np.stack([t[0] for t in tables])
        self.first = np.where(first >= 0, first, self.roots)
        self.goes = np.concatenate(tables).ravel()
        self.cost = np.array([np.log2(len(s) + 1.0) for s in model.samples])
        self.tables = symbol_tables(model.letters)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(languages, texts) numbers of phrases."""
        owner, parts = [], []
        for k, t in enumerate(texts):
            for at in range(0, len(t), SEGMENT):
                owner.append(k)
                parts.append(t[at : at + SEGMENT])
        total = np.zeros((len(self.roots), len(texts)), np.int64)
        if not parts:
            return total
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        lengths, parts = lengths[order], [parts[i] for i in order]
        held = np.zeros((lengths[0], len(parts)), np.uint8)
        for k, p in enumerate(parts):
            held[: len(p), k] = p
        state = np.repeat(self.roots, len(parts), 1)
        count = np.ones(state.shape, np.int64)
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        for step, n in enumerate(active):
            c = held[step, :n].astype(np.int64)
            to = self.goes[state[:, :n] * WIDTH + c]
            miss = to < 0
            count[:, :n] += miss
            state[:, :n] = np.where(miss, self.first[:, c], to)
        for row, each in zip(total, count, strict=True):
            np.add.at(row, np.array(owner)[order], each)
        return total


_PARSERS: dict[Model, Parser] = {}


def parser_of(model: Model) -> Parser:
    """One parser per Python worker: only the samples travel, the automata are built where they run."""
    if model not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[model] = Parser(model)
    return _PARSERS[model]


def _letters(text: Column) -> Column:
    """The text's letters with single spaces for all else, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"\P{L}+", " "))


def train(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in ``lang_col`` over the rows for which ``learn`` holds (default: not held out)."""
    learn = ~held_out(F.col(id_col)) if learn is None else learn
    rows = docs.filter(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    told = rows.filter(F.col("text").rlike(r"\p{L}")).select("lang", _letters(F.col("text")).alias("said"), F.xxhash64("text").alias("text_hash"))
    # The grouping sorts its rows, so they hold the texts' beginnings and not the texts.
    told = told.select("lang", F.length("said").alias("size"), F.substring("said", 1, PIECE).alias("first"), "text_hash")
    known = {r["lang"]: r for r in told.groupBy("lang").agg(F.sum("size").alias("size"), F.min_by("first", "text_hash").alias("first")).collect()}
    if not known:
        return Model((), "", ())
    share = F.create_map(*[F.lit(x) for name, r in known.items() for x in (name, 2.0 * SAMPLE_CHARS / r["size"])])
    # Only the numbers of pieces are dealt out; texts are read again for those that are picked.
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    cut_texts = rows.filter(F.length("text") > 0).withColumn("text_hash", F.xxhash64("text")).withColumn("share", share[F.col("lang")])
    place = lambda k: F.pmod(F.xxhash64("doc_id", "text_hash", k), F.lit(1 << 30)) / float(1 << 30)
    picked = cut_texts.withColumn("piece", F.explode(F.filter(numbers, lambda k: place(k) < F.col("share"))))
    picked = picked.select("lang", place(F.col("piece")).alias("place"), "doc_id", "piece", _letters(F.substring(F.col("text"), F.col("piece") * PIECE + 1, F.lit(PIECE))).alias("text"))
    # Copies of a row have one place, so only one of them comes, and a language of nothing but copies may have none.
    sample = picked.filter("text <> ''").distinct().toPandas()
    missing = [{"lang": name, "place": 0.0, "doc_id": None, "piece": 0, "text": r["first"]} for name, r in known.items() if name not in set(sample["lang"])]
    sample = pd.concat([sample, pd.DataFrame(missing)], ignore_index=True) if missing else sample
    sample = sample.sort_values(["lang", "place", "doc_id", "piece", "text"])
    seen = pd.Series(list("".join(sample["text"]).lower())).value_counts()
    letters = "".join(sorted([c for c in seen.index if c.isalpha()][:OWN]))
    tables = symbol_tables(letters)
    samples = {}
    for name, own in sample.groupby("lang", sort=True):
        parts = [p for t in own["text"] if len(p := symbols(t, tables))]
        joined = b" ".join(p.tobytes() for p in parts).replace(b" ", b"\0")[:SAMPLE_CHARS]
        if joined:
            samples[name] = joined
    return Model(tuple(samples), letters, tuple(samples.values()))


def predict_column(text: Column, model: Model) -> Column:
    """lang_pred, score and evidence (bits saved against noise, 0 for ``und``) of a text, as a struct.

    It is called nondeterministic, which it isn't, so that a filter on it stays above it. Pushed below, the filter would
    judge every text a second time, by a second Python worker for each task.
    """

    @F.arrow_udf(FOUND)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = parser_of(model) if model.languages else None
        for batch in batches:
            parts, texts, held = [], [], 0
            for at in range(0, len(batch), SLICE):
                for text in batch.slice(at, SLICE).to_pylist():
                    texts.append(symbols(text, parser.tables) if parser and text is not None else np.zeros(0, np.uint8))
                    held += len(texts[-1])
                    if held >= BATCH_SYMBOLS:
                        parts.append(decide(parser, model, texts))
                        texts, held = [], 0
            parts.append(decide(parser, model, texts))
            found = pd.concat(parts, ignore_index=True)
            yield pa.StructArray.from_arrays([pa.array(found[c], t) for c, t in zip(found, (pa.string(), pa.float64(), pa.float64()), strict=True)], found.columns.tolist())

    return judge.asNondeterministic()(text)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, evidence."""
    found = predict_column(F.col(text_col).cast("string"), model).alias("found")
    return docs.select(F.col(id_col).alias("doc_id"), found).select("doc_id", "found.*")


def decide(parser: Parser | None, model: Model, texts: list[np.ndarray]) -> pd.DataFrame:
    n = len(texts)
    if parser is None or not n:
        return pd.DataFrame({"lang_pred": np.full(n, UNKNOWN, object), "score": np.zeros(n), "evidence": np.zeros(n)})
    sizes = np.array([len(t) for t in texts])
    phrases = parser.phrases(texts)
    costs = phrases * parser.cost[:, None]
    best = costs.argmin(0)
    score = 1 / np.exp(-np.minimum(costs - costs.min(0), 500)).sum(0)
    known = sizes > 0
    names = np.array(model.languages, object)[best]
    saved = NOISE_BITS * sizes - costs.min(0)
    return pd.DataFrame({"lang_pred": np.where(known, names, UNKNOWN), "score": np.where(known, score, 0.0), "evidence": np.where(known, saved, 0.0)})
