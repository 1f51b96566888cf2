"""Toxicity by noisy-channel deobfuscation.

A character language model (interpolated trigrams over all documents) and a channel (leetspeak, spacing, repetition)
span a lattice over the text; its Viterbi path is the restored text, which is scored. Where two characters in a row have
one reading only, the path's two halves don't depend on each other, as the model looks back two letters. So the lattice
falls into short segments between such places, and only these are searched. Of places with two readings (a blank or a
separator between letters, a doubled letter) that stand by themselves, arrays find those whose other reading is cheaper.
Segments of any length are decoded with a fixed lag, so memory doesn't grow with them.

What the path changes must hold as words. The ``MOST_WORDS`` most frequent words of all documents are known with their
counts; a token, or the tokens a segment spans, is changed only if the restored words are likelier than the written ones
by what the channel costs. Unknown words are equally unlikely, and then plain letters stay as they are written. Of a short
token all readings are weighed, not the path's alone. One apostrophe inside a word hides nothing.

The scorer is a logistic regression over words and word beginnings of four letters or more: at most ``MOST_FEATURES``, each in
``LEAST_TOXIC_DOCS`` toxic documents of the sample and ``LEAST_LIFT`` times as frequent in them as in others. It is fitted on a bounded sample, at most
``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` other labelled documents by hash of doc_id, none of them held out.

Defined results: null text is empty text and gets the score of a document without any feature, as does text without a
word. Of several labels for a doc_id the highest counts; rows with a null doc_id are never learnt from and not held out.
Without both labels to learn from, every score is 0. Repeated rows are scored one by one; an empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, product

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
#: The model's letters; 0 is a boundary, 63 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšž"
BOUNDARY, OTHER, WIDTH = 0, 63, 64
#: What a sign may stand for.
LEET = {
    "0": "ou", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c",
}
#: Signs that stand between letters and hide them, and signs that may stand for a letter at a word's edge.
SEPARATORS, AT_EDGE = ".-_*~,'/", "0123456789@$€£+"
#: Channel costs in nats: a sign for a letter, a sign in a word that is meant, a letter drawn out and doubled, and what is
#: put between letters: between single ones, between any of a token, and between words.
LEET_COST, KEPT_SIGN_COST, REPEAT_COST, DOUBLED_COST, SPACING_COST, SEPARATOR_COST, JOIN_COST = 1.0, 6.0, 0.7, 4.0, 0.2, 2.0, 6.0
KEPT_SPACE_COST = 4.0
#: A plain word counted so often, or of so few letters, is meant as it is written.
KNOWN_COUNT, SHORT_WORD = 5, 3
#: Columns after which a choice no longer changes.
LAG = 64
PREFIXES = (4, 5, 6)
#: Words known with their counts, at most; words counted together in a task before they are handed on; readings of a token that are weighed.
MOST_WORDS, WORDS_HELD, MOST_READINGS = 200_000, 200_000, 64
#: A token: what stands between white space, without punctuation at its edges. A word of plain letters, apostrophes and hyphens inside.
EDGES = ".,;:!?()[]{}\"'’“”«»<>-*_~/\\"
PLAIN_WORD = regex.compile(r"\p{L}+(?:['’\-]\p{L}+)*")
FEATURE_BITS = 22
MOST_FEATURES, LEAST_TOXIC_DOCS, LEAST_LIFT = 20_000, 4, 3.0
MEMO_CHARS, MOST_REMEMBERED, MEMO_WORDS = 4_000_000, 60, 200_000
BATCH_CHARS = 200_000

#: Letters and signs that stand alone, three at least; separators and what they separate have no character in common.
SPACED = regex.compile(r"(?<!\S)[\p{L}\p{N}@$](?:[\s.\-_*~,'/]{1,2}[\p{L}\p{N}@$]){2,}(?![^\s.,;:!?])")


def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for start in range(0, 0x110000, 0x1000):
        if not 0xD800 <= start < 0xE000:
            table[start : start + 0x1000] = [OTHER * chr(c).isalpha() for c in range(start, start + 0x1000)]
    for k, letter in enumerate(LETTERS):
        for form in {letter, letter.upper()}:
            if len(form) == 1:
                table[ord(form)] = k + 1
    return table


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, count over all texts: counted per partition, then summed. There are at most 64 ** 3 grams."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = symbol_table(), np.zeros(WIDTH**3, np.int64)
        held, size = [], 0

        def add() -> None:
            s = np.concatenate(held).astype(np.int32)
            total[:] += np.bincount((s[:-2] << 12) | (s[1:-1] << 6) | s[2:], minlength=WIDTH**3)

        edge = np.zeros(2, np.uint8)
        for batch in batches:
            for text in batch["text"]:
                if isinstance(text, str) and text:
                    held += [edge, table[codes(text)], edge]
                    size += len(text)
                    if size > 1_000_000:
                        add()
                        held, size = [], 0
        if held:
            add()
        grams = np.flatnonzero(total)
        yield pd.DataFrame({"gram": grams.astype(np.int32), "count": total[grams]})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "gram int, count long")
    return rows.groupBy("gram").agg(F.sum("count").alias("count"))


def word_counts(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """word, count of the most frequent words of plain letters over all texts, lower-cased: counted in tasks, summed, the first ``most`` by count and word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if isinstance(text, str):
                    held.update(token.strip(EDGES) for token in text.lower().split())
                    if len(held) > WORDS_HELD:
                        yield plain(held)
                        held = Counter()
        yield plain(held)

    def plain(held: Counter[str]) -> pd.DataFrame:
        own = [(w, n) for w, n in held.items() if len(w) <= MOST_REMEMBERED and PLAIN_WORD.fullmatch(w)]
        return pd.DataFrame(own, columns=["word", "count"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "word string, count long")
    counted = cut(rows.groupBy("word").agg(F.sum("count").alias("count")))
    # At most 64 lengths of counts in bits: below the length at which enough words are met, none is sorted.
    enough, least = 0, 1
    for r in counted.groupBy(F.length(F.bin("count")).alias("bits")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("bits")).collect():
        enough, least = enough + r["words"], 1 << (r["bits"] - 1)
        if enough >= most:
            break
    return counted.filter(F.col("count") >= least).orderBy(F.desc("count"), "word").limit(most)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Interpolated costs (negative log probabilities) of the third symbol after two others."""
    three = counts.reshape(WIDTH, WIDTH, WIDTH).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + WIDTH)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def lattice(stretch: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
    """Columns of (what is emitted, cost) in order; an empty emission drops the sign. ``spaced``: letters that stand alone."""
    at = 0
    while at < len(stretch):
        c, run = stretch[at], 1
        while at + run < len(stretch) and stretch[at + run] == c:
            run += 1
        if c.isalpha():
            if run > 2:
                yield [(c + c, REPEAT_COST), (c, REPEAT_COST + 0.5)]
            else:
                yield [(c * run, 0.0), (c, DOUBLED_COST)][:run]
        elif c in LEET:
            stands = [(x * n, LEET_COST * (1 if n == run else 2)) for x in LEET[c] for n in ((2, 1) if run > 1 else (1,))]
            yield [*stands, (c * run, KEPT_SIGN_COST)]
        elif spaced:
            yield [("", SPACING_COST), (" ", KEPT_SPACE_COST)]
        elif c in SEPARATORS or c in " \t":
            yield [(c * run, 0.0), ("", JOIN_COST if c.isspace() else SEPARATOR_COST)]
        else:
            yield [(c * run, 0.0)]
        at += run


def viterbi(columns: Iterable[list[tuple[str, float]]], model: np.ndarray, symbol: dict[str, int], start: tuple[int, int] = (0, 0), lag: int = LAG) -> str:
    """The emission of least channel and language-model cost; the state is the last two symbols. Equal costs: the first.

    Once two lags of columns are open, the best path fixes the older half.
    """
    states: dict[tuple[int, int], float] = {start: 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    out: list[str] = []

    def trace(state: tuple[int, int], steps: list) -> tuple[tuple[int, int], list[str]]:
        said = []
        for came in reversed(steps):
            state, emitted = came[state]
            said.append(emitted)
        return state, said[::-1]

    for column in columns:
        new: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), cost in states.items():
            for emitted, own in column:
                x, y, total = a, b, cost + own
                for letter in emitted:
                    z = symbol.get(letter) or (OTHER if letter.isalpha() else BOUNDARY)
                    total += float(model[x, y, z])
                    x, y = y, z
                if total < new.get((x, y), np.inf):
                    new[x, y], came[x, y] = total, ((a, b), emitted)
        states = new
        back.append(came)
        if len(back) >= 2 * lag:
            fixed = trace(min(states, key=states.get), back[lag:])[0]
            out += trace(fixed, back[:lag])[1]
            back = back[lag:]
            states = {s: cost for s, cost in states.items() if trace(s, back)[0] == fixed}
    last = min(states, key=lambda s: states[s] + float(model[s[0], s[1], BOUNDARY]))
    return "".join([*out, *trace(last, back)[1]])


class Restorer:
    """Restores texts under costs of letters (``model``) and counts of words; without counts the path alone decides."""

    def __init__(self, model: np.ndarray, counts: dict[str, int] | None = None):
        self.model, self.symbol, self.memo, self.size = model, {c: k + 1 for k, c in enumerate(LETTERS)}, {}, 0
        self.counts, self.total, self.held = counts, sum(counts.values()) + 1 if counts else 1, {}
        self.table = symbol_table()
        self.kinds = {}
        for name, signs in (("sign", LEET), ("separator", SEPARATORS), ("edge", AT_EDGE), ("blank", " \t")):
            self.kinds[name] = np.zeros(0x110000, bool)
            self.kinds[name][[ord(c) for c in signs]] = True
        self.space = np.zeros(0x110000, bool)
        self.space[[c for c in range(0x3001) if chr(c).isspace()]] = True

    def decoded(self, before: str, segment: str, after: str, spaced: bool = False) -> str:
        """The best reading of a segment between characters that have one reading only."""
        key = (before, segment, after, spaced)
        if key in self.memo:
            return self.memo[key]
        symbol = lambda c: self.symbol.get(c) or (OTHER if c.isalpha() else BOUNDARY)
        left = f"  {before}"[-2:]
        columns = chain(lattice(segment, spaced), ([(c, 0.0)] for c in after))
        found = viterbi(columns, self.model, self.symbol, (symbol(left[0]), symbol(left[1])))
        found = found[: len(found) - len(after)]
        if len(segment) <= MOST_REMEMBERED:
            self.size += 2 * len(segment) + 50
            if self.size > MEMO_CHARS:
                self.memo, self.size = {}, 0
            self.memo[key] = found
        return found

    def likely(self, text: str) -> float:
        """Log probability of a text's words; a word that isn't known has half a count."""
        return sum(float(np.log(self.counts.get(token.strip(EDGES), 0.5) / self.total)) for token in text.split())

    def chosen(self, written: str, restored: str) -> str:
        """The likelier of whole tokens as they are written and as they might be meant."""
        if self.counts is None or written == restored:
            return restored
        apart, meant = regex.split(r"(\s+)", written), restored.split()
        if len(apart) > 1 and len([token for token in apart if token and not token.isspace()]) == len(meant):
            own = iter(meant)
            return "".join(self.chosen(token, next(own)) if token and not token.isspace() else token for token in apart)
        if len(written) <= MOST_REMEMBERED and (written, restored) in self.held:
            return self.held[written, restored]
        own = self.likely(written)
        joined = len(written.split()) - len(restored.split())
        drawn = regex.search(r"(\p{L})\1\1", written) is not None
        plain = all(PLAIN_WORD.fullmatch(token.strip(EDGES)) or not token.strip(EDGES) for token in written.split()) and not drawn
        known = self.counts.get(written.strip(EDGES), 0) >= KNOWN_COUNT
        # Plain letters change only into words that are known, and short words and known ones not at all.
        core = written.strip(EDGES)
        stay = (np.inf if known or len(core) <= SHORT_WORD else DOUBLED_COST) if plain and not joined else 0.0
        meant = [token.strip(EDGES) for token in restored.split()]
        if plain and any(self.counts.get(word, 0) < KNOWN_COUNT for word in set(meant) - {token.strip(EDGES) for token in written.split()}):
            stay = np.inf
        cost = JOIN_COST * joined + stay
        options = [(own, 1 if plain else 0, written), (self.likely(restored) - cost, 0 if plain else 1, restored)]
        if not written.split()[1:] and 0 < len(core) <= MOST_REMEMBERED:
            columns = list(lattice(core, False))
            if np.prod([len(column) for column in columns], dtype=float) <= MOST_READINGS:
                at = written.index(core)
                for reading in product(*columns):
                    word = "".join(emitted for emitted, _ in reading)
                    if word in self.counts and word != core:
                        options.append((self.likely(word) - max(stay, sum(c for _, c in reading)), 2, written[:at] + word + written[at + len(core) :]))
        best = max(options, key=lambda o: o[:2])[2]
        if len(written) <= MOST_REMEMBERED:
            if len(self.held) > MEMO_WORDS:
                self.held = {}
            self.held[written, restored] = best
        return best

    def spaced(self, c: np.ndarray) -> np.ndarray:
        """Places of letters or signs that stand alone, three of them within reach of each other."""
        part = (self.table[c] > 0) | self.kinds["sign"][c] & (c != ord("!"))
        alone = part.copy()
        alone[1:] &= ~part[:-1]
        alone[:-1] &= ~part[1:]
        at = np.flatnonzero(alone)
        return at[2:][at[2:] - at[:-2] <= 6]

    def segments(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of what has several readings, with two characters of one reading at least between them."""
        sym = np.concatenate([[0, 0], self.table[c], [0, 0, 0]])
        n, m = len(c), self.model
        letter, space = sym[2:-3] > 0, self.space[c]
        begins, ends, certain, apart = [], [], [], []

        def add(b: np.ndarray, e: np.ndarray, sure: np.ndarray, separates: bool) -> None:
            begins.append(b)
            ends.append(e)
            certain.append(sure)
            apart.append(np.full(len(b), separates))

        # Other signs inside and at the edges of words.
        other = np.concatenate([[False], ~letter & ~space, [False]])
        b, e = np.flatnonzero(other[1:] & ~other[:-1]), np.flatnonzero(other[:-1] & ~other[1:])
        count = {k: np.concatenate([[0], np.cumsum(self.kinds[k][c])]) for k in ("sign", "separator", "edge")}
        held = {k: v[e] - v[b] for k, v in count.items()}
        left, right = sym[b + 1] > 0, sym[e + 2] > 0
        inner = left & right & (held["sign"] + held["separator"] > 0)
        edge = (left ^ right) & (held["edge"] == e - b) & (e - b <= 2)
        plain = inner & (held["sign"] == 0) & (e - b == 1)
        # An apostrophe without another separator two places on is part of its word.
        lone = plain & np.isin(c[np.minimum(b, n - 1)], [ord("'"), ord("’")])
        beside = np.zeros(len(b), bool)
        beside[1:] |= b[1:] - e[:-1] <= 2
        beside[:-1] |= b[1:] - e[:-1] <= 2
        inner &= ~lone | beside
        b, e, plain = b[inner | edge], e[inner | edge], plain[inner | edge]
        add(b, e, ~plain | self._cheaper(sym, b, e, SEPARATOR_COST), True)
        # One blank between words.
        b = np.flatnonzero(self.kinds["blank"][c])
        b = b[(sym[b + 1] > 0) & (sym[b + 3] > 0)]
        add(b, b + 1, self._cheaper(sym, b, b + 1, JOIN_COST), True)
        # Letters that are repeated.
        same = np.concatenate([[False], (c[1:] == c[:-1]) & letter[1:], [False]])
        b, e = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:]) + 1
        x, y, z = sym[b + 1], sym[b + 2], sym[e + 2]
        add(b, e, (e - b > 2) | (m[x, y, y] + m[y, y, z] > m[x, y, z] + DOUBLED_COST), False)

        begin, end, sure, separates = map(np.concatenate, (begins, ends, certain, apart))
        order = np.argsort(begin, kind="stable")
        begin, end, sure, separates = begin[order], end[order], sure[order], separates[order]
        # A doubtful place counts if it stands by a certain one, or by another that separates as it does.
        while True:
            near = begin[1:] - end[:-1] < 2
            take = sure.copy()
            take[1:] |= near & (sure[:-1] | separates[:-1] & separates[1:])
            take[:-1] |= near & (sure[1:] | separates[1:] & separates[:-1])
            if (take == sure).all():
                break
            sure = take
        begin, end = begin[sure], end[sure]
        new = np.concatenate([[True], begin[1:] - end[:-1] >= 2]) if len(begin) else np.zeros(0, bool)
        return begin[new], end[np.concatenate([new[1:], [True]])] if len(begin) else end

    def _cheaper(self, sym: np.ndarray, b: np.ndarray, e: np.ndarray, cost: float) -> np.ndarray:
        """Whether the model would rather have the letters around [b, e) joined."""
        m, x, y, z, w = self.model, sym[b], sym[b + 1], sym[e + 2], sym[e + 3]
        return m[x, y, BOUNDARY] + m[y, BOUNDARY, z] + m[BOUNDARY, z, w] > m[x, y, z] + m[y, z, w] + cost

    def texts(self, texts: list[str]) -> list[str]:
        """Lower-cased texts, restored; arrays run over all of them at once."""
        texts = [t.lower() for t in texts]
        for at in np.unique(np.searchsorted(_bounds(texts), self.spaced(_joined(texts)), "right") - 1).tolist():
            texts[at] = SPACED.sub(lambda m: self.decoded("", m[0], "", True), texts[at])
        bounds = _bounds(texts)
        begin, end = self.segments(_joined(texts))
        owner = np.searchsorted(bounds, begin, "right") - 1
        begin, end, owner = (begin - bounds[owner]).tolist(), (end - bounds[owner]).tolist(), owner.tolist()
        pieces, done = {k: [] for k in set(owner)}, dict.fromkeys(owner, 0)
        at, size = 0, len(begin)
        while at < size:
            # All segments of one token are weighed together, between its white space.
            k, text, b, e = owner[at], texts[owner[at]], begin[at], end[at]
            first, last = b - len(regex.search(r"\S*$", text[max(b - MOST_REMEMBERED, 0) : b])[0]), at
            restored = [text[first:b]]
            while True:
                restored.append(self.decoded(text[max(begin[last] - 2, 0) : begin[last]], text[begin[last] : end[last]], text[end[last] : end[last] + 2]))
                e = end[last]
                rest = regex.match(r"\S*", text[e : e + MOST_REMEMBERED])[0]
                if last + 1 < size and owner[last + 1] == k and begin[last + 1] < e + len(rest):
                    restored.append(text[e : begin[last + 1]])
                    last += 1
                else:
                    break
            first = max(first, done[k])
            restored[0] = text[first:b]
            pieces[k] += [text[done[k] : first], self.chosen(text[first : e + len(rest)], "".join([*restored, rest]))]
            done[k], at = e + len(rest), last + 1
        for k, own in pieces.items():
            texts[k] = "".join([*own, texts[k][done[k] :]])
        return texts

    def text(self, text: str) -> str:
        return self.texts([text])[0]

    def words(self, texts: list[str]) -> Iterator[Counter[str]]:
        """The runs of letters of each restored text."""
        held, size = [], 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size > BATCH_CHARS or k == len(texts) - 1:
                for restored in self.texts(held):
                    c = codes(restored)
                    yield Counter(np.where(self.table[c] > 0, c, np.uint32(32)).tobytes().decode("utf-32-le").split())
                held, size = [], 0


#: Two characters of one reading keep texts apart.
_BETWEEN = "\n\n"


def _joined(texts: list[str]) -> np.ndarray:
    return codes(_BETWEEN.join(texts))


def _bounds(texts: list[str]) -> np.ndarray:
    """Where each text begins among the joined ones."""
    return np.concatenate([[0], np.cumsum([len(t) + len(_BETWEEN) for t in texts])])[:-1]


def features_of(word: str) -> list[int]:
    """Hashes of the whole word and of its beginnings."""
    names = [f"{word}$", *(f"{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(x) >> (32 - FEATURE_BITS) for x in names]


@dataclass(frozen=True)
class Model:
    costs: bytes
    counts: dict[str, int]
    index: dict[int, int]
    weights: np.ndarray
    bias: float
    length_weight: float
    fitted: bool


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _restorer(costs: bytes, counts: dict[str, int]) -> Restorer:
    return Restorer(np.frombuffer(costs, np.float32).reshape(WIDTH, WIDTH, WIDTH), counts)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels (doc_id, label 0 or 1); ``learn`` is a condition on the labels' doc_id (default: not held out)."""
    spark = docs.sparkSession
    total = np.zeros(WIDTH**3, np.int64)
    grams = trigram_counts(docs, text_col).toPandas()
    total[grams["gram"]] = grams["count"]
    costs = language_model(total).tobytes()
    known_words = word_counts(docs, text_col).toPandas()
    counts = dict(zip(known_words["word"], known_words["count"].astype(int).tolist(), strict=True))

    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    known = labels.select(F.col("doc_id"), F.col(label_col).alias("toxic")).filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.filter("toxic > 0").orderBy(*order).limit(SAMPLE_TOXIC)
    clean = known.filter("toxic <= 0").orderBy(*order).limit(SAMPLE_CLEAN)
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids.
    picked = F.broadcast(toxic.unionByName(clean).withColumnRenamed("doc_id", "__id"))
    sample = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).join(picked, F.col("__doc") == F.col("__id")).select("text", "toxic")
    # Costs of at most 64 ** 3 grams and MOST_WORDS words.
    shared = spark.sparkContext.broadcast((costs, counts))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = _restorer(*shared.value)
        for batch in batches:
            rows = []
            for words in restorer.words([text or "" for text in batch["text"]]):
                found: Counter[int] = Counter()
                for word, n in words.items():
                    for f in features_of(word):
                        found[f] += n
                rows.append((list(found), list(found.values()), sum(words.values())))
            yield pd.DataFrame(rows, columns=["features", "counts", "words"]).assign(toxic=(batch["toxic"] > 0).astype("int32").to_numpy())

    seen = cut(sample.mapInPandas(read, "features array<int>, counts array<int>, words long, toxic int"))
    sizes = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    empty = Model(costs, counts, {}, np.zeros(0), -40.0, 0.0, False)
    if len(sizes) < 2:
        return empty

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Document frequencies of a partition's features, pre-aggregated."""
        total = np.zeros((2, 1 << FEATURE_BITS), np.int32)
        for batch in batches:
            for features, toxic in zip(batch["features"], batch["toxic"], strict=True):
                total[toxic, features] += 1
        own = np.flatnonzero(total[1])
        yield pd.DataFrame({"feature": own.astype(np.int32), "clean": total[0][own], "toxic": total[1][own]})
        rest = np.flatnonzero((total[1] == 0) & (total[0] > 0))
        yield pd.DataFrame({"feature": rest.astype(np.int32), "clean": total[0][rest], "toxic": total[1][rest]})

    spread = seen.select("features", "toxic").mapInPandas(per_partition, "feature int, clean int, toxic int")
    spread = spread.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") / sizes[1]) / ((F.col("clean") + 0.5) / sizes[0])
    chosen = spread.filter((F.col("toxic") >= LEAST_TOXIC_DOCS) & (lift >= LEAST_LIFT)).orderBy(F.desc(F.log(lift) * F.col("toxic")), "feature").limit(MOST_FEATURES)
    names = sorted(r["feature"] for r in chosen.collect())
    index = {f: k for k, f in enumerate(names)}
    wanted = spark.sparkContext.broadcast(np.array(names, np.int32))

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [np.isin(f, wanted.value) for f in batch["features"]]
            yield pd.DataFrame({
                "features": [np.asarray(f)[k].tolist() for f, k in zip(batch["features"], keep, strict=True)],
                "counts": [np.asarray(c)[k].tolist() for c, k in zip(batch["counts"], keep, strict=True)], "words": batch["words"], "toxic": batch["toxic"],
            })

    # The bounded sample, with its few chosen features only.
    rows = seen.mapInPandas(narrow, seen.schema).toPandas()
    rows = rows.assign(key=[str((t, w, sorted(f))) for f, w, t in zip(rows["features"], rows["words"], rows["toxic"], strict=True)]).sort_values("key", kind="stable")
    weights, bias, length_weight = fit(rows, index)
    return Model(costs, counts, index, weights, bias, length_weight, True)


def fit(rows: pd.DataFrame, index: dict[int, int], steps: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Logistic regression by Adam; a feature's value is log(1 + count), and log(1 + words) stands for the length."""
    doc = np.repeat(np.arange(len(rows)), [len(f) for f in rows["features"]])
    column = np.array([index[f] for fs in rows["features"] for f in fs], np.int64)
    value = np.log1p(np.array([c for cs in rows["counts"] for c in cs], float))
    length, label = np.log1p(rows["words"].to_numpy(float)), rows["toxic"].to_numpy(float)
    theta, m, v = np.zeros(len(index) + 2), np.zeros(len(index) + 2), np.zeros(len(index) + 2)
    for step in range(1, steps + 1):
        z = np.bincount(doc, theta[column] * value, len(rows)) + theta[-2] + theta[-1] * length
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / len(rows)
        gradient = np.concatenate([np.bincount(column, error[doc] * value, len(index)) + penalty * theta[:-2] / 10, [error.sum(), error @ length]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        restorer, memo = _restorer(model.costs, model.counts), {}
        for batch in batches:
            scores = np.zeros(len(batch))
            for k, words in enumerate(restorer.words([text or "" for text in batch["text"]])):
                found: Counter[int] = Counter()
                for word, n in words.items():
                    own = memo.get(word)
                    if own is None:
                        own = tuple(model.index[f] for f in features_of(word) if f in model.index)
                        if len(word) <= MOST_REMEMBERED:
                            memo[word] = own
                    for f in own:
                        found[f] += n
                if len(memo) > MEMO_WORDS:
                    memo = {}
                z = model.bias + model.length_weight * np.log1p(sum(words.values()))
                z += sum(model.weights[f] * np.log1p(n) for f, n in found.items())
                scores[k] = 1 / (1 + np.exp(-np.clip(z, -40, 40))) if model.fitted else 0.0
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "predicted": (scores >= 0.5).astype("int32")})

    return rows.mapInPandas(run, f"doc_id {id_type}, score double, predicted int")
