"""Toxicity of texts whose words may be disguised.

Noisy channel: the writer meant letters, the channel replaced them by look-alikes (leetspeak), repeated them or put spaces and
marks between them. Each observed character of a suspicious token is a set of arcs in a lattice (letters it may stand for, nothing, or a word
boundary); Viterbi decoding under a trigram model of characters picks the most likely reading. Restored words are then scored by
what labelled documents show for words and word beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, give_back, lookup, prepared, remainder, stage

by_value(__name__)

# Letters that a digit or sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}

# Symbols of the character model: 0 is the word boundary, then the lower-case letters of Latin-1.
ALPHABET = "\0abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SIZE = 64
# Log probabilities of the channel.
AS_IS, LOOKALIKE, REPEATED, DROPPED, BROKEN, LOST = -0.05, -1.2, -1.2, -1.0, -2.5, -9.0
BEAM = 48
KEEP_WORDS = 250_000
KEEP_SCORES = 400_000

MARK = re.compile(r"[^\W_]")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
# Within a token: a doubled letter, or something else than letters between them.
RUN = re.compile(r"([^\W\d_])\1")
LETTERS = re.compile(r"^[^\W\d_]+$")
# Three or more single characters, marks attached or not, with white space between them.
SINGLE = r"(?=\S)[^\w\s]*+\w?+[^\w\s]*+(?!\S)"
SPACED = re.compile(rf"(?<!\S){SINGLE}(?:\s++{SINGLE}){{2,}}+")
LONGEST = 64  # characters decoded at once; longer tokens are decoded in overlapping parts


def symbol_codes() -> np.ndarray:
    """Symbol of each Latin-1 byte."""
    codes = np.zeros(256, dtype=np.int64)
    for number, letter in enumerate(ALPHABET):
        if number:
            codes[ord(letter)] = number
            if len(letter.upper()) == 1 and ord(letter.upper()) < 256:
                codes[ord(letter.upper())] = number
    return codes


def count_trigrams(schema: pa.Schema):
    """Partition function: ``gram, n`` of symbol triples; runs of other characters are one boundary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = symbol_codes(), np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for start in range(0, len(texts), 100):
                raw = "\n".join(t or "" for t in texts[start : start + 100]).encode("latin-1", "replace")
                for at in range(0, max(1, len(raw)), 1 << 22):
                    s = codes[np.frombuffer(b"\n" + raw[at : at + (1 << 22)] + b"\n", dtype=np.uint8)]
                    s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))]
                    counts += np.bincount(s[:-2] * SIZE * SIZE + s[1:-1] * SIZE + s[2:], minlength=SIZE**3)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], schema=schema)

    return run


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over symbols, from all texts; the table has a fixed size."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
    counted = docs.select("text").mapInArrow(count_trigrams(schema), "gram long, n long")
    found = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SIZE**3)
    n[found["gram"].to_numpy()] = found["n"].to_numpy()
    n = n.reshape(SIZE, SIZE, SIZE)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + SIZE)
    pairs = n.sum(axis=0)
    two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(three)


class Decoder:
    """Viterbi decoding of one disguised stretch."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.number = {letter: i for i, letter in enumerate(ALPHABET)}
        self.number["\0"] = 0
        self.readings: dict[tuple[str, bool], list[tuple[int, float]]] = {}

    def arcs(self, text: str, at: int) -> list[tuple[int, float]]:
        """Readings of a character: symbol (-1 for nothing) and log probability."""
        c = text[at]
        key = (c, at > 0 and c == text[at - 1])
        if key in self.readings:
            return self.readings[key]
        out = self.readings[key] = []
        if c in self.number and c != "\0":
            out.append((self.number[c], AS_IS))
        for letter in LOOKALIKES.get(c, ""):
            out.append((self.number[letter], LOOKALIKE))
        if at and c == text[at - 1]:
            out.append((-1, REPEATED))
        if c not in self.number or c == "\0":
            plain = c not in LOOKALIKES
            out.append((-1, DROPPED if plain else LOST))
            out.append((0, BROKEN if plain else LOST))
        return out

    def decode(self, text: str) -> list[str]:
        """The words of the most likely reading of a lower-cased text."""
        if len(text) > LONGEST:
            half = LONGEST // 2
            parts = [text[i : i + LONGEST] for i in range(0, len(text) - half, half)]
            return [w for p in parts for w in self.decode(p)]
        # Up to the first character with more than one reading there is one path.
        a = b = at = 0
        p, history = 0.0, ()
        while at < len(text) and len(arcs := self.arcs(text, at)) == 1:
            ((symbol, cost),) = arcs
            p += cost
            p += self.model[a][b][symbol]
            a, b, history, at = b, symbol, (history, symbol), at + 1
        # (last but one, last) symbol -> (log probability, history)
        best: dict[tuple[int, int], tuple[float, tuple]] = {(a, b): (p, history)}
        for at in range(at, len(text)):
            following: dict[tuple[int, int], tuple[float, tuple]] = {}
            arcs = self.arcs(text, at)
            for (a, b), (p, history) in best.items():
                row = self.model[a][b]
                for symbol, cost in arcs:
                    if symbol < 0 or (symbol == 0 and b == 0):
                        key, q, path = (a, b), p + cost, history
                    else:
                        key, q, path = (b, symbol), p + cost + row[symbol], (history, symbol)
                    known = following.get(key)
                    if known is None or q > known[0]:
                        following[key] = (q, path)
            if len(following) > BEAM:
                following = dict(sorted(following.items(), key=lambda kv: -kv[1][0])[:BEAM])
            best = following
        (_, history) = max(
            ((p + (self.model[a][b][0] if b else 0.0), h) for (a, b), (p, h) in best.items()), key=lambda x: x[0]
        )
        letters = []
        while history:
            history, symbol = history
            letters.append(ALPHABET[symbol])
        return [w for w in "".join(reversed(letters)).split("\0") if w]


class Restorer(dict):
    """Restored words of each lower-cased token, decoded once per distinct token."""

    def __init__(self, decoder: Decoder):
        super().__init__()
        self.decoder = decoder

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > KEEP_WORDS:
            self.clear()
        out = self[token] = self.read(token)
        return out

    def read(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not RUN.search(token):
            return (token,)
        core = EDGES.sub("", token)
        if LETTERS.match(core) and not RUN.search(core):
            # Signs at the edges may be disguised letters too ($tupid): then both readings count.
            if core != token and any(c in LOOKALIKES for c in token) and len(token) - len(core) < 3:
                return tuple(dict.fromkeys((core, *self.decoder.decode(token))))
            return (core,)
        if not MARK.search(token):
            return ()
        words = [*re.findall(r"[^\W\d_]+", core), *self.decoder.decode(core)]
        if core != token:
            words += self.decoder.decode(token)
        return tuple(dict.fromkeys(words))


def spaced_words(stretch: str, decoder: Decoder) -> list[str]:
    """Words of single characters with white space between them, read with the marks attached to them and without."""
    parts = stretch.split()
    readings = dict.fromkeys((" ".join(parts), " ".join(EDGES.sub("", p) or p for p in parts)))
    return [w for reading in readings for w in decoder.decode(reading)]


def restored_words(text: str | None, restorer: Restorer) -> set[str]:
    """Words of a text, disguised ones restored."""
    lowered = (text or "").lower()
    words: set[str] = set()
    for token in set(lowered.split()):
        words.update(restorer[token])
    for spaced in SPACED.finditer(lowered):
        words.update(spaced_words(spaced.group(), restorer.decoder))
    return words


def features_of(word: str) -> list[str]:
    """A word (closed by a space) and its beginnings."""
    return [word + " ", *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


def count_features(model: np.ndarray, schema: pa.Schema):
    """Partition function: ``feature, n_bad, n_good`` documents; the empty feature counts all documents."""

    def rows(bad: Counter, good: Counter) -> pa.RecordBatch:
        names = list(bad.keys() | good.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([bad[f] for f in names], pa.int64()), pa.array([good[f] for f in names], pa.int64())],
            schema=schema,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(Decoder(model))
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = {f for w in restored_words(text, restorer) for f in features_of(w)}
                (bad if toxic else good).update(found | {""})
            if len(bad) + len(good) > 500_000:
                yield rows(bad, good)
                bad, good = Counter(), Counter()
        if bad or good:
            yield rows(bad, good)
        del restorer, bad, good
        give_back()

    return run


class WordScores(dict):
    """Score of each lower-cased token: the largest weight among its restored words, 0 for none."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        super().__init__()
        self.restorer, self.weights = restorer, weights

    def of_words(self, words: Iterable[str]) -> float:
        best, weight = 0.0, self.weights.get
        for word in words:
            for feature in features_of(word):
                best = max(best, weight(feature, 0.0))
        return best

    def __missing__(self, token: str) -> float:
        if len(self) > KEEP_SCORES:
            self.clear()
        out = self[token] = self.of_words(self.restorer.read(token))
        return out


def text_score(text: str | None, scores: WordScores, base: float) -> float:
    """Probability that at least one sign of toxicity is right; ``base`` without any sign."""
    lowered = (text or "").lower()
    tokens = lowered.split()
    each = [*map(scores.__getitem__, tokens)]
    found = {t: s for t, s in zip(tokens, each, strict=True) if s > 0.0} if any(each) else {}
    if len(tokens) > 2:
        for spaced in SPACED.finditer(lowered):
            s = scores.of_words(spaced_words(spaced.group(), scores.restorer.decoder))
            if s > 0.0:
                found[spaced.group()] = s
    clean = 1.0 - base
    for s in sorted(found.values(), reverse=True)[:3]:
        clean *= 1.0 - s
    return 1.0 - clean


def score_rows(model: np.ndarray, weights: dict[str, float], base: float, schema: pa.Schema):
    """Partition function: ``doc_id, held_out, score, predicted``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(Restorer(Decoder(model)), weights)
        for batch in batches:
            values = [text_score(t, scores, base) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())],
                schema=schema,
            )
        del scores
        give_back()

    return run


def training_rows(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """``text, toxic`` of a sample of the labelled documents that are not held out, about ``most_labelled`` of them.

    An id labelled more than once counts as toxic if any label says so; rows without id or label are left out. The sample is taken by a
    hash of the id, so reruns agree.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(remainder("doc_id", 5) != 0)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    known = stage(known, "labelled")
    n = known.count()
    if n > most_labelled:
        known = stage(known.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 20)) < (most_labelled << 20) // n), "labelled")
    return docs.select("doc_id", "text").join(lookup(known), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def toxicity_model(docs: DataFrame, labels: DataFrame, most_labelled: int = 50_000) -> tuple[np.ndarray, dict[str, float], float]:
    """Character model, weights of words and beginnings, and the score of texts without any.

    A weight is the lower bound of the feature's toxic share among the labelled documents that have it; features count from a bound of
    0.6 on, and if at least 5 documents and 0.2 % of the toxic ones have them. Without labels nothing has a weight.
    """
    prepared(docs.sparkSession)
    model = character_model(docs)
    schema = pa.schema([("feature", pa.string()), ("n_bad", pa.int64()), ("n_good", pa.int64())])
    rows = training_rows(docs, labels, most_labelled)
    counts = rows.mapInArrow(count_features(model, schema), "feature string, n_bad long, n_good long")
    counts = counts.groupBy("feature").agg(F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good"))
    counts = stage(counts.where("n_bad >= 5 or feature = ''"), "toxic-features")
    whole = counts.where("feature = ''").first()
    if whole is None or not whole["n_bad"]:
        return model, {}, 0.0
    n, share = F.col("n_bad") + F.col("n_good") + 4, (F.col("n_bad") + 2) / (F.col("n_bad") + F.col("n_good") + 4)
    low = share - 1.96 * F.sqrt(share * (1 - share) / n)
    least = max(5, whole["n_bad"] // 500)
    kept = counts.select("feature", "n_bad", low.alias("low")).where("feature != ''").where((F.col("low") >= 0.6) & (F.col("n_bad") >= least))
    weights = {r["feature"]: r["low"] for r in kept.collect()}
    # What is left without a sign is taken to be a twentieth of the toxic share: below any sign, and above nothing.
    base = 0.05 * whole["n_bad"] / (whole["n_bad"] + whole["n_good"])
    return model, weights, base


def score_toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = 50_000) -> DataFrame:
    """Toxicity of every row of ``docs`` (``doc_id, text``): ``doc_id, held_out, score, predicted``.

    Labels (``doc_id, toxic``) are used from ids that are not held out (crc32 of the id modulo 5 is not 0), at most about ``most_labelled``;
    the character model covers all texts. Null and empty texts get the score of texts without any sign. Rows may repeat; a null id is
    held out; other columns are ignored.
    """
    model, weights, base = toxicity_model(docs, labels, most_labelled)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out"), "text"
    )
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    return rows.mapInArrow(score_rows(model, weights, base, schema), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns stay."""
    model, weights, base = toxicity_model(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(Restorer(Decoder(model)), weights)
        for batch in batches:
            keep = [text_score(t, scores, base) < threshold for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        del scores
        give_back()

    return docs.mapInArrow(run, docs.schema)
