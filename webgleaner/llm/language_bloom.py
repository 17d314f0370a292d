"""Language identification with a bit-sliced Bloom filter of n-grams.

Row r of the filter is a mask with one bit per language; looking up an n-gram takes the AND of a few rows and so returns all
languages that contain it at once. A text's score for a language is the number of its n-grams that the language
contains, corrected for the filter's false positives: (hits - n * p) / (1 - p), where p is the language's fill rate to the power of
the number of hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, prepared, remainder, restored, stage

by_value(__name__)

N_HASHES = 3
PIECE = 1 << 20  # characters worked on at a time
KEEP = 2_000_000  # distinct n-grams a training task holds before it passes them on


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of about ``PIECE`` characters: text numbers and lower-cased parts; long texts in overlapping parts."""
    numbers, parts, size = [], [], 0
    for number, text in enumerate(texts):
        text = text or ""
        for start in range(0, max(1, len(text)), PIECE):
            part = text[max(0, start - 3) : start + PIECE].lower()
            numbers.append(number)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def ngrams(parts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 4-grams of words, the part each is in, and the letters per part.

    All but letters counts as space, runs of it as one; parts begin and end with a space.
    """
    codes = np.frombuffer((" " + "   ".join(parts) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    part = np.repeat(np.arange(len(parts)), sizes + 3)
    is_letter = letters[codes]
    n_letters = np.bincount(part, weights=is_letter, minlength=len(parts))
    # A space stays where a letter is before or after it; two spaces close a part's last word.
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]
    keep[1:] |= is_letter[:-1]
    keep[2:] |= is_letter[:-2] & ~is_letter[1:-1] & (part[2:] != np.append(part[3:], -1))
    codes = np.where(is_letter, codes, 0)[keep].astype(np.uint64)
    part = part[keep]
    if len(codes) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    low = codes[:-3] | (codes[1:-2] << np.uint64(21)) | (codes[2:-1] << np.uint64(42))
    keys = mixed(low * np.uint64(0x9FB21C651E98DF25) + codes[3:] * np.uint64(0xD1342543DE82EF95))
    inside = part[:-3] == part[3:]
    return keys[inside], part[:-3][inside], n_letters


def count_ngrams(letters: np.ndarray, schema: pa.Schema):
    """Partition function: ``lang, key, n`` with the n-grams of a task counted before they leave it."""

    def rows(held: dict) -> pa.RecordBatch:
        langs = [lang for lang in held]
        keys = [held[lang][0] for lang in langs]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(langs, dtype=object), [len(k) for k in keys]).tolist(), pa.string()),
                pa.array(np.concatenate(keys).view(np.int64)),
                pa.array(np.concatenate([held[lang][1] for lang in langs])),
            ],
            schema=schema,
        )

    def add(held: dict, lang: str, keys: np.ndarray) -> None:
        distinct, counts = np.unique(keys, return_counts=True)
        if lang in held:
            distinct = np.concatenate([held[lang][0], distinct])
            counts = np.concatenate([held[lang][1], counts])
            distinct, where = np.unique(distinct, return_inverse=True)
            counts = np.bincount(where, weights=counts).astype(np.int64)
        held[lang] = (distinct, counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            by_lang: dict = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for _, parts in pieces(texts):
                    keys, _, _ = ngrams(parts, letters)
                    if len(keys):
                        add(held, lang, keys)
            if sum(len(k) for k, _ in held.values()) > KEEP:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return run


class SlicedFilter:
    """Rows of language masks; ``lookup`` gives the mask of the languages that contain each key."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, n_langs: int, bits_per_key: int = 12):
        most = int(np.bincount(langs, minlength=1).max()) if len(keys) else 1
        self.n_langs = n_langs
        self.bits = max(10, int(np.ceil(np.log2(max(1, most) * bits_per_key))))
        self.rows = np.zeros((1 << self.bits, (n_langs + 63) // 64), dtype=np.uint64)
        for at in self.places(keys):
            np.bitwise_or.at(self.rows, (at, langs // 64), np.uint64(1) << (langs % 64).astype(np.uint64))
        fill = np.array([self.bit(self.rows, lang).mean() for lang in range(n_langs)])
        self.false_rate = fill**N_HASHES

    @staticmethod
    def bit(masks: np.ndarray, lang: int) -> np.ndarray:
        return (masks[:, lang // 64] >> np.uint64(lang % 64)) & np.uint64(1)

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """Row numbers by double hashing."""
        step = mixed(keys + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for turn in range(N_HASHES):
            yield ((keys + np.uint64(turn) * step) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for at in self.places(keys):
            out = self.rows[at] if out is None else out & self.rows[at]
        return out

    def corrected(self, keys: np.ndarray, owner: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
        """Hits per owner and language without the expected false ones, and n-grams per owner."""
        n = np.bincount(owner, minlength=n_owners).astype(float)
        masks = self.lookup(keys)
        hits = np.stack(
            [np.bincount(owner, weights=self.bit(masks, lang), minlength=n_owners) for lang in range(self.n_langs)], axis=1
        )
        return hits, n


def learn(docs: DataFrame, min_share: float = 2e-5, min_ratio: float = 0.2) -> tuple[list[str], SlicedFilter, str | None]:
    """Languages, filter and most frequent language of ``lang, text`` rows (null lang or text: ignored).

    A language contains an n-gram whose share of the language's n-grams is at least ``min_share``, and at least
    ``min_ratio`` of its largest share in any language (stray words of other languages stay out). Shares add up to 1, so a
    language contains at most ``1 / min_share`` n-grams, whatever the size of the corpus: that bounds what is collected.
    All n-grams of all rows are counted.
    """
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(count_ngrams(letter_table(), schema), "lang string, key long, n long")
    counts = stage(counts.groupBy("lang", "key").agg(F.sum("n").alias("n")), "ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    shares = shares.where(F.col("share") >= min_share)
    highest = shares.groupBy("key").agg(F.max("share").alias("highest"))
    held = shares.join(highest, "key").where(F.col("share") >= F.col("highest") * min_ratio).select("lang", "key")
    sizes = {r["lang"]: r["total"] for r in totals.collect()}
    langs = sorted(sizes)
    found = held.toArrow()
    codes = np.searchsorted(np.array(langs, dtype=object), np.array(found["lang"].to_pylist(), dtype=object))
    keys = found["key"].to_numpy().view(np.uint64) if len(found) else np.zeros(0, np.uint64)
    usual = min(langs, key=lambda lang: (-sizes[lang], lang)) if langs else None
    return langs, SlicedFilter(keys, codes.astype(np.int64), max(1, len(langs))), usual


def label_batches(langs: list[str], model, usual: str | None, letters: np.ndarray, schema: pa.Schema):
    """Partition function: adds the language and its score to ``doc_id, held_out, text``."""

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        sliced = restored(SlicedFilter, model.value)
        n_docs = len(texts)
        hits, n, n_letters = np.zeros((n_docs, sliced.n_langs)), np.zeros(n_docs), np.zeros(n_docs)
        for numbers, parts in pieces(texts):
            keys, owner, part_letters = ngrams(parts, letters)
            numbers = np.array(numbers)
            np.add.at(n_letters, numbers, part_letters)
            if len(keys):
                part_hits, part_n = sliced.corrected(keys, owner, len(parts))
                np.add.at(hits, numbers, part_hits)
                np.add.at(n, numbers, part_n)
        rate = sliced.false_rate
        real = np.maximum(0.0, (hits - n[:, None] * rate) / np.maximum(1e-9, 1 - rate))
        best, total = real.argmax(axis=1), real.sum(axis=1)
        out, scores = [], []
        for i in range(n_docs):
            if not n_letters[i] or not langs:
                out.append("und")
                scores.append(0.0)
            elif total[i] <= 0:
                out.append(usual)
                scores.append(0.0)
            else:
                out.append(langs[best[i]])
                scores.append(float(real[i, best[i]] / total[i]))
        return out, scores

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            predicted, scores = judge(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(schema.field("doc_id").type), batch["held_out"], pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                schema=schema,
            )

    return run


def identify(docs: DataFrame, training: DataFrame | None = None, min_share: float = 2e-5, min_ratio: float = 0.2) -> DataFrame:
    """Language per row of ``docs`` (``doc_id, text, lang``): ``doc_id, held_out, lang_pred, score``.

    ``held_out`` rows (crc32 of the id modulo 3 is 1) are not learned from unless ``training`` says what to learn
    from. The score is the winner's share of all corrected hits. Null texts and texts without a letter are ``und`` with
    score 0; texts none of whose n-grams is known get the most frequent language with score 0; ties go to the first
    language in code point order. Without any labelled text all are ``und``. Rows may repeat; other columns are ignored.
    """
    spark = prepared(docs.sparkSession)
    held_out = remainder("doc_id", 3) == 1
    langs, sliced, usual = learn(docs.where(~held_out) if training is None else training, min_share, min_ratio)
    model = spark.sparkContext.broadcast(vars(sliced))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    )
    return rows.mapInArrow(
        label_batches(langs, model, usual, letter_table(), schema),
        "doc_id long, held_out boolean, lang_pred string, score double",
    )
