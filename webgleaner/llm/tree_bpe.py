"""BPE encoding of long texts by tree concatenation.

A text longer than a leaf is cut in halves until the parts are short. The leaves are encoded in parallel, each as if it were a text; neighbouring parts
are then joined level by level. Around a join the tokens may be wrong on both sides, so a window of text over it is encoded again and grows until
its tokens agree with those of both parts: the same token at the same characters, once before the join and once behind it. Between these two tokens the
window's are taken. This is exact because a BPE sequence is right if all its neighbouring tokens are right together, pre-tokenisation looks no
further than one character ahead, and parts are cut where no normalisation reaches over. Added tokens, which are found as strings, are the
exception: where one may lie over a join the window is at least as long as they are. A window that has grown over both parts is their encoding itself.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, give_back, groups_of, packed, prepared, stage, unpacked, worker_store

by_value(__name__)

LEAF = 32_768  # characters of a part that is not cut further
KEEP_WORDS = 300_000  # encoded words met lately that a worker keeps, and as many met before
WINDOW = 64  # characters on each side of a join at first


class Codec:
    """Encoding with places, and decoding, by one tokenizer file."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        # One core per task.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        file = json.loads(tokenizer_json)
        # Without a decoder the library puts a space between the tokens.
        self.plain = file["decoder"] is None
        # A vocabulary with word ends has no token over white space; added tokens may have, if they say so.
        loose = [t for t in file["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1]
        self.words = Words(self) if self.plain and file["model"].get("end_of_word_suffix") and not loose else None
        self.tokens = [""] * (max(vocabulary.values(), default=0) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token

        self.added = [t["content"] for t in file["added_tokens"]]

    def reach(self, text: str, cut: int) -> int:
        """Characters on each side of ``cut`` that tell whether an added token lies over it."""
        longest = max(map(len, self.added), default=0)
        near = text[max(0, cut - longest) : cut + longest]
        return max((len(t) for t in self.added if t[0] in near), default=1)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def placed(self, text: str, start: int) -> Tokens:
        """Tokens with their characters, counted from ``start``."""
        made = self.tokenizer.encode(text, add_special_tokens=False)
        places = np.array(made.offsets, dtype=np.int64).reshape(-1, 2) + start
        return Tokens(np.array(made.ids, dtype=np.int64), places[:, 0], places[:, 1])

    def decode(self, ids: list[int]) -> str:
        if self.plain:
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


class Words:
    """Encoded words of a tokenizer that drops white space and has no token over it: ids as bytes, and decoded texts."""

    def __init__(self, coder: Codec):
        self.coder, self.known, self.older = coder, {}, {}

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, hash of the ids and hash of the decoded text of each text."""
        if len(self.known) > KEEP_WORDS:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        # ASCII white space: whatever else is white space stays inside a word.
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        for word in set().union(*split).difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        for word, made in zip(new, self.coder.tokenizer.encode_batch([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False), strict=True):
            known[word] = (np.array(made.ids, dtype="<u4").tobytes(), self.coder.decode(made.ids).encode("utf-8", "surrogatepass"))
        out = []
        for words in split:
            found = [*map(known.__getitem__, words)]
            ids = b"".join([f[0] for f in found])
            decoded = b" ".join([f[1] for f in found if f[0]])
            out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out


def codec(tokenizer_json: str) -> Codec:
    """The worker's codec."""
    store, key = worker_store(), ("codec", zlib.crc32(tokenizer_json.encode()))
    if key not in store:
        store[key] = Codec(tokenizer_json)
    return store[key]


class Tokens:
    """Token ids and the characters ``start`` to ``end`` each covers."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.ids, self.start, self.end = ids, start, end

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, at: slice) -> Tokens:
        return Tokens(self.ids[at], self.start[at], self.end[at])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(pair) for pair in zip(vars(self).values(), vars(other).values(), strict=True)))

    def whole(self) -> np.ndarray:
        """Which tokens share no character with another one: only these can be told by their place."""
        apart = self.start[1:] >= self.end[:-1]
        return np.append(True, apart) & np.append(apart, True) & (self.start < self.end)


def agreement(a: Tokens, b: Tokens, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Places in ``a`` and ``b`` of a token that both have at the same characters between ``low`` and ``high``: the first or the last such."""
    of_a = np.flatnonzero(a.whole() & (a.start >= low) & (a.end <= high))
    of_b = np.flatnonzero(b.whole() & (b.start >= low) & (b.end <= high))
    at = np.searchsorted(b.start[of_b], a.start[of_a])
    inside = at < len(of_b)
    of_a, at = of_a[inside], of_b[at[inside]]
    same = np.flatnonzero((a.start[of_a] == b.start[at]) & (a.end[of_a] == b.end[at]) & (a.ids[of_a] == b.ids[at]))
    return (int(of_a[same[-1 if last else 0]]), int(at[same[-1 if last else 0]])) if len(same) else None


def safe_cut(text: str, at: int) -> bool:
    """Whether normalisation never combines the character at ``at`` with what stands before: a letter or digit other than conjoining Hangul."""
    c = text[at]
    return c.isascii() or (unicodedata.category(c)[0] in "LN" and not "ᄀ" <= c <= "ᇿ" and not "ힰ" <= c <= "퟿")


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Where ``text`` is cut: in halves until parts have at most ``leaf`` characters, each at the safe place next to the middle."""
    out: list[int] = []

    def halve(low: int, high: int) -> None:
        if high - low <= leaf:
            return
        middle = (low + high) // 2
        for step in range((high - low) // 2):
            for at in (middle + step, middle - step):
                if low < at < high and safe_cut(text, at):
                    halve(low, at)
                    out.append(at)
                    halve(at, high)
                    return

    halve(0, len(text))
    return out


def join(coder: Codec, text: str, offset: int, left: Tokens, right: Tokens, low: int, cut: int, high: int, window: int) -> Tokens:
    """Tokens of ``text[low:high]`` (its first character has number ``offset``) from those of ``text[low:cut]`` and ``text[cut:high]``.

    The window starts and ends at safe places. A part's last token before the cut, and the window's last one, may carry a false end of
    word, its tokens next to the window's ends a false start: agreement is looked for before and behind these.
    """
    reach = max(window, coder.reach(text, cut - offset))
    while True:
        first, last = max(low, cut - reach), min(high, cut + reach)
        while first > low and not safe_cut(text, first - offset):
            first -= 1
        while last < high and not safe_cut(text, last - offset):
            last += 1
        again = coder.placed(text[first - offset : last - offset], first)
        if first == low and last == high:
            return again
        before = (0, 0) if first == low else agreement(left[:-1], again[:-1], first, cut, last=False)
        behind = (len(right), len(again)) if last == high else agreement(right, again[:-1], cut, last, last=True)
        if before and behind and before[1] <= behind[1]:
            return left[: before[0]] + again[before[1] : behind[1]] + right[behind[0] :]
        reach *= 2


def folded(coder: Codec, parts: list[tuple[int, str, Tokens]], window: int = WINDOW) -> Tokens:
    """Tokens of a whole text from its parts (first character, text, tokens), joined two by two, level by level."""
    while len(parts) > 1:
        joined = []
        for (at, text, left), (cut, more, right) in zip(parts[::2], parts[1::2]):
            joined.append((at, text + more, join(coder, text + more, at, left, right, at, cut, cut + len(more), window)))
        parts = [*joined, *parts[len(joined) * 2 :]]
    return parts[0][2]


def encode_long(coder: Codec, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """Ids of one text by tree concatenation, all in one place."""
    edges = [0, *cuts(text, leaf), len(text)]
    parts = [(a, text[a:b], coder.placed(text[a:b], a)) for a, b in zip(edges[:-1], edges[1:])]
    return folded(coder, parts, window).ids.tolist()


# --- rows -------------------------------------------------------------------------------------------------------------

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
DIGEST_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
LEAVES = "row long, doc_id long, start long, text string, ids binary, places binary"
LEAVES_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("ids", pa.binary()), ("places", pa.binary())])


def digest_rows(doc_ids: list, digests: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """What a query tells of token ids: their number, their hash and the hash of the decoded text."""
    columns = [doc_ids, *(list(c) for c in zip(*digests, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DIGEST_SCHEMA, strict=True)], schema=DIGEST_SCHEMA)


def digest(coder: Codec, ids: list[int]) -> tuple[int, str, str]:
    decoded = coder.decode(ids).encode("utf-8", "surrogatepass")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def short_rows(shipped):
    """Partition function: digests of texts that fit a leaf."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The words are many and hold no cycles.
        gc.disable()
        for batch in batches:
            coder = codec(shipped.value)
            doc_ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for first in range(0, len(texts), 500):
                some = texts[first : first + 500]
                if coder.words:
                    made = coder.words.digests(some)
                else:
                    made = [digest(coder, e.ids) for e in coder.tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
                yield digest_rows(doc_ids[first : first + 500], made)
        gc.enable()
        give_back()

    return run


def cut_rows(leaf: int):
    """Partition function: a row per leaf of each text, without tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                edges = [0, *cuts(text, leaf), len(text)]
                parts = [text[a:b] for a, b in zip(edges[:-1], edges[1:])]
                n = len(parts)
                columns = [[row] * n, [doc_id] * n, edges[:-1], parts, [None] * n, [None] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LEAVES_SCHEMA, strict=True)], schema=LEAVES_SCHEMA)

    return run


def leaf_rows(shipped):
    """Partition function: the leaves with their tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = codec(shipped.value)
            made = [coder.placed(text, 0) for text in batch["text"].to_pylist()]
            ids = [packed(t.ids) for t in made]
            # Starts never decrease; the characters of a token are few.
            places = [packed(np.concatenate([np.diff(t.start, prepend=0), t.end - t.start])) for t in made]
            columns = [batch["row"], batch["doc_id"], batch["start"], batch["text"], pa.array(ids, pa.binary()), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=LEAVES_SCHEMA)
        give_back()

    return run


def joined_rows(shipped, window: int):
    """Partition function: digests of whole texts from their leaves, sorted by row and place. A text and its tokens are those of one input row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["row"], least=1):
            coder = codec(shipped.value)
            parts = []
            for start, text, ids, places in zip(*(group[c].to_pylist() for c in ("start", "text", "ids", "places")), strict=True):
                step, size = unpacked(places).reshape(2, -1)
                at = np.cumsum(step) + start
                parts.append((start, text, Tokens(unpacked(ids), at, at + size)))
            yield digest_rows(group["doc_id"].slice(0, 1).to_pylist(), [digest(coder, folded(coder, parts, window).ids.tolist())])
        give_back()

    return run


def encode_digests(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """Token ids of every row of ``docs`` (``doc_id, text``), and the text decoded from them, as numbers and hashes.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``; the ids are those of the whole text without special tokens added, those it
    holds kept. Texts of more than ``leaf`` characters are cut in leaves, which are dealt to all tasks; the leaves of a text meet again in one task for
    the joins. Null texts are empty and have no tokens; repeated rows are rows of their own; other columns are ignored.
    """
    spark = prepared(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        shipped = spark.sparkContext.broadcast(file.read())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.char_length("text"), F.lit(0)) > leaf
    short = rows.where(~long).mapInArrow(short_rows(shipped), DIGEST)
    # Leaves are written before they are dealt out: the row numbers must not change.
    numbered = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    leaves = stage(numbered.mapInArrow(cut_rows(leaf), LEAVES).select("row", "doc_id", "start", "text"), "bpe-leaves")
    dealt = leaves.repartition(partitions, "row", "start").selectExpr("row", "doc_id", "start", "text")
    encoded = dealt.mapInArrow(leaf_rows(shipped), LEAVES)
    met = encoded.repartition(partitions, "row").sortWithinPartitions("row", "start")
    return short.union(met.mapInArrow(joined_rows(shipped, window), DIGEST))
