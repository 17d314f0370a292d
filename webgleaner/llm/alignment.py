"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how their ids go together in a corpus.

Both token lists of a text are given by their byte ends. The shorter list drives an exponential and then a binary search into the longer one
(galloping intersection); the common ends cut both lists into groups, and the rank differences between them give the ranges of tokens that overlap.

A text is taken apart at single spaces between other characters first: neither tokenizer has a token over such a place, so that a part is
aligned once and its groups are used wherever it stands. Chunks of documents then hold the numbers of their parts and the id pairs of each part.
The documents of a pair are counted over the corpus; a bucket of pairs is one row of a table, which answers what each chunk asks of
it, and the chunk adds the answers up per document. Nothing of the corpus is broadcast.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, give_back, groups_of, packed, prepared, stage, unpacked, worker_store

by_value(__name__)

CHUNK_PARTS = 1 << 20  # parts of a chunk, about
KEEP_PARTS = 200_000  # aligned parts met lately that a worker keeps, and as many met before
LARGE_GROUP = 10_000  # links of a group from which its pairs are made of distinct ids
BUCKET_PAIRS = 500_000  # id pairs of a bucket, about
SPREAD = 1_000_003  # a prime: pairs are dealt to buckets by the remainder

# Where a text is taken apart: a space between two characters that are no white space.
PART = re.compile(r"(?<=\S) (?=\S)")

CHUNK = (
    "chunk long, bucket long, doc_ids array<long>, sha array<string>, facts binary, sizes binary, parts binary, "
    "ends binary, pairs binary, times binary, keys binary, n binary"
)



def parts_of(text: str) -> list[str]:
    """The parts of a text. Splitting at every space does, unless a piece then begins or ends with white space or is empty."""
    pieces = text.split(" ")
    return pieces if all(pieces) and [*map(str.strip, pieces)] == pieces else PART.split(text)


# --- tokens -----------------------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def gallop(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the first of ``values[low:end]`` (sorted) that is not below ``wanted``, for many searches at once: steps double, then halve."""
    low, high, step = low.copy(), low.copy(), 1
    todo = np.flatnonzero(high < end)
    todo = todo[values[high[todo]] < wanted[todo]]
    while len(todo):
        low[todo] = high[todo] + 1
        high[todo] = np.minimum(high[todo] + step, end[todo])
        step *= 2
        todo = todo[high[todo] < end[todo]]
        todo = todo[values[high[todo]] < wanted[todo]]
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        below = values[middle] < wanted[todo]
        low[todo] = np.where(below, middle + 1, low[todo])
        high[todo] = np.where(below, high[todo], middle)
        todo = todo[low[todo] < high[todo]]
    return low


def common_ends(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of the numbers that stand in both lists of a pair of sorted lists.

    ``a`` and ``b`` hold many lists one after another, with as many numbers as the sizes say. The shorter list of each pair drives the search.
    """
    lists = np.arange(len(size_a))
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    shorter = size_a <= size_b
    found_a, found_b = [], []
    for driven, x, n_x, start_x, y, n_y, start_y, out_x, out_y in (
        (lists[shorter], a, size_a, start_a, b, size_b, start_b, found_a, found_b),
        (lists[~shorter], b, size_b, start_b, a, size_a, start_a, found_b, found_a),
    ):
        of = np.repeat(driven, n_x[driven])
        at = np.arange(len(of)) - np.repeat(np.cumsum(n_x[driven]) - n_x[driven], n_x[driven]) + start_x[of]
        end = start_y[of] + n_y[of]
        place = gallop(y, x[at], start_y[of], end)
        hit = np.flatnonzero(place < end)
        hit = hit[y[place[hit]] == x[at[hit]]]
        out_x.append(at[hit])
        out_y.append(place[hit])
    places_a, places_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(places_a, kind="stable")
    return places_a[order], places_b[order]


def products(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups one after another: places of the first and of the second in every pair of a group."""
    n = size_a * size_b
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(size_b, n)
    return np.repeat(np.cumsum(size_a) - size_a, n) + inner // wide, np.repeat(np.cumsum(size_b) - size_b, n) + inner % wide


# How the byte-level vocabulary takes text apart before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder_by_ranks(byte_level: str, bytes_of: list[bytes]):
    """A faster encoder of the same vocabulary, for texts within Latin-1; None where its merges do not stand in the order of their ids."""
    import tiktoken

    file = json.loads(byte_level)
    before, vocabulary = file["pre_tokenizer"], file["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    first = len(vocabulary) - len(merges)
    plain = file["normalizer"] is None and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    if not plain or first != 256 or any(vocabulary[a + b] != first + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes_of[i]: i for i in vocabulary.values()}
    return tiktoken.Encoding("parts", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Token bytes of both tokenizers and the groups of text parts; ``parts`` holds those met lately."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        # One core per task.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_level)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        self.quick = encoder_by_ranks(byte_level, self.bytes_a)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([*map(len, t)], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.radix = len(self.bytes_b)
        # Ids as text with what follows them: another id, the other side, another group.
        ids = [*map(str, range(max(len(self.bytes_a), len(self.bytes_b))))]
        self.texts = [np.array([i + mark for i in ids], dtype=object) for mark in ",|;"]
        self.parts: dict = {}
        self.older: dict = {}

    def meet(self, parts: set[str], numbered: dict) -> None:
        """Have all of ``parts`` that have no number yet in ``self.parts``."""
        if len(self.parts) > KEEP_PARTS:
            self.parts, self.older = {}, self.parts
        known, older, new = self.parts, self.older, []
        for part in parts.difference(numbered).difference(known):
            if part in older:
                known[part] = older[part]
            else:
                new.append(part)
        self.learn(new)

    def learn(self, parts: list[str]) -> None:
        """Align text parts (each stands after a space): their numbers of tokens, groups and links, the groups as text, and the linked pairs with
        how often; None where the bytes of the tokens are not those of the part."""
        for first in range(0, len(parts), 20_000):
            some = parts[first : first + 20_000]
            spaced = [" " + p for p in some]
            of_a: list = [None] * len(some)
            if self.quick:
                of_a = [self.quick.encode_ordinary(t) if t.isascii() or max(t) <= "ÿ" else None for t in spaced]
            rest = [i for i, ids in enumerate(of_a) if ids is None]
            for i, made in zip(rest, self.a.encode_batch([spaced[i] for i in rest], add_special_tokens=False), strict=True):
                of_a[i] = made.ids
            raw = [t.encode() for t in spaced]
            of_b = self.b.encode(some, num_threads=1)
            whole = self._whole(raw, of_b, self.bytes_b, self.size_b)
            # The faster encoder leaves no byte out.
            for i in rest:
                whole[i] &= b"".join(map(self.bytes_a.__getitem__, of_a[i])) == raw[i]
            if not whole.all():
                self.parts.update((some[i], None) for i in np.flatnonzero(~whole).tolist())
                some, of_a, of_b = ([*compress(x, whole.tolist())] for x in (some, of_a, of_b))
            if some:
                self._align(some, of_a, of_b)

    @staticmethod
    def _whole(raw: list[bytes], lists: list[list[int]], bytes_of: list[bytes], size_of: np.ndarray) -> np.ndarray:
        """Whether the bytes of each list of ids are the bytes in its place of ``raw``."""
        n, size = np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter(map(len, raw), np.int64, len(raw))
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
        out = sums(size_of[ids], n) == size
        same = out.tolist()
        made = np.frombuffer(b"".join(map(bytes_of.__getitem__, ids[np.repeat(out, n)].tolist())), dtype=np.uint8)
        wanted = np.frombuffer(b"".join(compress(raw, same)), dtype=np.uint8)
        out[out] = sums(made != wanted, size[out]) == 0
        return out

    def _align(self, parts: list[str], of_a: list[list[int]], of_b: list[list[int]]) -> None:
        n_a, n_b = (np.fromiter(map(len, lists), np.int64, len(parts)) for lists in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())) for lists, n in ((of_a, n_a), (of_b, n_b)))
        # Byte ends over all parts: those of one part lie behind those of the part before.
        end_a, end_b = common_ends(np.cumsum(self.size_a[a]), n_a, np.cumsum(self.size_b[b]), n_b)
        in_a, in_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
        part_of = np.repeat(np.arange(len(parts)), n_a)[end_a]
        groups = np.bincount(part_of, minlength=len(parts))
        links = np.bincount(part_of, weights=in_a * in_b, minlength=len(parts)).astype(np.int64)
        # Tokens of A, then those of B, group by group.
        group_a, group_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
        comma, bar, mark = self.texts
        words = np.concatenate([comma[a], comma[b]])
        words[end_a], words[len(a) + end_b] = bar[a[end_a]], mark[b[end_b]]
        words = words[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        facts = np.stack([n_a, n_b, groups, links], axis=1)
        edges, first = np.cumsum(n_a + n_b).tolist(), 0
        texts = []
        for last in edges:
            texts.append("".join(words[first:last]))
            first = last
        # Large groups by distinct ids: all their pairs would be too many.
        large = np.flatnonzero(in_a * in_b > LARGE_GROUP)
        small_a, small_b = np.where(in_a * in_b > LARGE_GROUP, 0, in_a), np.where(in_a * in_b > LARGE_GROUP, 0, in_b)
        keep_a, keep_b = small_a[group_a] > 0, small_b[group_b] > 0
        at_a, at_b = products(small_a, small_b)
        keys, of_key = a[keep_a][at_a] * self.radix + b[keep_b][at_b], np.repeat(part_of, small_a * small_b)
        times = np.ones(len(keys), dtype=np.int64)
        for g in large.tolist():
            x, n = np.unique(a[end_a[g] + 1 - in_a[g] : end_a[g] + 1], return_counts=True)
            y, m = np.unique(b[end_b[g] + 1 - in_b[g] : end_b[g] + 1], return_counts=True)
            keys = np.concatenate([keys, (x[:, None] * self.radix + y).ravel()])
            times = np.concatenate([times, (n[:, None] * m).ravel()])
            of_key = np.concatenate([of_key, np.full(len(x) * len(y), part_of[g])])
        order = np.argsort(of_key, kind="stable") if len(large) else slice(None)
        keys, times, held = keys[order], times[order], np.bincount(of_key, minlength=len(parts))
        raw_facts, raw_keys, raw_times, edges = facts.tobytes(), keys.tobytes(), times.astype(np.int32).tobytes(), np.cumsum(held).tolist()
        first = 0
        for i, (part, text, last) in enumerate(zip(parts, texts, edges, strict=True)):
            self.parts[part] = (raw_facts[32 * i : 32 * i + 32], text, raw_keys[8 * first : 8 * last], raw_times[4 * first : 4 * last])
            first = last


def aligner(byte_level: str, pieces: bytes) -> Aligner:
    """The worker's aligner."""
    store, key = worker_store(), ("aligner", zlib.crc32(byte_level.encode()), zlib.crc32(pieces))
    if key not in store:
        store[key] = Aligner(byte_level, pieces)
    return store[key]


# --- chunks -----------------------------------------------------------------------------------------------------------


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; runs may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def spread(ids: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``ids`` the places of its run (``start``, ``sizes``), and which of them each place is for."""
    n = sizes[ids]
    which = np.repeat(np.arange(len(ids)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[ids], n), which


def records(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """Rows of the chunk table; columns not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


class Numbers(dict):
    """Numbers of the chunk's parts in the order they come, -1 for those that cannot be aligned."""

    def __init__(self, align: Aligner):
        super().__init__()
        self.align, self.found = align, []

    def __missing__(self, part: str) -> int:
        one = self.align.parts[part]
        if one is not None:
            self.found.append(one)
        out = self[part] = -1 if one is None else len(self.found) - 1
        return out


class Chunk:
    """Documents as numbers of their parts, and the aligned parts."""

    def __init__(self, align: Aligner):
        self.align, self.numbers = align, Numbers(align)
        self.doc_ids, self.parts, self.sizes, self.sha = [], [], [], []
        self.n_parts = 0

    def add(self, rows: list[tuple[int | None, str | None]]) -> None:
        """Documents with null, empty or unequal texts have no parts."""
        numbers, found = self.numbers, self.numbers.found
        split = [parts_of(text) if text else [] for _, text in rows]
        self.align.meet(set().union(*split), numbers)
        for (doc_id, text), parts in zip(rows, split, strict=True):
            own = [*map(numbers.__getitem__, parts)]
            if own and min(own) < 0:
                # What differs in a part could only be made good elsewhere in the text.
                if text not in numbers:
                    self.align.learn([text])
                own = [n for n in [numbers[text]] if n >= 0]
            groups = "".join([found[i][1] for i in own])
            self.sha.append(hashlib.sha256(groups[:-1].encode()).hexdigest() if own else "")
            self.doc_ids.append(doc_id)
            self.sizes.append(len(own))
            self.parts.append(np.frombuffer(array("i", own), dtype=np.int32))
            self.n_parts += len(own)

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        """The chunk's row: with ``keys``, the id pairs it holds, in order, and ``n``, how many of its documents hold each."""
        parts, sizes = np.concatenate(self.parts), np.array(self.sizes, dtype=np.int64)
        found = self.numbers.found
        facts = np.frombuffer(b"".join([f[0] for f in found]), dtype=np.int64).reshape(-1, 4)
        held = np.frombuffer(b"".join([f[2] for f in found]), dtype=np.int64)
        times = np.frombuffer(b"".join([f[3] for f in found]), dtype=np.int32)
        ends = np.array([len(f[3]) // 4 for f in found], dtype=np.int64)
        keys, pairs = np.unique(held, return_inverse=True)
        start, counted = np.cumsum(ends) - ends, np.zeros(len(keys), dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # Some documents at a time: each pair of a document counts once.
        edges = np.searchsorted(np.cumsum(sizes), np.arange(0, len(parts), 100_000), side="right")
        edges = np.unique([0, *edges.tolist(), len(sizes)])
        first = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = slice(first[a], first[b])
            both = np.unique((doc[at] - a) * max(1, len(ends)) + parts[at])
            place, which = spread(both % max(1, len(ends)), ends, start)
            both = np.unique((both // max(1, len(ends)))[which] * max(1, len(keys)) + pairs[place])
            counted += np.bincount(both % max(1, len(keys)), minlength=len(keys)) if len(keys) else 0
        of_docs = [sums(facts[parts, k], sizes) if len(facts) else np.zeros(len(sizes), np.int64) for k in range(4)]
        return records(
            schema, chunk=[number], bucket=[-1], doc_ids=[self.doc_ids], sha=[self.sha], facts=[packed(np.concatenate(of_docs))], sizes=[packed(sizes)],
            parts=[packed(parts)], ends=[packed(ends)], pairs=[packed(pairs)], times=[packed(times)], keys=[packed(np.diff(keys, prepend=0))], n=[packed(counted)],
        )


def chunk_rows(byte_level, pieces, most_parts: int, schema: pa.Schema):
    """Partition function: a row per chunk from ``doc_id, text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, made, chunk = None, 0, None
        # The parts are many and hold no cycles: searching them for some takes an eighth of the time.
        gc.disable()
        for batch in batches:
            align = align or aligner(byte_level.value, pieces.value)
            rows = list(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True))
            for first in range(0, len(rows), 500):
                chunk = chunk or Chunk(align)
                chunk.add(rows[first : first + 500])
                if chunk.n_parts >= most_parts:
                    yield chunk.row((TaskContext.get().partitionId() << 32) + made, schema)
                    made, chunk = made + 1, None
        if chunk:
            yield chunk.row((TaskContext.get().partitionId() << 32) + made, schema)
        gc.enable()
        give_back()

    return run


def keys_of(row: dict) -> np.ndarray:
    return np.cumsum(unpacked(row["keys"]))


def counted_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partition function: ``pair, n`` of each chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(row)), pa.array(unpacked(row["n"]))], names=["pair", "n"])
    give_back()


# --- answers ----------------------------------------------------------------------------------------------------------


def in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket and key, and their buckets in that order."""
    bucket = keys % SPREAD % buckets
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def table_rows(schema: pa.Schema):
    """Partition function: pairs of a bucket and their values, packed, from rows ``bucket, pair, n`` sorted by bucket and pair."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket"], least=1):
            keys, n = group["pair"].to_numpy(), group["n"].to_numpy()
            yield records(schema, chunk=[-1], bucket=[int(group["bucket"][0].as_py())], keys=[packed(np.diff(keys, prepend=0))], n=[packed(n)])
        give_back()

    return run


def requests(buckets: int, schema: pa.Schema):
    """Partition function: what each chunk asks, a row per bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = keys_of(row)
                order, bucket = in_buckets(keys, buckets)
                keys = keys[order]
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
                spans = [(a, b) for a, b in zip(edges[:-1], edges[1:]) if a < b]
                if spans:
                    yield records(
                        schema, chunk=[row["chunk"]] * len(spans), bucket=[int(bucket[a]) for a, _ in spans],
                        keys=[packed(np.diff(keys[a:b], prepend=0)) for a, b in spans],
                    )
        give_back()

    return run


def answers(schema: pa.Schema):
    """Partition function: the values of the asked pairs, from rows sorted by bucket and chunk; the table's row comes first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = n = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] < 0:
                    keys, n = keys_of(row), unpacked(row["n"])
                    continue
                found = n[np.searchsorted(keys, keys_of(row))]
                yield records(schema, chunk=[row["chunk"]], bucket=[row["bucket"]], n=[packed(found)])
        give_back()

    return run


def document_rows(buckets: int, schema: pa.Schema):
    """Partition function: facts per document from a chunk and the answers to it, sorted by chunk and bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["chunk"], least=1):
            row = group.slice(0, 1).to_pylist()[0]
            keys, sizes, parts, ends = keys_of(row), unpacked(row["sizes"]), unpacked(row["parts"]), unpacked(row["ends"])
            value = np.zeros(len(keys), dtype=np.int64)
            if len(keys):
                order, _ = in_buckets(keys, buckets)
                value[order] = np.concatenate([unpacked(raw) for raw in group["n"].slice(1).to_pylist()])
            pairs, times = unpacked(row["pairs"]), unpacked(row["times"])
            of_part = [sums(times * v[pairs], ends) for v in (value & 1, value >> 1)]
            best, total = (sums(v[parts], sizes) for v in of_part)
            columns = [row["doc_ids"], *np.split(unpacked(row["facts"]), 4), best, total, row["sha"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        give_back()

    return run


def token_links(docs: DataFrame, byte_level_path: str, pieces_path: str, most_parts: int = CHUNK_PARTS) -> DataFrame:
    """Alignment of the tokens of every row of ``docs`` (``doc_id, text``) by a byte-level BPE (A) and a SentencePiece model (B).

    Returns ``doc_id``, long ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups_sha256``. Groups are the tokens between byte ends that
    both lists share; links are all token pairs inside groups. A pair of ids counts once per row that links it; ``count_sum`` adds the
    counts of a row's links, ``n_best`` is how many of them have the largest count of their A id. Null and empty texts, and texts whose token bytes
    are not a space and the text, have zeros and an empty ``groups_sha256``. Repeated rows are rows of their own; other columns are ignored.
    """
    spark = prepared(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    with open(byte_level_path, encoding="utf-8") as file:
        byte_level = spark.sparkContext.broadcast(file.read())
    with open(pieces_path, "rb") as file:
        pieces = spark.sparkContext.broadcast(file.read())
    schema = to_arrow_schema(StructType.fromDDL(CHUNK))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stage(rows.mapInArrow(chunk_rows(byte_level, pieces, most_parts, schema), CHUNK), "alignment-chunks")

    counted = chunks.select("keys", "n").mapInArrow(counted_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # The radix of the pairs: the number of B's ids. A is A's id.
    radix = Aligner(byte_level.value, pieces.value).radix
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / radix)))
    counted = stage(counted.select("pair", (2 * F.col("n") + (F.col("n") == most).cast("long")).alias("n")), "alignment-pairs")
    buckets = max(partitions, counted.count() // BUCKET_PAIRS)
    placed = counted.withColumn("bucket", F.col("pair") % SPREAD % buckets).repartition(partitions, "bucket").sortWithinPartitions("bucket", "pair")
    table = placed.select("bucket", "pair", "n").mapInArrow(table_rows(schema), CHUNK)
    asked = chunks.select("chunk", "keys").mapInArrow(requests(buckets, schema), CHUNK)
    met = table.union(asked).repartition(partitions, "bucket").sortWithinPartitions("bucket", "chunk")
    together = chunks.withColumn("n", F.lit(None).cast("binary")).union(met.mapInArrow(answers(schema), CHUNK))
    together = together.repartition(partitions, "chunk").sortWithinPartitions("chunk", "bucket")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = pa.schema([*((name, pa.int64()) for name in names), ("groups_sha256", pa.string())])
    return together.mapInArrow(document_rows(buckets, out), ", ".join(f"{name} long" for name in names) + ", groups_sha256 string")
