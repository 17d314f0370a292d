"""Language-model scoring with a weighted backoff automaton.

The n-grams kept are states. A state's arcs carry the smoothed probabilities of the words seen after it; a failure arc
leads to the state without its first word and carries the backoff weight. A text is scored in one pass from left to right: from the
current state follow failure arcs until one has an arc for the word, add the weights passed and the arc's log probability, and go
to the arc's target. Since a state is the longest kept suffix of the words before, the states of a whole batch are looked up together and all its
positions take each failure step at once.

Probabilities (interpolated absolute discounting, order 3) add up to 1 over the known words and one unknown:
P(w) = (c + 0.5) / (N + 0.5 (V + 1)); P(w | h) = (c(h, w) - d) / c(h) + b(h) P(w | h'), where b(h) is what the kept n-grams leave.

All counts cover all training rows, and every n-gram seen at least ``LEAST`` times is kept, whatever the size of the corpus: what is
gathered grows with it, and nothing of it is broadcast. The texts are cut into chunks, which lie in buckets by chunk and are not moved
again. Each chunk first asks for the numbers and counts of its words (64-bit hashes, a bucket of hashes goes to one task). Then it sends
its n-grams as numbers, dealt by their first word: words after it, and words after both. So the task of a bucket knows the counts and what
the kept n-grams take from their histories at once, and answers each chunk. A word or pair that is frequent in the corpus is dealt to several
buckets by the word after it. An n-gram has one entry per chunk at most. A chunk is then scored by the automaton of its own n-grams, with the
weights of the whole corpus.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, give_back, groups_of, placed, prepared, remainder

by_value(__name__)

END = b"\n"  # no word contains it
DISCOUNT = 0.75
LEAST = 2  # occurrences from which an n-gram is kept
SEED = 42
CHUNK_TOKENS = 1 << 19

BUCKET_TOKENS = 1 << 20  # tokens whose n-grams meet in one bucket, about
SHARE = 8  # a word with over 1 / SHARE of a bucket's tokens is dealt to several
LEAST_SPREAD = 1 << 12  # tokens of a word from which it may be

CHUNK = "chunk long, n_train long, doc_ids array<long>, held array<boolean>, sizes array<long>, ids binary, keys binary"
CHUNK_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("n_train", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
     ("ids", pa.binary()), ("keys", pa.binary())]
)
SLICE = "chunk long, bucket long, kinds long, keys binary, n binary"
SLICE_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kinds", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Numbers(dict):
    """Numbers from 1 in the order words come."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self) + 1
        return out


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of bytes, as many as the largest of an array needs, each compressed if that is shorter."""
    out = [bytes([len(arrays)])]
    for values in arrays:
        values = np.asarray(values).astype("<u8")
        width = (int(values.max(initial=0)).bit_length() + 7) // 8
        out.append(struct.pack("<IB", len(values), width))
        for plane in np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T):
            coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_RLE)
            short = coder.compress(plane.data) + coder.flush()
            out += [struct.pack("<I", len(short)), short] if len(short) < len(plane) else [struct.pack("<I", 0), plane.tobytes()]
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    arrays, at = [], 1
    for _ in range(raw[0]):
        n, width = struct.unpack_from("<IB", raw, at)
        at += 5
        out = np.zeros((n, 8), dtype=np.uint8)
        for k in range(width):
            (size,) = struct.unpack_from("<I", raw, at)
            at += 4
            plane = zlib.decompress(raw[at : at + size], -15) if size else raw[at : at + n]
            at += size or n
            out[:, k] = np.frombuffer(plane, dtype=np.uint8)
        arrays.append(out.reshape(-1).view("<i8"))
    return arrays


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their distances, whose upper bytes are zeros; these are left out, and the number of bytes is put first."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, dtype=np.uint8, offset=9).reshape(width, -1)
    steps = np.zeros((planes.shape[1] + 1, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(raw, dtype=np.uint8, count=8, offset=1)
    steps[1:, :width] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def slices(rows: dict[str, list]) -> pa.RecordBatch:
    """What chunks ask of buckets, or are answered."""
    n = len(rows["chunk"])
    return pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * n), f.type) for f in SLICE_SCHEMA], schema=SLICE_SCHEMA)


def packed_ids(ids: np.ndarray) -> bytes:
    """Planes of bytes, the lowest first."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked_ids(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def chunk_rows(most_tokens: int):
    """Partition function: a row per chunk from ``doc_id, held_out, text``.

    Words have numbers of the chunk in ``ids``, 1 is the end; ``keys`` are the hashes of the words in the order of their numbers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, kept = 0, 0
        numbers, parts, doc_ids, held = Numbers({END: 1}), [], [], []

        def chunk() -> pa.RecordBatch:
            keys = np.array([xxhash.xxh64_intdigest(w, SEED) for w in numbers], dtype="<u8")
            sizes = [len(p) for p in parts]
            n_train = sum(n for n, h in zip(sizes, held, strict=True) if not h)
            found = {
                "chunk": (TaskContext.get().partitionId() << 32) + made, "n_train": n_train, "doc_ids": doc_ids, "held": held, "sizes": sizes,
                "ids": zlib.compress(packed_ids(np.concatenate(parts)), 1), "keys": keys.tobytes(),
            }
            return pa.RecordBatch.from_pylist([found], schema=CHUNK_SCHEMA)

        for batch in batches:
            for doc_id, out, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"].to_pylist(), strict=True):
                parts.append(np.array([*map(numbers.__getitem__, words_of(text)), 1], dtype="<i8"))
                doc_ids.append(doc_id)
                held.append(out)
                kept += len(parts[-1])
                if kept >= most_tokens:
                    yield chunk()
                    made, kept = made + 1, 0
                    numbers, parts, doc_ids, held = Numbers({END: 1}), [], [], []
        if parts:
            yield chunk()
        give_back()

    return run


def before(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The previous word of each position (the end at a text's start), the one before that (0 if none), and the starts."""
    start = np.cumsum(sizes) - sizes
    one = np.empty_like(ids)
    one[1:] = ids[:-1]
    one[start] = end
    two = np.empty_like(ids)
    two[1:] = one[:-1]
    two[start] = 0
    return one, two, start


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in the sorted ``keys``, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Hashes of whole numbers."""
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(1)


def spans(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal buckets."""
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def bucket_of_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def word_requests(buckets: int):
    """Partition function: each chunk's words by their hashes, with their occurrences in training texts and in all of its texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                ids = unpacked_ids(chunk["ids"]) - 1
                train = np.repeat(~np.array(chunk["held"], dtype=bool), chunk["sizes"])
                keys = np.frombuffer(chunk["keys"], dtype="<u8")
                order = np.argsort(keys, kind="stable")
                every = np.bincount(ids, minlength=len(keys))[order]
                n = np.bincount(ids[train], minlength=len(keys))[order]
                keys = keys[order]
                bucket = bucket_of_hash(keys, buckets)
                parts = spans(bucket)
                yield slices({
                    "chunk": [chunk["chunk"]] * len(parts), "bucket": [int(bucket[a]) for a, _ in parts],
                    "keys": [packed_keys(keys[a:b]) for a, b in parts], "n": [packed(n[a:b], every[a:b]) for a, b in parts],
                })
        give_back()

    return run


def number_words(buckets: int, most: int):
    """Partition function: number, count in training texts and spread of each word asked for, from rows sorted by bucket and chunk.

    Frequent words have small numbers. The spread is the number of buckets a word's n-grams are dealt to: one per ``most`` occurrences.
    ``kinds`` has the words of training texts, at one row of each bucket.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket"], least=1):
            keys = [unpacked_keys(raw) for raw in group["keys"].to_pylist()]
            edges = np.cumsum([0, *map(len, keys)]).tolist()
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            n, every = (np.bincount(at, weights=np.concatenate(x)).astype(np.int64) for x in zip(*map(unpacked, group["n"].to_pylist()), strict=True))
            bucket = group["bucket"].to_pylist()
            number = np.empty(len(n), dtype=np.int64)
            number[np.argsort(-every, kind="stable")] = np.arange(len(n)) * buckets + bucket[0] + 1
            spread = np.minimum(every // most + 1, buckets)
            places = [at[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield slices({
                "chunk": group["chunk"].to_pylist(), "bucket": bucket, "kinds": [int((n > 0).sum()), *[0] * (len(keys) - 1)],
                "n": [packed(number[p], n[p], spread[p]) for p in places],
            })
        give_back()

    return run


class Grams:
    """The n-grams of a chunk as units, pairs and triples.

    Words have the chunk's numbers. A unit is a history word, or one of the buckets it is dealt to; pairs are coded as unit * 2^32 +
    second word, triples as (place of the pair) * 2^32 + third word, 0 for the end of a text and for words too rare for a kept triple.
    N-grams with a word seen less than ``LEAST`` times are never kept and left out. A pair of two very frequent words is a unit of its own too: its
    pairs have the third words, and its triples below its first word have third word 0.
    """

    def __init__(self, chunk: dict, buckets: int):
        self.ids = unpacked_ids(chunk["ids"])
        self.sizes = np.array(chunk["sizes"], dtype=np.int64)
        keys = np.frombuffer(chunk["keys"], dtype="<u8")
        n_words = len(keys)
        words = np.zeros((3, n_words + 1), dtype=np.int64)
        words[:, np.argsort(keys, kind="stable") + 1] = np.concatenate([unpacked(x["n"]) for x in chunk["words"]], axis=1)
        self.number, self.n, spread = words
        one, _, start = before(self.ids, self.sizes, 1)
        after = np.append(self.ids[1:], 0)
        after[start + self.sizes - 1] = 0
        known = self.n >= LEAST
        at = np.flatnonzero(known[one] & known[self.ids])
        a, b = one[at], self.ids[at]
        c = np.where(known[after[at]], after[at], 0)
        train = np.repeat(~np.array(chunk["held"], dtype=bool), self.sizes)[at]
        hashes = mixed(self.number).astype(np.int64)

        # Units: words, then pairs of very frequent words, in all buckets that each is dealt to.
        word = np.flatnonzero(known)
        hot = np.flatnonzero(np.minimum(spread[a], spread[b]) >= SHARE)
        self.hot_pairs, hot_at = np.unique((a[hot] << 32) | b[hot], return_inverse=True)
        hot_a, hot_b = self.hot_pairs >> 32, self.hot_pairs & 0xFFFFFFFF
        hot_spread = np.minimum(spread[hot_a], spread[hot_b]) // SHARE + 1
        # Frequent words have small numbers: two of them fit 62 bits.
        names = np.concatenate([self.number[word], (1 << 62) | (self.number[hot_a] << 31) | self.number[hot_b]])
        times = np.concatenate([spread[word], hot_spread])
        first = np.cumsum(times) - times
        owner = np.repeat(np.arange(len(names)), times)
        bucket = ((mixed(names) % np.uint64(buckets)).astype(np.int64)[owner] + np.arange(len(owner)) - first[owner]) % buckets
        order = np.lexsort((names[owner], bucket))
        self.bucket, self.names, self.owner = bucket[order], names[owner][order], owner[order]
        place = np.empty(len(owner), dtype=np.int64)
        place[order] = np.arange(len(owner))
        self.word, self.n_word_units = word, len(word)

        begin = np.zeros(n_words + 1, dtype=np.int64)
        begin[word] = first[: len(word)]
        unit = place[begin[a] + hashes[b] % spread[a]]
        inner = c[hot] > 0
        hot_c, hot_at = c[hot][inner], hot_at[inner]
        c[hot] = 0
        unit = np.concatenate([unit, place[first[len(word) :][hot_at] + hashes[hot_c] % hot_spread[hot_at]]])
        train = np.concatenate([train, train[hot][inner]])
        self.pairs, pair_at = np.unique((unit << 32) | np.concatenate([b, hot_c]), return_inverse=True)
        self.triples, triple_at = np.unique((pair_at << 32) | np.concatenate([c, np.zeros_like(hot_c)]), return_inverse=True)
        self.count = np.bincount(triple_at[train], minlength=len(self.triples))
        self.unit, self.second = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        self.pair, self.third = self.triples >> 32, self.triples & 0xFFFFFFFF

    def requests(self, chunk: int) -> pa.RecordBatch:
        """A row per bucket: names of units, numbers of second words, numbers and counts of third words."""
        of_unit = np.bincount(self.unit, minlength=len(self.names))
        of_pair = np.bincount(self.pair, minlength=len(self.pairs))
        pair_edge, triple_edge = np.append(0, np.cumsum(of_unit)), np.append(0, np.cumsum(of_pair))
        second, third = self.number[self.second], self.number[self.third]
        parts, rows = spans(self.bucket), []
        for a, b in parts:
            p, q = pair_edge[a], pair_edge[b]
            t, u = triple_edge[p], triple_edge[q]
            rows.append(packed(np.diff(self.names[a:b], prepend=0), of_unit[a:b], second[p:q], of_pair[p:q], third[t:u], self.count[t:u]))
        return slices({"chunk": [chunk] * len(parts), "bucket": [int(self.bucket[a]) for a, _ in parts], "n": rows})


def gram_requests(buckets: int):
    """Partition function: what each chunk asks and counts of its n-grams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                yield Grams(chunk, buckets).requests(chunk["chunk"])
        give_back()

    return run


def codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Both in one number; numbers of words over 32 bits by their places."""
    if second.max(initial=0) >> 32:
        second = np.unique(second, return_inverse=True)[1] + 1
    return (first << 32) | second


def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partition function: answers to each chunk, from rows sorted by bucket and chunk.

    What the kept pairs take from each unit (four times the count less discount), the count of each pair and what the kept triples take
    from it, and the count of each triple.
    """
    for group in groups_of(batches, ["bucket"], least=1):
        found = [unpacked(raw) for raw in group["n"].to_pylist()]
        names, of_unit, second, of_pair, third, count = (np.concatenate(x) for x in zip(*found, strict=True))
        unit_edge, pair_edge, triple_edge = (np.cumsum([0, *(len(x[k]) for x in found)]).tolist() for k in (0, 2, 4))
        names = np.concatenate([np.cumsum(x[0]) for x in found])
        del found
        units, unit_at = np.unique(names, return_inverse=True)
        pairs, pair_at = np.unique(codes(np.repeat(unit_at, of_unit), second), return_inverse=True)
        rest = third == 0
        triples, triple_at = np.unique(np.where(rest, np.repeat(pair_at, of_pair) << 32, codes(np.repeat(pair_at, of_pair), third)), return_inverse=True)
        n = np.bincount(triple_at, weights=count, minlength=len(triples)).astype(np.int64)
        pair_n = np.bincount(triples >> 32, weights=n, minlength=len(pairs)).astype(np.int64)
        n[(triples & 0xFFFFFFFF) == 0] = 0
        taken = lambda x: np.where(x >= LEAST, 4 * x - round(4 * DISCOUNT), 0)
        pair_taken = np.bincount(triples >> 32, weights=taken(n), minlength=len(pairs)).astype(np.int64)
        unit_taken = np.bincount(pairs >> 32, weights=taken(pair_n), minlength=len(units)).astype(np.int64)
        rows = []
        for k in range(len(group)):
            u, p, t = (x[edge[k] : edge[k + 1]] for x, edge in ((unit_at, unit_edge), (pair_at, pair_edge), (triple_at, triple_edge)))
            rows.append(packed(unit_taken[u], pair_n[p], pair_taken[p], n[t]))
        yield slices({"chunk": group["chunk"].to_pylist(), "bucket": group["bucket"].to_pylist(), "n": rows})
    give_back()


class Automaton:
    """States: 0 the root, a word's number, then the kept pairs.

    Arcs of the root are ``root_log`` by word; those of other states are sorted keys (state * 2^32 + word) with log10
    probabilities and targets. ``weight`` is the log10 weight of a state's failure arc, ``fail`` its target. ``taken``: what the kept
    n-grams of the corpus take from each word and each pair, if other than those given.
    """

    def __init__(self, words: np.ndarray, total: int, kinds: int, pairs: np.ndarray, pair_n: np.ndarray, triples: np.ndarray, triple_n: np.ndarray, end: int, taken: tuple[np.ndarray, np.ndarray] | None = None):
        n_words = len(words)
        self.end, self.n_words = end, n_words
        p_word = np.concatenate([[1.0], (words + 0.5) / (total + 0.5 * (kinds + 1))])
        count = np.concatenate([[1.0], words.astype(float)])
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        seen = (pair_n - DISCOUNT) / count[first]
        left = 1.0 - np.bincount(first, weights=seen, minlength=n_words + 1)
        if taken is not None:
            left = 1.0 - np.concatenate([[0.0], taken[0]]) / np.maximum(count, 1.0)
        p_pair = seen + left[first] * p_word[second]
        state, third = triples >> 32, triples & 0xFFFFFFFF
        seen = (triple_n - DISCOUNT) / pair_n[state] if len(triples) else np.zeros(0)
        pair_left = 1.0 - np.bincount(state, weights=seen, minlength=len(pairs)) if taken is None else 1.0 - taken[1] / pair_n
        below = find(pairs, (second[state] << 32) | third) if len(triples) else np.zeros(0, np.int64)
        p_triple = seen + pair_left[state] * p_pair[below] if len(triples) else np.zeros(0)
        self.root_log = np.log10(p_word)
        self.root_log[0] = 0.0
        tiny = 1e-300
        self.weight = np.log10(np.maximum(tiny, np.concatenate([[1.0], left[1:], pair_left])))
        self.fail = np.concatenate([np.zeros(n_words + 1, np.int64), second]).astype(np.int64)
        self.keys = np.concatenate([pairs, ((state + n_words + 1) << 32) | third])
        self.logs = np.log10(np.concatenate([p_pair, p_triple]))
        pair_state = np.arange(len(pairs)) + n_words + 1
        self.target = np.concatenate([pair_state, pair_state[below] if len(triples) else np.zeros(0, np.int64)])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.logs, self.target = self.keys[order], self.logs[order], self.target[order]
        self.pairs = pairs

    def states(self, ids: np.ndarray, one: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The state before each position: the longest kept suffix of the words so far; the end's state at a start."""
        after = np.where(ids > 0, ids, 0)
        both = np.flatnonzero((one > 0) & (ids > 0))
        at = find(self.pairs, (one[both] << 32) | ids[both])
        after[both[at >= 0]] = at[at >= 0] + self.n_words + 1
        state = np.empty_like(after)
        state[1:] = after[:-1]
        state[start] = self.end
        return state

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability per text; an unknown word (0) adds the failure weights only."""
        one, _, start = before(ids, sizes, self.end)
        state = self.states(ids, one, start)
        out = np.zeros(len(ids))
        todo = np.arange(len(ids))
        while len(todo):
            s, w = state[todo], ids[todo]
            root = s == 0
            out[todo[root]] += self.root_log[w[root]]
            todo, s, w = todo[~root], s[~root], w[~root]
            at = np.full(len(todo), -1)
            known = w > 0
            at[known] = find(self.keys, (s[known] << 32) | w[known])
            hit = at >= 0
            out[todo[hit]] += self.logs[at[hit]]
            todo, s = todo[~hit], s[~hit]
            out[todo] += self.weight[s]
            state[todo] = self.fail[s]
        return np.add.reduceat(out, start) if len(ids) else np.zeros(len(sizes))


def automaton_of(grams: Grams, answers: list[bytes], total: int, kinds: int) -> Automaton:
    """The automaton of a chunk's n-grams with the weights of the corpus."""
    found = [unpacked(x) for x in answers]
    taken, pair_n, pair_taken, triple_n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
    owned = np.bincount(grams.owner, weights=taken, minlength=grams.n_word_units + len(grams.hot_pairs))
    word_taken = np.zeros(len(grams.n))
    word_taken[grams.word] = owned[: grams.n_word_units]
    owner = grams.owner[grams.unit]
    plain = owner < grams.n_word_units

    kept = np.flatnonzero(plain & (pair_n >= LEAST))
    pairs = (grams.word[owner[kept]] << 32) | grams.second[kept]
    order = np.argsort(pairs, kind="stable")
    kept, pairs = kept[order], pairs[order]
    place = np.full(len(pair_n), -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    below = pair_taken[kept] / 1.0
    hot = find(pairs, grams.hot_pairs)
    below[hot[hot >= 0]] = owned[grams.n_word_units :][hot >= 0]

    triples = np.flatnonzero(triple_n >= LEAST)
    hot_triples = np.flatnonzero(~plain & (pair_n >= LEAST))
    states = np.concatenate([place[grams.pair[triples]], hot[owner[hot_triples] - grams.n_word_units]])
    third = np.concatenate([grams.third[triples], grams.second[hot_triples]])
    return Automaton(
        grams.n[1:], total, kinds, pairs, pair_n[kept], (states << 32) | third, np.concatenate([triple_n[triples], pair_n[hot_triples]]), 1,
        (word_taken[1:] / 4, below / 4),
    )


def score_rows(total: int, kinds: int, buckets: int, schema: pa.Schema):
    """Partition function: the scores of the texts of each chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                grams = Grams(chunk, buckets)
                automaton = automaton_of(grams, [x["n"] for x in chunk["grams"] or []], total, kinds)
                start = np.cumsum(grams.sizes) - grams.sizes
                base = np.add.reduceat(automaton.root_log[grams.ids], start)
                known = np.add.reduceat((grams.n[grams.ids] > 0).astype(np.int64), start)
                columns = [chunk["doc_ids"], chunk["held"], grams.sizes, known, [total] * len(start), base, automaton.score(grams.ids, grams.sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        give_back()

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """Score of every row of ``docs`` (``doc_id, text``) under a model of those whose crc32 of the id modulo 5 is not 1.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Words are runs of anything but ASCII white
    space, A-Z lower-cased; each text has one end, counted as a token (null texts have just that). N-grams seen once are
    not kept in the automaton. Without training rows nothing is known and both scores are those of unknown words. Other columns are ignored.
    """
    spark = prepared(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 1).alias("held_out"), "text")
    chunks = placed(rows.mapInArrow(chunk_rows(CHUNK_TOKENS), CHUNK), "lm-chunks", "chunk", parts)
    facts = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.lit(0))).first()
    total, tokens = facts
    buckets = max(parts, tokens // BUCKET_TOKENS)
    most = max(LEAST_SPREAD, tokens // (SHARE * buckets))

    def answers(requests: DataFrame, work, name: str) -> DataFrame:
        sorted_rows = requests.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
        found = F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias(name)
        return sorted_rows.mapInArrow(work, SLICE).groupBy("chunk").agg(F.sum("kinds").alias("kinds"), found)

    words = answers(chunks.mapInArrow(word_requests(buckets), SLICE), number_words(buckets, most), "words")
    words = placed(words, "lm-words", "chunk", parts)
    kinds = words.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    numbered = chunks.join(words.drop("kinds"), "chunk")
    grams = answers(numbered.mapInArrow(gram_requests(buckets), SLICE), add_up, "grams").drop("kinds")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
         ("base_score", pa.float64()), ("score", pa.float64())]
    )
    # A chunk without a word seen LEAST times asks for nothing.
    return numbered.join(grams, "chunk", "left").mapInArrow(
        score_rows(total, kinds, buckets, schema),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
