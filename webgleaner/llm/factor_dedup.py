"""Remove passages that repeat an earlier document, by longest-previous-factor arrays.

The longest previous factor at a position is the longest string starting there that also starts in an earlier document. In
suffix order it is found among two neighbours only: the nearest suffixes before and after it (previous and next smaller
values) that belong to an earlier document. Bytes covered by previous factors of at least ``length`` bytes go; the first copy stays.

One suffix array over a corpus does not fit a cluster's tasks, so it is built in parts, each over the strings that can match:

1. Every window of ``length`` bytes has an anchor, the 16 bytes in it with the smallest hash; neighbouring windows mostly share it,
   equal windows always do. Anchors are exchanged as hashes, counted per task first. One seen in a single document is dropped. The
   others go back to the texts, which are dealt out to places by their ids: one row for each bucket of anchors and place.
2. For the others the text around them is exchanged: all windows of an anchor as one context. Equal contexts meet in the task already.
   A task gets all contexts of its anchors, sorts their window starts into a suffix array and computes the factors.
3. The covered spans go back to their documents.

An anchor with very many different contexts (a phrase that a third of the documents share) is exchanged window by window instead, which
spreads it; the list of such anchors is bounded.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, give_back, groups_of, prepared, stage

by_value(__name__)

LENGTH = 50
ANCHOR = 16
PART = 1 << 19  # bytes hashed at a time
CHUNK = 1 << 24  # bytes of text whose anchors meet before they are exchanged
CONTEXTS = 1 << 23  # bytes of contexts that meet before they are exchanged
SUFFIXES = 1 << 18  # suffixes sorted at a time, about: runs with the same first bytes stay together
MOST_HOT = 1_000_000
# Bits of an anchor's hash that travel beside its bucket: with half a million anchors a bucket, one in 10,000 seems to recur by chance
# alone and is exchanged for nothing.
KEY_MASK = 0xFFFFFFFF
HOT = 20_000
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


# --- arrays as bytes --------------------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, byte planes apart."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((0, 0), np.uint8)
        out.append(struct.pack("<8sQ", a.dtype.str.encode(), len(a)) + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays again."""
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, n = struct.unpack_from("<8sQ", data, at)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        at += 16
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        at += n * kind.itemsize
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
    return out


# --- windows and anchors ----------------------------------------------------------------------------------------------


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Polynomial hashes of all windows of a buffer."""

    def __init__(self):
        self.table = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power = self.inverse = np.zeros(0, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(self.power) < len(raw) + 1:
            size = max(PART + 4096, len(raw) + 1)
            self.power, self.inverse = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            self.power[0] = self.inverse[0] = 1
            self.power, self.inverse = np.cumprod(self.power), np.cumprod(self.inverse)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[raw] * self.power[: len(raw)])])

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        return finished((sums[width:] - sums[:-width]) * self.inverse[: max(0, len(sums) - width)])


def lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def window_runs(parts: list[bytes], length: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: part, first and last window start within it, hash of the anchor."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    grams = hasher.windows(hasher.sums(raw), ANCHOR)
    # Among equal grams the place in the part decides, so that a document has the same runs in any buffer.
    at = (np.arange(len(raw)) - np.repeat(starts, sizes))[: len(grams)].astype(np.uint64)
    low = lowest((grams & ~np.uint64(63)) | (at & np.uint64(63)), length - ANCHOR + 1)
    n_windows = np.maximum(0, sizes - length + 1)
    window = np.repeat(starts - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
    anchor = window + ((low[window].astype(np.int64) - at[window].astype(np.int64)) & 63)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    part = np.repeat(np.arange(len(parts)), n_windows)[first]
    return part, window[first] - starts[part], window[last] - starts[part], grams[anchor[first]]


def document_runs(texts: list[bytes], length: int, hasher: Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole documents: document, number of the run in it, first and last window start, anchor hash.

    Long documents are hashed in parts that overlap by a window, whose borders depend on the document alone.
    """
    parts, owner, offset, size = [], [], [], 0
    seen: dict[int, int] = {}

    def done() -> tuple[np.ndarray, ...]:
        part, first, last, anchor = window_runs(parts, length, hasher)
        doc = np.array(owner, dtype=np.int64)[part]
        begins = run_starts(doc)
        counts = np.diff(np.append(begins, len(doc)))
        number = np.arange(len(doc)) - np.repeat(begins, counts)
        if len(doc):
            number[: counts[0]] += seen.get(int(doc[0]), 0)
            seen[int(doc[-1])] = int(number[-1]) + 1
        shift = np.array(offset, dtype=np.int64)[part]
        return doc, number, first + shift, last + shift, anchor

    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), PART):
            parts.append(text[start : start + PART + length - 1])
            owner.append(i)
            offset.append(start)
            size += len(parts[-1])
            if size >= PART:
                yield done()
                parts, owner, offset, size = [], [], [], 0
    if parts:
        yield done()


# --- first exchange: anchors ------------------------------------------------------------------------------------------


def anchor_rows(length: int, buckets: int, schema: pa.Schema):
    """Partition function: per chunk of texts and bucket, anchors of one document each, and one for those of several.

    Anchors that several documents of the chunk share need no answer; these occurrences travel on as known hits, spread over
    all buckets.
    """

    def flush(ids: list[int], places: list[int], runs: list[tuple]) -> pa.RecordBatch:
        doc, number, anchor = (np.concatenate(c) for c in zip(*runs, strict=True))
        order = np.lexsort((number, doc, anchor))
        doc, number, anchor = doc[order], number[order], anchor[order]
        begins = run_starts(anchor)
        counts = np.diff(np.append(begins, len(anchor)))
        shared = doc[begins] != doc[begins + counts - 1]
        of_shared = np.repeat(shared, counts)
        is_first = np.zeros(len(doc), dtype=bool)
        is_first[begins] = True
        asked = ~of_shared | is_first
        known = np.flatnonzero(of_shared)
        place = ((anchor[asked] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        known_place = doc[known] % buckets
        a_doc, a_number, a_anchor, a_shared = doc[asked], number[asked], anchor[asked], of_shared[asked]
        order = np.lexsort((a_number, a_doc, place))
        known = known[np.lexsort((number[known], doc[known], known_place))]
        known_place = doc[known] % buckets
        edges = np.searchsorted(place[order], np.arange(buckets + 1))
        known_edges = np.searchsorted(known_place, np.arange(buckets + 1))
        all_ids, all_places = np.array(ids, dtype=np.int64), np.array(places, dtype=np.int32)
        out: tuple[list, list] = ([], [])
        for bucket in range(buckets):
            pick, hit = order[edges[bucket] : edges[bucket + 1]], known[known_edges[bucket] : known_edges[bucket + 1]]
            if not len(pick) and not len(hit):
                continue
            used = np.unique(np.concatenate([a_doc[pick], doc[hit]]))
            key = (a_anchor[pick] & np.uint64(KEY_MASK)).astype("<u4")
            out[0].append(bucket)
            out[1].append(
                packed(
                    np.diff(all_ids[used], prepend=0), all_places[used], key, _steps(np.searchsorted(used, a_doc[pick])), _steps(a_number[pick]),
                    a_shared[pick], _steps(np.searchsorted(used, doc[hit])), _steps(number[hit]),
                )
            )
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ids, places, runs, size = Hasher(), [], [], [], 0
        for batch in batches:
            texts = [_bytes(t) for t in batch["text"].to_pylist()]
            for doc, number, _, _, anchor in document_runs(texts, length, hasher):
                runs.append((doc + len(ids), number, anchor))
            ids.extend(batch["_order"].to_pylist())
            places.extend(batch["_place"].to_pylist())
            size += sum(map(len, texts))
            if size >= CHUNK:
                yield flush(ids, places, runs)
                ids, places, runs, size = [], [], [], 0
        if runs:
            yield flush(ids, places, runs)
        give_back()

    return run


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0).astype(np.int32)


def hit_rows(least_hot: int, schema: pa.Schema):
    """Partition function: ``_place, anchors`` (ids of the place's documents and the numbers of their runs that recur) from anchors by bucket.

    A bucket gives one row to each place of texts, however many documents lie there. Anchors with more than ``least_hot`` occurrences are given too, as rows with ``hot``, the low bits of the hash, and the bucket.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket"], least=1):
            bucket = group["bucket"][0].as_py()
            pieces, places, keys, docs, numbers, flags, base = [], [], [], [], [], [], 0
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            for data in group["data"].to_pylist():
                steps, place, key, doc, number, shared, hit_doc, hit_number = unpacked(data)
                keys.append(key)
                docs.append(np.cumsum(doc, dtype=np.int64) + base)
                numbers.append(np.cumsum(number, dtype=np.int64))
                flags.append(shared)
                hits.append((np.cumsum(hit_doc, dtype=np.int64) + base, np.cumsum(hit_number, dtype=np.int64)))
                pieces.append(np.cumsum(steps))
                places.append(place)
                base += len(steps)
            ids, place = np.concatenate(pieces), np.concatenate(places)
            key, doc, number, shared = (np.concatenate(x) for x in (keys, docs, numbers, flags))
            order = np.lexsort((doc, key))
            key, doc, number, shared = key[order], doc[order], number[order], shared[order]
            begins = run_starts(key)
            counts = np.diff(np.append(begins, len(key)))
            recurs = doc[begins] != doc[begins + counts - 1]
            if len(key):
                recurs |= np.add.reduceat(shared.astype(np.int64), begins) > 0
            picked = np.repeat(recurs, counts) & ~shared
            hits.append((doc[picked], number[picked]))
            hit_doc, hit_number = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.lexsort((hit_number, hit_doc, place[hit_doc]))
            hit_doc, hit_number = hit_doc[order], hit_number[order].astype("<u4")
            hot = key[begins[counts > least_hot]].astype(np.int64).tolist()
            edges = [*run_starts(place[hit_doc]).tolist(), len(hit_doc)] if len(hit_doc) else [0]
            found = [(int(place[hit_doc[a]]), packed_hits(ids, hit_doc[a:b], hit_number[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in found] + [None] * len(hot), pa.int32()),
                    pa.array([data for _, data in found] + [None] * len(hot), pa.binary()),
                    pa.array([None] * len(found) + hot, pa.int64()),
                    pa.array([bucket] * (len(found) + len(hot)), pa.int32()),
                ],
                schema=schema,
            )
        give_back()

    return run


def packed_hits(ids: np.ndarray, doc: np.ndarray, number: np.ndarray) -> bytes:
    """Ids of documents, and the numbers of runs of each."""
    begins = run_starts(doc)
    return packed(np.diff(ids[doc[begins]], prepend=0), np.diff(np.append(begins, len(doc))).astype(np.int32), _steps(number))


class Hits:
    """The numbers of recurring runs by document, of one place."""

    def __init__(self, rows: list[bytes]):
        ids, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data in rows:
            steps, counts, number = unpacked(data)
            ids.append(np.repeat(np.cumsum(steps), counts))
            numbers.append(np.cumsum(number, dtype=np.int64))
        self.ids, self.numbers = np.concatenate(ids), np.concatenate(numbers)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.numbers = self.ids[order], self.numbers[order]

    def of(self, order: int) -> np.ndarray:
        return self.numbers[np.searchsorted(self.ids, order) : np.searchsorted(self.ids, order, side="right")]


# --- second exchange: contexts ----------------------------------------------------------------------------------------


def context_rows(length: int, buckets: int, hot: frozenset, schema: pa.Schema):
    """Partition function: contexts of recurring anchors by bucket, from hits and texts sorted by place, hits first.

    Of equal contexts in a task only those of the smallest id travel; the others are covered and travel as known spans.
    """

    def flush(docs: list[tuple[int, int]], found: list[tuple[int, int, int, bytes, int]]) -> pa.RecordBatch:
        first: dict[tuple[int, bytes], int] = {}
        for route, doc, _, context, _ in found:
            key, order = (route, context), docs[doc][0]
            if key not in first or order < first[key]:
                first[key] = order
        placed: dict[int, tuple[list, list]] = {}
        for one in found:
            route, doc, start, context, _ = one
            if docs[doc][0] == first[route, context]:
                placed.setdefault(route % buckets, ([], []))[0].append(one)
            else:
                placed.setdefault(doc % buckets, ([], []))[1].append((doc, start, start + len(context)))
        out: tuple[list, list] = ([], [])
        for bucket, (sent, spans) in placed.items():
            doc = np.array([c[1] for c in sent], dtype=np.int64)
            spans = np.array(spans, dtype=np.int64).reshape(-1, 3)
            used = np.unique(np.concatenate([doc, spans[:, 0]]))
            table = np.array([docs[d] for d in used.tolist()], dtype=np.int64).reshape(-1, 2)
            out[0].append(bucket)
            out[1].append(
                packed(
                    np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1]),
                    _steps(np.searchsorted(used, doc)), np.array([c[2] for c in sent], dtype=np.int64),
                    np.array([len(c[3]) for c in sent], dtype=np.int32),
                    np.frombuffer(b"".join(c[3] for c in sent), dtype=np.uint8),
                    np.searchsorted(used, spans[:, 0]).astype(np.int32), np.ascontiguousarray(spans[:, 1]), np.ascontiguousarray(spans[:, 2]),
                )
            )
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        docs: list[tuple[int, int]] = []
        found: list[tuple[int, int, int, bytes, int]] = []
        waiting: list[tuple[int, int, bytes, np.ndarray]] = []
        held = waiting_size = 0

        def work() -> None:
            nonlocal held
            base = len(docs)
            docs.extend((order, key) for order, key, _, _ in waiting)
            texts = [text for _, _, text, _ in waiting]
            wanted = np.zeros(0, np.int64)
            listed = [(np.full(len(h), i, dtype=np.int64) << 32) | h for i, (_, _, _, h) in enumerate(waiting)]
            wanted = np.sort(np.concatenate(listed))
            for doc, number, start, last, anchor in document_runs(texts, length, hasher):
                key = (doc << 32) | number
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                for k in np.flatnonzero(wanted[at] == key).tolist():
                    a, b, d, route = int(start[k]), int(last[k]), int(doc[k]), int(anchor[k])
                    text = texts[d]
                    if hot and ((route >> 40) % buckets, route & KEY_MASK) in hot:
                        for s in range(a, b + 1):
                            window = text[s : s + length]
                            found.append((xxhash.xxh64_intdigest(window), base + d, s, window, 1))
                    else:
                        found.append((route >> 40, base + d, a, text[a : b + length], b - a + 1))
                    held += b - a + length
            waiting.clear()

        rows: list[bytes] = []
        hits = hits_of = None
        for batch in batches:
            for place, order, key, text, anchors in zip(*(batch[c].to_pylist() for c in ("_place", "_order", "_key", "text", "anchors")), strict=True):
                if place != hits_of:
                    rows, hits, hits_of = [], None, place
                if anchors is not None:
                    rows.append(anchors)
                    continue
                if hits is None:
                    rows, hits = [], Hits(rows)
                numbers = hits.of(order)
                if not len(numbers):
                    continue
                waiting.append((order, key, _bytes(text), numbers))
                waiting_size += len(waiting[-1][2])
                if waiting_size >= PART:
                    work()
                    waiting_size = 0
                if held >= CONTEXTS:
                    yield flush(docs, found)
                    docs, found, held = [], [], 0
        if waiting:
            work()
        if found:
            yield flush(docs, found)
        del docs, found, hits
        give_back()

    return run


# --- factors ----------------------------------------------------------------------------------------------------------


def smaller_before(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Position of the nearest smaller value before each position within its group (-1: none), by pointer jumping."""
    at = np.arange(len(values)) - 1
    inside = (at >= 0) & (groups[at] == groups)
    at = np.where(inside, at, -1)
    todo = np.flatnonzero((at >= 0) & (values[at] >= values))
    final = at.copy()
    while len(todo):
        # Where the pointer stands on a value that is not smaller, that value's own pointer skips all that are not smaller either.
        final[todo] = final[final[todo]]
        todo = todo[(final[todo] >= 0) & (values[final[todo]] >= values[todo])]
    return final


def common_prefix(strings: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j of a byte matrix."""
    same = strings[i] == strings[j]
    return np.where(same.all(axis=1), strings.shape[1], same.argmin(axis=1))


def suffix_order(strings: np.ndarray, hashes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the number of each row's value; only one row of each hash is compared, if its rows are all equal."""
    n, width = strings.shape
    if hashes is None:
        return np.argsort(np.ascontiguousarray(strings).view(f"S{width}").reshape(-1), kind="stable"), np.arange(n)
    _, first, value = np.unique(hashes, return_index=True, return_inverse=True)
    if not np.array_equal(strings, strings[first][value]):
        return suffix_order(strings, None)
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(np.ascontiguousarray(strings[first]).view(f"S{width}").reshape(-1), kind="stable")] = np.arange(len(first))
    return np.argsort(rank[value], kind="stable"), rank[value]


def previous_factors(strings: np.ndarray, docs: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Longest previous factor of each suffix, up to the width of ``strings`` (its first bytes): a row per suffix.

    In suffix order the longest common prefix with a suffix of an earlier document is that with the nearest such suffix
    before or after. Only neighbours with a common first half are searched; shorter factors are reported as 0. ``hashes`` of the rows,
    if given, spare the comparison of equal rows.
    """
    n, width = strings.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    order, value = suffix_order(strings, hashes)
    sorted_strings, sorted_docs, value = strings[order], docs[order], value[order]
    alike = np.zeros(n, dtype=bool)
    alike[1:] = (sorted_strings[1:, : width // 2] == sorted_strings[:-1, : width // 2]).all(axis=1)
    groups = np.cumsum(~alike)
    factor = np.zeros(n, dtype=np.int64)
    for neighbour in (smaller_before(sorted_docs, groups), n - 1 - smaller_before(sorted_docs[::-1], groups[::-1])[::-1]):
        has = np.flatnonzero((neighbour >= 0) & (neighbour < n))
        same = value[has] == value[neighbour[has]]
        factor[has[same]] = width
        has = has[~same & (factor[has] < width)]
        for at in np.array_split(has, len(has) // 200_000 + 1):
            factor[at] = np.maximum(factor[at], common_prefix(sorted_strings, at, neighbour[at]))
    out = np.empty(n, dtype=np.int64)
    out[order] = factor
    return out


def by_first_bytes(text: np.ndarray, at: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places in ``at`` by the first eight bytes of their suffixes, about ``most`` at a time; equal first bytes stay together."""
    if not len(at):
        return
    lead = np.zeros(len(at), dtype=np.uint64)
    for i in range(8):
        lead = (lead << np.uint64(8)) | text[at + i]
    order = np.argsort(lead)
    new = np.append(run_starts(lead[order]), len(at))
    begin = 0
    while begin < len(at):
        end = int(new[min(np.searchsorted(new, begin + most), len(new) - 1)])
        yield order[begin:end]
        begin = end


def context_hashes(text: np.ndarray, sizes: np.ndarray, length: int, hasher: Hasher) -> np.ndarray:
    """Hashes of all windows of contexts that stand one after another, some of the contexts at a time."""
    ends = np.cumsum(sizes)
    out, first = [], 0
    while first < len(sizes):
        begin = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + PART)))
        windows = sizes[first:last] - length + 1
        starts = ends[first:last] - sizes[first:last] - begin
        at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        out.append(hasher.windows(hasher.sums(text[begin : int(ends[last - 1])]), length)[at])
        first = last
    return np.concatenate(out)


def span_rows(length: int, schema: pa.Schema):
    """Partition function: covered spans ``_order, _key, start, size`` from contexts by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for group in groups_of(batches, ["bucket"], least=1):
            orders, keys, docs, starts, sizes, texts, base = [], [], [], [], [], [], 0
            spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for data in group["data"].to_pylist():
                order, key, doc, start, size, text, span_doc, span_start, span_end = unpacked(data)
                orders.append(order)
                keys.append(key)
                docs.append(np.cumsum(doc, dtype=np.int64) + base)
                starts.append(start)
                sizes.append(size.astype(np.int64))
                texts.append(text)
                spans.append((span_doc.astype(np.int64) + base, span_start, span_end))
                base += len(order)
            order, key, doc, start, size, text = (np.concatenate(x) for x in (orders, keys, docs, starts, sizes, texts))
            if len(size):
                ends = np.cumsum(size)
                windows = size - length + 1
                context = np.repeat(np.arange(len(size), dtype=np.int32), windows)
                # Only windows whose hash recurs can have a previous factor of full length.
                hashes = context_hashes(text, size, length, hasher)
                by_hash = np.argsort(hashes)
                same = hashes[by_hash][1:] == hashes[by_hash][:-1]
                again = np.zeros(len(hashes), dtype=bool)
                again[by_hash[1:][same]] = True
                again[by_hash[:-1][same]] = True
                pick = np.flatnonzero(again)
                hashes = hashes[pick]
                del by_hash, same, again
                owner = doc[context[pick]]
                inside = pick - (np.cumsum(windows) - windows)[context[pick]]
                at = (ends - size)[context[pick]] + inside
                full = np.zeros(len(pick), dtype=bool)
                for some in by_first_bytes(text, at, SUFFIXES):
                    strings = np.lib.stride_tricks.sliding_window_view(text, length)[at[some]]
                    full[some] = previous_factors(strings, order[owner[some]], hashes[some]) >= length
                covered, inside = pick[full], inside[full]
                if len(covered):
                    begin = start[context[covered]] + inside
                    new = np.append(True, (context[covered][1:] != context[covered][:-1]) | (begin[1:] != begin[:-1] + 1))
                    first = np.flatnonzero(new)
                    final = np.append(first[1:], len(begin)) - 1
                    spans.append((doc[context[covered[first]]], begin[first], begin[final] + length))
            span_doc, span_start, span_end = (np.concatenate(x) for x in zip(*spans, strict=True))
            if not len(span_doc):
                continue
            # Sorted, so that ids and starts compress well.
            by_doc = np.lexsort((span_start, span_doc))
            span_doc, span_start, span_end = span_doc[by_doc], span_start[by_doc], span_end[by_doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[span_doc]), pa.array(key[span_doc]), pa.array(span_start), pa.array((span_end - span_start).astype(np.int32))],
                schema=schema,
            )
        give_back()

    return run


def merged_spans(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(make: Callable, schema: pa.Schema):
    """Partition function over spans and texts sorted by document: ``make(text bytes, merged spans)`` per text row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = None, []
        for batch in batches:
            out: list[tuple] = []
            for order, key, doc_id, text, start, size in zip(
                *(batch[c].to_pylist() for c in ("_order", "_key", "doc_id", "text", "start", "size")), strict=True
            ):
                if (order, key) != known:
                    known, pairs = (order, key), []
                if size is not None:
                    pairs.append((start, start + size))
                else:
                    out.append((doc_id, *make(_bytes(text), merged_spans(pairs))))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def rest_of(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def digest_of(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """Size, bytes covered, runs covered, and the SHA-256 of the rest."""
    return len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest_of(text, spans)).hexdigest()


# --- the operator -----------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """``_order`` (the id, a null id before all) and ``_key`` (a hash of the text: tells rows with one id apart)."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_order"),
        F.xxhash64("text").alias("_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
    )


def factor_spans(docs: DataFrame, length: int = LENGTH, bytes_per_bucket: int = 1 << 23, hot: int = HOT) -> DataFrame:
    """Covered spans, not merged: ``_order, _key, start, size`` in bytes, a row each (see ``_keyed``).

    A window of ``length`` bytes is covered if it also starts in a row with a smaller id, wherever it stands there. Windows are compared
    byte by byte; hashes only bring candidates together.
    """
    if not ANCHOR < length <= ANCHOR + 48:
        raise ValueError(f"length must be {ANCHOR + 1} to {ANCHOR + 48}")
    spark = prepared(docs.sparkSession)
    rows = _keyed(docs)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(places, n_bytes // bytes_per_bucket)
    rows = rows.withColumn("_place", F.pmod(F.xxhash64("_order"), F.lit(places)).cast("int"))
    blob = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
    anchors = rows.select("_order", "_place", "text").mapInArrow(anchor_rows(length, buckets, blob), "bucket int, data binary")
    anchors = anchors.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    # About n_bytes / 18 anchors in all: at most MOST_HOT of them can have more occurrences than this.
    least_hot = max(hot, n_bytes // 18 // MOST_HOT)
    hit_schema = pa.schema([("_place", pa.int32()), ("anchors", pa.binary()), ("hot", pa.int64()), ("bucket", pa.int32())])
    hits = stage(anchors.mapInArrow(hit_rows(least_hot, hit_schema), "_place int, anchors binary, hot long, bucket int"), "anchor-hits")
    listed = frozenset((r["bucket"], r["hot"]) for r in hits.where("hot is not null").select("bucket", "hot").collect())
    both = rows.select("_place", "_order", "_key", "text", F.lit(None).cast("binary").alias("anchors")).unionByName(
        hits.where("anchors is not null").select("_place", "anchors"), allowMissingColumns=True
    )
    both = both.repartitionById(places, "_place").sortWithinPartitions("_place", F.col("anchors").isNull())
    contexts = both.mapInArrow(context_rows(length, buckets, listed, blob), "bucket int, data binary")
    contexts = contexts.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    span_schema = pa.schema([("_order", pa.int64()), ("_key", pa.int64()), ("start", pa.int64()), ("size", pa.int32())])
    return stage(contexts.mapInArrow(span_rows(length, span_schema), "_order long, _key long, start long, size int"), "factor-spans")


def _with_documents(docs: DataFrame, spans: DataFrame, make: Callable, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    rows = _keyed(docs).select("*", F.lit(None).cast("long").alias("start"), F.lit(None).cast("int").alias("size"))
    marks = spans.select("_order", "_key", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "start", "size")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.unionByName(marks).repartition(parts, "_order").sortWithinPartitions("_order", "_key", F.col("size").isNull())
    schema = pa.schema([("doc_id", pa.int64()), *((n, t) for n, t, _ in fields)])
    return placed.mapInArrow(with_spans(make, schema), "doc_id long, " + ", ".join(f"{n} {t}" for n, _, t in fields))


def factor_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs`` (``doc_id, text``).

    Texts are UTF-8 bytes (null: empty). Rows with one id do not match each other; a null id is smaller than all others; matches within one
    text do not count. Other columns are ignored.
    """
    fields = [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    return _with_documents(docs, factor_spans(docs, length), digest_of, fields)


def without_earlier_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, text`` with the covered passages cut out (a character that is cut in two becomes U+FFFD)."""

    def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[str]:
        return (rest_of(text, spans).decode("utf-8", "replace"),)

    return _with_documents(docs, factor_spans(docs, length), cut, [("text", pa.string(), "string")])
