"""Quartile bucket digest: a fingerprint whose likeness survives edits.

Byte triplets of a sliding window are hashed into buckets and counted. Each bucket becomes two bits: which quarter of the text's own
counts it falls into. A checksum and a logarithmic length code go first. Two digests are compared bucket by bucket; the
difference is bounded by what unrelated texts differ by on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, id_ranges, prepared, range_of

by_value(__name__)

BUCKETS = 1024
# Offsets of the triplets in a window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
# Mean difference of two independent buckets: quarters that are 0, 1, 2, 3 apart cost 0, 1, 2, 6.
COST = np.array([0, 1, 2, 6], dtype=np.float64)
UNRELATED = (6 * 1 + 4 * 2 + 2 * 6) / 16
CHUNK = 1 << 20  # bytes counted at a time


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Bucket counts per text, from whole texts; long ones are counted in overlapping parts."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    numbers, parts, size = [], [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text)), CHUNK):
            # A window belongs to the part it starts in.
            parts.append((text[start : start + CHUNK + 4], min(CHUNK, len(text) - start)))
            numbers.append(number)
            size += len(parts[-1][0])
            if size >= CHUNK:
                _count(parts, numbers, out)
                numbers, parts, size = [], [], 0
    if parts:
        _count(parts, numbers, out)
    return out


def _count(parts: list[tuple[bytes, int]], numbers: list[int], out: np.ndarray) -> None:
    raw = np.frombuffer(b"".join(p for p, _ in parts) + b"\0\0\0\0", dtype=np.uint8)
    sizes = np.array([len(p) for p, _ in parts])
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    at = np.arange(total)
    local = np.repeat(np.arange(len(parts)), sizes)
    start = at - np.repeat(ends - sizes, sizes)
    left = np.repeat(sizes, sizes) - start
    owned = start < np.repeat(np.array([n for _, n in parts]), sizes)
    spread = raw.astype(np.uint32)
    flat = np.zeros(len(parts) * BUCKETS, dtype=np.int64)
    base = local * BUCKETS
    for salt, (a, b, c) in enumerate(TRIPLETS):
        h = spread[a : a + total] * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15 * (salt + 1) & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + spread[b : b + total] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) + spread[c : c + total] * np.uint32(0x165667B1)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x9E3779B1)
        places = base + (h >> np.uint32(22)).astype(np.int64)
        flat += np.bincount(places[owned & (left > c)], minlength=len(flat))
    np.add.at(out, np.array(numbers), flat.reshape(len(parts), BUCKETS))


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two header bytes (checksum, length code) and the quarter of each bucket, per text."""
    counts = bucket_counts(texts)
    ordered = np.sort(counts, axis=1)
    quarter = BUCKETS // 4
    codes = np.zeros(counts.shape, dtype=np.uint8)
    for q in (1, 2, 3):
        codes += counts > ordered[:, q * quarter - 1 : q * quarter]
    header = np.array(
        [(hashlib.sha256(t).digest()[0], min(255, round(8 * np.log2(1 + len(t))))) for t in texts], dtype=np.uint8
    ).reshape(-1, 2)
    return header, codes


def as_text(header: np.ndarray, codes: np.ndarray) -> list[str]:
    """Hexadecimal digests: checksum, length code, then four buckets a byte."""
    quads = codes.reshape(len(codes), -1, 4)
    packed = quads[..., 0] | quads[..., 1] << 2 | quads[..., 2] << 4 | quads[..., 3] << 6
    return [bytes(h).hex() + bytes(p).hex() for h, p in zip(header, packed.astype(np.uint8), strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 - difference / bound, within 0 and 1; 1 only for equal digests.

    Lengths cost their distance in codes beyond one, at most 5 % of the bound; a differing checksum costs one.
    """
    bound = UNRELATED * BUCKETS
    body = COST[np.abs(a[1].astype(np.int8) - b[1].astype(np.int8))].sum(axis=1)
    apart = np.abs(a[0][:, 1].astype(int) - b[0][:, 1].astype(int))
    length = np.minimum(np.maximum(apart - 1, 0) * 4.0, 0.05 * bound)
    check = (a[0][:, 0] != b[0][:, 0]).astype(float)
    return 1.0 - np.minimum(bound, body + length + check) / bound


def compare_digests(a: str, b: str) -> float:
    """Likeness of two digests as text."""

    def parsed(text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(bytes.fromhex(text), dtype=np.uint8)
        codes = (raw[2:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
        return raw[None, :2], codes.reshape(1, -1)

    return float(likeness(parsed(a), parsed(b))[0])


def digest_rows(schema: pa.Schema):
    """Partition function over rows in order (``_bucket, _extra, doc_id, text``): digests of texts and edited texts."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        own = [text.encode("utf-8", "surrogatepass") for _, text, _ in rows]
        after = rows[-1][2].encode("utf-8", "surrogatepass")
        edited = []
        for _, text, following in rows:
            half = len(text) // 2
            edited.append((text[: len(text) - half] + following[:half]).encode("utf-8", "surrogatepass"))
        head, codes = digests([*own, after])
        edit = digests(edited)
        mine, following = (head[:-1], codes[:-1]), (head[1:].copy(), codes[1:].copy())
        # Rows of one call follow each other except where a bucket ends: there the next text is not the next row's.
        for i in range(len(rows) - 1):
            if rows[i][2] is not rows[i + 1][1]:
                h, c = digests([rows[i][2].encode("utf-8", "surrogatepass")])
                following[0][i], following[1][i] = h[0], c[0]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": [doc_id for doc_id, _, _ in rows],
                "n_chars": [len(text) for _, text, _ in rows],
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": as_text(*mine),
                "edited_fingerprint": as_text(*edit),
                "near_edited": likeness(mine, edit),
                "near_next": likeness(mine, following),
            },
            schema=schema,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready, size = None, [], 0
        for batch in batches:
            for bucket, extra, doc_id, text in zip(*(batch[c].to_pylist() for c in ("_bucket", "_extra", "doc_id", "text")), strict=True):
                text = text or ""
                if last is not None and last[0] == bucket:
                    ready.append((last[1], last[2], text))
                    size += len(text)
                    if size >= CHUNK or len(ready) >= 1000:
                        yield emit(ready)
                        ready, size = [], 0
                # The first extra row closes its bucket; it only lends its text.
                last = None if extra else (bucket, doc_id, text)
        if ready:
            yield emit(ready)

    return run


def fingerprint(docs: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Digests of ``docs`` (``doc_id, text``) and of their edited texts, a row per input row.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The edited text is
    the text with its last half replaced by the beginning of the next document's (ascending id; after the last the
    first; a lone document follows itself). Null texts are empty; texts under three bytes have no triplets and all-zero
    buckets; a null id comes before all others; rows of one id are ordered by a hash of their text. Other columns are ignored.

    The texts are shuffled once, into ranges of ids, and read in order; each range also gets the first row of the next one.
    """
    spark = prepared(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_order"),
    )
    splits = id_ranges(rows, "_order", rows_per_bucket)
    ranges = len(splits) + 1
    rows = rows.withColumn("_bucket", range_of(F.col("_order"), splits))
    # One row per range: their number is bounded by ``ranges``.
    firsts = sorted((r["_bucket"], r["_first"]) for r in rows.groupBy("_bucket").agg(F.min("_order").alias("_first")).collect())
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    lent = spark.createDataFrame(before, "_first long, _before int")
    lent = rows.join(F.broadcast(lent), F.col("_order") == F.col("_first"))
    lent = lent.select("doc_id", "text", "_order", F.col("_before").alias("_bucket"), F.lit(True).alias("_extra"))
    both = rows.withColumn("_extra", F.lit(False)).unionByName(lent)
    placed = both.repartition(ranges, "_bucket").sortWithinPartitions("_bucket", "_extra", "_order", F.xxhash64("text"), "text")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    return placed.select("_bucket", "_extra", "doc_id", "text").mapInArrow(
        digest_rows(schema),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
