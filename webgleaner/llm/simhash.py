"""SimHash near-duplicates with BK-trees.

A fingerprint bit is the majority of that bit over the hashes of all word shingles. Close fingerprints are found in
BK-trees, whose children hang on their parent by the integer Hamming distance: a search within a radius r that stands at
distance d from a node follows only the edges d - r to d + r.

The trees cannot be broadcast whole, since together they hold all fingerprints. They are built per shard, and a shard goes
to one task: fingerprints that agree in all but ``radius`` of their blocks share a shard, and two fingerprints within the
radius always do (their differing bits touch ``radius`` blocks at most).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, give_back, groups_of, lookup, pa_schema, placed, prepared, stage
from .components import components
from .set_join import heads_of, joined_sets

by_value(__name__)

SEED = 42
LANES = 4  # 64-bit words of the wide fingerprint
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words (A-Z lower-cased, joined by a space); fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    first = [0, *ends[: len(last) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; none: 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        raw = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def lane(hashes: np.ndarray, number: int) -> np.ndarray:
    """Independent 64 bits from each hash; lane 0 is the hash itself."""
    if number == 0:
        return hashes
    h = (hashes + np.uint64(number)) * np.uint64(MIX[number])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX[number - 1])
    return h ^ (h >> np.uint64(32))


class BKTree:
    """Integers by Hamming distance; ``add`` returns what lies within the radius of the new value."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def near(self, value: int) -> list[int]:
        """Numbers of the values within the radius."""
        found, todo, radius = [], [0] if self.values else [], self.radius
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            edges = self.edges[node]
            if len(edges) <= 2 * radius:
                todo.extend(child for at, child in edges.items() if -radius <= at - d <= radius)
            else:
                todo.extend(edges[at] for at in range(d - radius, d + radius + 1) if at in edges)
        return found

    def insert(self, value: int) -> int:
        """Add a value and return its number."""
        number = len(self.values)
        self.values.append(value)
        self.edges.append({})
        if number:
            node = 0
            while True:
                d = (self.values[node] ^ value).bit_count()
                following = self.edges[node].get(d)
                if following is None:
                    self.edges[node][d] = number
                    break
                node = following
        return number


def spanning_links(values: list[int], radius: int, fits=None) -> list[tuple[int, int]]:
    """Links that join all values within the radius of each other, directly or by steps: at most one fewer than values."""
    tree, root, links = BKTree(radius), [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for value in values:
        close = tree.near(value)
        me = tree.insert(value)
        root.append(me)
        for other in close:
            a, b = find(me), find(other)
            if a != b and (fits is None or fits(me, other)):
                root[b] = a
                links.append((me, other))
    return links


def tree_pairs(lanes: np.ndarray, radius: int, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """A node and the values within the radius of it, for each node of a BK-tree over rows of 64-bit words that has any.

    The tree holds the first values and is searched for all others; with 0 first it holds all, and each pair comes once. The tree is
    built and searched in one go: the values below a node are dealt to its children by distance, and so are the values searched for, as many as may have a match there.
    """
    todo = [(np.arange(first or len(lanes)), np.arange(first, len(lanes)))]
    while todo:
        below, asked = todo.pop()
        node, below = below[0], below[1:]
        if not first:
            asked = asked[asked > node]
        far = np.bitwise_count(lanes[asked] ^ lanes[node]).sum(axis=1, dtype=np.int64)
        near = asked[far <= radius]
        if len(near):
            yield int(node), near
        if not len(below) or not len(asked):
            continue
        edges = np.bitwise_count(lanes[below] ^ lanes[node]).sum(axis=1, dtype=np.int64)
        for at in np.unique(edges).tolist():
            following = asked[np.abs(far - at) <= radius]
            if len(following):
                todo.append((below[edges == at], following))


def block_links(lanes: np.ndarray, sizes: np.ndarray, radius: int, similarity: float, first: int) -> list[tuple[int, int]]:
    """Links that join all fitting values within the radius of each other (rows of 64-bit words), directly or by steps.

    Pairs are of one value among the first and one among the others, found in a BK-tree of the first; with 0 first all pairs count.
    """
    label, links = np.arange(len(lanes)), []
    for i, near in tree_pairs(lanes, radius, first):
        near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i])]
        roots, where = np.unique(label[near], return_index=True)
        for root, j in zip(roots.tolist(), near[where].tolist(), strict=True):
            if root != label[i]:
                links.append((i, j))
                label[label == root] = label[i]
    return links


def fingerprint_rows(width: int, schema: pa.Schema):
    """Partition function: ``doc_id, fingerprint`` from ``doc_id, text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([majority(shingle_hashes(t, width)) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bits.view(np.int64))], schema=schema)
        give_back()

    return run


def tree_links(radius: int, schema: pa.Schema):
    """Partition function: links ``a, b`` from rows ``mask, part, fingerprint`` sorted by shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for group in groups_of(batches, ["mask", "part"]):
            values = group["fingerprint"].to_numpy()
            whole = values.view(np.uint64).tolist()
            for a, b in spanning_links(whole, radius):
                left.append(values[a])
                right.append(values[b])
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)
        give_back()

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (a signed long) per row of ``docs``; null or wordless texts have fingerprint 0."""
    prepared(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(fingerprint_rows(width, schema), "doc_id long, fingerprint long")


def masks(radius: int, blocks: int = 8) -> list[int]:
    """Bit masks that leave out ``radius`` of the blocks, as signed longs."""
    size = 64 // blocks
    block = [((1 << size) - 1) << (size * i) for i in range(blocks)]
    out = [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def close_links(distinct: DataFrame, radius: int = 2, blocks: int = 8) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints within the radius (``fingerprint``: distinct longs).

    With 8 blocks of 8 bits and radius 2 every fingerprint is in 28 shards, and the members of a shard agree in 48 bits: a
    tree has at most 65,536 nodes, whatever the table holds. Each shard gives a spanning set of links, not all pairs.
    """
    spark = distinct.sparkSession
    listed = F.array(*(F.lit(m).cast("long") for m in masks(radius, blocks)))
    sharded = distinct.select("fingerprint", F.explode(listed).alias("mask")).withColumn(
        "part", F.col("fingerprint").bitwiseAND(F.col("mask"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = sharded.repartition(parts, "mask", "part").sortWithinPartitions("mask", "part")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return placed.select("mask", "part", "fingerprint").mapInArrow(tree_links(radius, schema), "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs`` (``doc_id, text``).

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest doc_id that links reach
    (null if none of them has an id). Equal fingerprints, and so copies and repeated rows, meet as one value before any search. Other columns are ignored.
    """
    marked = stage(fingerprints(docs, width), "fingerprints")
    values = stage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprint-values")
    roots = components(close_links(values.select("fingerprint"), radius))
    rooted = values.join(roots, values["fingerprint"] == roots["id"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first_id"
    )
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select(F.col("fingerprint").alias("_value"), "component_id")
    return marked.join(named, marked["fingerprint"] == named["_value"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- wide fingerprints: near copies by estimated similarity -----------------------------------------------------------

TABLES, KEY_BITS = 24, 20
TREE_NODES = 4096


CHUNK_MEMBERS = 1 << 19
CHUNK = (
    "chunk long, ids array<long>, wides array<binary>, counts array<long>, marks array<long>, sizes array<long>, shingles binary"
)


def chunk_rows(width: int, members: int, schema: pa.Schema):
    """Partition function: texts (``doc_id, text``) in chunks of about ``members`` distinct shingles.

    Of each text its id, wide fingerprint, number of shingles, mark (a hash of the set of its shingles) and number of distinct shingles,
    which lie sorted one text behind the other in ``shingles``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, made = 0, 0

        def chunk() -> pa.RecordBatch:
            number = (TaskContext.get().partitionId() << 32) + made
            *columns, shingles = zip(*held, strict=True)
            values = [number, *map(list, columns), b"".join(shingles)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                hashes = shingle_hashes(text, width)
                wide = b"".join(majority(lane(hashes, i)).to_bytes(8, "little") for i in range(LANES))
                own = np.unique(hashes).astype("<u8").tobytes()
                mark = xxhash.xxh64_intdigest(own, SEED)
                held.append((doc_id, wide, len(hashes), mark - (1 << 64) if mark >> 63 else mark, len(own) // 8, own))
                total += len(own) // 8
                if total >= members or len(held) >= 20_000:
                    yield chunk()
                    held, total, made = [], 0, made + 1
        if held:
            yield chunk()
        give_back()

    return run


def key_bits() -> list[list[int]]:
    """Bit numbers of each table's key, spread over the fingerprint by a fixed rule."""
    rng = np.random.default_rng(7)
    return [rng.permutation(64 * LANES)[:KEY_BITS].tolist() for _ in range(TABLES)]


def table_rows(picked: list[list[int]], schema: pa.Schema):
    """Partition function: a row ``shard, id, wide, n`` per table of each ``id, wide, n``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            raw = np.frombuffer(b"".join(batch["wide"].to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
            for number, chosen in enumerate(picked):
                keys = (bits[:, chosen] << np.arange(KEY_BITS)).sum(axis=1) + (number << KEY_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch["id"], batch["wide"], batch["n"]], schema=schema)

    return run


def wide_links(radius: int, similarity: float, schema: pa.Schema):
    """Partition function: links ``shard, a, b`` between ids with close wide fingerprints and fitting sizes.

    A whole shard gives a spanning set of links. Of a split shard each block of values is a BK-tree that is searched for its own values and, in a
    group of its own, for those of every other block, so that no pair of the shard is missed, by any number of tasks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in groups_of(batches, ["shard", "low", "high"]):
            values = [int.from_bytes(w, "little") for w in group["wide"].to_pylist()]
            ids, sizes = group["id"].to_pylist(), group["n"].to_pylist()

            def fits(i: int, j: int, sizes: list[int] = sizes) -> bool:
                return min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j])

            if group["splits"][0].as_py() == 1:
                found = spanning_links(values, radius, fits)
            else:
                lanes = np.frombuffer(b"".join(group["wide"].to_pylist()), dtype="<u8").reshape(len(group), -1)
                block = group["block"].to_numpy()
                first = 0 if block[0] == block[-1] else int((block == block[0]).sum())
                # A group of two blocks that has rows of one only has nothing to compare.
                one_sided = not first and group["low"][0].as_py() != group["high"][0].as_py()
                found = [] if one_sided else block_links(lanes, group["n"].to_numpy(), radius, similarity, first)
            out.extend((ids[a], ids[b]) for a, b in found)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def near_copy_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 42) -> DataFrame:
    """``doc_id, group_id`` for documents that have a near copy; ``group_id`` is the smallest id of the group.

    Near copies are all pairs whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more (see ``set_join``: none is
    missed). Most are found before by wide SimHashes: unrelated texts differ in about half of the 256 bits, texts of similarity 0.8 in
    about 39, and a pair is taken up to ``radius`` if its fingerprints agree in one of 24 keys of 20 bits. Rows without id are left out, and so
    stay; wordless texts are one group. Shards of over 4096 values are split into blocks, and every block meets every other.
    """
    spark = prepared(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = rows.mapInArrow(chunk_rows(width, CHUNK_MEMBERS, pa_schema(spark, CHUNK)), CHUNK)
    chunks = placed(made, "shingles", "chunk", parts)
    each = F.explode(F.arrays_zip("ids", "wides", "counts", "marks", "sizes", F.sequence(F.lit(0), F.size("ids") - 1).alias("place")))
    each = chunks.select("chunk", each.alias("_text"))
    marked = stage(
        each.selectExpr(
            "_text.ids AS doc_id", "_text.wides AS wide", "_text.counts AS n", "_text.marks AS mark", "_text.sizes AS size", "chunk", "_text.place AS place"
        ),
        "wide",
    )
    values = stage(marked.groupBy("wide", "n").agg(F.min("doc_id").alias("id")), "wide-values")
    near = stage(wide_value_links(values, similarity, radius), "wide-links")
    # Of each set of shingles one text stands for all.
    sets = marked.groupBy("mark").agg(F.min(F.struct("doc_id", "chunk", "place", "size")).alias("_first"))
    sets = stage(sets.select("mark", "_first.*"), "sets")
    equal = marked.groupBy("wide", "n", "mark").agg(F.min("doc_id").alias("_id")).join(values, ["wide", "n"])
    equal = equal.join(sets.select("mark", F.col("doc_id").alias("_set")), "mark")
    links = near.union(equal.select("_id", "id")).union(equal.select("_id", "_set")).where("a != b")
    places = sets.groupBy("chunk").agg(F.collect_list(F.col("place").cast("long")).alias("places"))
    members = sets.agg(F.sum("size")).first()[0] or 0
    roots = joined_sets(heads_of(chunks, places, members, similarity), links, similarity)
    named = values.join(roots, "id", "left").select("wide", "n", F.coalesce("root", "id").alias("group_id"))
    grouped = marked.select("doc_id", "wide", "n").join(named, ["wide", "n"]).select("doc_id", "group_id")
    return grouped


def wide_value_links(values: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links ``a, b`` between ids of ``values`` (``wide, n, id``) whose wide fingerprints are close and whose sizes fit."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_schema = pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("wide", pa.binary()), ("n", pa.int64())])
    sharded = values.select("id", "wide", "n").mapInArrow(
        table_rows(key_bits(), row_schema), "shard long, id long, wide binary, n long"
    )
    hot = sharded.groupBy("shard").agg(F.count("*").alias("_rows")).where(F.col("_rows") > TREE_NODES)
    hot = stage(hot.select("shard", F.ceil(F.col("_rows") / TREE_NODES).cast("long").alias("splits")), "hot-shards")
    split = sharded.join(hot, "shard", "left").fillna({"splits": 1}).withColumn("block", F.pmod(F.xxhash64("id"), "splits"))
    paired = split.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
    paired = paired.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")})
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    dealt = paired.repartition(parts, "shard", "low", "high").sortWithinPartitions("shard", "low", "high", "block", "id")
    dealt = dealt.select("shard", "low", "high", "block", "splits", "id", "wide", "n")
    return dealt.mapInArrow(wide_links(radius, similarity, link_schema), "a long, b long")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id. All columns stay.

    Rows are told apart by their ids: rows with one id stay or go together, equal rows too, and rows without id stay.
    """
    groups = near_copy_groups(docs, **options)
    gone = stage(groups.where("doc_id != group_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    whole = docs.select(F.struct("*").alias("_row"))
    return whole.join(lookup(gone), F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")
