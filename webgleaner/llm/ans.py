"""Token ids in files coded by a static range asymmetric numeral system.

One frequency table, counted over all ids, serves all files. A file holds the ids of a run of documents: a header, the table of its
documents, a directory of blocks (first token, byte offset, size, checksum: the checkpoints from which decoding may start
in parallel) and the blocks. A block is coded on its own by many interleaved lanes: token k belongs to lane k mod LANES,
so that one step codes a token of every lane.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import running_totals
from .alignment import byte_letters
from .common import by_value, give_back, id_ranges, lookup, prepared, range_of, restored, stage, worker_store

by_value(__name__)

MAGIC = b"rANS1\0\0\0"
LANES = 1024
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 20
LOW = 1 << 31  # states stay in [LOW, LOW << 32)
HEADER = "<8sIIQQI"  # magic, scale bits, blocks, documents, tokens, checksum of the frequency table
CHECKPOINT = "<QQIIII"  # first token, byte offset, tokens, bytes, checksum of the bytes, checksum of the ids
KEEP_PIECES = 340_000  # about 60 MB in a worker; the dict grows by half beyond 349,525

# --- tokens -----------------------------------------------------------------------------------------------------------

# Within Latin-1, letters, digits, white space and the rest as the tokenizer's own pre-tokenisation sees them.
LETTER, DIGIT, SPACE = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")


class Pieces(dict):
    """Encoded ids of text pieces that the tokenizer never joins with their neighbours, as bytes."""

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.tokenizer, self.kind = tokenizer, kind

    def __missing__(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        out = self[piece] = np.array(ids, dtype=self.kind).tobytes()
        return out


class ModelPieces(Pieces):
    """The same for pieces as the tokenizer's own steps before its model make them: only the model is asked."""

    def __init__(self, tokenizer, kind: str):
        super().__init__(tokenizer, kind)
        self.model, self.letters = tokenizer.model, {b: letter for letter, b in byte_letters().items()}
        self.code = {"<u2": "H", "<u4": "I"}[kind]

    def __missing__(self, piece: str) -> bytes:
        made = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        out = self[piece] = array(self.code, [t.id for t in made]).tobytes()
        return out


def encoder(tokenizer_json: str, kind: str):
    """Text to id bytes, with a store of known pieces that outlives the task.

    A text within Latin-1 is split like the tokenizer splits it; one with other characters at ASCII white space, over which no
    token reaches; one that may hold a special token is encoded whole.
    """
    from tokenizers import Tokenizer

    store = worker_store()
    key = ("tokenizer", zlib.crc32(tokenizer_json.encode()))
    if key not in store:
        tokenizer = Tokenizer.from_str(tokenizer_json)
        store[key] = (tokenizer, ModelPieces(tokenizer, kind), Pieces(tokenizer, kind))
    tokenizer, pieces, words = store[key]

    def encode(text: str) -> bytes:
        for known in (pieces, words):
            if len(known) > KEEP_PIECES:
                known.clear()
        if "<|" in text:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=kind).tobytes()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(words.__getitem__, re.split("[\t-\r ]+", text)))
        return b"".join(map(pieces.__getitem__, PIECE.findall(text.lower())))

    return encode


def token_rows(tokenizer, kind: str, end_id: int, schema: pa.Schema):
    """Partition function: ``doc_id, ids`` (bytes) from ``doc_id, text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = None, np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            encode = encode or encoder(tokenizer.value, kind)
            ids = [(encode(t) if t else b"") + end for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], schema=schema)

    return run


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, str]:
    """``doc_id, ids`` for every row, ``end_id`` last, and the number type of the ids. Null texts are empty."""
    spark = prepared(docs.sparkSession)
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    largest = max([end_id, *Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values()])
    kind = "<u2" if largest < 1 << 16 else "<u4"
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(rows.mapInArrow(token_rows(shipped, kind, end_id, schema), "doc_id long, ids binary"), "tokens"), kind


# --- frequencies ------------------------------------------------------------------------------------------------------


def count_ids(kind: str, schema: pa.Schema):
    """Partition function: how often each id occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tokenizer and its pieces are not needed any more: they would stay in the idle workers while Spark sorts and writes.
        worker_store().clear()
        give_back()
        counts = np.zeros(1, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch["ids"].to_pylist()), dtype=kind)
            new = np.bincount(ids, minlength=len(counts))
            new[: len(counts)] += counts
            counts = new
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], schema=schema)
        give_back()

    return run


class Frequencies:
    """Frequencies that add up to 2 ** bits, at least 1 for every id that occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.bits = max(12, int(np.ceil(np.log2(max(2, len(ids))))) + 2)
        whole = 1 << self.bits
        self.freq = np.zeros(size, dtype=np.uint64)
        if len(ids):
            share = counts / counts.sum() * (whole - len(ids))
            freq = 1 + np.floor(share).astype(np.int64)
            # What rounding left goes to the largest remainders, in id order among equals.
            spare = whole - int(freq.sum())
            freq[np.lexsort((ids, np.floor(share) - share))[:spare]] += 1
            self.freq[ids] = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(size), self.freq.astype(np.int64)).astype(np.uint32)
        self.checksum = zlib.crc32(self.freq.astype("<u8").tobytes())


def frequencies(tokens: DataFrame, kind: str) -> Frequencies:
    """The table over all ids of ``tokens``; its size is that of the vocabulary."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])
    counted = tokens.select("ids").mapInArrow(count_ids(kind, schema), "id long, n long")
    found = counted.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    return Frequencies(found["id"].to_numpy(), found["n"].to_numpy())


# --- coding -----------------------------------------------------------------------------------------------------------


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    """Lane states, then the words the lanes gave up, in the order in which decoding takes them back."""
    bits = np.uint64(table.bits)
    state = np.full(LANES, LOW, dtype=np.uint64)
    room = np.uint64((LOW >> table.bits) << 32)
    words = []
    for first in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
        step = ids[first : first + LANES]
        freq, x = table.freq[step], state[: len(step)]
        full = x >= room * freq
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        high = x // freq
        state[: len(step)] = (high << bits) + (x - high * freq) + table.start[step]
    return b"".join([state.astype("<u8").tobytes(), *(w.tobytes() for w in reversed(words))])


def decode_block(data: bytes, n_tokens: int, table: Frequencies) -> np.ndarray:
    """The ids of one block."""
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    state = np.frombuffer(data, dtype="<u8", count=LANES).astype(np.uint64)
    words = np.frombuffer(data, dtype="<u4", offset=8 * LANES)
    out, at = np.empty(n_tokens, dtype=np.uint32), 0
    for first in range(0, n_tokens, LANES):
        x = state[: min(LANES, n_tokens - first)]
        slot = x & mask
        symbol = table.symbol[slot]
        out[first : first + len(x)] = symbol
        x = table.freq[symbol] * (x >> bits) + slot - table.start[symbol]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("damaged block: it does not end in its first state")
    return out


def file_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray, table: Frequencies) -> bytes:
    """A file of the ids of some documents. A null id is stored as a flag."""
    blocks, directory, offset = [], [], 0
    for first in range(0, len(ids), BLOCK_TOKENS):
        part = ids[first : first + BLOCK_TOKENS]
        data = encode_block(part, table)
        directory.append(
            struct.pack(CHECKPOINT, first, offset, len(part), len(data), zlib.crc32(data), zlib.crc32(part.astype("<u4").tobytes()))
        )
        blocks.append(data)
        offset += len(data)
    head = struct.pack(HEADER, MAGIC, table.bits, len(blocks), len(sizes), len(ids), table.checksum)
    docs = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array(sizes, dtype="<u8").tobytes()
    docs += np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    body = head + docs + b"".join(directory)
    return body + struct.pack("<I", zlib.crc32(body)) + b"".join(blocks)


def read_file(data: bytes, table: Frequencies) -> tuple[list, np.ndarray, list[tuple]]:
    """Document ids, token counts and block checkpoints of a file."""
    magic, bits, n_blocks, n_docs, _, checksum = struct.unpack_from(HEADER, data)
    if magic != MAGIC or bits != table.bits or checksum != table.checksum:
        raise ValueError("not a file of this frequency table")
    at = struct.calcsize(HEADER)
    doc_ids = np.frombuffer(data, dtype="<i8", count=n_docs, offset=at).tolist()
    sizes = np.frombuffer(data, dtype="<u8", count=n_docs, offset=at + 8 * n_docs).astype(np.int64)
    missing = np.frombuffer(data, dtype=np.uint8, count=n_docs, offset=at + 16 * n_docs)
    at += 17 * n_docs
    points = [struct.unpack_from(CHECKPOINT, data, at + i * struct.calcsize(CHECKPOINT)) for i in range(n_blocks)]
    at += n_blocks * struct.calcsize(CHECKPOINT)
    if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise ValueError("damaged file header")
    return [None if m else d for d, m in zip(doc_ids, missing, strict=True)], sizes, [(*p, at + 4 + p[1]) for p in points]


def read_block(data: bytes, point: tuple, table: Frequencies) -> np.ndarray:
    """The ids of the block at a checkpoint, checked."""
    _, _, n_tokens, n_bytes, data_crc, ids_crc, at = point
    block = data[at : at + n_bytes]
    if zlib.crc32(block) != data_crc:
        raise ValueError("damaged block")
    ids = decode_block(block, n_tokens, table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("block decodes to other ids")
    return ids


def write_rows(table, kind: str, schema: pa.Schema):
    """Partition function: files from rows ``_range, doc_id, ids`` in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that counted nothing may still hold the tokenizer and its pieces.
        worker_store().clear()
        give_back()
        freqs = restored(Frequencies, table.value)
        now, part, size, doc_ids, parts = None, 0, 0, [], []

        def file() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype=kind)
            sizes = [len(p) // np.dtype(kind).itemsize for p in parts]
            image = file_bytes(doc_ids, sizes, ids, freqs)
            return pa.RecordBatch.from_pydict(
                {"range": [now], "part": [part], "n_docs": [len(sizes)], "n_tokens": [len(ids)], "file": [image]}, schema=schema
            )

        for batch in batches:
            for where, doc_id, ids in zip(*(batch[c].to_pylist() for c in ("_range", "doc_id", "ids")), strict=True):
                if parts and (where != now or size >= FILE_TOKENS):
                    yield file()
                    part, size, doc_ids, parts = part + 1 if where == now else 0, 0, [], []
                elif where != now:
                    part = 0
                now = where
                doc_ids.append(doc_id)
                parts.append(ids)
                size += len(ids) // np.dtype(kind).itemsize
        if parts:
            yield file()
        del doc_ids, parts
        give_back()

    return run


def document_rows(table, schema: pa.Schema):
    """Partition function: facts per document read from files (``start, file``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freqs = restored(Frequencies, table.value)
        for batch in batches:
            for start, data in zip(batch["start"].to_pylist(), batch["file"].to_pylist(), strict=True):
                doc_ids, sizes, points = read_file(data, freqs)
                ids = np.concatenate([read_block(data, p, freqs) for p in points]).astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                    schema=schema,
                )
        give_back()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, rows_per_range: int = 20_000) -> tuple[DataFrame, Frequencies]:
    """Encode ``docs`` (``doc_id, text``) and write them in ascending id order; null ids first, equal ids by their tokens.

    Returns the table of files (``range, part, n_docs, n_tokens, start, file``) and the frequency table they share.
    The files are rows of a Parquet table in the shared folder, so that Spark's committer keeps them whole if executors are lost.
    """
    spark = docs.sparkSession
    tokens, kind = encoded(docs, tokenizer_path, end_id)
    table = frequencies(tokens, kind)
    shared = spark.sparkContext.broadcast(vars(table))
    ordered = tokens.withColumn("_order", F.coalesce("doc_id", F.lit(-(1 << 63))))
    splits = id_ranges(ordered, "_order", rows_per_range)
    placed = (
        ordered.withColumn("_range", range_of(F.col("_order"), splits))
        .repartition(len(splits) + 1, "_range")
        .sortWithinPartitions("_range", "_order", "ids")
        .select("_range", "doc_id", "ids")
    )
    schema = pa.schema(
        [("range", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())]
    )
    files = stage(
        placed.mapInArrow(write_rows(shared, kind, schema), "range int, part int, n_docs long, n_tokens long, file binary"),
        "token-files",
    )
    index = files.select("range", "part", "n_tokens")
    index = running_totals(index, [], F.floor(F.col("range") / 1000), [F.col("range"), F.col("part")], {"end": F.col("n_tokens")})
    index = index.select(F.col("range").alias("_r"), F.col("part").alias("_p"), (F.col("end") - F.col("n_tokens")).alias("start"))
    index = lookup(stage(index, "token-index"))
    joined = files.join(index, (F.col("range") == F.col("_r")) & (F.col("part") == F.col("_p")))
    return joined.drop("_r", "_p"), table


def read_tokens(files: DataFrame, table: Frequencies) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from the files; checksums are verified."""
    shared = files.sparkSession.sparkContext.broadcast(vars(table))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return files.select("start", "file").mapInArrow(
        document_rows(shared, schema), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all of ``docs`` and read the files back: ``doc_id, start, n_tokens, ids_crc32`` per row. Other columns are ignored."""
    return read_tokens(*write_tokens(docs, tokenizer_path, end_id))
