"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, work_folder

# Rows and bytes of one Arrow batch: long texts must not meet in one batch by the thousand.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

# Words as the contracts define them: runs of anything but ASCII white space. bytes.split() does the same.
WORD = r"[^\x20\x09-\x0D]+"


def by_value(name: str) -> None:
    """Ship a module's worker functions with the job, so that executors need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def prepared(spark: SparkSession) -> SparkSession:
    """Arrow batch sizes for the Python stages."""
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return materialize(df, work_folder(df.sparkSession, label))


def placed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like ``stage``, in buckets by ``key``: joins on it do not shuffle these rows. They are written where they are, so they should be few and large."""
    spark = df.sparkSession
    name = f"training_text_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", work_folder(spark, label)).saveAsTable(name)
    return spark.table(name)


def restored(kind: type, state: dict):
    """An object from its broadcast ``vars()``: classes of this package need not be importable on executors."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def lookup(staged: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A narrow staged table as the small side of a join: broadcast up to ``most_rows`` rows, else joined by a shuffle.

    The count comes from the file footers.
    """
    return F.broadcast(staged) if staged.count() <= most_rows else staged


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def word_count(text: Column | str) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_batches(
    df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """Map Arrow batches through ``work`` (columns as lists in, columns as lists out)."""
    wanted = pa_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch.to_pydict())
            yield pa.RecordBatch.from_pydict(out, schema=wanted)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    """Arrow schema of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def id_ranges(rows: DataFrame, order: str, rows_per_range: int) -> list[int]:
    """Split points of the long column ``order`` into ranges of about ``rows_per_range`` rows, at least one per shuffle partition."""
    n_rows = rows.count()
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // rows_per_range)
    if ranges < 2 or not n_rows:
        return []
    points = [k / ranges for k in range(1, ranges)]
    found = rows.agg(F.percentile_approx(order, points, F.lit(max(10_000, 10 * ranges))).alias("s")).first()["s"]
    return sorted(set(found or []))


def range_of(value: Column, splits: list[int]) -> Column:
    """Number of split points at or below ``value``, by two short searches."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    listed = [f"array({', '.join(f'{s}L' for s in g)})" for g in groups]
    coarse = F.expr(f"array({', '.join(f'{s}L' for s in splits[::step])})")
    fine = F.expr(f"array({', '.join(listed)})")
    group = F.size(F.filter(coarse, lambda s: s <= value))
    inside = F.size(F.filter(F.get(fine, group - 1), lambda s: s <= value))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inside).cast("int")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes, as many as the largest needs."""
    values = np.asarray(values, dtype="<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).data, 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view("<i8")


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages, and what they keep counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def worker_store() -> dict:
    """A dict that lives as long as the Python worker: functions shipped by value keep nothing between tasks."""
    module = sys.modules.setdefault("_training_text_store", types.ModuleType("_training_text_store"))
    return vars(module).setdefault("held", {})


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 2) -> Iterator[pa.Table]:
    """Runs of at least ``least`` rows with equal keys, from rows sorted by them; holds one group and one batch."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        columns = [rows[k].to_numpy() for k in keys]
        change = np.zeros(len(rows), dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        bounds = [0, *starts, len(rows)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            inner = 0 < a and b < len(rows)
            if inner:
                if b - a >= least:
                    yield rows.slice(a, b - a)
                continue
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                if sum(map(len, held)) >= least:
                    yield pa.concat_tables(held)
                held = []
            held, held_key = [*held, rows.slice(a, b - a)], key
    if held and sum(map(len, held)) >= least:
        yield pa.concat_tables(held)
