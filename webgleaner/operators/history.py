"""Request history: a Parquet table partitioned by kind and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Result keys kept in compact mode, with their types.
COMPACT_KEYS = (
    ("ai_summary", "string"),
    ("total_results", "bigint"),
    ("total_pages", "bigint"),
    ("total_urls", "bigint"),
    ("failed_urls", "bigint"),
    ("success", "boolean"),
    ("extract_mode", "string"),
    ("discovery_method", "string"),
)
# Page size bounds of the listing.
MAX_LIMIT = 200
DEFAULT_LIMIT = 50

HISTORY_SCHEMA = (
    "id string, query_or_url string, params string, status string, result string, result_size int, "
    "error string, created_at timestamp, kind string, dt date"
)


def compact_result(result: Column) -> Column:
    """Keep only the summary keys of a JSON object; other JSON stays as it is."""
    doc = F.try_parse_json(result)
    kept = F.to_json(F.struct(*(F.try_variant_get(doc, f"$.{k}", t).alias(k) for k, t in COMPACT_KEYS)))
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), kept).otherwise(result)


def history_rows(entries: DataFrame, full_content: bool = False, max_query_chars: int | None = None) -> DataFrame:
    """Rows as they are stored: id filled in, empty params NULL, result compacted.

    ``max_query_chars`` cuts longer queries; by default they are stored whole.
    """
    query = F.col("query_or_url")
    result = F.col("result") if full_content else compact_result(F.col("result"))
    created = F.coalesce("created_at", F.current_timestamp())
    return entries.select(
        F.coalesce("id", F.uuid()).alias("id"),
        (query if max_query_chars is None else F.substring(query, 1, max_query_chars)).alias("query_or_url"),
        F.when(~F.trim("params").isin("", "{}", "null"), F.col("params")).alias("params"),
        "status",
        result.alias("result"),
        F.col("result_size").cast("int").alias("result_size"),
        "error",
        created.alias("created_at"),
        "kind",
        F.to_date(created).alias("dt"),
    )


def append_history(
    entries: DataFrame, path: str, full_content: bool = False, max_query_chars: int | None = None
) -> None:
    """Append rows, partitioned by kind and day. Adaptive execution merges small partitions and splits those of hot days by size.

    Files are sorted by id and carry a Bloom filter on it, so that a read of one entry skips the row groups without it.
    """
    rows = history_rows(entries, full_content, max_query_chars).hint("rebalance", "kind", "dt")
    writer = rows.sortWithinPartitions("kind", "dt", "id").write.mode("append").partitionBy("kind", "dt")
    writer.options(**{"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def get_entry(history: DataFrame, entry_id: str, kind: str | None = None, day: str | None = None) -> DataFrame:
    """The entry with params and result as VARIANT beside the text; text that is not JSON stays text.

    ``kind`` and ``day``, where known, prune the read to one partition.
    """
    found = history.where(F.col("id") == entry_id)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if day is not None:
        found = found.where(F.col("dt") == F.to_date(F.lit(day)))
    return found.select(
        "*",
        F.try_parse_json("params").alias("params_json"),
        F.try_parse_json("result").alias("result_json"),
    )


def list_entries(
    history: DataFrame, kind: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0, max_limit: int = MAX_LIMIT
) -> DataFrame:
    """Newest first, ties by id. The filter prunes partitions; the sort keeps limit + offset rows, ``max_limit`` at most."""
    rows = history if not kind else history.where(F.col("kind") == kind)
    size, start = max(1, min(limit, max_limit)), max(0, offset)
    return rows.orderBy(F.desc("created_at"), F.col("id")).offset(start).limit(size)


def retained(history: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Rows inside the retention period; zero or negative days keep everything."""
    if days <= 0:
        return history
    cutoff = (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days))
    # The day predicate prunes partitions, the time predicate is exact.
    return history.where((F.col("dt") >= F.to_date(cutoff)) & (F.col("created_at") >= cutoff))


def purge(history: DataFrame, days: int, staged_path: str, now: Column | None = None) -> int:
    """Write the retained rows to ``staged_path`` (to be swapped in) and return the rows removed."""
    kept = retained(history, days, now)
    kept.write.mode("errorifexists").partitionBy("kind", "dt").parquet(staged_path)
    # Both counts come from file footers.
    left = history.sparkSession.read.schema(HISTORY_SCHEMA).parquet(staged_path).count()
    return history.count() - left
