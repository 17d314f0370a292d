"""Page snapshots, search results and log lines as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import decode_body

SEARCH_SCHEMA = "query string, results array<struct<url string, title string, content string>>"

LOG_SCHEMA = (
    "timestamp timestamp, level string, logger string, message string, module string, function string, "
    "line int, trace_id string, exception string, url string, duration_ms bigint, fetch_method string, "
    "content_length bigint, query string, _corrupt_record string"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots (page_id, url, html) in Parquet; only the columns used later are read."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_raw_pages(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Raw page files as (path, html, error).

    With ``max_bytes`` larger files are not opened (the limit is pushed down) and come as error rows from the file listing.
    """
    files = spark.read.format("binaryFile").load(path)
    none = F.lit(None).cast("string")
    if max_bytes is None:
        return files.select("path", decode_body(F.col("content")).alias("html"), none.alias("error"))
    read = files.where(F.col("length") <= max_bytes).select("path", decode_body(F.col("content")).alias("html"), none.alias("error"))
    error = F.concat(F.lit("File too large ("), F.col("length").cast("string"), F.lit(" bytes)"))
    return read.unionByName(files.where(F.col("length") > max_bytes).select("path", none.alias("html"), error.alias("error")))


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """Search answers as JSON lines with a query and its results."""
    return spark.read.schema(SEARCH_SCHEMA).json(path)


def search_hits(searches: DataFrame, max_results: Column | int = 5) -> DataFrame:
    """Hits per search, first ``max_results`` in answer order, 1-based ``rank``, missing fields empty.

    The list is cut inside the row, before it is exploded.
    """
    limit = F.lit(max_results) if isinstance(max_results, int) else max_results
    keys = [c for c in searches.columns if c != "results"]
    hits = searches.select(*keys, F.posexplode(F.slice("results", 1, limit)).alias("pos", "hit"))
    return hits.select(
        *keys,
        (F.col("pos") + 1).alias("rank"),
        *(F.coalesce(F.col(f"hit.{c}"), F.lit("")).alias(c) for c in ("url", "title", "content")),
    )


def hit_titles(hits: DataFrame) -> DataFrame:
    """(request_id, url, title): of a URL listed twice in a search the later title counts."""
    return hits.groupBy("request_id", "url").agg(F.max_by("title", "rank").alias("title"))


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON log lines as columns; a line that is not JSON is kept in ``_corrupt_record``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select(F.from_json(F.col(value), LOG_SCHEMA, options).alias("r")).select("r.*")
