"""Counters and duration histograms over result and log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Histogram bounds in seconds per stage.
BUCKETS = {
    "search": (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0),
    "scrape": (0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0),
    "summarize": (1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0),
    "extract": (2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0),
}


def counter(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Number of rows per label combination."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def counter_with_totals(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counts per label combination and for every prefix of the labels (NULL = all)."""
    return rows.rollup(*labels).agg(F.count(F.lit(1)).alias("total"))


def scrape_counter(results: DataFrame) -> DataFrame:
    """Scrapes by fetch_method and status."""
    status = F.when(F.col("fetch_method").endswith("-failed"), "failure").otherwise("success")
    return counter(results.withColumn("status", status), ["fetch_method", "status"])


def histogram(rows: DataFrame, duration: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative histogram in long form: labels, le, bucket_count, observations, duration_sum.

    One aggregation makes all buckets; they are unpivoted afterwards.
    """
    value = F.col(duration)
    sums = [F.count_if(value <= bound).alias(f"b{i}") for i, bound in enumerate(bounds)]
    wide = rows.where(value.isNotNull()).groupBy(*labels).agg(
        *sums, F.count(F.lit(1)).alias("observations"), F.sum(value).alias("duration_sum")
    )
    cells = [
        F.struct(F.lit(f"{bound:g}").alias("le"), F.col(f"b{i}").alias("bucket_count"))
        for i, bound in enumerate(bounds)
    ]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("bucket_count")))
    return wide.select(*labels, F.explode(F.array(*cells)).alias("c"), "observations", "duration_sum").select(
        *labels, "c.le", "c.bucket_count", "observations", "duration_sum"
    )


def tier_fallbacks(results: DataFrame) -> DataFrame:
    """Pages whose static version was not taken, one row."""
    return results.agg(F.count_if("fell_back").alias("fallbacks"))


def search_counters(searches: DataFrame) -> DataFrame:
    """Searches by status, and the hits they returned."""
    return searches.groupBy("status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce(F.size("results"), F.lit(0))).alias("results")
    )


def research_summary(results: DataFrame) -> DataFrame:
    """Results and non-empty results per request."""
    return results.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("total_results"),
        F.count_if(F.col("content_length") > 0).alias("success_count"),
    )
