"""Nested JSON answers, one per request.

An answer is one value, so all rows of a request meet in one: bound them by the limits of the requests (``validate``) or by the job's arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(order: str, *fields: str) -> Column:
    """Array of structs in the order of ``order``, which itself is not shown."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def _grouped(requests: DataFrame, rows: DataFrame, key: str, order: str, fields: tuple[str, ...], name: str):
    items = rows.groupBy(key).agg(_ordered(order, *fields).alias(name))
    joined = requests.join(items, key, "left")
    empty = F.array().cast(items.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(name, empty))


def research_envelopes(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id, response): query, ai_summary, results[], total_results."""
    fields = ("url", "title", "fetch_method", "markdown_content", "content_length", "error")
    g = _grouped(requests, results, "request_id", "rank", fields, "results")
    body = F.struct("query", "ai_summary", "results", F.size("results").alias("total_results"))
    return g.select("request_id", F.to_json(body).alias("response"))


def crawl_envelopes(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(seed_id, response): base_url, total_pages, results[], ai_summary."""
    fields = ("url", "depth", "fetch_method", "markdown_content", "content_length", "links_found", "error")
    g = _grouped(requests, pages, "seed_id", "rank", fields, "results")
    body = F.struct("base_url", F.size("results").alias("total_pages"), "results", "ai_summary")
    return g.select("seed_id", F.to_json(body).alias("response"))


def map_envelopes(summaries: DataFrame, urls: DataFrame) -> DataFrame:
    """(seed_id, response): base_url, total_urls, urls[], sitemap_url, discovery_method, counts."""
    fields = ("url", "path", "depth", "source", "last_modified")
    g = _grouped(summaries.withColumnRenamed("url", "base_url"), urls, "seed_id", "rank", fields, "urls")
    body = F.struct(
        "base_url", "total_urls", "urls", "sitemap_url", "discovery_method", "sitemap_count", "crawl_count"
    )
    return g.select("seed_id", F.to_json(body).alias("response"))


def extract_envelopes(summaries: DataFrame, data: DataFrame) -> DataFrame:
    """(request_id, response): success, data[], total_urls, failed_urls, extract_mode."""
    g = _grouped(summaries, data, "request_id", "position", ("url", "extraction", "error"), "data")
    body = F.struct("success", "data", "total_urls", "failed_urls", "extract_mode")
    return g.select("request_id", F.to_json(body).alias("response"))
