"""Site maps per request: sitemap, link traversal or both."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..session import materialize, work_folder
from .crawl import discover
from .scale import first_buckets
from .sitemaps import locate_sitemaps, sitemap_documents, urlset_rows

# Entries per numbering bucket inside one sitemap document.
_ENTRIES_PER_BUCKET = 10_000

_COLUMNS = ("seed_id", "url", "path", "depth", "source", "last_modified")


def run_discovery(
    requests: DataFrame,
    fetched: DataFrame,
    site_files: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_subdomains: bool = False,
    strip_query: bool = False,
    child_ok: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """URLs and located sitemaps per request, by its ``discovery_method``.

    ``requests``: seed_id, url, discovery_method (sitemap, crawl, hybrid), max_urls, max_depth.
    ``fetched``: url, resolved_url, links. ``site_files``: sitemap and robots responses with url,
    status, content_type, text. Hybrid requests whose sitemap already holds ``max_urls`` entries are
    not traversed; the others are traversed for the remainder, sitemap URLs excluded.
    """
    folder = work_folder(requests.sparkSession, "discovery")
    seeds = requests.select("*", normalize_url(F.col("url")).alias("base_url")).where("base_url <> ''")
    seeds = materialize(seeds, f"{folder}/seeds")
    by_map = seeds.where(F.col("discovery_method") != "crawl")
    # Read to find the sitemaps and again for every nesting level: what makes these files is done once.
    site_files = materialize(site_files.select("url", "status", "content_type", "text"), f"{folder}/site-files")
    located = materialize(locate_sitemaps(by_map.select("seed_id", "base_url"), site_files), f"{folder}/located")
    documents = sitemap_documents(
        located, site_files.where(F.col("status") == 200).select("url", "text"), f"{folder}/sitemaps"
    )
    limited = documents.join(seeds.select("seed_id", "max_urls"), "seed_id")
    part = F.struct("trail", F.floor(F.col("pos") / F.lit(_ENTRIES_PER_BUCKET)).alias("part"))

    def entries_of(chosen: DataFrame) -> DataFrame:
        return urlset_rows(chosen, include, exclude, include_subdomains, strip_query).withColumn("bucket", part)

    # What is over a request's limit is not kept: such a request is full, and is not traversed. Documents that start beyond
    # the limit are counted, but their entries are neither written nor sorted.
    cut = first_buckets(entries_of(limited), ["seed_id"], F.col("bucket"), F.col("max_urls"), f"{folder}/cut")
    first = limited.join(cut.select("seed_id", F.col("bucket.trail").alias("trail")).distinct(), ["seed_id", "trail"], "left_semi")
    in_bucket = Window.partitionBy("seed_id", "bucket").orderBy("pos")
    numbered = entries_of(first).join(cut.drop("total"), ["seed_id", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(in_bucket)
    )
    listed = numbered.where("rank <= max_urls").select(*_COLUMNS, F.col("rank").cast("bigint").alias("rank"))
    listed = materialize(listed, f"{folder}/listed")
    counts = listed.groupBy("seed_id").agg(F.max("rank").alias("listed"))
    limits = seeds.join(counts, "seed_id", "left").select(
        "seed_id", "url", "discovery_method", "max_urls", "max_depth", F.coalesce("listed", F.lit(0)).alias("listed")
    )
    open_seeds = limits.where(
        (F.col("discovery_method") == "crawl")
        | ((F.col("discovery_method") == "hybrid") & (F.col("listed") < F.col("max_urls")))
    ).select(
        "seed_id", "url", "max_depth", (F.col("max_urls") - F.col("listed")).alias("max_urls"), "listed"
    )
    open_seeds = materialize(open_seeds, f"{folder}/open")
    if open_seeds.isEmpty():
        # Every request is served by its sitemap: no page is parsed.
        return listed, located
    walked = discover(
        open_seeds.drop("listed"), fetched, strip_query, child_ok, listed.select("seed_id", "url")
    )
    # A sitemap fills the first places; the traversal follows.
    tail = walked.join(open_seeds.select("seed_id", "listed"), "seed_id").select(
        *_COLUMNS, (F.col("rank") + F.col("listed")).alias("rank")
    )
    return listed.unionByName(tail), located


def map_summary(requests: DataFrame, urls: DataFrame, located: DataFrame) -> DataFrame:
    """Counts per request: total_urls, sitemap_count, crawl_count, sitemap_url."""
    counts = urls.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(F.col("source") == "sitemap").alias("sitemap_count"),
        F.count_if(F.col("source") == "crawl").alias("crawl_count"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        requests.select("seed_id", "url", "discovery_method")
        .join(counts, "seed_id", "left")
        .join(located.select("seed_id", "sitemap_url"), "seed_id", "left")
        .select(
            "seed_id",
            "url",
            "discovery_method",
            "sitemap_url",
            *(F.coalesce(c, zero).alias(c) for c in ("total_urls", "sitemap_count", "crawl_count")),
        )
    )
