"""Research, crawl, map and extract over tables of requests and fetched data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import MEDIA_DOMAINS, domain_allowed, is_safe_url, merge_rules
from ..operators.crawl import crawl, pages_of_seed_hosts
from ..operators.discovery import map_summary, run_discovery
from ..operators.extraction import run_extraction
from ..operators.fetching import scrape, scrape_urls
from ..operators.links import fetched_links, with_links
from ..operators.request_rules import filter_by_request_rules
from ..operators.rules import accepted_requests
from ..session import materialize, work_folder
from ..sources.readers import hit_titles, search_hits


def seed_gate(
    seeds: DataFrame, allow: Sequence[str] = (), block: Sequence[str] = (), rules: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Seeds that may be visited, and the others with a reason. Media sites are always blocked.

    ``rules`` (request_id, kind, value) holds the domain rules of each seed, the request of a seed being its ``seed_id``.
    """
    block = merge_rules(MEDIA_DOMAINS, block)
    reason = F.when(~is_safe_url(F.col("url")), "URL points to an internal or invalid address").when(
        ~domain_allowed(F.col("url"), allow, block), "Domain is not allowed"
    )
    if rules is not None:
        passing = filter_by_request_rules(seeds.select("seed_id", "url").distinct(), rules, "seed_id", paths=False).withColumn("_passes", F.lit(True))
        seeds = seeds.join(passing, ["seed_id", "url"], "left")
        reason = reason.when(F.col("_passes").isNull(), "Domain is not allowed")
    marked = seeds.withColumn("reject_reason", reason).drop("_passes")
    return (
        marked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.where(F.col("reject_reason").isNotNull()),
    )


def research_job(
    searches: DataFrame,
    responses: DataFrame,
    allow: Sequence[str] = (),
    block: Sequence[str] = (),
    rules: DataFrame | None = None,
) -> DataFrame:
    """Content per search hit: (request_id, rank, url, title, fetch_method, markdown_content, ...).

    ``searches``: request_id, query, results, max_results. Unsafe and blocked hits go before any page
    is read. When a search lists a URL twice, the later title counts for both. ``allow`` and ``block`` hold for
    all requests, the domain rules in ``rules`` (request_id, kind, value) for their own.
    """
    block = merge_rules(MEDIA_DOMAINS, block)
    hits = search_hits(searches, F.col("max_results")).where(F.col("url") != "")
    kept = hits.where(is_safe_url(F.col("url")) & domain_allowed(F.col("url"), allow, block))
    if rules is not None:
        kept = filter_by_request_rules(kept, rules, paths=False)
    pages = scrape_urls(kept.select("request_id", "rank", "url"), responses)
    return pages.join(hit_titles(kept), ["request_id", "url"], "left").select(
        "request_id", "rank", "url", "title", "fetch_method", "markdown_content", "content_length", "error"
    )


def scraped_with_links(
    responses: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), force_js: bool = False
) -> DataFrame:
    """Content and links of each page, links resolved against the requested URL."""
    made = scrape(responses, F.lit(force_js), keep_html=True)
    linked = with_links(made, "raw_html", "url", include, exclude)
    return linked.select(
        "url",
        "fetch_method",
        "markdown_content",
        F.col("content_length_out").alias("content_length"),
        "error",
        "links",
    )


def crawl_job(
    seeds: DataFrame,
    responses: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    allow: Sequence[str] = (),
    block: Sequence[str] = (),
    force_js: bool = False,
    rules: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Crawled pages and rejected seeds. ``seeds``: seed_id, url, max_depth, max_pages.

    ``include``, ``exclude``, ``allow`` and ``block`` hold for all seeds; ``rules`` (request_id, kind, value) holds domain and path rules for the
    seed whose id the request is. ``links_found`` counts the links that the path rules of the row's seed let pass.

    Only pages on the seeds' hosts are parsed, and each only once: contents and links are written to
    the shared folder before the traversal. Children are checked for safety and the caller's rules;
    the media list applies to seeds only.
    """
    good, rejected = seed_gate(seeds, allow, block, rules)
    reachable = pages_of_seed_hosts(responses, good)
    scraped = materialize(
        scraped_with_links(reachable, include, exclude, force_js),
        work_folder(seeds.sparkSession, "scraped"),
    )
    keep = (lambda found: filter_by_request_rules(found, rules, "seed_id")) if rules is not None else None
    pages = crawl(good, scraped, lambda u: is_safe_url(u) & domain_allowed(u, allow, block), keep)
    if rules is not None:
        pages = _links_found_by_rules(pages, scraped, rules)
    return pages, rejected


def _links_found_by_rules(pages: DataFrame, scraped: DataFrame, rules: DataFrame) -> DataFrame:
    """``links_found`` of seeds with path rules, counted over the links these let pass."""
    ruled = rules.where(F.col("kind").isin("include", "exclude")).select(F.col("request_id").alias("seed_id")).distinct()
    visited = pages.select("seed_id", "url").join(ruled, "seed_id", "left_semi").join(scraped.select("url", "links"), "url")
    links = visited.select("seed_id", F.col("url").alias("page"), F.explode("links").alias("url"))
    passing = filter_by_request_rules(links, rules, "seed_id", domains=False)
    counts = passing.groupBy("seed_id", F.col("page").alias("url")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    joined = pages.join(ruled.withColumn("_ruled", F.lit(True)), "seed_id", "left").join(counts, ["seed_id", "url"], "left")
    found = F.when(F.col("_ruled"), F.coalesce("_n", F.lit(0))).otherwise(F.col("links_found")).alias("links_found")
    return joined.select(*(found if c == "links_found" else c for c in pages.columns))


def map_job(
    requests: DataFrame,
    responses: DataFrame,
    site_files: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    allow: Sequence[str] = (),
    block: Sequence[str] = (),
    include_subdomains: bool = False,
    strip_query: bool = False,
    global_block: Sequence[str] = (),
    rules: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """URLs, summaries and rejected seeds. Children are checked against ``global_block`` only.

    ``rules`` (request_id, kind, value) holds the domain rules that each seed itself must pass.
    """
    good, rejected = seed_gate(requests, allow, merge_rules(global_block, block), rules)
    fetched = fetched_links(responses, include, exclude, include_subdomains)
    child_ok = (lambda u: domain_allowed(u, (), global_block)) if global_block else None
    urls, located = run_discovery(
        good, fetched, site_files, include, exclude, include_subdomains, strip_query, child_ok
    )
    return urls, map_summary(good, urls, located), rejected


def accepted_by_rules(specs: DataFrame, rules: DataFrame) -> DataFrame:
    """The specs of requests of which no URL falls to the request's domain rules."""
    asked = specs.select("request_id", "url").distinct()
    passing = filter_by_request_rules(asked, rules, paths=False)
    rejected = asked.join(passing, ["request_id", "url"], "left_anti").select("request_id").distinct()
    return specs.join(rejected, "request_id", "left_anti")


def extract_job(
    specs: DataFrame,
    responses: DataFrame,
    mode: str,
    fn: Callable,
    schema: dict | None = None,
    allow: Sequence[str] = (),
    block: Sequence[str] = (),
    rules: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Extraction rows and outcomes. ``specs``: request_id, position, url, prompt, force_js_render.

    One unsafe or blocked URL rejects its whole request; ``rules`` (request_id, kind, value) holds the domain rules of each request.
    """
    block = merge_rules(MEDIA_DOMAINS, block)
    accepted = accepted_requests(specs, allow, block)
    if rules is not None:
        accepted = accepted_by_rules(accepted, rules)
    pages = scrape_urls(accepted, responses, "force_js_render")
    return run_extraction(pages, mode, fn, schema)
