"""Breadth-first site traversal for any number of seeds at once, over a link table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url, url_host, url_path
from ..session import bucketed, work_folder
from .rules import hosts_under
from .scale import first_buckets, small_or_whole, spread_join

# Parents per numbering bucket.
_PARENTS_PER_BUCKET = 64


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def pages_of_seed_hosts(
    pages: DataFrame, seeds: DataFrame, url: str = "url", include_subdomains: bool = False
) -> DataFrame:
    """Only the pages a traversal from the seeds can reach by internal links.

    Internal links never leave the host (or go below it with subdomains), so other pages need not be
    parsed. Valid for tables without redirects to another host.
    """
    hosts = seeds.select(url_host(normalize_url(F.col(url))).alias("host")).distinct()
    keyed = pages.withColumn("_host", url_host(F.col("url")))
    if include_subdomains:
        own = keyed.select(F.col("_host").alias("host"))
        hosts = hosts_under(own, hosts, domain="host")
    hosts = small_or_whole(hosts.withColumnRenamed("host", "_host"))
    return spread_join(keyed, hosts, ["_host"], "left_semi").drop("_host")


def child_table(links: DataFrame, strip_query: bool = False) -> DataFrame:
    """(url, resolved_url, children): the links of each page as traversal keys, first place kept."""
    # Links are canonical already, except that a bare authority gets its root path.
    rooted = F.transform(
        "links",
        lambda u: F.when(u.rlike(r"\A[^:/]+://[^/?]*\z"), F.concat(u, F.lit("/"))).otherwise(u),
    )
    stripped = F.transform("links", lambda u: normalize_url(u, True))
    keys = F.array_distinct(stripped if strip_query else rooted)
    resolved = F.col("resolved_url") if "resolved_url" in links.columns else F.col("url")
    return links.select("url", resolved.alias("resolved_url"), keys.alias("children"))


def traverse(
    seeds: DataFrame,
    children: DataFrame,
    child_ok: Callable[[Column], Column] | None = None,
    skip: DataFrame | None = None,
    redirects: bool = False,
    folder: str | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """First ``max_urls`` URLs per seed in breadth-first order: (seed_id, url, depth, rank).

    ``seeds`` has seed_id, url, max_depth, max_urls; ``children`` has url, resolved_url, children.
    ``skip`` (seed_id, url) is never entered, except for the seed itself. With ``redirects`` a final
    URL hides links found on the same or a later page. ``child_ok`` tests a child's URL, ``keep`` filters the new children
    of a level as a table (seed_id, url and more), for rules that differ by seed.

    Two jobs per level: a histogram of the new children over their parents' ranks finds where the limit of each seed falls, then only the parents
    up to there are opened, and the limit's rows and those of one bucket of parents at most are sorted and numbered. Every level is written to
    the shared folder, so the plan stays short and lost executors cost one level at most.
    The links lie in buckets by URL, what was visited by seed and URL: a level shuffles its frontier and its children, never the link
    table or an earlier level.
    """
    folder = folder or work_folder(seeds.sparkSession, "traverse")
    start = (
        seeds.select(
            "seed_id",
            normalize_url(F.col("url")).alias("url"),
            F.lit(0).alias("depth"),
            F.lit(1).cast("bigint").alias("rank"),
            F.lit(1).cast("bigint").alias("level_end"),
            F.col("max_urls").cast("bigint").alias("max_urls"),
            F.col("max_depth").cast("int").alias("max_depth"),
        )
        .where("url <> '' AND max_urls >= 1")
    )
    level = bucketed(start, f"{folder}/level-0", ["seed_id", "url"])
    deepest = level.agg(F.max("max_depth")).first()[0] or 0
    levels, finals, seen = [level], [], [level]
    # Without an open seed no page is parsed for its links.
    if deepest > 0:
        children = bucketed(children, f"{folder}/children", ["url"])
        if skip is not None:
            seen.append(bucketed(skip.select("seed_id", "url"), f"{folder}/skip", ["seed_id", "url"]))
    bucket = F.floor(F.col("parent_rank") / F.lit(_PARENTS_PER_BUCKET))

    def fresh_children(parents: DataFrame) -> DataFrame:
        """Children not visited yet, each at its first place: seed_id, url, parent_rank, pos and what the parents carry."""
        carried = [c for c in parents.columns if c not in ("seed_id", "url", "parent_rank")]
        found = spread_join(parents, children, ["url"]).select(
            "seed_id", "parent_rank", *carried, F.posexplode("children").alias("pos", "url")
        ).where(F.col("url") != "")
        if child_ok is not None:
            found = found.where(child_ok(F.col("url")))
        fresh = found.groupBy("seed_id", "url").agg(F.min(F.struct("parent_rank", "pos", *carried)).alias("at"))
        for table in seen:
            fresh = fresh.join(table.select("seed_id", "url"), ["seed_id", "url"], "left_anti")
        for hidden in finals:
            fresh = fresh.join(hidden, ["seed_id", "url"], "left").where(
                F.col("final_rank").isNull() | (F.col("at.parent_rank") < F.col("final_rank"))
            ).drop("final_rank")
        return (fresh if keep is None else keep(fresh)).select("seed_id", "url", "at.*")

    for depth in range(1, deepest + 1):
        open_rows = level.where((F.col("depth") < F.col("max_depth")) & (F.col("level_end") < F.col("max_urls")))
        parents = open_rows.select("seed_id", "url", F.col("rank").alias("parent_rank"), "level_end", "max_urls", "max_depth")
        if redirects:
            landed = spread_join(level, children.select("url", "resolved_url"), ["url"])
            landed = landed.groupBy("seed_id", F.col("resolved_url").alias("url")).agg(F.min("rank").alias("final_rank"))
            finals.append(bucketed(landed, f"{folder}/final-{depth}", ["seed_id", "url"]))
        room = F.col("max_urls") - F.col("level_end")
        cut = first_buckets(
            fresh_children(parents.select("seed_id", "url", "parent_rank", "level_end", "max_urls")), ["seed_id"], bucket, room, f"{folder}/cut-{depth}"
        )
        if cut.isEmpty():
            break
        # A child counts where its first parent stands: parents beyond the cut-off add no row within the limit and are not opened again.
        chosen = parents.withColumn("bucket", bucket).join(cut, ["seed_id", "bucket"])
        in_bucket = Window.partitionBy("seed_id", "bucket").orderBy("parent_rank", "pos")
        numbered = fresh_children(chosen).withColumn(
            "rank", F.col("level_end") + F.col("before") + F.row_number().over(in_bucket)
        )
        level = bucketed(
            numbered.where(F.col("rank") <= F.col("max_urls")).select(
                "seed_id",
                "url",
                F.lit(depth).alias("depth"),
                "rank",
                F.least(F.col("max_urls"), F.col("level_end") + F.col("total")).alias("level_end"),
                "max_urls",
                "max_depth",
            ),
            f"{folder}/level-{depth}",
            ["seed_id", "url"],
        )
        seen.append(level)
        levels.append(level)
    return _union([t.select("seed_id", "url", "depth", "rank") for t in levels])


def crawl(
    seeds: DataFrame,
    scraped: DataFrame,
    child_ok: Callable[[Column], Column] | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Content crawl: the traversal joined to the page contents, one row per visited URL.

    ``scraped`` has url, fetch_method, markdown_content, content_length, error, links (distinct links
    resolved against the requested URL). A URL without a page is a failed fetch and counts.
    """
    order = traverse(seeds.withColumnRenamed("max_pages", "max_urls"), child_table(scraped), child_ok, keep=keep)
    pages = scraped.select(
        "url",
        "fetch_method",
        "markdown_content",
        "content_length",
        "error",
        F.size("links").alias("links_found"),
    )
    joined = spread_join(order, pages, ["url"], "left")
    missing = F.col("fetch_method").isNull()
    return joined.select(
        "seed_id",
        "rank",
        "url",
        "depth",
        F.coalesce("fetch_method", F.lit("playwright-failed")).alias("fetch_method"),
        F.coalesce("markdown_content", F.lit("")).alias("markdown_content"),
        F.coalesce("content_length", F.lit(0)).alias("content_length"),
        F.coalesce("links_found", F.lit(0)).alias("links_found"),
        F.when(missing, "No response").otherwise(F.col("error")).alias("error"),
    )


def discover(
    seeds: DataFrame,
    fetched: DataFrame,
    strip_query: bool = False,
    child_ok: Callable[[Column], Column] | None = None,
    skip: DataFrame | None = None,
) -> DataFrame:
    """URL-only discovery: (seed_id, rank, url, path, depth, source, last_modified).

    ``fetched`` has url, resolved_url, links (resolved against the final URL). The result shows the
    final URL of each visited page.
    """
    order = traverse(seeds, child_table(fetched, strip_query), child_ok, skip, redirects=True)
    final = spread_join(order, fetched.select("url", "resolved_url"), ["url"], "left")
    shown = F.coalesce("resolved_url", "url")
    return final.select(
        "seed_id",
        "rank",
        shown.alias("url"),
        url_path(shown).alias("path"),
        "depth",
        F.lit("crawl").alias("source"),
        F.lit(None).cast("string").alias("last_modified"),
    )


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Pages and greatest depth per seed."""
    return pages.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.max("depth").alias("max_depth_reached")
    )
