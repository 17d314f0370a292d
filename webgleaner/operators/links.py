"""Link extraction: page tables to link arrays and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import anchor_hrefs
from ..functions.hosts import is_safe_url
from ..functions.urls import link_target, normalize_url, split_url

# The usual limit of an accepted body in bytes, for ``max_bytes``.
MAX_BODY_BYTES = 50 * 1024 * 1024


def with_links(
    pages: DataFrame,
    html: str = "html",
    base: str = "url",
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_subdomains: bool = False,
    name: str = "links",
) -> DataFrame:
    """Add the distinct internal links of each page in page order. Row-local: no shuffle.

    The page URL is split once per page; the hrefs are resolved inside an array transform.
    """
    parts = split_url(F.col(base))
    origin = F.when(
        F.col("_base.netloc") != "",
        F.concat(F.col("_base.scheme"), F.lit("://"), F.lower(F.col("_base.netloc"))),
    ).otherwise("")
    targets = F.transform(
        F.col("_hrefs"),
        lambda href: link_target(
            F.col("_base"), F.col("_origin"), href, include, exclude, include_subdomains
        ),
    )
    links = F.array_distinct(F.array_compact(targets))
    empty = F.array().cast("array<string>")
    return (
        pages.withColumn("_base", parts)
        .withColumn("_origin", origin)
        .withColumn("_hrefs", anchor_hrefs(F.col(html)))
        .withColumn(name, F.coalesce(links, empty))
        .drop("_base", "_origin", "_hrefs")
    )


def link_edges(pages: DataFrame, links: str = "links", base: str = "url") -> DataFrame:
    """Edge table (src_url, pos, dst_url); ``pos`` is the 0-based place among the page's links."""
    return pages.select(F.col(base).alias("src_url"), F.posexplode(links).alias("pos", "dst_url"))


def unvisited_edges(edges: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Edges that lead to none of the ``visited`` URLs, whose canonical form counts. A side of known small size is broadcast."""
    known = visited.select(normalize_url(F.col(url)).alias("dst_url")).distinct()
    return edges.join(known, "dst_url", "left_anti").select(*edges.columns)


def fetch_error(
    status: Column, final_url: Column, declared: Column, size: Column, max_bytes: int | None = None
) -> Column:
    """Why a fetched page yields no links: HTTP status, unsafe redirect, size (with ``max_bytes``), empty body."""
    limit = F.lit(max_bytes).cast("long")
    return (
        F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(~is_safe_url(final_url), "Redirect to internal/blocked address")
        .when(
            declared > limit,
            F.concat(F.lit("Response too large ("), declared.cast("string"), F.lit(" bytes)")),
        )
        .when(size > limit, F.concat(F.lit("Response too large (>"), limit.cast("string"), F.lit(" bytes)")))
        .when(F.coalesce(size, F.lit(0)) == 0, "Empty response body")
    )


def fetched_links(
    responses: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_subdomains: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Links per fetched page, resolved against the final URL: (url, resolved_url, links, error).

    With ``max_bytes`` larger bodies are error rows without links; by default bodies of any size are read.

    ``responses`` has url, final_url, status, content_length, html. After an unsafe redirect or an
    HTTP error the requested URL stays the resolved one.
    """
    final = F.coalesce(F.col("final_url"), F.col("url"))
    error = fetch_error(
        F.col("status"), final, F.col("content_length"), F.octet_length(F.col("html")), max_bytes
    )
    checked = responses.select(
        "url",
        F.when(
            F.coalesce(F.col("status") >= 400, F.lit(False)) | ~is_safe_url(final), F.col("url")
        ).otherwise(final).alias("resolved_url"),
        error.alias("error"),
        "html",
    ).withColumn("html", F.when(F.col("error").isNull(), F.col("html")))
    found = with_links(checked, "html", "resolved_url", include, exclude, include_subdomains)
    return found.select("url", "resolved_url", "links", "error")
