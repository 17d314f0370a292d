"""Fetch outcomes and the two-step content choice per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import (
    MIN_CONTENT_CHARS,
    is_script_noise,
    looks_like_pdf,
    with_markdown,
)
from ..session import materialize, work_folder
from .scale import small_or_whole, spread_join

# First delay between two attempts in seconds.
RETRY_BASE_DELAY = 1.0


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """Outcome per (url, tier) of logged attempts: first success wins, a static 4xx ends the tier.

    Aggregates only, so a URL with very many log rows is combined before the shuffle.
    """
    ok = F.col("error").isNull() & F.coalesce(F.col("status") < 400, F.lit(True))
    gone = (F.col("tier") == "static") & F.col("status").between(400, 499)
    row = F.struct("attempt", ok.alias("ok"), "status", "error")
    grouped = attempts.groupBy("url", "tier").agg(
        F.min(F.when(ok | gone, row)).alias("ended"),
        F.max(F.struct("attempt", F.lit(False).alias("ok"), "status", "error")).alias("last"),
    )
    out = grouped.select("url", "tier", F.coalesce("ended", "last").alias("o"))
    return out.select(
        "url",
        "tier",
        F.col("o.ok").alias("ok"),
        F.col("o.attempt").alias("attempts"),
        F.col("o.status").alias("status"),
        F.when(~F.col("o.ok"), F.coalesce("o.error", F.concat(F.lit("HTTP "), F.col("o.status").cast("string")))).alias(
            "error"
        ),
        # Waits 1, 2, 4, ... before the second and later attempts.
        (F.lit(RETRY_BASE_DELAY) * (F.pow(F.lit(2.0), F.col("o.attempt") - 1) - 1)).alias("backoff_s"),
    )


def size_error(declared: Column, body_bytes: Column, max_bytes: int | None = None) -> Column:
    """Error text for a body over ``max_bytes``, declared or actual; NULL when it fits or without a limit."""
    if max_bytes is None:
        return F.lit(None).cast("string")
    limit = F.lit(max_bytes)
    return F.when(
        declared > limit,
        F.concat(F.lit("Response too large ("), declared.cast("string"), F.lit(f" bytes > {max_bytes} max)")),
    ).when(body_bytes > limit, f"Response too large (>{max_bytes} bytes)")


def assemble_pdf(pdf_pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Text per document in page order: (doc_url, text, error, truncated).

    NULL text with an error when it is empty. With ``max_pages`` (usual: PDF_MAX_PAGES) only the first pages count and
    ``truncated`` tells where some were left out; by default all pages count. A document is one value, so its pages meet in one row by nature.
    """
    inside = F.lit(True) if max_pages is None else F.col("page_no") < max_pages
    page = F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))
    joined = pdf_pages.groupBy("doc_url").agg(
        F.array_sort(F.collect_list(F.when(inside, page))).alias("parts"), F.max(~inside).alias("truncated")
    )
    text = F.trim(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"), F.lit(" \t\r\n\f"))
    return joined.select("doc_url", "truncated", text.alias("_text")).select(
        "doc_url",
        F.when(F.col("_text") != "", F.col("_text")).alias("text"),
        F.when(F.col("_text") == "", "PDF has no extractable text (likely scanned image)").alias("error"),
        "truncated",
    )


_OPTIONAL = {
    "status": "int",
    "content_type": "string",
    "content_length": "bigint",
    "rendered_html": "string",
    "render_error": "string",
    "fetch_error": "string",
    "pdf_text": "string",
    "pdf_error": "string",
    "head": "binary",
}


def _with_columns(responses: DataFrame) -> DataFrame:
    have = set(responses.columns)
    return responses.select(
        "*", *(F.lit(None).cast(t).alias(c) for c, t in _OPTIONAL.items() if c not in have)
    )


def scrape(
    responses: DataFrame,
    force_js: Column | None = None,
    keep_html: bool = False,
    max_bytes: int | None = None,
    min_content_chars: int = MIN_CONTENT_CHARS,
) -> DataFrame:
    """Content per response row by the two-step rule.

    The static page is taken when its text is long enough and not script noise; a PDF is final; all
    else falls back to the rendered page, which is taken as it is. Adds fetch_method,
    markdown_content, content_length, error, static_error, fell_back (and raw_html). ``static_error`` says why the static
    fetch was not taken (its own error, HTTP status, size), also where the rendered page was. The rendered page is
    converted only where it is needed: its input is NULL elsewhere. With ``max_bytes`` larger static bodies are not
    taken; ``min_content_chars`` is the length from which a static text is taken.
    """
    force = F.lit(False) if force_js is None else F.coalesce(force_js, F.lit(False))
    r = _with_columns(responses)
    too_large = size_error(F.col("content_length"), F.octet_length("html"), max_bytes)
    http = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    r = r.withColumn("_static_error", F.coalesce("fetch_error", http, too_large))
    r = r.withColumn("_force", force).withColumn(
        "_static_ok",
        ~F.col("_force") & F.coalesce(F.col("status") < 400, F.lit(True)) & too_large.isNull(),
    )
    r = r.withColumn(
        "_pdf", F.col("_static_ok") & looks_like_pdf(F.col("url"), F.col("content_type"), F.col("head"))
    )
    r = r.withColumn("_static", F.when(F.col("_static_ok") & ~F.col("_pdf") & (F.col("html") != ""), F.col("html")))
    r = with_markdown(r, "_static", "_static_md")
    good = (F.char_length("_static_md") >= min_content_chars) & ~is_script_noise(F.col("_static_md"), min_content_chars)
    r = r.withColumn("_static_good", F.col("_static").isNotNull() & good)
    r = r.withColumn(
        "_rendered",
        F.when(~F.col("_static_good") & ~F.col("_pdf") & (F.col("rendered_html") != ""), F.col("rendered_html")),
    )
    r = with_markdown(r, "_rendered", "_rendered_md")
    pdf_ok = F.coalesce(F.col("pdf_text") != "", F.lit(False))
    method = (
        F.when(F.col("_pdf") & pdf_ok, "pdf")
        .when(F.col("_pdf"), "pdf-failed")
        .when(F.col("_static_good"), "httpx")
        .when(F.col("_rendered").isNotNull(), "playwright")
        .otherwise("playwright-failed")
    )
    r = r.withColumn("fetch_method", method)
    kind = F.col("fetch_method")
    text = (
        F.when(kind == "pdf", F.col("pdf_text"))
        .when(kind == "httpx", F.col("_static_md"))
        .when(kind == "playwright", F.col("_rendered_md"))
        .otherwise("")
    )
    r = r.withColumn("markdown_content", text)
    error = F.when(kind == "pdf-failed", F.coalesce("pdf_error", F.lit("PDF extraction failed"))).when(
        kind == "playwright-failed", F.coalesce("render_error", F.lit("Playwright returned empty HTML"))
    )
    extra = [F.when(kind == "httpx", F.col("_static")).otherwise(F.col("_rendered")).alias("raw_html")]
    return r.select(
        *responses.columns,
        "fetch_method",
        "markdown_content",
        F.char_length("markdown_content").alias("content_length_out"),
        error.alias("error"),
        F.when(~F.col("_force"), F.col("_static_error")).alias("static_error"),
        (~F.col("_force") & kind.startswith("playwright")).alias("fell_back"),
        *(extra if keep_html else []),
    )


def scrape_urls(
    urls: DataFrame,
    responses: DataFrame,
    force_js: str | None = None,
    folder: str | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One content row per requested URL, duplicates included; a URL without response has failed.

    Pages are converted once per distinct URL and written to the shared folder: conversion is the
    costly step, and a later filter on the result must not be pushed into it and repeat it. The rows
    are joined back; hot URLs are split over tasks.
    """
    keys = ["url"] if force_js is None else ["url", force_js]
    wanted = small_or_whole(urls.select(*keys).distinct())
    # Only requested pages leave the scan; of several versions of one the best counts: fetched before failed, then by content.
    version = Window.partitionBy(*keys).orderBy(
        F.coalesce(F.col("status") >= 400, F.lit(False)), F.desc_nulls_last("status"), F.xxhash64("html", "rendered_html"), "html", "rendered_html"
    )
    found = _with_columns(responses).join(wanted, "url").withColumn("_version", F.row_number().over(version))
    found = found.where("_version = 1").drop("_version")
    made = scrape(found, None if force_js is None else F.col(force_js), max_bytes=max_bytes).select(
        *keys,
        "fetch_method",
        "markdown_content",
        F.col("content_length_out").alias("content_length"),
        "error",
    )
    made = materialize(made, f"{folder or work_folder(urls.sparkSession, 'contents')}/pages")
    missing = F.col("fetch_method").isNull()
    return spread_join(urls, made, keys, "left").select(
        *urls.columns,
        F.coalesce("fetch_method", F.lit("playwright-failed")).alias("fetch_method"),
        F.coalesce("markdown_content", F.lit("")).alias("markdown_content"),
        F.coalesce("content_length", F.lit(0)).alias("content_length"),
        F.when(missing, "Playwright returned empty HTML").otherwise(F.col("error")).alias("error"),
    )
