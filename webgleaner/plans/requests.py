"""From a table of raw requests to pages, summaries and history: validation, rules by request, job, summary step, history rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.request_rules import request_rules
from ..operators.summary import run_summaries, usable_documents
from ..operators.validate import request_fields, split_requests
from ..session import materialize, work_folder
from .jobs import crawl_job, research_job

# What stands in place of a summary whose model call failed.
SUMMARY_FAILED = "An internal error occurred. Check server logs for details."


def _flagged(valid: DataFrame, kind: str) -> DataFrame:
    """Typed fields of the valid requests of a kind, with ``generate_summary``."""
    wanted = F.coalesce(F.try_variant_get("doc", F.lit("$.generate_summary"), "boolean"), F.lit(False))
    flags = valid.where(F.col("kind") == kind).select("request_id", wanted.alias("generate_summary"))
    return request_fields(valid, kind).join(flags, "request_id")


def _summaries(pages: DataFrame, fields: DataFrame, question: str, fn: Callable | None) -> DataFrame:
    """(request_id, ai_summary) of the requests that ask for one and have a page with text; a failed call leaves a fixed text."""
    asking = fields.where("generate_summary").select("request_id", F.col(question).alias("query"), "summary_prompt")
    documents = pages.select("request_id", F.col("rank").alias("position"), F.col("markdown_content").alias("text"))
    documents = documents.join(asking.select("request_id"), "request_id", "left_semi")
    asking = asking.join(usable_documents(documents).select("request_id").distinct(), "request_id", "left_semi")
    if fn is None:
        return asking.select("request_id", F.lit(None).cast("string").alias("ai_summary")).limit(0)
    answers = run_summaries(documents, asking, fn)
    return answers.select("request_id", F.when(F.col("error").isNotNull(), SUMMARY_FAILED).otherwise(F.col("ai_summary")).alias("ai_summary"))


def _history(fields: DataFrame, pages: DataFrame, summaries: DataFrame, kind: str, query: str, params: Sequence[str], total: str) -> DataFrame:
    """A history entry per request; the number of its pages is the result's size. The id is the request's."""
    counts = pages.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = fields.join(counts, "request_id", "left").join(summaries, "request_id", "left")
    size: Column = F.coalesce("_n", F.lit(0))
    return joined.select(
        F.col("request_id").cast("string").alias("id"),
        F.lit(kind).alias("kind"),
        F.col(query).alias("query_or_url"),
        F.to_json(F.struct(*params)).alias("params"),
        F.lit("done").alias("status"),
        F.to_json(F.struct("ai_summary", size.alias(total))).alias("result"),
        size.alias("result_size"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def research_requests(
    requests: DataFrame, search_results: DataFrame, responses: DataFrame, fn: Callable | None = None, block: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages, summaries, history entries and quarantined requests. ``requests``: request_id, kind, payload (JSON); other kinds are left alone.

    ``search_results`` has request_id and results. A request's domain rules are its own, ``block`` holds for all. A request without search results
    has neither pages nor a history entry. ``fn`` is the batch model function of the summaries that requests ask for.
    """
    valid, rejected = split_requests(requests.where("kind = 'research'"))
    fields = _flagged(valid, "research")
    searches = fields.join(search_results.select("request_id", "results"), "request_id").where(F.size("results") > 0)
    made = research_job(searches, responses, block=block, rules=request_rules(valid))
    # Read by the summaries and by the history.
    pages = materialize(made, work_folder(requests.sparkSession, "research"))
    summaries = _summaries(pages, searches, "query", fn)
    return pages, summaries, _history(searches, pages, summaries, "research", "query", ["max_results"], "total_results"), rejected


def crawl_requests(
    requests: DataFrame, responses: DataFrame, fn: Callable | None = None, block: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages, summaries, history entries and rejected requests (invalid ones and those whose seed may not be visited), with the reasons.

    ``requests``: request_id, kind, payload (JSON); other kinds are left alone. Domain and path rules of a request are its own.
    """
    valid, invalid = split_requests(requests.where("kind = 'crawl'"))
    fields = _flagged(valid, "crawl")
    seeds = fields.withColumnRenamed("request_id", "seed_id")
    made, gated = crawl_job(seeds.select("seed_id", "url", "max_depth", "max_pages"), responses, block=block, rules=request_rules(valid))
    pages = materialize(made.withColumnRenamed("seed_id", "request_id"), work_folder(requests.sparkSession, "crawled"))
    visited = fields.join(gated.select(F.col("seed_id").alias("request_id")), "request_id", "left_anti")
    summaries = _summaries(pages, visited, "url", fn)
    entries = _history(visited, pages, summaries, "crawl", "url", ["max_depth", "max_pages"], "total_pages")
    rejected = invalid.select("request_id", F.array_join("violations", "; ").alias("reason")).unionByName(
        gated.select(F.col("seed_id").alias("request_id"), F.col("reject_reason").alias("reason"))
    )
    return pages, summaries, entries, rejected
