"""Structured extraction: prompts, model calls, answer resolution, outcome rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import matches_schema, recover_json
from ..functions.prompts import (
    EXTRACT_URL_SEPARATOR,
    chat_thread,
    extract_content,
    extract_prompt,
    extract_system,
)
from ..functions.python_workers import call_model
from ..functions.text import cap, is_blank
from ..session import materialize, work_folder

def with_model(prompts: DataFrame, fn: Callable[[list[str]], Iterable]) -> DataFrame:
    """Call a batch model function on ``messages`` (JSON text), partition by partition.

    ``fn`` gets a list of message lists and yields one answer text or exception for each. Adds ``raw``
    and ``error``.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(call_model(fn), f"{types}, raw string, error string")


def scrape_failures(pages: DataFrame, mode: str, page_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages with usable content and failure rows (request_id, position, url, error).

    Pages are whole unless ``page_chars`` cuts them.
    """
    content = pages.withColumn("content", extract_content(F.col("markdown_content"), page_chars))
    reason = F.col("error")
    if mode == "per_page":
        reason = F.coalesce(reason, F.when(is_blank(F.col("content")), "Empty content"))
    marked = content.withColumn("_reason", reason)
    return (
        marked.where(F.col("_reason").isNull()).drop("_reason"),
        marked.where(F.col("_reason").isNotNull()).select(
            "request_id", "position", "url", F.col("_reason").alias("error")
        ),
    )


def page_prompts(pages: DataFrame, schema: dict | None = None) -> DataFrame:
    """One prompt per page: (request_id, position, url, user_prompt)."""
    return pages.select(
        "request_id",
        "position",
        "url",
        extract_prompt(F.col("content"), F.col("prompt"), F.col("url"), schema).alias("user_prompt"),
    )


def combined_prompts(pages: DataFrame, schema: dict | None = None) -> DataFrame:
    """One prompt per request over its pages in order: (request_id, url, user_prompt).

    The page number is the place in the request, failed pages included. A prompt is one value, so a request's pages
    meet in one row by nature.
    """
    part = F.struct(
        "position",
        "url",
        F.concat(
            F.lit("--- Page "),
            (F.col("position") + 1).cast("string"),
            F.lit(": "),
            F.col("url"),
            F.lit(" ---\n"),
            F.col("content"),
        ).alias("part"),
    )
    grouped = pages.groupBy("request_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.first("prompt").alias("prompt")
    )
    return grouped.select(
        "request_id",
        F.array_join(F.transform("parts", lambda p: p["url"]), EXTRACT_URL_SEPARATOR).alias("url"),
        extract_prompt(
            F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), F.col("prompt"), None, schema
        ).alias("user_prompt"),
    )


def grade_answers(answers: DataFrame, schema: dict | None = None) -> DataFrame:
    """Add ``json_text`` (recovered JSON or NULL) and ``accepted`` to raw answers."""
    graded = answers.withColumn("json_text", recover_json(F.col("raw")))
    ok = F.col("json_text").isNotNull()
    if schema:
        ok = ok & matches_schema(F.try_parse_json("json_text"), schema)
    return graded.withColumn("accepted", F.col("error").isNull() & ok)


def resolve_answers(
    answers: DataFrame, keys: list[str], schema: dict | None = None, attempts: int | None = None, raw_chars: int | None = None
) -> DataFrame:
    """Final extraction per key from numbered attempts (raw, error).

    The first accepted answer wins. Otherwise the last attempt on record counts: JSON that fails the
    schema is still returned, text without JSON too, an error gives NULL. JSON ``null`` counts as failed. ``attempts``
    leaves out later ones and ``raw_chars`` cuts text without JSON (usual: RAW_ANSWER_CHARS); by default all counts. Aggregates only.
    """
    allowed = answers if attempts is None else answers.where(F.col("attempt") <= attempts)
    graded = grade_answers(allowed, schema)
    value = F.when(F.col("error").isNotNull(), F.lit(None)).otherwise(
        F.coalesce("json_text", F.col("raw") if raw_chars is None else cap(F.col("raw"), raw_chars))
    )
    row = F.struct("attempt", value.alias("value"), F.col("json_text").isNotNull().alias("is_json"))
    picked = graded.groupBy(*keys).agg(
        F.min(F.when(F.col("accepted"), row)).alias("good"),
        F.max(row).alias("final"),
    )
    chosen = F.coalesce("good", "final")
    null_json = chosen["is_json"] & (chosen["value"] == "null")
    extraction = F.when(~F.coalesce(null_json, F.lit(False)), chosen["value"])
    return picked.select(
        *keys,
        extraction.alias("extraction"),
        F.coalesce(chosen["is_json"], F.lit(False)).alias("is_json"),
        F.when(extraction.isNull(), "Extraction failed").alias("error"),
    )


def retry_prompts(prompts: DataFrame, answers: DataFrame, keys: list[str], schema: dict | None = None) -> DataFrame:
    """Prompts whose first answer was not accepted, with the bad answer to show the model.

    After a failed call the thread starts afresh.
    """
    graded = grade_answers(answers, schema)
    again = graded.where(~F.col("accepted")).select(
        *keys, F.when(F.col("error").isNull(), F.col("raw")).alias("previous")
    )
    return prompts.join(again, keys)


def ask(prompts: DataFrame, fn: Callable, keys: list[str], schema: dict | None = None) -> DataFrame:
    """Run both attempts: all prompts once, then those without an accepted answer once more.

    The first answers are needed twice and model calls are costly, so they are written out.
    """
    folder = work_folder(prompts.sparkSession, "answers")
    system = F.lit(extract_system(bool(schema)))
    prompts = materialize(prompts, f"{folder}/prompts")
    first_in = prompts.select(*keys, chat_thread(system, F.col("user_prompt")).alias("messages"))
    first = materialize(with_model(first_in, fn).select(*keys, "raw", "error"), f"{folder}/first")
    retry = retry_prompts(prompts, first, keys, schema)
    second_in = retry.select(
        *keys, chat_thread(system, F.col("user_prompt"), F.col("previous")).alias("messages")
    )
    second = materialize(with_model(second_in, fn).select(*keys, "raw", "error"), f"{folder}/second")
    return first.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2)))


def fill_missing(requested: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Requested URLs without any result row get an error row."""
    missing = requested.join(results.select(*keys).distinct(), keys, "left_anti")
    return results.unionByName(
        missing.select(
            *keys, F.lit(None).cast("string").alias("extraction"), F.lit("No content to extract").alias("error")
        )
    )


def outcome(failed: Column, total: Column) -> Column:
    return F.when(failed == 0, "success").when(failed < total, "partial").otherwise("error")


def run_extraction(
    pages: DataFrame,
    mode: str,
    fn: Callable,
    schema: dict | None = None,
    page_chars: int | None = None,
    raw_chars: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Extraction rows and one outcome row per request.

    ``page_chars`` cuts page texts and ``raw_chars`` answers without JSON; by default both are whole.

    ``pages`` has request_id, position, url, prompt, markdown_content, error. ``failed`` counts pages
    without content only; a failed model call does not change the outcome.
    """
    usable, failures = scrape_failures(pages, mode, page_chars)
    if mode == "combined":
        prompts, keys = combined_prompts(usable, schema), ["request_id", "url"]
        answers = resolve_answers(ask(prompts, fn, keys, schema), keys, schema, raw_chars=raw_chars)
        rows = answers.withColumn("position", F.lit(2147483647))
    else:
        prompts, keys = page_prompts(usable, schema), ["request_id", "position", "url"]
        rows = resolve_answers(ask(prompts, fn, keys, schema), keys, schema, raw_chars=raw_chars)
    columns = ["request_id", "position", "url", "extraction", "error"]
    failed = failures.withColumn("extraction", F.lit(None).cast("string"))
    data = failed.select(*columns).unionByName(rows.select(*columns))
    counts = (
        pages.select("request_id", F.lit(0).alias("bad"))
        .unionByName(failures.select("request_id", F.lit(1).alias("bad")))
        .groupBy("request_id")
        .agg(F.count_if(F.col("bad") == 0).alias("total_urls"), F.sum("bad").alias("failed_urls"))
    )
    summary = counts.select(
        "request_id",
        "total_urls",
        "failed_urls",
        (F.col("failed_urls") == 0).alias("success"),
        outcome(F.col("failed_urls"), F.col("total_urls")).alias("status"),
    )
    return data, summary
