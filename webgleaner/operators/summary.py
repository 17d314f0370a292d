"""Summary prompts per request and their answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import SUMMARY_EMPTY, chat_thread, summary_document, summary_prompt, summary_system
from ..functions.text import strip
from ..session import materialize, work_folder
from .extraction import with_model
from .scale import number_rows


def usable_documents(documents: DataFrame) -> DataFrame:
    """Documents with text."""
    return documents.where(F.coalesce(F.col("text"), F.lit("")) != "")


def numbered_documents(documents: DataFrame, per_bucket: int = 1000) -> DataFrame:
    """Usable documents with their 1-based ``number`` in the request; a large request is numbered by ranges of positions."""
    rows = usable_documents(documents).select("request_id", "position", "text")
    return number_rows(rows, ["request_id"], F.floor(F.col("position") / per_bucket), [F.col("position")], "number")


def ordered_texts(documents: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(request_id, text): the texts of a request in order, as one value."""
    parts = F.array_sort(F.collect_list(F.struct("position", F.coalesce("text", F.lit("")).alias("text"))))
    joined = documents.groupBy("request_id").agg(parts.alias("_parts"))
    return joined.select("request_id", F.array_join(F.transform("_parts", lambda p: p["text"]), separator).alias("text"))


def char_totals(documents: DataFrame, keys: list[str], doc_chars: int | None = None) -> DataFrame:
    """Characters per group before and after the cut of single documents."""
    after = F.char_length(summary_document(F.col("text"), doc_chars))
    return documents.groupBy(*keys).agg(F.sum(F.char_length("text")).alias("chars_before"), F.sum(after).alias("chars_after"))


def summary_prompts(documents: DataFrame, requests: DataFrame, doc_chars: int | None = None) -> DataFrame:
    """One prompt per request: (request_id, document_count, chars_before, chars_after, system, user).

    ``documents`` has request_id, position, text; all texts are whole unless ``doc_chars`` cuts them (before the shuffle).
    A prompt is one value, so a request's documents meet in one row by nature. ``requests`` has request_id, query, summary_prompt. Empty documents
    do not count. Requests without documents get NULL prompts.
    """
    capped = usable_documents(documents).select(
        "request_id",
        "position",
        F.char_length("text").alias("_before"),
        summary_document(F.col("text"), doc_chars).alias("_doc"),
    )
    grouped = capped.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "_doc"))).alias("_docs"),
        F.sum("_before").alias("chars_before"),
        F.sum(F.char_length("_doc")).alias("chars_after"),
    )
    texts = F.transform("_docs", lambda d: d["_doc"])
    joined = requests.join(grouped, "request_id", "left")
    has_docs = F.col("_docs").isNotNull()
    return joined.select(
        "request_id",
        F.coalesce(F.size("_docs"), F.lit(0)).alias("document_count"),
        F.coalesce("chars_before", F.lit(0)).alias("chars_before"),
        F.coalesce("chars_after", F.lit(0)).alias("chars_after"),
        F.when(has_docs, summary_system(F.col("summary_prompt"))).alias("system_prompt"),
        F.when(has_docs, summary_prompt(texts, F.col("query"))).alias("user_prompt"),
    )


def run_summaries(documents: DataFrame, requests: DataFrame, fn: Callable, doc_chars: int | None = None) -> DataFrame:
    """(request_id, ai_summary, error): the model's trimmed answer, a fixed sentence without documents."""
    folder = work_folder(requests.sparkSession, "summaries")
    prompts = materialize(summary_prompts(documents, requests, doc_chars), f"{folder}/prompts")
    asked = prompts.where(F.col("user_prompt").isNotNull()).select(
        "request_id", chat_thread(F.col("system_prompt"), F.col("user_prompt")).alias("messages")
    )
    # Written, so that a second use of the result does not call the model again.
    answers = materialize(with_model(asked, fn).select("request_id", strip(F.col("raw")).alias("ai_summary"), "error"), f"{folder}/answers")
    empty = prompts.where(F.col("user_prompt").isNull()).select(
        "request_id", F.lit(SUMMARY_EMPTY).alias("ai_summary"), F.lit(None).cast("string").alias("error")
    )
    return answers.unionByName(empty)
