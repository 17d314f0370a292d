"""Readers and writers of the engine's tables."""

from .readers import (
    LOG_SCHEMA,
    parse_log_lines,
    read_pages,
    read_raw_pages,
    read_search_results,
    search_hits,
)
from .envelopes import crawl_envelopes, extract_envelopes, map_envelopes, research_envelopes

__all__ = [
    "LOG_SCHEMA",
    "crawl_envelopes",
    "extract_envelopes",
    "map_envelopes",
    "parse_log_lines",
    "read_pages",
    "read_raw_pages",
    "read_search_results",
    "research_envelopes",
    "search_hits",
]
