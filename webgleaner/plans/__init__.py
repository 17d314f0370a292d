"""The four jobs a user runs: research, crawl, map, extract."""

from .jobs import crawl_job, extract_job, map_job, research_job
from .requests import crawl_requests, research_requests

__all__ = ["crawl_job", "crawl_requests", "extract_job", "map_job", "research_job", "research_requests"]
