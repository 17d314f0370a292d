"""Rules by request against plain Python, and requests from JSON to history."""

import json
import random
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from webgleaner.operators.history import history_rows
from webgleaner.operators.request_rules import filter_by_request_rules, longest_literal, request_rules
from webgleaner.operators.validate import check_requests
from webgleaner.plans.requests import SUMMARY_FAILED, crawl_requests, research_requests

PATTERNS = ["^/a", "b$", "c.d", "x*y", "(", "[0-9]{2}", "q?", "/a|/b", "\\.html$", "*"]
DOMAINS = ["one.test", ".Two.test ", "a.one.test", "", "test"]


def allowed(url, rules):
    """The rules of one request, spelled out."""
    host, path = urlparse(url).hostname or "", urlparse(url).path
    under = lambda d: host == d or host.endswith("." + d)
    lists = {k: [v for kind, v in rules if kind == k] for k in ("allow", "block", "include", "exclude")}
    clean = {k: [d for d in (v.strip().lower().lstrip(".") for v in lists[k]) if d] for k in ("allow", "block")}
    if not host or any(map(under, clean["block"])) or (clean["allow"] and not any(map(under, clean["allow"]))):
        return False

    def hit(pattern):
        try:
            return re.search(pattern, path) is not None
        except re.error:
            return False

    return not any(map(hit, lists["exclude"])) and (not lists["include"] or any(map(hit, lists["include"])))


@pytest.mark.parametrize("seed", range(3))
def test_rules_match_plain_python(spark, seed):
    rng = random.Random(seed)
    rules = [(r, k, v) for r in range(12) for k in ("allow", "block", "include", "exclude") for v in rng.sample(DOMAINS if k in ("allow", "block") else PATTERNS, rng.choice([0, 0, 1, 2]))]
    hosts = ["one.test", "a.one.test", "b.a.one.test", "two.test", "xtwo.test", "other.example"]
    paths = ["", "/", "/a", "/a/b", "/c-d", "/xxy", "/q10", "/z.html", "/b"]
    urls = [(r, f"https://{rng.choice(hosts)}{rng.choice(paths)}", i) for i, r in enumerate([*range(12), None] * 12)]
    df = spark.createDataFrame(urls, "request_id int, url string, value int")
    table = spark.createDataFrame(rules, "request_id int, kind string, value string")
    got = {r["value"] for r in filter_by_request_rules(df, table).collect()}
    assert got == {i for r, u, i in urls if allowed(u, [(k, v) for q, k, v in rules if q == r])}


def test_no_rules_and_no_urls(spark):
    rules = spark.createDataFrame([], "request_id int, kind string, value string")
    df = spark.createDataFrame([(1, "https://x.test/a"), (1, "https://x.test/a"), (None, "https://x.test/"), (2, None), (2, "")], "request_id int, url string")
    assert filter_by_request_rules(df, rules).count() == 3
    assert filter_by_request_rules(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if p not in ("(", "*")])
def test_literals_stand_in_every_match(pattern):
    literal = longest_literal(pattern)
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("/abcdxyq.html19") for _ in range(8))
        if re.search(pattern, text):
            assert literal in text


def test_rules_of_requests(spark):
    payload = {"url": "x.test", "allow_domains": ["a.test", " "], "exclude_paths": ["^/b", "^/b"], "include_paths": None}
    df = spark.createDataFrame([(1, "crawl", json.dumps(payload)), (2, "crawl", "{}")], "request_id int, kind string, payload string")
    got = sorted(tuple(r) for r in request_rules(check_requests(df)).collect())
    assert got == [(1, "allow", "a.test"), (1, "exclude", "^/b")]


@pytest.fixture
def model():
    """Defined inside, so that it is shipped with the job."""

    def answer(threads):
        return [RuntimeError("down") if "fail" in t else f" summary of {len(json.loads(t))} turns " for t in threads]

    return answer


def test_crawl_requests_to_history(spark, model):
    text = "words of the page " * 20
    page = lambda *links: f"<article><p>{text}</p>{''.join(f'<a href={x}>x</a>' for x in links)}</article>"
    responses = spark.createDataFrame(
        [("https://x.test/", page("/a", "/b", "/c")), ("https://x.test/a", page()), ("https://x.test/b", page("/d")), ("https://x.test/c", page())], "url string, html string"
    )
    payloads = [
        {"url": "x.test", "max_depth": 2}, {"url": "x.test", "max_depth": 2, "exclude_paths": ["^/b"], "generate_summary": True},
        {"url": "x.test", "block_domains": ["x.test"]}, {"url": "ftp://x.test"}, {"url": "none.test", "generate_summary": True},
        {"url": "x.test", "max_pages": 2, "generate_summary": True, "summary_prompt": "fail"},
    ]
    requests = spark.createDataFrame([(i, "crawl", json.dumps(p)) for i, p in enumerate(payloads)], "request_id int, kind string, payload string")
    pages, summaries, entries, rejected = crawl_requests(requests, responses, model)
    visited = {}
    for r in pages.orderBy("request_id", "rank").collect():
        visited.setdefault(r.request_id, []).append((r.url.removeprefix("https://x.test"), r.links_found))
    assert visited == {
        0: [("/", 3), ("/a", 0), ("/b", 1), ("/c", 0), ("/d", 0)], 1: [("/", 2), ("/a", 0), ("/c", 0)], 4: [("https://none.test/", 0)], 5: [("/", 3), ("/a", 0)],
    }
    assert {r.request_id: r.ai_summary for r in summaries.collect()} == {1: "summary of 2 turns", 5: SUMMARY_FAILED}
    kept = {r.id: (r.query_or_url, json.loads(r.params), json.loads(r.result), r.result_size) for r in history_rows(entries).collect()}
    assert set(kept) == {"0", "1", "4", "5"}
    assert kept["1"] == ("https://x.test", {"max_depth": 2, "max_pages": 20}, {"ai_summary": "summary of 2 turns", "total_pages": 3}, 3)
    assert kept["0"][2:] == ({"total_pages": 5}, 5)
    reasons = {r.request_id: r.reason for r in rejected.collect()}
    assert set(reasons) == {2, 3} and reasons[2] == "Domain is not allowed" and reasons[3].startswith("url: ")


def test_research_requests_to_history(spark, model):
    page = "<article><p>" + "words of the page " * 20 + "</p></article>"
    responses = spark.createDataFrame([("https://x.test/a", page), ("https://y.test/b", page)], "url string, html string")
    hits = [{"url": "https://x.test/a", "title": "A", "content": ""}, {"url": "https://y.test/b", "title": "B", "content": ""}]
    found = spark.createDataFrame([(1, hits), (2, hits), (3, [])], "request_id int, results array<struct<url:string,title:string,content:string>>")
    payloads = [{"query": "q", "generate_summary": True}, {"query": "q", "block_domains": ["x.test"]}, {"query": "q"}, {"query": ""}]
    requests = spark.createDataFrame([(i + 1, "research", json.dumps(p)) for i, p in enumerate(payloads)], "request_id int, kind string, payload string")
    pages, summaries, entries, rejected = research_requests(requests, found, responses, model)
    assert sorted((r.request_id, r.title) for r in pages.collect()) == [(1, "A"), (1, "B"), (2, "B")]
    assert [(r.request_id, r.ai_summary) for r in summaries.collect()] == [(1, "summary of 2 turns")]
    assert sorted((r.id, r.result_size) for r in entries.collect()) == [("1", 2), ("2", 1)]
    assert [r.request_id for r in rejected.collect()] == [4]
    assert entries.where(F.col("status") != "done").count() == 0
