"""Domain rules, private addresses, request rows."""

import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from webgleaner.functions import hosts as H
from webgleaner.operators import rules as R
from webgleaner.operators import validate as V


@pytest.mark.parametrize(
    "url,allow,block,expected",
    [
        ("http://shop.lake.org/a?b", ["lake.org"], ["shop.lake.org"], False),
        ("http://shop.lake.org/a?b", ["shop.lake.org"], ["boat.lake.org"], True),
        ("http://lake.org", ["shop.lake.org"], [], False),
        ("http://deep.er.shop.lake.org:81/", ["lake.org"], [], True),
        ("http://snowlake.org", [], ["lake.org"], True),
        ("http://snowlake.org", ["lake.org"], [], False),
        ("http://Shop.LAKE.org", [], [".lake.org"], False),
        ("http://hill.net", [], [], True),
        ("lake.org", [], [], False),
        ("", [], ["lake.org"], False),
    ],
)
def test_domain_rules_literal_and_joined(spark, url, allow, block, expected):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(H.domain_allowed(F.col("url"), allow, block)).first()[0] is expected
    tables = {k: spark.createDataFrame([(d,) for d in v], "domain string") for k, v in (("allow", allow), ("block", block))}
    assert (R.filter_by_rules(df, **tables).count() == 1) is expected


def test_merged_rules_are_the_distinct_clean_entries():
    """Any split of the entries over two lists gives them once each, in order, however they are written."""
    names = [f"n{i}.test" for i in range(6)]
    written = [f"{' ' * (i % 3)}{n.upper() if i % 2 else n}\t" for i, n in enumerate(names)]
    for cut in range(len(names) + 1):
        assert H.merge_rules(written[:cut], [*written[cut:], "", " \n", names[0], written[-1]]) == names


# The ends of every blocked range, and what lies just outside of it.
NETWORKS = [ipaddress.ip_network(n) for n in H.BLOCKED_NETWORKS]
PRIVATE = [str(n[i]) for n in NETWORKS for i in (0, -1)] + list(H.BLOCKED_HOSTS) + ["", "fe9a::2%en0", "0:0:0:0:0:0:0:1"]


def outside(network):
    kind = ipaddress.IPv4Address if network.version == 4 else ipaddress.IPv6Address
    around = [int(network[0]) - 1, int(network[-1]) + 1]
    near = [kind(n) for n in around if 0 <= n < 1 << kind(0).max_prefixlen]
    return [str(a) for a in near if not any(a in n for n in NETWORKS)]


PUBLIC = [a for n in NETWORKS for a in outside(n)] + "lake.org 10.3.4.256 010.3.4.5 3:4 ::ffff:10.3.4.5 10.3.4.5.lake.org".split()


def test_private_hosts(spark):
    df = spark.createDataFrame([(h,) for h in PRIVATE + PUBLIC], "h string")
    got = {r.h: r.p for r in df.select("h", H.is_private_host(F.col("h")).alias("p")).collect()}
    assert [h for h in PRIVATE if not got[h]] == []
    assert [h for h in PUBLIC if got[h]] == []
    mapped = spark.createDataFrame([("::ffff:10.0.0.1",)], "h string")
    assert mapped.select(H.is_private_host(F.col("h"), block_mapped=True)).first()[0]


def test_safe_urls(spark):
    bad = ["ftp://example.com", "file:///etc/passwd", "javascript:alert(1)", "", "  ", "http://127.0.0.1:8080/admin", "http://169.254.169.254/latest/meta-data/"]
    df = spark.createDataFrame([(u,) for u in [*bad, "https://8.8.8.8", " https://example.com "]], "url string")
    assert [r.url for r in R.safe_urls(df).collect()] == ["https://8.8.8.8", " https://example.com "]


def test_dns_gate(spark):
    urls = spark.createDataFrame([("https://a.com/1",), ("https://B.com/2",), ("https://c.com",)], "url string")
    dns = spark.createDataFrame([("a.com", "8.8.8.8"), ("a.com", "10.0.0.1"), ("b.com", "fe80::1%eth0")], "host string, ip string")
    assert [r.url for r in R.safe_urls(urls, dns=dns).collect()] == ["https://c.com"]
    hosts = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",), ("10.1.1.1",)], "host string")
    assert {r.host: r.blocked for r in R.blocked_hosts(hosts, dns).collect()} == {"a.com": True, "b.com": True, "c.com": False, "10.1.1.1": True}


REQUESTS = [
    ("research", {"query": "hello world"}, True),
    ("research", {"query": "q", "max_results": 0}, False),
    ("research", {"query": "q", "max_results": 21}, False),
    ("research", {"query": "q", "summary_prompt": "x" * 2001}, False),
    ("research", {"query": "q", "summary_prompt": None}, True),
    ("research", {}, False),
    ("crawl", {"url": "example.com"}, True),
    ("crawl", {"url": "ftp://example.com"}, False),
    ("crawl", {"url": "example.com", "max_pages": 101}, False),
    ("map", {"url": "example.com", "allow_domains": ["a.com"]}, True),
    ("map", {"url": "example.com", "discovery_method": "invalid"}, False),
    ("map", {"url": "example.com", "block_domains": ["a"] * 101}, False),
    ("extract", {"urls": ["example.com", "https://b.com"], "prompt": "list the prices"}, True),
    ("extract", {"urls": [{"url": "b.com", "force_js_render": True}, "c.com", {"url": "d.com", "force_js_render": False}], "prompt": "list the prices"}, True),
    ("extract", {"urls": [{"force_js_render": True}], "prompt": "list the prices"}, False),
    ("extract", {"urls": ["ftp://x.com"], "prompt": "list the prices"}, False),
    ("extract", {"urls": ["x.com"], "prompt": "short"}, False),
    ("extract", {"urls": [], "prompt": "list the prices"}, False),
    ("extract", {"urls": ["x.com"] * 21, "prompt": "list the prices"}, False),
    ("other", {}, False),
]


def test_request_rows(spark):
    rows = [(i, k, json.dumps(p)) for i, (k, p, _) in enumerate(REQUESTS)] + [(99, "crawl", "{broken")]
    df = spark.createDataFrame(rows, "request_id int, kind string, payload string")
    good, bad = V.split_requests(df)
    assert sorted(r.request_id for r in good.collect()) == [i for i, r in enumerate(REQUESTS) if r[2]]
    assert good.count() + bad.count() == len(rows)
    research = V.request_fields(good, "research").orderBy("request_id").first()
    assert (research.query, research.max_results) == ("hello world", 5)
    specs = V.explode_specs(V.request_fields(good, "extract")).orderBy("request_id", "position").collect()
    assert [(s.url, s.url_force_js_render, s.force_js_render) for s in specs if s.request_id == 13] == [
        ("https://b.com", True, True), ("https://c.com", None, False), ("https://d.com", False, False)
    ]


def test_whole_request_gate(spark):
    specs = spark.createDataFrame([(1, "https://a.com"), (1, "https://evil.com"), (2, "https://a.com"), (3, "http://10.0.0.1")], "request_id int, url string")
    assert [r.request_id for r in R.accepted_requests(specs, (), ["evil.com"]).collect()] == [2]
