"""Domain rules, address checks and request validation."""

from pyspark.sql import functions as F

from ..functions import hosts as H
from ..functions.content import looks_like_pdf
from ..functions.urls import url_host
from ..operators import rules as R
from ..operators import validate as V
from .common import HOST, pages, table

QUERIES, ORACLES = {}, {}

ALLOW = ["example.com", ".Example.ORG "]
BLOCK = ["cheap-pills.example.com", "spam-farm.example.org"]


def p8_domain_rules(spark, sf):
    return pages(spark, sf, "page_id", "url").select(
        "page_id",
        H.domain_allowed(F.col("url"), ALLOW, BLOCK).alias("allowed"),
        H.domain_allowed(F.col("url"), (), BLOCK).alias("not_blocked"),
    )


ORACLES["p8_domain_rules"] = f"""WITH h AS (SELECT page_id, {HOST} AS h FROM pages),
m AS (SELECT page_id, (h = 'example.com' OR ends_with(h, '.example.com') OR h = 'example.org' OR ends_with(h, '.example.org')) AS a,
 (h = 'cheap-pills.example.com' OR ends_with(h, '.cheap-pills.example.com') OR h = 'spam-farm.example.org'
 OR ends_with(h, '.spam-farm.example.org')) AS b FROM h)
SELECT page_id, a AND NOT b AS allowed, NOT b AS not_blocked FROM m"""

RULE = """CASE page_id % 3 WHEN 0 THEN concat(' ', upper(h)) WHEN 1 THEN h ELSE '  ' END"""


def _rules(spark, sf):
    return pages(spark, sf, "page_id", f"{HOST} AS h").selectExpr(f"{RULE} AS domain")


def p9_rule_merge(spark, sf):
    return R.with_media_rules(_rules(spark, sf))


ORACLES["p9_rule_merge"] = f"""WITH h AS (SELECT page_id, {HOST} AS h FROM pages)
SELECT lower(trim({RULE})) AS domain FROM h WHERE trim({RULE}) <> '' UNION SELECT unnest([{', '.join(f"'{d}'" for d in H.MEDIA_DOMAINS)}])"""


def u3_rule_union(spark, sf):
    sources = table(spark, sf, "documents").selectExpr("concat(source, '.Example.net') AS domain")
    return R.merge_rule_tables(_rules(spark, sf), sources)


ORACLES["u3_rule_union"] = f"""WITH h AS (SELECT page_id, {HOST} AS h FROM pages)
SELECT lower(trim({RULE})) AS domain FROM h WHERE trim({RULE}) <> '' UNION SELECT concat(source, '.example.net') FROM documents"""


def j3_rule_join(spark, sf):
    """Block the hosts with five pages or more, allow two domains, by rule tables."""
    urls = pages(spark, sf, "page_id", "url")
    busy = urls.groupBy(url_host(F.col("url")).alias("domain")).count().where("count >= 5").select("domain")
    allow = table(spark, sf, "nation").selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN 'example.com' ELSE '.Example.org' END AS domain")
    return R.filter_by_rules(urls, allow=allow, block=busy)


ORACLES["j3_rule_join"] = f"""WITH h AS (SELECT page_id, url, {HOST} AS h FROM pages),
b AS (SELECT h FROM h GROUP BY h HAVING count(*) >= 5)
SELECT page_id, url FROM h WHERE (ends_with(h, '.example.com') OR ends_with(h, '.example.org') OR h IN ('example.com', 'example.org'))
AND NOT EXISTS (SELECT 1 FROM b WHERE h.h = b.h OR ends_with(h.h, concat('.', b.h)))"""

ADDRESS = """CASE event_id % 12
 WHEN 0 THEN concat(user_id % 256, '.', event_id % 256, '.1.', event_id % 200)
 WHEN 1 THEN concat('172.', event_id % 64, '.0.', user_id % 256)
 WHEN 2 THEN concat('192.168.', user_id % 256, '.', event_id % 256)
 WHEN 3 THEN concat('100.', event_id % 256, '.7.7')
 WHEN 4 THEN concat('198.', event_id % 64, '.', user_id % 128, '.9')
 WHEN 5 THEN concat('host', user_id, '.example.com')
 WHEN 6 THEN CASE event_id % 5 WHEN 0 THEN 'LOCALHOST' WHEN 1 THEN '[::1]' WHEN 2 THEN 'metadata.google.internal' WHEN 3 THEN '' ELSE '0:0:0:0:0:0:0:1' END
 WHEN 7 THEN concat('fe', event_id % 90 + 10, '::', user_id)
 WHEN 8 THEN concat('2001:db8::', user_id)
 WHEN 9 THEN concat('10.0.0.', event_id % 600)
 WHEN 10 THEN concat('fd', event_id % 90 + 10, ':1::2')
 ELSE concat('203.0.', user_id % 128, '.4') END"""

_OCTETS = """try_cast(split_part(host, '.', 1) AS BIGINT) AS a, try_cast(split_part(host, '.', 2) AS BIGINT) AS b,
 try_cast(split_part(host, '.', 3) AS BIGINT) AS c, try_cast(split_part(host, '.', 4) AS BIGINT) AS d"""
_BAD_V4 = """(a = 127 OR a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254)
 OR a BETWEEN 224 AND 239 OR a = 0 OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100)
 OR (a = 203 AND b = 0 AND c = 113) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b BETWEEN 18 AND 19))"""


def p10_private_host(spark, sf):
    return (
        table(spark, sf, "events")
        .selectExpr("event_id", f"{ADDRESS} AS host")
        .select("event_id", "host", H.is_private_host(F.col("host")).alias("private"))
    )


ORACLES["p10_private_host"] = f"""WITH h AS (SELECT event_id, {ADDRESS} AS host FROM events), o AS (SELECT *, {_OCTETS} FROM h)
SELECT event_id, host, CASE WHEN event_id % 12 IN (0, 1, 2, 3, 4, 9, 11) THEN a < 256 AND b < 256 AND c < 256 AND d < 256 AND {_BAD_V4}
 WHEN event_id % 12 IN (5, 8) THEN false WHEN event_id % 12 = 6 THEN true
 WHEN event_id % 12 = 7 THEN CAST(substr(host, 3, 2) AS INTEGER) BETWEEN 80 AND 99
 ELSE true END AS private FROM o"""

DNS_IP = """CASE page_id % 4 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN concat('93.184.', page_id % 256, '.34')
 WHEN 2 THEN concat('172.', page_id % 40, '.0.1') ELSE 'fe80::1%eth0' END"""


def p11_resolved_hosts(spark, sf):
    """Hosts of all pages against a DNS table with one address per page."""
    dns = pages(spark, sf, f"{HOST} AS host", f"{DNS_IP} AS ip")
    return R.blocked_hosts(pages(spark, sf, f"{HOST} AS host"), dns)


ORACLES["p11_resolved_hosts"] = f"""SELECT {HOST} AS host, bool_or(page_id % 4 = 3 OR (page_id % 4 = 2 AND page_id % 40 BETWEEN 16 AND 31)) AS blocked
 FROM pages GROUP BY 1"""


def j4_dns_join(spark, sf):
    dns = pages(spark, sf, f"{HOST} AS host", f"{DNS_IP} AS ip")
    return R.safe_urls(pages(spark, sf, "page_id", "url"), dns=dns)


ORACLES["j4_dns_join"] = f"""WITH b AS (SELECT {HOST} AS h FROM pages WHERE page_id % 4 = 3 OR (page_id % 4 = 2 AND page_id % 40 BETWEEN 16 AND 31))
SELECT page_id, url FROM pages WHERE {HOST} NOT IN (SELECT h FROM b)"""

RISKY = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN replace(replace(url, 'https:', 'ftp:'), 'http:', 'file:')
 WHEN 2 THEN concat('http://10.0.0.', page_id % 256, ':8080/admin') WHEN 3 THEN concat(' https://8.8.8.', page_id % 256, '/')
 WHEN 4 THEN 'http://169.254.169.254/latest/meta-data/' ELSE '' END"""


def p12_safe_url(spark, sf):
    return pages(spark, sf, "page_id", f"{RISKY} AS target").select("page_id", H.is_safe_url(F.col("target")).alias("safe"))


ORACLES["p12_safe_url"] = "SELECT page_id, page_id % 6 IN (0, 3) AS safe FROM pages"

KIND = """CASE event_type WHEN 'click' THEN 'crawl' WHEN 'view' THEN 'map' WHEN 'error' THEN 'other' ELSE 'research' END"""
_PAYLOAD = """CASE event_type
 WHEN 'click' THEN to_json(named_struct('url', concat('host', user_id, '.example.com'), 'max_depth', event_id % 13, 'max_pages', event_id % 120))
 WHEN 'view' THEN to_json(named_struct('url', concat(CASE WHEN event_id % 2 = 0 THEN 'https' ELSE 'ftp' END, '://h', user_id, '.example.org'),
   'max_urls', event_id % 6000, 'discovery_method', CASE event_id % 4 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'crawl' WHEN 2 THEN 'hybrid' ELSE 'none' END))
 WHEN 'error' THEN '{}' WHEN 'signup' THEN '[1, 2'
 ELSE to_json(named_struct('query', repeat('q', CAST(event_id % 600 AS INT)), 'max_results', event_id % 25)) END"""


def p13_request_violations(spark, sf):
    requests = table(spark, sf, "events").selectExpr("event_id AS request_id", f"{KIND} AS kind", f"{_PAYLOAD} AS payload")
    checked = V.check_requests(requests)
    return checked.select("request_id", "kind", F.array_join("violations", "; ").alias("violations"))


ORACLES["p13_request_violations"] = f"""WITH e AS (SELECT *, {KIND} AS kind FROM events)
SELECT event_id AS request_id, kind, CASE event_type WHEN 'signup' THEN 'payload: must be a JSON object' WHEN 'error' THEN 'kind: unknown request kind'
 WHEN 'click' THEN concat_ws('; ', CASE WHEN event_id % 13 NOT BETWEEN 1 AND 10 THEN 'max_depth: must be between 1 and 10' END,
  CASE WHEN event_id % 120 NOT BETWEEN 1 AND 100 THEN 'max_pages: must be between 1 and 100' END)
 WHEN 'view' THEN concat_ws('; ', CASE WHEN event_id % 6000 NOT BETWEEN 1 AND 5000 THEN 'max_urls: must be between 1 and 5000' END,
  CASE WHEN event_id % 4 = 3 THEN 'discovery_method: must be one of sitemap, crawl, hybrid' END,
  CASE WHEN event_id % 2 = 1 THEN 'url: URL must start with http:// or https://' END)
 ELSE concat_ws('; ', CASE WHEN event_id % 25 NOT BETWEEN 1 AND 20 THEN 'max_results: must be between 1 and 20' END,
  CASE WHEN event_id % 600 NOT BETWEEN 1 AND 500 THEN 'query: must be text of 1 to 500 characters' END) END AS violations FROM e"""


def _extract_requests(spark, sf):
    payload = F.expr(
        """concat('{"prompt": "list all the prices", "urls": ["', url, '", {"url": "', url, '", "force_js_render": ',
        CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END, '}, {"url": "b.example.com"}',
        CASE page_id % 5 WHEN 3 THEN ', {"force_js_render": true}' WHEN 4 THEN ', 7' ELSE '' END, ']}')"""
    )
    return pages(spark, sf, "page_id AS request_id", "page_id", "url").select(
        "request_id", F.lit("extract").alias("kind"), payload.alias("payload")
    )


def p14_url_specs(spark, sf):
    docs = _extract_requests(spark, sf).select("request_id", F.try_parse_json("payload").alias("doc"))
    specs = docs.select("request_id", F.posexplode(V.url_specs(F.col("doc"))).alias("position", "s"))
    return specs.select(
        "request_id", "position", F.coalesce("s.url", F.lit("")).alias("url"),
        F.coalesce(F.col("s.force_js_render").cast("string"), F.lit("inherit")).alias("force_js_render"),
        F.coalesce("s.reject_reason", F.lit("")).alias("reject_reason"),
    )


ORACLES["p14_url_specs"] = """SELECT page_id AS request_id, 0 AS position, url, 'inherit' AS force_js_render, '' AS reject_reason FROM pages
UNION ALL SELECT page_id, 1, url, CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END, '' FROM pages
UNION ALL SELECT page_id, 2, 'https://b.example.com', 'inherit', '' FROM pages
UNION ALL SELECT page_id, 3, '', 'true', 'URL object is missing ''url''' FROM pages WHERE page_id % 5 = 3
UNION ALL SELECT page_id, 3, '', 'inherit', 'URL must be a string or an object' FROM pages WHERE page_id % 5 = 4"""


def j7_render_override(spark, sf):
    """The entry's render flag wins over the request's; requests with a bad entry are quarantined."""
    good, _ = V.split_requests(_extract_requests(spark, sf))
    return V.explode_specs(V.request_fields(good, "extract")).select("request_id", "position", "url", "force_js_render")


ORACLES["j7_render_override"] = """SELECT page_id AS request_id, 0 AS position, url, false AS force_js_render FROM pages WHERE page_id % 5 < 3
UNION ALL SELECT page_id, 1, url, page_id % 2 = 0 FROM pages WHERE page_id % 5 < 3
UNION ALL SELECT page_id, 2, 'https://b.example.com', false FROM pages WHERE page_id % 5 < 3"""

_CT = "CASE page_id % 5 WHEN 0 THEN 'Application/PDF; x' WHEN 1 THEN 'text/html' WHEN 2 THEN '' ELSE 'application/octet-stream' END"
_PU = "CASE WHEN page_id % 4 = 0 THEN concat(regexp_extract(url, '^([^?#]*)', 1), '.PDF?v=1') ELSE url END"


def p16_pdf_detect(spark, sf):
    df = pages(spark, sf, "page_id", f"{_PU} AS u", f"{_CT} AS ct", "CAST(CASE WHEN page_id % 3 = 0 THEN '%PDF-1.7' ELSE html END AS BINARY) AS body")
    return df.select("page_id", looks_like_pdf(F.col("u"), F.col("ct"), F.col("body")).alias("is_pdf"))


ORACLES["p16_pdf_detect"] = "SELECT page_id, page_id % 5 = 0 OR page_id % 4 = 0 OR page_id % 3 = 0 AS is_pdf FROM pages"


def p17_redirect_safety(spark, sf):
    df = pages(spark, sf, "page_id", "url", f"{RISKY} AS final_url")
    return R.safe_urls(df, "final_url").select("page_id", "final_url")


ORACLES["p17_redirect_safety"] = f"SELECT page_id, {RISKY} AS final_url FROM pages WHERE page_id % 6 IN (0, 3)"


def p18_request_gate(spark, sf):
    specs = pages(spark, sf, "page_id div 20 AS request_id", "url")
    return R.request_gate(specs, H.domain_allowed(F.col("url"), (), BLOCK) & H.is_safe_url(F.col("url")))


ORACLES["p18_request_gate"] = f"""WITH h AS (SELECT page_id // 20 AS request_id, {HOST} IN ('cheap-pills.example.com', 'spam-farm.example.org')
 OR ends_with({HOST}, '.cheap-pills.example.com') OR ends_with({HOST}, '.spam-farm.example.org') AS bad FROM pages)
SELECT request_id, count(*) AS total_urls, count(*) FILTER (bad) AS blocked_urls, count(*) FILTER (bad) = 0 AS accepted FROM h GROUP BY 1"""


def p18_accepted_urls(spark, sf):
    specs = pages(spark, sf, "page_id div 20 AS request_id", "page_id", "url")
    return R.accepted_requests(specs, (), BLOCK)


ORACLES["p18_accepted_urls"] = f"""WITH h AS (SELECT page_id // 20 AS request_id, page_id, url, {HOST} IN ('cheap-pills.example.com', 'spam-farm.example.org')
 OR ends_with({HOST}, '.cheap-pills.example.com') OR ends_with({HOST}, '.spam-farm.example.org') AS bad FROM pages)
SELECT request_id, page_id, url FROM h WHERE request_id NOT IN (SELECT request_id FROM h WHERE bad)"""

for _f in (
    p8_domain_rules, p9_rule_merge, u3_rule_union, j3_rule_join, p10_private_host, p11_resolved_hosts, j4_dns_join, p12_safe_url,
    p13_request_violations, p14_url_specs, j7_render_override, p16_pdf_detect, p17_redirect_safety, p18_request_gate, p18_accepted_urls,
):
    QUERIES[_f.__name__] = _f
