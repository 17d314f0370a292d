"""Sitemaps and site maps. Every page stands for a site whose sitemaps list the page's anchors."""

import gzip
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..functions.content import anchor_hrefs
from ..operators import sitemaps as S
from ..operators.discovery import map_summary, run_discovery
from .common import pages, table

QUERIES, ORACLES = {}, {}

# The stand-in functions below run in Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SITE = "concat('https://p', page_id, '.example.org')"

# Site files by page_id % 5:
#   0 sitemap with all anchors
#   1 index over two sitemaps (first three anchors, the rest), the second through a nested index
#   2 robots.txt that names /maps/main.xml, served as text
#   3 nothing
#   4 robots.txt that names another site's sitemap


def _urlset(hrefs):
    rows = F.transform(
        hrefs,
        lambda h, i: F.concat(
            F.lit("<url><loc> "), F.col("site"), h, F.lit(" </loc><lastmod>2024-01-0"), (i + 1).cast("string"), F.lit("</lastmod></url>")
        ),
    )
    return F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.array_join(rows, ""),
        F.lit("<url><loc>https://external.example.net/x</loc></url><url><loc> </loc></url></urlset>"),
    )


def _index(*names):
    parts = [F.concat(F.lit("<sitemap><loc>"), F.col("site"), F.lit(f"/{n}</loc></sitemap>")) for n in names]
    return F.concat(F.lit("<sitemapindex>"), *parts, F.lit("</sitemapindex>"))


def site_files(spark, sf):
    base = pages(spark, sf, "page_id", "html", f"{_SITE} AS site").select(
        "page_id", "site", anchor_hrefs(F.col("html")).alias("hrefs"), (F.col("page_id") % 5).alias("kind")
    )

    def file(kind, path, content_type, text):
        return F.when(
            F.col("kind") == kind,
            F.struct(F.concat("site", F.lit(path)).alias("url"), F.lit(content_type).alias("content_type"), text.alias("text")),
        )

    files = F.array(
        file(0, "/sitemap.xml", "application/xml", _urlset(F.col("hrefs"))),
        file(1, "/sitemap.xml", "text/html", _index("sm-1.xml", "deep.xml", "sitemap.xml")),
        file(1, "/deep.xml", "text/xml", _index("sm-2.xml", "sm-1.xml")),
        file(1, "/sm-1.xml", "text/xml", _urlset(F.slice("hrefs", 1, 3))),
        file(1, "/sm-2.xml", "text/xml", _urlset(F.slice("hrefs", 4, 1000))),
        file(2, "/robots.txt", "text/plain", F.concat(F.lit("User-agent: *\n sitemap: "), F.col("site"), F.lit("/maps/main.xml\nSitemap: x\n"))),
        file(2, "/maps/main.xml", "text/plain", _urlset(F.col("hrefs"))),
        file(3, "/sitemap.xml", "text/html", F.lit("<html>not found</html>")),
        file(4, "/robots.txt", "text/plain", F.lit("Sitemap: https://elsewhere.example.net/sitemap.xml")),
    )
    return base.select(F.explode(F.array_compact(files)).alias("f")).select("f.url", F.lit(200).alias("status"), "f.content_type", "f.text")


def _seeds(spark, sf):
    return pages(spark, sf, "page_id AS seed_id", f"concat({_SITE}, '/') AS base_url")


_ANCHORS = f"""a AS (SELECT page_id, page_id % 5 AS kind, {_SITE} AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS n FROM pages)"""


def s3_sitemap_urls(spark, sf):
    """URL sets of the sites with a flat sitemap, path filter on."""
    docs = S.parse_documents(site_files(spark, sf).where(F.endswith("url", F.lit("/sitemap.xml"))))
    rows = S.urlset_rows(docs.withColumn("base_url", F.col("url")).drop("url"), exclude=["^/[A-Z]"])
    return rows.select("base_url", "pos", "url", "path", "depth", "source", "last_modified")


ORACLES["s3_sitemap_urls"] = f"""WITH {_ANCHORS} SELECT concat(site, '/sitemap.xml') AS base_url, CAST(n - 1 AS INTEGER) AS pos, concat(site, href) AS url,
 href AS path, 0 AS depth, 'sitemap' AS source, concat('2024-01-0', n) AS last_modified FROM a WHERE kind = 0 AND NOT regexp_matches(href, '^/[A-Z]')"""


def s4_document_kind(spark, sf):
    docs = S.parse_documents(site_files(spark, sf))
    return docs.select(
        "url", "root", F.coalesce(F.size("urls"), F.lit(0)).alias("urls"), F.coalesce(F.size("sitemaps"), F.lit(0)).alias("sitemaps")
    )


ORACLES["s4_document_kind"] = f"""WITH {_ANCHORS}, c AS (SELECT page_id, kind, site, count(*) AS n FROM a GROUP BY 1, 2, 3)
SELECT concat(site, '/sitemap.xml') AS url, 'urlset' AS root, n + 2 AS urls, 0 AS sitemaps FROM c WHERE kind = 0
UNION ALL SELECT concat(site, '/sitemap.xml'), 'sitemapindex', 0, 3 FROM c WHERE kind = 1
UNION ALL SELECT concat(site, '/deep.xml'), 'sitemapindex', 0, 2 FROM c WHERE kind = 1
UNION ALL SELECT concat(site, '/sm-1.xml'), 'urlset', least(n, 3) + 2, 0 FROM c WHERE kind = 1
UNION ALL SELECT concat(site, '/sm-2.xml'), 'urlset', greatest(n - 3, 0) + 2, 0 FROM c WHERE kind = 1
UNION ALL SELECT concat(site, '/robots.txt'), '', 0, 0 FROM c WHERE kind IN (2, 4)
UNION ALL SELECT concat(site, '/maps/main.xml'), 'urlset', n + 2, 0 FROM c WHERE kind = 2
UNION ALL SELECT concat(site, '/sitemap.xml'), 'html', 0, 0 FROM c WHERE kind = 3"""


def s5_robots_directive(spark, sf):
    robots = site_files(spark, sf).where(F.endswith("url", F.lit("/robots.txt")))
    return robots.select("url", S.robots_sitemap(F.col("text")).alias("sitemap_url"))


ORACLES["s5_robots_directive"] = f"""SELECT concat({_SITE}, '/robots.txt') AS url, CASE page_id % 5 WHEN 2 THEN concat({_SITE}, '/maps/main.xml')
 ELSE 'https://elsewhere.example.net/sitemap.xml' END AS sitemap_url FROM pages WHERE page_id % 5 IN (2, 4)"""


def s6_sitemap_location(spark, sf):
    found = S.locate_sitemaps(_seeds(spark, sf), site_files(spark, sf))
    return found.select("seed_id", F.coalesce("sitemap_url", F.lit("")).alias("sitemap_url"))


ORACLES["s6_sitemap_location"] = f"""SELECT page_id AS seed_id, CASE page_id % 5 WHEN 0 THEN concat({_SITE}, '/sitemap.xml') WHEN 1 THEN concat({_SITE}, '/sitemap.xml')
 WHEN 2 THEN concat({_SITE}, '/maps/main.xml') ELSE '' END AS sitemap_url FROM pages"""


def _pack(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: gzip.compress(t.encode()))


def s7_decode_bodies(spark, sf):
    """Documents as bodies: plain, gzip, gzip without header, broken gzip."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    packed = docs.withColumn("zipped", F.pandas_udf(_pack, "binary")("text"))
    bodies = packed.selectExpr(
        "doc_id",
        "CASE doc_id % 4 WHEN 0 THEN CAST(text AS BINARY) WHEN 1 THEN zipped WHEN 2 THEN zipped ELSE CAST('not gzip' AS BINARY) END AS body",
        "CASE doc_id % 4 WHEN 1 THEN 'GZIP' WHEN 3 THEN 'gzip' END AS content_encoding",
    )
    return S.decoded_bodies(bodies).select("doc_id", F.md5("text").alias("text_md5"))


ORACLES["s7_decode_bodies"] = "SELECT doc_id, md5(CASE WHEN doc_id % 4 = 3 THEN '' ELSE text END) AS text_md5 FROM documents"


def c8_lastmod(spark, sf):
    files = site_files(spark, sf)
    docs = S.parse_documents(files.where(F.endswith("url", F.lit(".xml"))))
    rows = S.urlset_rows(docs.withColumn("base_url", F.col("url")).drop("url"))
    return rows.groupBy("last_modified").agg(
        F.count(F.lit(1)).alias("urls"), F.date_format(F.max(F.try_to_timestamp("last_modified")), "yyyy-MM-dd").alias("day")
    )


ORACLES["c8_lastmod"] = f"""WITH {_ANCHORS}, m AS (SELECT concat('2024-01-0', CASE WHEN kind = 1 AND n > 3 THEN n - 3 ELSE n END) AS d FROM a WHERE kind IN (0, 1, 2))
SELECT d AS last_modified, count(*) AS urls, d AS day FROM m GROUP BY 1"""


def g6_nested_sitemaps(spark, sf):
    """Entries of every site's sitemap, nested indexes followed; numbered in document order."""
    located = S.locate_sitemaps(_seeds(spark, sf), site_files(spark, sf))
    rows = S.read_sitemaps(located, site_files(spark, sf).select("url", "text"))
    return rows.select("seed_id", "url", "path", "last_modified", F.array_join(F.col("trail").cast("array<string>"), ".").alias("trail"), "pos")


ORACLES["g6_nested_sitemaps"] = f"""WITH {_ANCHORS} SELECT page_id AS seed_id, concat(site, href) AS url, href AS path,
 concat('2024-01-0', CASE WHEN kind = 1 AND n > 3 THEN n - 3 ELSE n END) AS last_modified,
 CASE WHEN kind <> 1 THEN '' WHEN n <= 3 THEN '0' ELSE '1.0' END AS trail,
 CAST(CASE WHEN kind = 1 AND n > 3 THEN n - 4 ELSE n - 1 END AS INTEGER) AS pos FROM a WHERE kind IN (0, 1, 2)"""


def _map_requests(spark, sf):
    return pages(
        spark, sf, "page_id AS seed_id", f"{_SITE} AS url",
        "CASE page_id % 3 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'crawl' ELSE 'hybrid' END AS discovery_method",
        "CAST(page_id % 8 + 1 AS INT) AS max_urls", "1 AS max_depth",
    )


def _fetched(spark, sf):
    """The root page of each site links to two of the anchors' pages and to two new ones."""
    df = pages(spark, sf, "page_id", "html", f"{_SITE} AS site").select("page_id", "site", anchor_hrefs(F.col("html")).alias("h"))
    first = F.concat("site", F.coalesce(F.get("h", F.lit(0)), F.lit("/none")))
    links = F.array(first, F.concat("site", F.lit("/new-1")), F.concat("site", F.lit("/new-2")))
    root = F.concat("site", F.lit("/"))
    return df.select(root.alias("url"), root.alias("resolved_url"), links.alias("links"))


# Entries per site in result order: sitemap rows first, then the traversal for the remainder.
_MAPPED = f"""{_ANCHORS}, q AS (SELECT page_id, {_SITE} AS site, page_id % 3 AS method, page_id % 8 + 1 AS cap, page_id % 5 AS kind FROM pages),
sm AS (SELECT q.page_id, concat(a.site, href) AS url, href AS path, 0 AS depth, 'sitemap' AS source, row_number() OVER (PARTITION BY q.page_id ORDER BY n) AS rank
 FROM q JOIN a USING (page_id) WHERE q.method <> 1 AND a.kind IN (0, 1, 2)),
cnt AS (SELECT q.*, coalesce(max(rank), 0) AS listed FROM q LEFT JOIN sm USING (page_id) GROUP BY ALL),
first AS (SELECT page_id, href FROM a WHERE n = 1),
cand AS (SELECT c.*, u.url, u.i FROM cnt c LEFT JOIN first f USING (page_id), LATERAL (
 SELECT concat(c.site, '/') AS url, 0 AS i UNION ALL SELECT concat(c.site, coalesce(f.href, '/none')), 1
 UNION ALL SELECT concat(c.site, '/new-1'), 2 UNION ALL SELECT concat(c.site, '/new-2'), 3) u
 WHERE c.method = 1 OR (c.method = 2 AND c.listed < c.cap)),
cr AS (SELECT c.page_id, c.url, c.listed + row_number() OVER (PARTITION BY c.page_id ORDER BY i) AS rank, i FROM cand c
 WHERE i = 0 OR NOT EXISTS (SELECT 1 FROM sm WHERE sm.page_id = c.page_id AND sm.url = c.url)),
mapped AS (SELECT page_id, url, path, depth, source, rank FROM sm UNION ALL
 SELECT page_id, url, regexp_replace(url, '^https://[^/]*', ''), CASE WHEN i = 0 THEN 0 ELSE 1 END, 'crawl', rank FROM cr),
capped AS (SELECT m.*, cap FROM mapped m JOIN q USING (page_id) WHERE rank <= cap)"""


def g4_hybrid_map(spark, sf):
    urls, _ = run_discovery(_map_requests(spark, sf), _fetched(spark, sf), site_files(spark, sf))
    return urls.select("seed_id", "rank", "url", "path", "depth", "source")


ORACLES["g4_hybrid_map"] = f"WITH {_MAPPED} SELECT page_id AS seed_id, rank, url, path, depth, source FROM capped"


def a8_map_summary(spark, sf):
    requests = _map_requests(spark, sf)
    urls, located = run_discovery(requests, _fetched(spark, sf), site_files(spark, sf))
    return map_summary(requests, urls, located).select(
        "seed_id", "discovery_method", F.coalesce("sitemap_url", F.lit("")).alias("sitemap_url"), "total_urls", "sitemap_count", "crawl_count"
    )


ORACLES["a8_map_summary"] = f"""WITH {_MAPPED}, t AS (SELECT page_id, count(*) AS n, count(*) FILTER (source = 'sitemap') AS s, count(*) FILTER (source = 'crawl') AS c
 FROM capped GROUP BY 1)
SELECT q.page_id AS seed_id, CASE method WHEN 0 THEN 'sitemap' WHEN 1 THEN 'crawl' ELSE 'hybrid' END AS discovery_method,
 CASE WHEN method = 1 THEN '' WHEN kind IN (0, 1) THEN concat(site, '/sitemap.xml') WHEN kind = 2 THEN concat(site, '/maps/main.xml') ELSE '' END AS sitemap_url,
 coalesce(n, 0) AS total_urls, coalesce(s, 0) AS sitemap_count, coalesce(c, 0) AS crawl_count FROM q LEFT JOIN t USING (page_id)"""


def g5_map_by_method(spark, sf):
    requests = _map_requests(spark, sf)
    urls, _ = run_discovery(requests, _fetched(spark, sf), site_files(spark, sf))
    return urls.join(requests.select("seed_id", "discovery_method"), "seed_id").groupBy("discovery_method", "source").agg(
        F.count(F.lit(1)).alias("urls"), F.countDistinct("seed_id").alias("sites")
    )


ORACLES["g5_map_by_method"] = f"""WITH {_MAPPED} SELECT CASE page_id % 3 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'crawl' ELSE 'hybrid' END AS discovery_method,
 source, count(*) AS urls, count(DISTINCT page_id) AS sites FROM capped GROUP BY 1, 2"""


def j6_sitemap_exclusion(spark, sf):
    """Traversed URLs of the hybrid requests: none is in the sitemap, except the root."""
    requests = _map_requests(spark, sf).withColumn("discovery_method", F.lit("hybrid")).withColumn("max_urls", F.lit(2147483647))
    urls, _ = run_discovery(requests, _fetched(spark, sf), site_files(spark, sf))
    return urls.where(F.col("source") == "crawl").select("seed_id", "url", "depth")


ORACLES["j6_sitemap_exclusion"] = f"""WITH {_MAPPED.replace('page_id % 3 AS method', '2 AS method').replace('page_id % 8 + 1 AS cap', '2147483647 AS cap')}
SELECT page_id AS seed_id, url, depth FROM capped WHERE source = 'crawl'"""


def u1_map_union(spark, sf):
    """Both sources in one table, duplicates kept."""
    requests = _map_requests(spark, sf).withColumn("discovery_method", F.lit("hybrid")).withColumn("max_urls", F.lit(2147483647))
    urls, _ = run_discovery(requests, _fetched(spark, sf), site_files(spark, sf))
    return urls.groupBy("seed_id").agg(F.count(F.lit(1)).alias("urls"), F.max("rank").alias("last_rank"))


ORACLES["u1_map_union"] = f"""WITH {_MAPPED.replace('page_id % 3 AS method', '2 AS method').replace('page_id % 8 + 1 AS cap', '2147483647 AS cap')}
SELECT page_id AS seed_id, count(*) AS urls, max(rank) AS last_rank FROM capped GROUP BY 1"""


def k2_first_urls(spark, sf):
    """First rows per request: the caps of the sitemap requests."""
    requests = _map_requests(spark, sf).withColumn("discovery_method", F.lit("sitemap"))
    urls, _ = run_discovery(requests, _fetched(spark, sf), site_files(spark, sf))
    return urls.select("seed_id", "rank", "url")


ORACLES["k2_first_urls"] = f"""WITH {_MAPPED.replace('page_id % 3 AS method', '0 AS method')} SELECT page_id AS seed_id, rank, url FROM capped"""

for _f in (
    s3_sitemap_urls, s4_document_kind, s5_robots_directive, s6_sitemap_location, s7_decode_bodies, c8_lastmod, g6_nested_sitemaps, g4_hybrid_map,
    a8_map_summary, g5_map_by_method, j6_sitemap_exclusion, u1_map_union, k2_first_urls,
):
    QUERIES[_f.__name__] = _f
