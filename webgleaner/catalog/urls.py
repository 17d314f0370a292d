"""URL columns over ``pages.url`` and the anchors of ``pages.html``."""

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.content import anchor_hrefs
from .common import pages

QUERIES, ORACLES = {}, {}

# Spelling variants of the page URLs, the same text in both engines.
VARIANT = """CASE page_id % 5
 WHEN 0 THEN url
 WHEN 1 THEN replace(url, 'http', 'HTTP')
 WHEN 2 THEN concat('  ', replace(url, '.example', '.EXAMPLE'), ' ')
 WHEN 3 THEN concat(regexp_extract(url, '^([^?#]*)', 1), '//')
 ELSE replace(replace(url, 'https://', ''), 'http://', '') END"""

_SPLIT = f"""WITH v AS (SELECT page_id, trim({VARIANT}) AS u FROM pages),
f AS (SELECT page_id, CASE WHEN contains(u, '://') THEN u ELSE concat('https://', u) END AS u FROM v),
p AS (SELECT page_id, u, lower(regexp_extract(u, '^([^:]+)://', 1)) AS scheme,
 regexp_extract(u, '^[^:]+://([^/?#]*)', 1) AS netloc,
 regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
 regexp_extract(u, '[?]([^#]*)', 1) AS query, regexp_extract(u, '#(.*)$', 1) AS fragment FROM f)"""

_PATH = """CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END"""


def p1_url_parts(spark, sf):
    df = pages(spark, sf, "page_id", "url").select("page_id", U.split_url(F.col("url")).alias("p"))
    return df.select(
        "page_id",
        "p.*",
        U.host_of(F.col("p.netloc")).alias("host"),
        F.coalesce(U.port_of(F.col("p.netloc")), F.lit(-1)).alias("port"),
    )


ORACLES["p1_url_parts"] = """SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme,
 regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS netloc, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
 '' AS params, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment,
 lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host, -1 AS port FROM pages"""


def p2_url_normalize(spark, sf):
    return pages(spark, sf, "page_id", f"{VARIANT} AS raw").select(
        "page_id", U.normalize_url(F.col("raw")).alias("norm_url")
    )


ORACLES["p2_url_normalize"] = f"""{_SPLIT} SELECT page_id, concat(scheme, '://', lower(netloc), {_PATH},
 CASE WHEN query <> '' THEN concat('?', query) ELSE '' END) AS norm_url FROM p"""


def p3_url_strip_query(spark, sf):
    return pages(spark, sf, "page_id", f"{VARIANT} AS raw").select(
        "page_id", U.normalize_url(F.col("raw"), True).alias("norm_url")
    )


ORACLES["p3_url_strip_query"] = f"""{_SPLIT} SELECT page_id, concat(scheme, '://', lower(netloc), {_PATH}) AS norm_url FROM p"""

SEED = """CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(replace(url, 'https://', ''), 'http://', ' ')
 WHEN 2 THEN replace(replace(url, 'https', 'ftp'), 'http', 'ftp') WHEN 3 THEN '   '
 ELSE concat(url, repeat('a', 2048)) END"""


def p4_seed_url_check(spark, sf):
    df = pages(spark, sf, "page_id", f"{SEED} AS raw").select("page_id", U.seed_url(F.col("raw")).alias("s"))
    return df.select(
        "page_id",
        F.coalesce("s.url", F.lit("")).alias("seed_url"),
        F.coalesce("s.reject_reason", F.lit("")).alias("reject_reason"),
    )


ORACLES["p4_seed_url_check"] = f"""WITH v AS (SELECT page_id, trim({SEED}) AS u FROM pages),
f AS (SELECT page_id, CASE WHEN contains(u, '://') THEN u ELSE concat('https://', u) END AS full_url, u FROM v),
r AS (SELECT page_id, full_url, CASE WHEN u = '' THEN 'URL cannot be empty'
 WHEN NOT (starts_with(full_url, 'http://') OR starts_with(full_url, 'https://'))
 THEN 'URL must start with http:// or https://'
 WHEN length(full_url) > 2048 THEN 'URL too long (max 2048 characters)' ELSE '' END AS reject_reason FROM f)
SELECT page_id, CASE WHEN reject_reason = '' THEN full_url ELSE '' END AS seed_url, reject_reason FROM r"""

HREF = """CASE page_id % 7 WHEN 0 THEN '/x/y' WHEN 1 THEN 'rel.html' WHEN 2 THEN '../up' WHEN 3 THEN '?q=1'
 WHEN 4 THEN '//other.example.org/z' WHEN 5 THEN '#frag' ELSE 'https://abs.example.org/a/b?c=d' END"""


def p5_url_resolve(spark, sf):
    return pages(spark, sf, "page_id", "url", f"{HREF} AS href").select(
        "page_id", U.resolve_url(F.col("url"), F.col("href")).alias("resolved")
    )


ORACLES["p5_url_resolve"] = f"""WITH p AS (SELECT page_id, {HREF} AS href, regexp_extract(url, '^([^:]+:)', 1) AS scheme,
 regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS site, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
 regexp_extract(url, '^([^#]*)', 1) AS bare FROM pages),
d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM p)
SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat(site, href) WHEN 1 THEN concat(site, folder, href)
 WHEN 2 THEN concat(site, regexp_replace(folder, '[^/]+/$', ''), 'up') WHEN 3 THEN concat(site, path, href)
 WHEN 4 THEN concat(scheme, href) WHEN 5 THEN concat(bare, href) ELSE href END AS resolved FROM d"""

TARGET = """CASE page_id % 4 WHEN 0 THEN concat(url, 'x') WHEN 1 THEN replace(url, '://', '://sub.')
 WHEN 2 THEN replace(replace(url, 'https:', 'ftp:'), 'http:', 'https:') ELSE replace(url, '://', '://x') END"""


def p6_internal_test(spark, sf):
    return pages(spark, sf, "page_id", "url", f"{TARGET} AS target").select(
        "page_id",
        U.is_internal(F.col("target"), F.col("url")).alias("same_host"),
        U.is_internal(F.col("target"), F.col("url"), True).alias("same_site"),
    )


ORACLES["p6_internal_test"] = """SELECT page_id, page_id % 4 = 0 AS same_host, page_id % 4 IN (0, 1) AS same_site FROM pages"""


def p7_path_filter(spark, sf):
    return pages(spark, sf, "page_id", "url").where(
        U.url_allowed(F.col("url"), ["^/en/", "^/fr/", "["], [r"\.html$", "("])
    )


ORACLES["p7_path_filter"] = """WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url FROM p WHERE (starts_with(path, '/en/') OR starts_with(path, '/fr/')) AND NOT ends_with(path, '.html')"""

HREF_KIND = """CASE pos % 6 WHEN 0 THEN href WHEN 1 THEN concat('mailto:', href) WHEN 2 THEN concat('#', href)
 WHEN 3 THEN concat('TEL:', href) WHEN 4 THEN '' ELSE concat('https:/', href) END"""


def p15_href_filter(spark, sf):
    hrefs = pages(spark, sf, "page_id", "html").select("page_id", F.posexplode(anchor_hrefs(F.col("html"))).alias("pos", "href"))
    return hrefs.selectExpr("page_id", "pos", f"{HREF_KIND} AS href").where(U.href_followable(F.col("href")))


ORACLES["p15_href_filter"] = f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos, {HREF_KIND} AS href FROM a WHERE pos % 6 IN (0, 5)"""


def c7_url_path(spark, sf):
    return pages(spark, sf, "page_id", f"{VARIANT} AS raw").select(
        "page_id", U.url_path(U.normalize_url(F.col("raw"))).alias("path")
    )


ORACLES["c7_url_path"] = f"""{_SPLIT} SELECT page_id, {_PATH} AS path FROM p"""

for _f in (
    p1_url_parts, p2_url_normalize, p3_url_strip_query, p4_seed_url_check, p5_url_resolve, p6_internal_test,
    p7_path_filter, p15_href_filter, c7_url_path,
):
    QUERIES[_f.__name__] = _f
