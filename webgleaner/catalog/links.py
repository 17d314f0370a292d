"""Links, traversal and visited sets."""

from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..operators import crawl as T
from ..operators import links as L
from ..operators.rules import safe_urls
from ..operators.scale import spread_join
from ..plans.jobs import crawl_job
from .common import SITE, pages, table
from .content import markdown_sql

QUERIES, ORACLES = {}, {}

NORM = f"""concat({SITE}, CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
 ELSE regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\\1') END,
 CASE WHEN contains(url, '?') THEN regexp_extract(url, '([?][^#]*)', 1) ELSE '' END)"""

# Distinct links of each page in page order.
_LINKS = f"""a AS (SELECT page_id, url, {SITE} AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS n FROM pages),
f AS (SELECT page_id, url, concat(site, href) AS dst_url, min(n) AS n FROM a GROUP BY 1, 2, 3),
links AS (SELECT page_id, url AS src_url, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, dst_url FROM f)"""


def g1_link_edges(spark, sf):
    return L.link_edges(L.with_links(pages(spark, sf, "url", "html")))


ORACLES["g1_link_edges"] = f"WITH {_LINKS} SELECT src_url, CAST(pos AS INTEGER) AS pos, dst_url FROM links"


def g1_filtered_edges(spark, sf):
    linked = L.with_links(pages(spark, sf, "url", "html"), include=["^/[a-m]", "^/[A-M]"], exclude=["e$"])
    return L.link_edges(linked).select("src_url", "dst_url")


ORACLES["g1_filtered_edges"] = f"""WITH {_LINKS} SELECT src_url, dst_url FROM links
 WHERE regexp_matches(regexp_replace(dst_url, '^[^:]+://[^/]*', ''), '^/[a-mA-M]') AND NOT ends_with(dst_url, 'e')"""


def a12_links_found(spark, sf):
    return L.with_links(pages(spark, sf, "page_id", "url", "html")).select("page_id", "url", F.size("links").alias("links_found"))


ORACLES["a12_links_found"] = f"""WITH {_LINKS}, c AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1)
SELECT page_id, url, CAST(coalesce(n, 0) AS INTEGER) AS links_found FROM pages LEFT JOIN c USING (page_id)"""


def u2_links_distinct(spark, sf):
    """Words of each document, each once, in order of first use (as links are made distinct)."""
    words = F.split("text", " ")
    df = table(spark, sf, "documents").select("doc_id", words.alias("w"), F.array_distinct(words).alias("d"))
    return df.select("doc_id", F.size("w").alias("words"), F.size("d").alias("distinct_words"), F.md5(F.array_join("d", " ")).alias("order_md5"))


ORACLES["u2_links_distinct"] = """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
d AS (SELECT doc_id, w, min(i) AS i, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS INTEGER) AS words, CAST(count(*) AS INTEGER) AS distinct_words, md5(string_agg(w, ' ' ORDER BY i)) AS order_md5 FROM d GROUP BY 1"""

_FINAL = """CASE page_id % 6 WHEN 0 THEN 'http://127.0.0.1/x' WHEN 1 THEN replace(url, '://', '://moved.') ELSE url END"""
_STATUS = "CASE WHEN page_id % 5 = 4 THEN 404 ELSE 200 END"


def g7_fetched_links(spark, sf):
    df = pages(
        spark, sf, "page_id", "url", f"{_FINAL} AS final_url", f"{_STATUS} AS status",
        "CASE WHEN page_id % 11 = 0 THEN 99999999 END AS content_length", "CASE WHEN page_id % 13 = 0 THEN '' ELSE html END AS html",
    )
    out = L.fetched_links(df, max_bytes=L.MAX_BODY_BYTES)
    return out.select("url", "resolved_url", F.size("links").alias("links_found"), F.coalesce("error", F.lit("")).alias("error"),
                      F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"))


ORACLES["g7_fetched_links"] = f"""WITH {_LINKS}, c AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1),
fl AS (SELECT page_id, regexp_replace(dst_url, '^[^:]+://[^/]*', '') AS first_path FROM links WHERE pos = 0),
e AS (SELECT page_id, url, CASE WHEN {_STATUS} = 404 OR page_id % 6 = 0 THEN url ELSE {_FINAL} END AS resolved_url,
 CASE WHEN {_STATUS} = 404 THEN 'HTTP 404' WHEN page_id % 6 = 0 THEN 'Redirect to internal/blocked address'
 WHEN page_id % 11 = 0 THEN 'Response too large (99999999 bytes)' WHEN page_id % 13 = 0 THEN 'Empty response body' ELSE '' END AS error FROM pages)
SELECT e.url, resolved_url, CAST(CASE WHEN error = '' THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS links_found, error,
 CASE WHEN error = '' THEN coalesce(concat(regexp_extract(resolved_url, '^([^:]+://[^/?#]*)', 1), first_path), '') ELSE '' END AS first_link
FROM e LEFT JOIN c USING (page_id) LEFT JOIN fl USING (page_id)"""

# A link graph over the customers: each links to three others; a third of all links lead to one page.
_NODE = "concat('https://site.example.org/c/', {0})"
_GRAPH = """n AS (SELECT count(*) AS n FROM customer),
edges AS (SELECT c_custkey AS k, 0 AS pos, (c_custkey * 2) % n AS t FROM customer, n
 UNION ALL SELECT c_custkey, 1, 1 FROM customer UNION ALL SELECT c_custkey, 2, (c_custkey * 3 + 1) % n FROM customer, n)"""


def _graph(spark, sf):
    customers = table(spark, sf, "customer")
    # One number for the whole table, used as a literal.
    n = customers.count()
    return customers.selectExpr(
        f"{_NODE.format('c_custkey')} AS url",
        f"array({_NODE.format(f'c_custkey * 2 % {n}')}, {_NODE.format('1')}, {_NODE.format(f'(c_custkey * 3 + 1) % {n}')}) AS links",
    )


def _seeds(spark, sf, limit_name):
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS seed_id", f"{_NODE.format('s_suppkey + 2')} AS url", "s_suppkey % 4 AS max_depth", f"s_suppkey % 17 + 1 AS {limit_name}"
    )


def _levels(depth: int) -> str:
    """Unrolled traversal: one CTE per level with first place, visited test and cap."""
    out = [
        f"""l0 AS (SELECT s_suppkey AS seed_id, s_suppkey + 2 AS k, 0 AS depth, 1 AS rank, s_suppkey % 4 AS max_depth, s_suppkey % 17 + 1 AS cap FROM supplier),
v0 AS (SELECT * FROM l0)"""
    ]
    for d in range(1, depth + 1):
        p = d - 1
        out.append(
            f"""c{d} AS (SELECT seed_id, t AS k, min(rank * 10 + pos) AS place, any_value(max_depth) AS max_depth, any_value(cap) AS cap
 FROM l{p} JOIN edges USING (k) WHERE depth < max_depth GROUP BY 1, 2),
x{d} AS (SELECT c.* FROM c{d} c WHERE NOT EXISTS (SELECT 1 FROM v{p} v WHERE v.seed_id = c.seed_id AND v.k = c.k)),
m{d} AS (SELECT seed_id, max(rank) AS last FROM l{p} GROUP BY 1),
r{d} AS (SELECT seed_id, k, {d} AS depth, last + row_number() OVER (PARTITION BY seed_id ORDER BY place) AS rank, max_depth, cap FROM x{d} JOIN m{d} USING (seed_id)),
l{d} AS (SELECT * FROM r{d} WHERE rank <= cap),
v{d} AS (SELECT * FROM v{p} UNION ALL SELECT * FROM l{d})"""
        )
    return ",\n".join(out)


def g3_graph_traversal(spark, sf):
    order = T.traverse(_seeds(spark, sf, "max_urls"), T.child_table(_graph(spark, sf)))
    return order.select("seed_id", "url", "depth", F.col("rank").cast("bigint").alias("rank"))


ORACLES["g3_graph_traversal"] = f"""WITH {_GRAPH}, {_levels(3)}
SELECT seed_id, {_NODE.format('k')} AS url, depth, rank FROM v3"""


def w1_bfs_position(spark, sf):
    """Place of every URL in the traversal of all sites together, without page limits that bite."""
    seeds = _seeds(spark, sf, "max_urls").withColumn("max_urls", F.lit(2147483647)).withColumn("max_depth", F.lit(2))
    order = T.traverse(seeds, T.child_table(_graph(spark, sf)))
    return order.groupBy("url").agg(F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("sites"))


ORACLES["w1_bfs_position"] = f"""WITH {_GRAPH}, {_levels(2).replace('s_suppkey % 4 AS max_depth', '2 AS max_depth').replace('s_suppkey % 17 + 1 AS cap', '2147483647 AS cap')}
SELECT {_NODE.format('k')} AS url, min(rank) AS best_rank, count(*) AS sites FROM v2 GROUP BY 1"""


def k3_page_cap(spark, sf):
    order = T.traverse(_seeds(spark, sf, "max_urls"), T.child_table(_graph(spark, sf)))
    return order.groupBy("seed_id").agg(F.count(F.lit(1)).alias("pages"), F.max("rank").alias("last_rank"))


ORACLES["k3_page_cap"] = f"""WITH {_GRAPH}, {_levels(3)} SELECT seed_id, count(*) AS pages, max(rank) AS last_rank FROM v3 GROUP BY 1"""


def u4_visited_urls(spark, sf):
    """All URLs entered from any seed."""
    order = T.traverse(_seeds(spark, sf, "max_urls"), T.child_table(_graph(spark, sf)))
    return order.select("url").distinct()


ORACLES["u4_visited_urls"] = f"WITH {_GRAPH}, {_levels(3)} SELECT DISTINCT {_NODE.format('k')} AS url FROM v3"


def _page_seeds(spark, sf):
    """Every page is the seed of a site; the responses are stored under canonical URLs."""
    seeds = pages(spark, sf, "page_id AS seed_id", "url", "1 AS max_depth", "CAST(page_id % 9 + 1 AS INT) AS max_pages")
    responses = pages(spark, sf, "url", "html").groupBy(normalize_url(F.col("url")).alias("url")).agg(F.max("html").alias("html"))
    return seeds, responses


_PAGE_CRAWL = f"""{markdown_sql('pages')}, ok AS (SELECT page_id AS owner FROM md WHERE length(md) >= 200), {_LINKS}, s AS (SELECT page_id, {NORM} AS url, page_id % 9 + 1 AS cap FROM pages),
h AS (SELECT s.url, max(p.html) AS html FROM s JOIN pages p USING (page_id) GROUP BY 1),
owner AS (SELECT s.url, min(p.page_id) AS owner FROM s JOIN pages p USING (page_id) JOIN h ON h.url = s.url AND h.html = p.html GROUP BY 1),
nl AS (SELECT page_id AS owner, count(*) AS n FROM links JOIN ok ON ok.owner = page_id GROUP BY 1),
child AS (SELECT s.page_id AS seed_id, l.dst_url AS url, 1 AS depth, l.pos + 2 AS rank, s.cap FROM s JOIN owner USING (url)
 JOIN ok USING (owner) JOIN links l ON l.page_id = owner.owner)"""


def g2_crawl(spark, sf):
    seeds, responses = _page_seeds(spark, sf)
    made, _ = crawl_job(seeds, responses)
    return made.select("seed_id", "rank", "url", "depth", "fetch_method", "links_found")


ORACLES["g2_crawl"] = f"""WITH {_PAGE_CRAWL}
SELECT s.page_id AS seed_id, 1 AS rank, s.url, 0 AS depth,
 CASE WHEN ok.owner IS NULL THEN 'playwright-failed' ELSE 'httpx' END AS fetch_method, CAST(coalesce(n, 0) AS INTEGER) AS links_found
FROM s JOIN owner USING (url) LEFT JOIN ok USING (owner) LEFT JOIN nl USING (owner)
UNION ALL SELECT seed_id, rank, url, depth, 'playwright-failed', 0 FROM child WHERE rank <= cap"""


def a7_crawl_summary(spark, sf):
    seeds, responses = _page_seeds(spark, sf)
    made, _ = crawl_job(seeds, responses)
    return T.crawl_summary(made)


ORACLES["a7_crawl_summary"] = f"""WITH {_PAGE_CRAWL}, c AS (SELECT seed_id, count(*) AS n FROM child WHERE rank <= cap GROUP BY 1)
SELECT page_id AS seed_id, 1 + coalesce(n, 0) AS total_pages, CASE WHEN n > 0 THEN 1 ELSE 0 END AS max_depth_reached FROM s LEFT JOIN c ON c.seed_id = s.page_id"""


def j2_unvisited_links(spark, sf):
    """Links that lead to no stored page."""
    edges = L.link_edges(L.with_links(pages(spark, sf, "url", "html")))
    return L.unvisited_edges(edges, pages(spark, sf, "url")).groupBy("src_url").agg(F.count(F.lit(1)).alias("open_links"))


ORACLES["j2_unvisited_links"] = f"""WITH {_LINKS}, v AS (SELECT {NORM} AS u FROM pages)
SELECT src_url, count(*) AS open_links FROM links WHERE dst_url NOT IN (SELECT u FROM v) GROUP BY 1"""


def j5_frontier_lookup(spark, sf):
    """A frontier of all orders against the link table: one page is asked for by a third of them."""
    frontier = table(spark, sf, "orders").selectExpr(
        "o_orderkey", f"CASE WHEN o_orderkey % 3 = 0 THEN {_NODE.format('7')} ELSE {_NODE.format('o_custkey')} END AS url"
    )
    found = spread_join(frontier, T.child_table(_graph(spark, sf)), ["url"], "left")
    return found.select("o_orderkey", "url", F.coalesce(F.size("children"), F.lit(0)).alias("children"))


ORACLES["j5_frontier_lookup"] = f"""WITH n AS (SELECT count(*) AS n FROM customer),
f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS k FROM orders),
d AS (SELECT c_custkey AS k, len(list_distinct([c_custkey * 2 % n, 1, (c_custkey * 3 + 1) % n])) AS c FROM customer, n)
SELECT o_orderkey, {_NODE.format('k')} AS url, CAST(coalesce(c, 0) AS INTEGER) AS children FROM f LEFT JOIN d USING (k)"""


def g2_safe_children(spark, sf):
    """Links of all pages that pass the safety test before they are entered."""
    edges = L.link_edges(L.with_links(pages(spark, sf, "url", "html")))
    return safe_urls(edges, "dst_url").groupBy(F.col("src_url").alias("url")).agg(F.count(F.lit(1)).alias("children"))


ORACLES["g2_safe_children"] = f"WITH {_LINKS} SELECT src_url AS url, count(*) AS children FROM links GROUP BY 1"

for _f in (
    g1_link_edges, g1_filtered_edges, a12_links_found, u2_links_distinct, g7_fetched_links, g3_graph_traversal, w1_bfs_position, k3_page_cap,
    u4_visited_urls, g2_crawl, a7_crawl_summary, j2_unvisited_links, j5_frontier_lookup, g2_safe_children,
):
    QUERIES[_f.__name__] = _f
