"""The four jobs from requests to answers."""

from pyspark.sql import functions as F

from ..operators.links import link_edges, with_links
from ..operators.metrics import research_summary
from ..operators.request_rules import filter_by_request_rules
from ..operators.summary import run_summaries
from ..plans import crawl_job, extract_job, map_job, research_job
from ..sources import crawl_envelopes, extract_envelopes, map_envelopes, research_envelopes
from . import sites
from .answers import _echo_model, _summary_model
from .common import HOST, pages
from .content import markdown_sql
from .links import _LINKS, _PAGE_CRAWL, _page_seeds

QUERIES, ORACLES = {}, {}

# Ten pages per search; every search lists its pages, one unsafe URL and one media site.
_BLOCK = ["spam-farm.example.org"]


def _searches(spark, sf):
    hits = pages(spark, sf, "page_id", "url").selectExpr(
        "page_id div 10 AS request_id", "CAST(page_id % 10 AS INT) AS i", "named_struct('url', url, 'title', concat('Title ', page_id), 'content', '') AS hit"
    )
    grouped = hits.groupBy("request_id").agg(F.expr("transform(array_sort(collect_list(struct(i, hit))), x -> x.hit)").alias("own"))
    return grouped.selectExpr(
        "request_id", "concat('query ', request_id) AS query", "12 AS max_results",
        "concat(array(named_struct('url', 'http://10.0.0.1/x', 'title', 'bad', 'content', ''), named_struct('url', 'https://m.youtube.com/v', 'title', 'video', 'content', '')), own) AS results",
    )


_RESEARCH = f"""{markdown_sql('pages')}, r AS (SELECT page_id // 10 AS request_id, CAST(page_id % 10 + 3 AS INTEGER) AS rank, url, page_id, md,
 length(md) >= 200 AS ok FROM md WHERE NOT ({HOST} = 'spam-farm.example.org' OR ends_with({HOST}, '.spam-farm.example.org')))"""


def r1_research(spark, sf):
    made = research_job(_searches(spark, sf), pages(spark, sf, "url", "html"), block=_BLOCK)
    return made.select("request_id", "rank", "url", "title", "fetch_method", "content_length", F.md5("markdown_content").alias("content_md5"))


ORACLES["r1_research"] = f"""WITH {_RESEARCH} SELECT request_id, rank, url, concat('Title ', page_id) AS title, CASE WHEN ok THEN 'httpx' ELSE 'playwright-failed' END AS fetch_method,
 CAST(CASE WHEN ok THEN length(md) ELSE 0 END AS INTEGER) AS content_length, md5(CASE WHEN ok THEN md ELSE '' END) AS content_md5 FROM r"""


def r1_research_summary(spark, sf):
    """Results per search and the summary over their contents."""
    searches = _searches(spark, sf)
    made = research_job(searches, pages(spark, sf, "url", "html"), block=_BLOCK)
    requests = searches.select("request_id", "query", F.lit(None).cast("string").alias("summary_prompt"))
    docs = made.select("request_id", F.col("rank").alias("position"), F.col("markdown_content").alias("text"))
    answers = run_summaries(docs, requests, _summary_model)
    return research_summary(made).join(answers.select("request_id", "ai_summary"), "request_id")


ORACLES["r1_research_summary"] = f"""WITH {_RESEARCH}, g AS (SELECT request_id, count(*) AS total_results, count(*) FILTER (ok) AS success_count,
 sum(CASE WHEN ok THEN length(md) END) AS chars, count(*) FILTER (ok AND md <> '') AS n FROM r GROUP BY 1)
SELECT request_id, total_results, success_count, CASE WHEN n = 0 THEN 'Tidak ada konten yang dapat diringkas (semua scraping gagal).' ELSE concat(
 CAST(length(concat('Pertanyaan riset: query ', request_id, 'xxBerikut adalah ', n, ' dokumen hasil scraping:xx<user_input>xx</user_input>xxBuatlah ringkasan sintesis berdasarkan dokumen-dokumen di atas.'))
 + chars + n * 13 + length(array_to_string(range(1, n + 1), '')) + (n - 1) * 7 AS BIGINT), ' chars') END AS ai_summary FROM g"""


def s12_research_envelope(spark, sf):
    searches = _searches(spark, sf)
    made = research_job(searches, pages(spark, sf, "url", "html"), block=_BLOCK)
    out = research_envelopes(searches.select("request_id", "query", F.lit("S").alias("ai_summary")), made)
    doc = F.parse_json("response")
    return out.select(
        "request_id", F.variant_get(doc, "$.query", "string").alias("query"), F.variant_get(doc, "$.total_results", "int").alias("total_results"),
        F.variant_get(doc, "$.results[0].url", "string").alias("first_url"), F.variant_get(doc, "$.results[0].content_length", "int").alias("first_length"),
    )


ORACLES["s12_research_envelope"] = f"""WITH {_RESEARCH} SELECT request_id, concat('query ', request_id) AS query, CAST(count(*) AS INTEGER) AS total_results, arg_min(url, rank) AS first_url,
 CAST(arg_min(CASE WHEN ok THEN length(md) ELSE 0 END, rank) AS INTEGER) AS first_length FROM r GROUP BY 1"""


def r2_crawl_answers(spark, sf):
    """Crawl answers as JSON: pages found and the length of the seed's content."""
    seeds, responses = _page_seeds(spark, sf)
    made, rejected = crawl_job(seeds, responses, block=_BLOCK)
    accepted = seeds.join(rejected.select("seed_id"), "seed_id", "left_anti")
    out = crawl_envelopes(accepted.select("seed_id", F.col("url").alias("base_url"), F.lit(None).cast("string").alias("ai_summary")), made)
    doc = F.parse_json("response")
    return out.select(
        "seed_id", F.variant_get(doc, "$.base_url", "string").alias("base_url"), F.variant_get(doc, "$.total_pages", "int").alias("total_pages"),
        F.variant_get(doc, "$.results[0].links_found", "int").alias("links_found"),
    )


ORACLES["r2_crawl_answers"] = f"""WITH {_PAGE_CRAWL}, c AS (SELECT seed_id, count(*) AS n FROM child WHERE rank <= cap GROUP BY 1)
SELECT p.page_id AS seed_id, p.url AS base_url, CAST(1 + coalesce(c.n, 0) AS INTEGER) AS total_pages, CAST(coalesce(nl.n, 0) AS INTEGER) AS links_found
FROM pages p JOIN s ON s.page_id = p.page_id LEFT JOIN c ON c.seed_id = p.page_id JOIN owner ON owner.url = s.url LEFT JOIN nl USING (owner)
WHERE NOT (lower(regexp_extract(p.url, '^[^:]+://([^/?#]*)', 1)) = 'spam-farm.example.org' OR ends_with(lower(regexp_extract(p.url, '^[^:]+://([^/?#]*)', 1)), '.spam-farm.example.org'))"""


def r3_map_answers(spark, sf):
    """Map answers as JSON, one per site; links are taken from stored root pages."""
    requests = sites._map_requests(spark, sf)
    roots = pages(spark, sf, f"concat({sites._SITE}, '/') AS url", "html", "200 AS status").selectExpr(
        "url", "url AS final_url", "status", "CAST(NULL AS BIGINT) AS content_length", "html"
    )
    urls, summary, _ = map_job(requests, roots, sites.site_files(spark, sf))
    out = map_envelopes(summary, urls)
    doc = F.parse_json("response")
    return out.select("seed_id", *(F.variant_get(doc, f"$.{c}", "int").alias(c) for c in ("total_urls", "sitemap_count", "crawl_count")),
                      F.coalesce(F.variant_get(doc, "$.urls[0].url", "string"), F.lit("")).alias("first_url"))


ORACLES["r3_map_answers"] = f"""WITH {sites._ANCHORS}, q AS (SELECT page_id, {sites._SITE} AS site, page_id % 3 AS method, page_id % 8 + 1 AS cap, page_id % 5 AS kind FROM pages),
d AS (SELECT page_id, count(*) AS listed_all, count(DISTINCT href) AS uniq, arg_min(href, n) AS first_href FROM a GROUP BY 1),
m AS (SELECT q.*, coalesce(d.uniq, 0) AS uniq, d.first_href, CASE WHEN method <> 1 AND kind IN (0, 1, 2) THEN coalesce(listed_all, 0) ELSE 0 END AS listed FROM q LEFT JOIN d USING (page_id)),
t AS (SELECT *, least(listed, cap) AS s, CASE WHEN method = 0 OR (method = 2 AND listed >= cap) THEN 0
 ELSE least(cap - listed, 1 + CASE WHEN listed > 0 THEN 0 ELSE uniq END) END AS c FROM m)
SELECT page_id AS seed_id, CAST(s + c AS INTEGER) AS total_urls, CAST(s AS INTEGER) AS sitemap_count, CAST(c AS INTEGER) AS crawl_count,
 CASE WHEN s > 0 THEN concat(site, first_href) WHEN c > 0 THEN concat(site, '/') ELSE '' END AS first_url FROM t"""


def r4_extract_answers(spark, sf):
    """Extract answers as JSON; requests with a blocked URL are rejected whole."""
    specs = pages(
        spark, sf, "page_id div 5 AS request_id", "CAST(page_id % 5 AS INT) AS position", "url", "'list all the prices' AS prompt", "false AS force_js_render"
    )
    data, summary = extract_job(specs, pages(spark, sf, "url", "html"), "per_page", _echo_model, block=_BLOCK)
    out = extract_envelopes(summary.withColumn("extract_mode", F.lit("per_page")), data)
    doc = F.parse_json("response")
    return out.select("request_id", *(F.variant_get(doc, f"$.{c}", "int").alias(c) for c in ("total_urls", "failed_urls")),
                      F.variant_get(doc, "$.success", "boolean").alias("success"), F.variant_get(doc, "$.data[0].url", "string").alias("first_url"))


ORACLES["r4_extract_answers"] = f"""WITH {markdown_sql('pages')}, b AS (SELECT page_id // 5 AS request_id, page_id, url, length(md) < 200 AS failed,
 {HOST} = 'spam-farm.example.org' OR ends_with({HOST}, '.spam-farm.example.org') AS bad FROM md)
SELECT request_id, CAST(count(*) AS INTEGER) AS total_urls, CAST(count(*) FILTER (failed) AS INTEGER) AS failed_urls, count(*) FILTER (failed) = 0 AS success,
 arg_min(url, page_id) AS first_url FROM b GROUP BY 1 HAVING NOT bool_or(bad)"""

# Rules by request: those of number 0 modulo 3 have none, those of 1 exclude and block, those of 2 include and allow; one pattern is not usable.
_RULE_ROWS = (
    (1, "exclude", "^/[a-mA-M]"), (1, "exclude", "(("), (1, "block", ".Example.NET "), (1, "block", "  "), (2, "include", "e$"), (2, "include", "^/[t-z]"),
    (2, "include", "*"), (2, "allow", "example.com"), (2, "allow", "Example.org"),
)


def _rules_by_request(spark, requests):
    rows = spark.createDataFrame(_RULE_ROWS, "number int, kind string, value string")
    return requests.join(F.broadcast(rows), F.col("request_id") % 3 == F.col("number")).select("request_id", "kind", "value")


def _domain_ok(request: str, host: str) -> str:
    under = lambda d: f"({host} = '{d}' OR ends_with({host}, '.{d}'))"
    return f"({request} % 3 = 0 OR ({request} % 3 = 1 AND NOT {under('example.net')}) OR ({request} % 3 = 2 AND ({under('example.com')} OR {under('example.org')})))"


def _path_ok(request: str, path: str) -> str:
    return f"({request} % 3 = 0 OR ({request} % 3 = 1 AND NOT regexp_matches({path}, '^/[a-mA-M]')) OR ({request} % 3 = 2 AND regexp_matches({path}, 'e$|^/[t-z]')))"


def p8_request_domains(spark, sf):
    """Every page asked for by three requests with unlike domain rules."""
    asked = pages(spark, sf, "page_id", "url", "explode(array(3, 4, 5)) AS request_id")
    rules = _rules_by_request(spark, spark.range(3, 6).select(F.col("id").cast("int").alias("request_id")))
    return filter_by_request_rules(asked, rules, paths=False).select("request_id", "page_id")


ORACLES["p8_request_domains"] = f"SELECT r AS request_id, page_id FROM pages, (SELECT unnest([3, 4, 5]) AS r) WHERE {_domain_ok('r', HOST)}"

_LINK_PATH = "regexp_replace(dst_url, '^[^:]+://[^/?#]*', '')"


def p7_request_paths(spark, sf):
    """Links of all pages under the path rules of three requests."""
    edges = link_edges(with_links(pages(spark, sf, "url", "html")))
    asked = edges.select("src_url", "dst_url", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5))).alias("request_id"))
    rules = _rules_by_request(spark, asked.select("request_id").distinct())
    kept = filter_by_request_rules(asked, rules, url="dst_url", domains=False)
    return kept.groupBy("request_id", "src_url").agg(F.count(F.lit(1)).alias("links"))


ORACLES["p7_request_paths"] = f"""WITH {_LINKS} SELECT r AS request_id, src_url, count(*) AS links FROM links, (SELECT unnest([3, 4, 5]) AS r)
 WHERE {_path_ok('r', _LINK_PATH)} GROUP BY 1, 2"""


def r1_request_rules(spark, sf):
    """Searches with unlike domain rules in one job."""
    searches = _searches(spark, sf)
    made = research_job(searches, pages(spark, sf, "url", "html"), block=_BLOCK, rules=_rules_by_request(spark, searches.select("request_id")))
    return made.select("request_id", "rank", "url", "title", "fetch_method")


ORACLES["r1_request_rules"] = f"""WITH {_RESEARCH} SELECT request_id, rank, url, concat('Title ', page_id) AS title,
 CASE WHEN ok THEN 'httpx' ELSE 'playwright-failed' END AS fetch_method FROM r WHERE {_domain_ok('request_id', HOST)}"""


def r2_request_rules(spark, sf):
    """Crawls with unlike domain and path rules in one job."""
    seeds, responses = _page_seeds(spark, sf)
    rules = _rules_by_request(spark, seeds.select(F.col("seed_id").alias("request_id")))
    made, _ = crawl_job(seeds, responses, rules=rules)
    return made.select("seed_id", "rank", "url", "depth", "fetch_method", "links_found")


ORACLES["r2_request_rules"] = f"""WITH {_PAGE_CRAWL}, good AS (SELECT page_id FROM pages WHERE {_domain_ok('page_id', HOST)}),
kl AS (SELECT s.page_id AS seed_id, l.dst_url, 1 + row_number() OVER (PARTITION BY s.page_id ORDER BY l.pos) AS rank, s.cap
 FROM s JOIN good USING (page_id) JOIN owner USING (url) JOIN ok USING (owner) JOIN links l ON l.page_id = owner.owner WHERE {_path_ok('s.page_id', 'l.' + _LINK_PATH).replace('l.regexp_replace(dst_url', 'regexp_replace(l.dst_url')}),
kn AS (SELECT seed_id, count(*) AS n FROM kl GROUP BY 1)
SELECT s.page_id AS seed_id, 1 AS rank, s.url, 0 AS depth, CASE WHEN ok.owner IS NULL THEN 'playwright-failed' ELSE 'httpx' END AS fetch_method,
 CAST(coalesce(kn.n, 0) AS INTEGER) AS links_found FROM s JOIN good USING (page_id) JOIN owner USING (url) LEFT JOIN ok USING (owner) LEFT JOIN kn ON kn.seed_id = s.page_id
UNION ALL SELECT seed_id, rank, dst_url, 1, 'playwright-failed', 0 FROM kl WHERE rank <= cap"""


def r4_request_rules(spark, sf):
    """Extract requests under their own domain rules: one rejected URL rejects the request."""
    specs = pages(
        spark, sf, "page_id div 2 AS request_id", "CAST(page_id % 2 AS INT) AS position", "url", "'list all the prices' AS prompt", "false AS force_js_render"
    )
    rules = _rules_by_request(spark, specs.select("request_id").distinct())
    data, _ = extract_job(specs, pages(spark, sf, "url", "html"), "per_page", _echo_model, rules=rules)
    return data.groupBy("request_id").agg(F.count(F.lit(1)).alias("urls"))


ORACLES["r4_request_rules"] = f"""SELECT page_id // 2 AS request_id, count(*) AS urls FROM pages GROUP BY 1 HAVING bool_and({_domain_ok('(page_id // 2)', HOST)})"""

for _f in (p8_request_domains, p7_request_paths, r1_request_rules, r2_request_rules, r4_request_rules):
    QUERIES[_f.__name__] = _f

for _f in (r1_research, r1_research_summary, s12_research_envelope, r2_crawl_answers, r3_map_answers, r4_extract_answers):
    QUERIES[_f.__name__] = _f
