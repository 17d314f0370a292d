"""Page and document content."""

from pyspark.sql import functions as F

from ..functions import content as C
from ..functions.text import cap, is_blank, strip
from ..functions.prompts import SUMMARY_DOC_CHARS
from ..operators.links import MAX_BODY_BYTES
from ..operators.summary import char_totals
from ..operators import fetching as G
from ..sources.readers import read_pages
from .common import pages, table

QUERIES, ORACLES = {}, {}

# Markdown of the pages in plain SQL (RE2 has no back references, so element by element).

def _drop(sql: str, tag: str) -> str:
    return f"regexp_replace({sql}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"


def live_sql(html: str) -> str:
    """Markup without the parts that are never content."""
    live = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("head", "script", "style", "nav", "footer", "iframe"):
        live = _drop(live, tag)
    return live


def markdown_sql(source: str, html: str = "html") -> str:
    """CTEs that add ``md`` to the rows of ``source``."""
    live = live_sql(html)
    blocks = (
        "address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|form|h[1-6]|header|main|ol|p|"
        "pre|section|table|tbody|thead|tr|ul"
    )
    return f"""live AS (SELECT *, {live} AS live FROM {source}),
art AS (SELECT *, regexp_extract(live, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) AS art FROM live),
pick AS (SELECT *, CASE WHEN length(trim(regexp_replace(art, '<[a-zA-Z/!?][^>]*>', '', 'g'), ' ' || chr(9) || chr(13) || chr(10))) >= 50
 THEN art ELSE live END AS m FROM art),
s1 AS (SELECT *, regexp_replace(m, '[\\t\\r\\n\\f]', ' ', 'g') AS t FROM pick),
s2 AS (SELECT * REPLACE (regexp_replace(t, '(?i)<h1\\b[^>]*> ?', chr(10) || chr(10) || '# ', 'g') AS t) FROM s1),
s3 AS (SELECT * REPLACE (regexp_replace(t, '(?i)<li\\b[^>]*> ?', chr(10) || '- ', 'g') AS t) FROM s2),
s4 AS (SELECT * REPLACE (regexp_replace(t, '(?i)<br\\b[^>]*>', chr(10), 'g') AS t) FROM s3),
s5 AS (SELECT * REPLACE (regexp_replace(t, '(?i)</?(?:{blocks})\\b[^>]*>', chr(10) || chr(10), 'g') AS t) FROM s4),
s6 AS (SELECT * REPLACE (regexp_replace(t, '<[a-zA-Z/!?][^>]*>', '', 'g') AS t) FROM s5),
s7 AS (SELECT * REPLACE (replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'),
 '&middot;', '·'), '&amp;', '&') AS t) FROM s6),
s8 AS (SELECT * REPLACE (regexp_replace(t, '[ \\x{{a0}}]+', ' ', 'g') AS t) FROM s7),
s9 AS (SELECT * REPLACE (regexp_replace(t, ' ?\\n ?', chr(10), 'g') AS t) FROM s8),
md AS (SELECT * EXCLUDE (t, live, art, m), trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS md FROM s9)"""


def s1_page_source(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.char_length("html").alias("chars"), F.octet_length("html").alias("bytes")
    )


ORACLES["s1_page_source"] = """SELECT page_id, url, CAST(length(html) AS INTEGER) AS chars, CAST(strlen(html) AS INTEGER) AS bytes FROM pages"""


def c1_markdown(spark, sf):
    return C.with_markdown(pages(spark, sf, "page_id", "html")).select("page_id", "markdown")


ORACLES["c1_markdown"] = f"""WITH {markdown_sql('pages')} SELECT page_id, md AS markdown FROM md"""


# Pages without article elements: the densest blocks have to be found.
_PLAIN = {"spark": r"regexp_replace(html, '(</?)article', '$1div')", "sql": r"regexp_replace(html, '(</?)article', '\1div', 'g')"}
_STARTS = (
    "address|article|aside|blockquote|body|caption|dd|div|dl|dt|fieldset|figcaption|figure|form|header|html|main|p|section|tbody|tfoot|thead|"
    "h[1-6]|li|ol|pre|table|tr|ul"
)


def c1_main_content(spark, sf):
    """Where the main content of each page lies among its blocks."""
    made = C.with_main_content(pages(spark, sf, "page_id", f"{_PLAIN['spark']} AS html"))
    run = [F.coalesce(F.col(f"run.{c}"), F.lit(-1)).alias(f"{c}_block") for c in ("first", "last")]
    return made.select(
        "page_id", *run, F.coalesce("run.chars", F.lit(0)).alias("chars"), F.md5(F.coalesce("run.markup", F.lit(""))).alias("markup_md5")
    )


def _chars_sql(markup: str) -> str:
    return f"length(regexp_replace({markup}, '<[a-zA-Z/!?][^>]*>|[ \\t\\r\\n\\f]+', '', 'g'))"


# Largest sum of a run of blocks by prefix sums: the least sum before each block, the last such place among equals.
ORACLES["c1_main_content"] = f"""WITH l AS (SELECT page_id, string_split(regexp_replace({live_sql(_PLAIN['sql'])}, '(?i)(<(?:{_STARTS})\\b)', chr(1) || '\\1', 'g'), chr(1)) AS b FROM pages),
u AS (SELECT page_id, unnest(b) AS b, generate_subscripts(b, 1) - 1 AS i FROM l),
n AS (SELECT page_id, i, b, {_chars_sql('b')} AS n, {_chars_sql("regexp_replace(b, '(?is)<a[^a-z][^>]*>.*?</a *>', '', 'g')")} AS outside FROM u),
o AS (SELECT *, 2 * outside - n AS own FROM n),
s AS (SELECT *, 4 * own + greatest(-100, least(100, coalesce(lag(own) OVER w, 0))) + greatest(-100, least(100, coalesce(lead(own) OVER w, 0))) - CASE WHEN regexp_matches(b, '^<[hH][1-6]') THEN 50 ELSE 200 END AS score
 FROM o WINDOW w AS (PARTITION BY page_id ORDER BY i)),
p AS (SELECT *, sum(score) OVER (PARTITION BY page_id ORDER BY i) AS upto, sum(score) OVER (PARTITION BY page_id ORDER BY i) - score AS before FROM s),
m AS (SELECT *, min(before) OVER (PARTITION BY page_id ORDER BY i) AS least FROM p),
e AS (SELECT page_id, max(upto - least) AS best FROM m GROUP BY 1),
z AS (SELECT m.page_id, min(m.i) AS last FROM m JOIN e ON e.page_id = m.page_id AND m.upto - m.least = e.best WHERE best > 0 GROUP BY 1),
a AS (SELECT z.page_id, last, max(p.i) AS first FROM z JOIN m ON m.page_id = z.page_id AND m.i = z.last JOIN p ON p.page_id = z.page_id AND p.i <= z.last AND p.before = m.least GROUP BY 1, 2),
r AS (SELECT a.page_id, first, last, sum(n) AS chars, md5(string_agg(b, '' ORDER BY i)) AS markup_md5 FROM a JOIN n ON n.page_id = a.page_id AND n.i BETWEEN first AND last GROUP BY 1, 2, 3)
SELECT page_id, CAST(CASE WHEN chars >= 50 THEN first ELSE -1 END AS INTEGER) AS first_block, CAST(CASE WHEN chars >= 50 THEN last ELSE -1 END AS INTEGER) AS last_block,
 CAST(CASE WHEN chars >= 50 THEN chars ELSE 0 END AS INTEGER) AS chars, CASE WHEN chars >= 50 THEN markup_md5 ELSE md5('') END AS markup_md5
FROM pages LEFT JOIN r USING (page_id)"""


def c1_nested_markdown(spark, sf):
    """Orders as pages: lines listed by flag in nested lists, as a table and as code."""
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_returnflag AS flag", "l_linenumber AS line", "l_partkey AS part", "CAST(l_quantity AS INT) AS quantity"
    )
    # Dealt once, by order: the lines of a flag and the flags of an order then meet where they are.
    flags = lines.repartition("l_orderkey").groupBy("l_orderkey", "flag").agg(F.sort_array(F.collect_list(F.struct("line", "part", "quantity"))).alias("lines"))
    orders = flags.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("flag", "lines"))).alias("flags"))
    made = orders.selectExpr(
        "l_orderkey",
        """concat('<body><main><h1>Order <em>', l_orderkey, '</em></h1><p>All lines of the order, listed by return flag &amp; in a table.</p>\n<ul>',
 array_join(transform(flags, f -> concat('<li>Flag <b>', f.flag, '</b>\n <ol>', array_join(transform(f.lines, x -> concat('<li>part ', x.part, '</li>')), '\n'),
 '</ol> </li>')), ''), '</ul><table><thead><tr><th>Line</th><th>Part|Quantity</th></tr></thead><tbody>',
 array_join(transform(array_sort(flatten(transform(flags, f -> f.lines))), x -> concat('<tr>\n<td>', x.line, '</td>\n<td>', x.part, '|<code>', x.quantity, '</code></td></tr>')), '\n'),
 '</tbody></table><pre><code>order  ', l_orderkey, '\n  ', size(flags), ' flags</code></pre><p>End of <a href="/orders">the order</a></main></body>') AS html""",
    )
    return C.with_markdown(made, in_python=True).select("l_orderkey", "markdown")


ORACLES["c1_nested_markdown"] = r"""WITH x AS (SELECT l_orderkey, l_returnflag AS flag, l_linenumber AS line, l_partkey AS part, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, flag ORDER BY line, part, quantity) AS number FROM x),
f AS (SELECT l_orderkey, flag, concat('- Flag **', flag, '**', string_agg(concat(chr(10), '  ', number, '. part ', part), '' ORDER BY number)) AS item FROM k GROUP BY 1, 2),
l AS (SELECT l_orderkey, count(*) AS n, string_agg(item, chr(10) ORDER BY flag) AS items FROM f GROUP BY 1),
t AS (SELECT l_orderkey, string_agg(concat('| ', line, ' | ', part, '\|`', quantity, '` |'), chr(10) ORDER BY line, part, quantity) AS rows FROM x GROUP BY 1)
SELECT l_orderkey, concat('# Order *', l_orderkey, '*', chr(10), chr(10), 'All lines of the order, listed by return flag & in a table.', chr(10), chr(10), items, chr(10), chr(10),
 '| Line | Part\|Quantity |', chr(10), '| --- | --- |', chr(10), rows, chr(10), chr(10), '```', chr(10), 'order  ', l_orderkey, chr(10), '  ', n, ' flags', chr(10), '```', chr(10), chr(10),
 'End of [the order](/orders)') AS markdown FROM l JOIN t USING (l_orderkey)"""


def c3_page_title(spark, sf):
    return pages(spark, sf, "page_id", "html").select("page_id", C.html_title(F.col("html")).alias("html_title"))


ORACLES["c3_page_title"] = r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
 '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS html_title FROM pages"""

NOISY = """CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', ' var ')
 ELSE replace(concat('window.document.x; !function a(){}; ', replace(text, chr(10), ' ')), ' ', '; ') END"""
_WORDS = "['function', 'const', 'let', 'var', 'typeof']"


def c2_script_noise(spark, sf):
    df = table(spark, sf, "documents").selectExpr("doc_id", f"{NOISY} AS body")
    return df.select("doc_id", C.script_hits(F.col("body")).alias("hits"), C.is_script_noise(F.col("body")).alias("noise"))


ORACLES["c2_script_noise"] = f"""WITH n AS (SELECT doc_id, lower({NOISY}) AS t FROM documents),
h AS (SELECT doc_id, t, len(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains({_WORDS}, w)))
 + len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])window[.]'))
 + len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])document[.]')) + len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])console[.]'))
 + len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])fetch\\s*\\('))
 + len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])void\\s+0(?:$|[^\\p{{L}}\\p{{N}}_])'))
 + len(regexp_extract_all(t, '!function(?:$|[^\\p{{L}}\\p{{N}}_])')) + len(regexp_extract_all(t, 'catch\\s*\\('))
 + len(regexp_extract_all(t, '[.]prototype[.]')) + len(regexp_extract_all(t, 'performance[.]now(?:$|[^\\p{{L}}\\p{{N}}_])')) AS hits FROM n),
z AS (SELECT doc_id, hits, length(t) AS n, length(t) - length(replace(t, chr(10), '')) AS lines,
 length(t) - length(replace(t, ';', '')) AS marks FROM h)
SELECT doc_id, CAST(hits AS INTEGER) AS hits, n >= 200 AND (hits / (n / 1000.0) > 10 OR (lines < 5 AND marks > 50)) AS noise FROM z"""

# Fetch results made from the pages: errors, PDFs, short pages, pages with and without a rendered version.
_RESPONSE = (
    "page_id",
    "url",
    "CASE page_id % 7 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END AS status",
    "CASE WHEN page_id % 7 = 3 THEN 'application/pdf' ELSE 'text/html' END AS content_type",
    "CASE WHEN page_id % 7 = 4 THEN '<p>Loading</p>' ELSE html END AS html",
    "CASE WHEN page_id % 2 = 0 THEN html END AS rendered_html",
    "CASE WHEN page_id % 14 = 1 THEN 'Render timeout' END AS render_error",
    "CASE WHEN page_id % 14 = 3 THEN 'PDF text' END AS pdf_text",
)
_ROUTE = """CASE WHEN page_id % 7 = 3 THEN CASE WHEN page_id % 14 = 3 THEN 'pdf' ELSE 'pdf-failed' END
 WHEN page_id % 7 NOT IN (1, 2, 4) AND length(md) >= 200 THEN 'httpx' WHEN page_id % 2 = 0 THEN 'playwright'
 ELSE 'playwright-failed' END"""


def c3_tier_route(spark, sf):
    made = G.scrape(pages(spark, sf, *_RESPONSE))
    return made.select(
        "page_id", "fetch_method", F.col("content_length_out").alias("content_length"), F.coalesce("error", F.lit("")).alias("error"), "fell_back",
        F.md5("markdown_content").alias("content_md5"),
    )


ORACLES["c3_tier_route"] = f"""WITH {markdown_sql('pages')}, r AS (SELECT *, {_ROUTE} AS fetch_method FROM md),
c AS (SELECT *, CASE fetch_method WHEN 'pdf' THEN 'PDF text' WHEN 'httpx' THEN md WHEN 'playwright' THEN md ELSE '' END AS body FROM r)
SELECT page_id, fetch_method, CAST(length(body) AS INTEGER) AS content_length, CASE WHEN fetch_method = 'pdf-failed' THEN 'PDF extraction failed'
 WHEN fetch_method = 'playwright-failed' THEN CASE WHEN page_id % 14 = 1 THEN 'Render timeout' ELSE 'Playwright returned empty HTML' END
 ELSE '' END AS error, starts_with(fetch_method, 'playwright') AS fell_back, md5(body) AS content_md5 FROM c"""


def c3_force_render(spark, sf):
    made = G.scrape(pages(spark, sf, *_RESPONSE), F.lit(True))
    return made.groupBy("fetch_method").agg(F.count(F.lit(1)).alias("pages"), F.count_if("fell_back").alias("fallbacks"))


ORACLES["c3_force_render"] = """SELECT CASE WHEN page_id % 2 = 0 THEN 'playwright' ELSE 'playwright-failed' END AS fetch_method,
 count(*) AS pages, 0 AS fallbacks FROM pages GROUP BY 1"""


def c4_scrape_urls(spark, sf):
    """Every page asked for twice, and one URL per page that was never fetched."""
    asked = pages(spark, sf, "page_id", "explode(array(url, url, concat(url, '-missing'))) AS url")
    made = G.scrape_urls(asked, pages(spark, sf, "url", "html"))
    return made.groupBy("page_id", "fetch_method").agg(
        F.count(F.lit(1)).alias("n"), F.max("content_length").alias("content_length"), F.max(F.coalesce("error", F.lit(""))).alias("error")
    )


ORACLES["c4_scrape_urls"] = f"""WITH {markdown_sql('pages')}
SELECT page_id, CASE WHEN length(md) >= 200 THEN 'httpx' ELSE 'playwright-failed' END AS fetch_method,
 CASE WHEN length(md) >= 200 THEN 2 ELSE 3 END AS n, CAST(CASE WHEN length(md) >= 200 THEN length(md) ELSE 0 END AS INTEGER) AS content_length,
 CASE WHEN length(md) >= 200 THEN '' ELSE 'Playwright returned empty HTML' END AS error FROM md
UNION ALL SELECT page_id, 'playwright-failed', 1, 0, 'Playwright returned empty HTML' FROM md WHERE length(md) >= 200"""


def c5_pdf_text(spark, sf):
    """Conversation turns as PDF pages, ten numbers apart, all of them read."""
    df = table(spark, sf, "conversations").selectExpr(
        "concat('conv-', conv_id) AS doc_url", "turn * 10 AS page_no", "CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE text END AS text"
    )
    out = G.assemble_pdf(df)
    return out.select("doc_url", "truncated", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.coalesce("error", F.lit("")).alias("error"))


ORACLES["c5_pdf_text"] = """WITH p AS (SELECT concat('conv-', conv_id) AS doc_url, turn, CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE text END AS t
 FROM conversations),
j AS (SELECT doc_url, trim(string_agg(t, chr(10) || chr(10) ORDER BY turn), ' ' || chr(9) || chr(13) || chr(10)) AS t FROM p GROUP BY 1)
SELECT doc_url, false AS truncated, md5(t) AS text_md5, CASE WHEN t = '' THEN 'PDF has no extractable text (likely scanned image)' ELSE '' END AS error FROM j"""


def k4_pdf_page_cap(spark, sf):
    """The usual page limit, and which documents it cuts."""
    df = table(spark, sf, "conversations").selectExpr("conv_id AS doc_url", "turn * 10 AS page_no", "'p' AS text")
    out = G.assemble_pdf(df, C.PDF_MAX_PAGES)
    pages_read = F.coalesce(F.regexp_count("text", F.lit("p")), F.lit(0)).cast("bigint")
    return out.select(F.col("doc_url").alias("conv_id"), pages_read.alias("pages"), "truncated")


ORACLES["k4_pdf_page_cap"] = "SELECT conv_id, count(*) FILTER (turn * 10 < 50) AS pages, bool_or(turn * 10 >= 50) AS truncated FROM conversations GROUP BY 1"


def c6_content_length(spark, sf):
    df = table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 9 = 0 THEN concat(' ', chr(10)) ELSE concat('  ', text, chr(10)) END AS body")
    return df.select(
        "doc_id", F.char_length("body").alias("raw_chars"), F.char_length(strip(F.col("body"))).alias("chars"), is_blank(F.col("body")).alias("blank")
    )


ORACLES["c6_content_length"] = r"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat(' ', chr(10)) ELSE concat('  ', text, chr(10)) END AS body FROM documents),
s AS (SELECT doc_id, body, regexp_replace(regexp_replace(body, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS t FROM b)
SELECT doc_id, CAST(length(body) AS INTEGER) AS raw_chars, CAST(length(t) AS INTEGER) AS chars, t = '' AS blank FROM s"""


def k5_text_caps(spark, sf):
    df = table(spark, sf, "documents")
    return df.select(
        "doc_id",
        F.md5(cap(F.col("text"), 4000, "\n\n[... konten dipotong ...]")).alias("summary_md5"),
        F.md5(cap(F.col("text"), 8000, "\n\n[... content truncated ...]")).alias("extract_md5"),
        F.char_length(cap(F.col("text"), 2000)).alias("raw_chars"),
    )


ORACLES["k5_text_caps"] = """SELECT doc_id,
 md5(CASE WHEN length(text) > 4000 THEN concat(substr(text, 1, 4000), chr(10), chr(10), '[... konten dipotong ...]') ELSE text END) AS summary_md5,
 md5(CASE WHEN length(text) > 8000 THEN concat(substr(text, 1, 8000), chr(10), chr(10), '[... content truncated ...]') ELSE text END) AS extract_md5,
 CAST(least(length(text), 2000) AS INTEGER) AS raw_chars FROM documents"""


def a10_char_totals(spark, sf):
    return char_totals(table(spark, sf, "documents"), ["source"], SUMMARY_DOC_CHARS)


ORACLES["a10_char_totals"] = """SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars_before,
 CAST(sum(CASE WHEN length(text) > 4000 THEN 4000 + 27 ELSE length(text) END) AS BIGINT) AS chars_after FROM documents GROUP BY 1"""


def s15_oversize(spark, sf):
    df = table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN n_chars * 20000 END AS declared", "n_chars * 30000 AS size")
    return df.select("doc_id", F.coalesce(G.size_error(F.col("declared"), F.col("size"), MAX_BODY_BYTES), F.lit("")).alias("error"))


ORACLES["s15_oversize"] = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n_chars * 20000 > 52428800
 THEN concat('Response too large (', n_chars * 20000, ' bytes > 52428800 max)')
 WHEN n_chars * 30000 > 52428800 THEN 'Response too large (>52428800 bytes)' ELSE '' END AS error FROM documents"""

_ATTEMPTS = (
    "concat('https://h', event_id div 3, '.example.com/') AS url",
    "CASE WHEN event_id div 3 % 2 = 0 THEN 'static' ELSE 'render' END AS tier",
    "CAST(event_id % 3 + 1 AS INT) AS attempt",
    "CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 WHEN 'view' THEN NULL ELSE 200 END AS status",
    "CASE event_type WHEN 'view' THEN 'Request error: timeout' WHEN 'error' THEN 'HTTP 503' WHEN 'click' THEN 'HTTP 404' END AS error",
)


def _attempts_sql() -> str:
    return """SELECT concat('https://h', event_id // 3, '.example.com/') AS url, CASE WHEN event_id // 3 % 2 = 0 THEN 'static' ELSE 'render' END AS tier,
 event_id % 3 + 1 AS attempt, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 WHEN 'view' THEN NULL ELSE 200 END AS status,
 CASE event_type WHEN 'view' THEN 'Request error: timeout' WHEN 'error' THEN 'HTTP 503' WHEN 'click' THEN 'HTTP 404' END AS error FROM events"""


def s14_fetch_outcome(spark, sf):
    out = G.resolve_attempts(table(spark, sf, "events").selectExpr(*_ATTEMPTS))
    return out.select(
        "url", "tier", "ok", "attempts", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("error", F.lit("")).alias("error"), "backoff_s"
    )


ORACLES["s14_fetch_outcome"] = f"""WITH a AS ({_attempts_sql()}),
m AS (SELECT *, error IS NULL AS ok, error IS NULL OR (tier = 'static' AND status BETWEEN 400 AND 499) AS ended FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY url, tier ORDER BY CASE WHEN ended THEN attempt ELSE 100 - attempt END) AS rn FROM m)
SELECT url, tier, ok, CAST(attempt AS INTEGER) AS attempts, coalesce(status, 0) AS status, coalesce(error, '') AS error,
 CAST(pow(2, attempt - 1) - 1 AS DOUBLE) AS backoff_s FROM n WHERE rn = 1"""


def w5_attempt_order(spark, sf):
    """Last error and number of attempts per URL, attempts in order."""
    df = table(spark, sf, "events").selectExpr(*_ATTEMPTS)
    return df.groupBy("url").agg(
        F.max("attempt").alias("attempts"),
        F.coalesce(F.max_by("error", F.when(F.col("error").isNotNull(), F.col("attempt"))), F.lit("")).alias("last_error"),
    )


ORACLES["w5_attempt_order"] = f"""WITH a AS ({_attempts_sql()})
SELECT url, CAST(max(attempt) AS INTEGER) AS attempts, coalesce(arg_max(error, CASE WHEN error IS NOT NULL THEN attempt END), '') AS last_error FROM a GROUP BY 1"""

for _f in (
    s1_page_source, c1_markdown, c1_main_content, c1_nested_markdown, c3_page_title, c2_script_noise, c3_tier_route, c3_force_render, c4_scrape_urls, c5_pdf_text, k4_pdf_page_cap,
    c6_content_length, k5_text_caps, a10_char_totals, s15_oversize, s14_fetch_outcome, w5_attempt_order,
):
    QUERIES[_f.__name__] = _f
