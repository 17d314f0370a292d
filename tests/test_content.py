"""Links, Markdown, script noise, PDF test, content choice, sitemaps."""

import gzip

from pyspark.sql import functions as F

from webgleaner.functions import content as C
from webgleaner.functions.text import decode_entities
from webgleaner.operators import fetching as G
from webgleaner.operators import links as L
from webgleaner.operators import sitemaps as S

BASE = "https://example.com/dir/page"


def links(spark, html, **options):
    df = spark.createDataFrame([(BASE, html)], "url string, html string")
    return L.with_links(df, **options).first().links


SCHEMES = ["mailto", "tel", "javascript", "data", "ftp", "file"]


def test_links_by_rule(spark):
    """Every href form against every way to write the tag: what the rules say of a form holds however it is written."""
    forms = {
        "sub/leaf": "https://example.com/dir/sub/leaf", "./leaf": "https://example.com/dir/leaf", "../leaf/": "https://example.com/leaf", "/": "https://example.com/",
        "?q=1": "https://example.com/dir/page?q=1", "//example.com/host": "https://example.com/host", "https://EXAMPLE.com/Case": "https://example.com/Case",
        "leaf#part": "https://example.com/dir/leaf", "http://example.com/other-scheme": None, "https://example.net/else": None, "#part": None, "": None,
        "https://sub.example.com/leaf": None, **{f"{s.upper() if i % 2 else s}:x{i}": None for i, s in enumerate(SCHEMES)},
    }
    tags = [
        lambda h: f'<a href="{h}">t</a>', lambda h: f"<A\n title='>' HREF='{h}'>t", lambda h: f'<a data-href="/no" href = " {h} " rel>', lambda h: f"<a class='c'/href={h or '\"\"'}>",
    ]
    rows = [(BASE, tag(href), [expected] if expected else []) for href, expected in forms.items() for tag in tags]
    df = spark.createDataFrame(rows, "url string, html string, expected array<string>")
    assert L.with_links(df).where("links <> expected").collect() == []


def test_what_holds_no_links(spark):
    anchor = '<a href="/hidden">x</a>'
    hidden = [f"<!-- {anchor} -->", f"<script>{anchor}</script>", f"<style>{anchor}</style>", anchor.replace("href", "name"), anchor.replace("<a ", "<abbr "), f"<!-- {anchor}"]
    for html in [*hidden, ""]:
        assert links(spark, html) == [], html


def test_links_are_distinct_in_page_order(spark):
    order = [7, 3, 7, 11, 3, 5]
    html = "".join(f'<p><a href="/n{i}#{k}">x</a>' for k, i in enumerate(order))
    assert links(spark, html) == [f"https://example.com/n{i}" for i in (7, 3, 11, 5)]
    assert links(spark, html, include=["/n[0-9]$"], exclude=["5"]) == [f"https://example.com/n{i}" for i in (7, 3)]
    sub = '<a href="https://deep.sub.example.com/x">b</a>'
    assert links(spark, sub, include_subdomains=True) == ["https://deep.sub.example.com/x"]


def test_long_pages_do_not_overflow(spark):
    html = "<p>" + "word " * 400_000 + "<a " + "x=1 " * 50 + 'href="/end">' + "<" * 1000
    assert links(spark, html) == ["https://example.com/end"]
    df = spark.createDataFrame([(html,)], "html string")
    assert len(C.with_markdown(df).first().markdown) > 1_900_000


def test_entities(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&lt;&gt;&quot;&#39;": "<>\"'", "&copy;&eacute;&#8226;&#x1F600;": "©é•😀", "&unknown; &": "&unknown; &", "&#0;": "�", "&#38;lt;": "&lt;"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(decode_entities(F.col("t"))).collect()] == list(cases.values())


def test_markdown_golden(spark):
    html = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/n">nav</a></nav><article><h2>Head  line</h2>
    <p>First <b>bold</b>, <em>it</em> &amp; <a href="/x"><b>link</b></a>.<br>Next</p><ul><li>one</li><li>two</li></ul><script>x()</script>
    <p>Last paragraph of the article, long enough.</p></article><footer>foot</footer></body></html>"""
    df = spark.createDataFrame([(html,), ("<body><p>Short</p></body>",), ("",), (None,)], "html string")
    got = [r.markdown for r in C.with_markdown(df).collect()]
    assert got == [
        "## Head line\n\nFirst **bold**, *it* & [**link**](/x).\nNext\n\n- one\n- two\n\nLast paragraph of the article, long enough.",
        "Short", "", "",
    ]


def test_script_noise(spark):
    text = "word " * 60
    cases = [
        ("function " * 10, False), ("x" * 199, False), ("x" * 200, False), ("var a; " * 40, True), (text + "; " * 51, True), (text + "; " * 50, False),
        (text + "\n" * 5 + "; " * 80, False), ("querySelector Error ( " * 20, False), ("évar var " * 30, True),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r[1] for r in df.select("i", C.is_script_noise(F.col("t"))).orderBy("i").collect()]
    assert got == [e for _, e in cases]
    hits = spark.createDataFrame([("!function a(){} window.prototype.x .prototype. fetch (",)], "t string")
    assert hits.select(C.script_hits(F.col("t"))).first()[0] == 6


def test_pdf_by_any_of_three_signs(spark):
    urls = {"https://files.example.org/a.PDF": True, "https://files.example.org/a.pdf?x=.html": True, "https://files.example.org/a?f=b.pdf": False, "https://files.example.org/pdf": False}
    kinds = {"Application/PDF; charset=x": True, "application/octet-stream": False, "": False, None: False}
    heads = {b"%PDF-2.0 rest": True, b" %PDF-1.4": False, b"%PDF": False, None: False}
    rows = [(u, k, h, a or b or c) for u, a in urls.items() for k, b in kinds.items() for h, c in heads.items()]
    df = spark.createDataFrame(rows, "u string, c string, b binary, expected boolean")
    assert df.where(C.looks_like_pdf(F.col("u"), F.col("c"), F.col("b")) != F.col("expected")).collect() == []


def test_content_choice(spark):
    page = "<article><p>" + "good text " * 40 + "</p></article>"
    js = "<article><p>" + "var x; let y; " * 40 + "</p></article>"
    rows = [
        ("ok", 200, "text/html", page, None, None, None), ("short", 200, "text/html", "<p>hi</p>", page, None, None), ("gone", 404, "text/html", page, "<p>r</p>", None, None),
        ("noise", 200, "text/html", js, "<p>r</p>", None, None), ("dead", 500, "text/html", None, None, "Render error", None), ("empty", 200, "text/html", "", "", None, None),
        ("pdf", 200, "application/pdf", "x", page, None, "body"), ("scan", 200, "application/pdf", "x", page, None, ""),
    ]
    df = spark.createDataFrame(rows, "url string, status int, content_type string, html string, rendered_html string, render_error string, pdf_text string")
    got = {r.url: (r.fetch_method, r.content_length_out, r.error, r.fell_back) for r in G.scrape(df).collect()}
    assert got == {
        "ok": ("httpx", 399, None, False), "short": ("playwright", 399, None, True), "gone": ("playwright", 1, None, True), "noise": ("playwright", 1, None, True),
        "dead": ("playwright-failed", 0, "Render error", True), "empty": ("playwright-failed", 0, "Playwright returned empty HTML", True),
        "pdf": ("pdf", 4, None, False), "scan": ("pdf-failed", 0, "PDF extraction failed", False),
    }
    forced = {r.url: r.fetch_method for r in G.scrape(df, F.lit(True)).collect()}
    assert forced["pdf"] == "playwright" and forced["ok"] == "playwright-failed"


def test_attempts(spark):
    rows = [
        ("a", "static", 1, 503, "HTTP 503"), ("a", "static", 2, 200, None), ("b", "static", 1, 404, "HTTP 404"), ("b", "static", 2, 200, None),
        ("c", "static", 1, None, "timeout"), ("c", "static", 2, 500, "HTTP 500"), ("c", "static", 3, None, "reset"), ("d", "render", 1, 404, "x"), ("d", "render", 2, 200, None),
    ]
    df = spark.createDataFrame(rows, "url string, tier string, attempt int, status int, error string")
    got = {r.url: (r.ok, r.attempts, r.error, r.backoff_s) for r in G.resolve_attempts(df).collect()}
    assert got == {"a": (True, 2, None, 1.0), "b": (False, 1, "HTTP 404", 0.0), "c": (False, 3, "reset", 3.0), "d": (True, 2, None, 1.0)}


def test_bodies(spark):
    xml = "<urlset/>"
    rows = [("plain", xml.encode(), None), ("zip", gzip.compress(xml.encode()), "gzip"), ("magic", gzip.compress(xml.encode()), None), ("bad", b"not gzip", "gzip"), ("utf", b"h\xff", None)]
    df = spark.createDataFrame(rows, "url string, body binary, content_encoding string")
    assert {r.url: r.text for r in S.decoded_bodies(df).collect()} == {"plain": xml, "zip": xml, "magic": xml, "bad": "", "utf": "h�"}


def test_urlset(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    body = f"""<?xml version="1.0"?><urlset {ns}><url><loc>https://example.com/a</loc><lastmod>2024-01-01</lastmod></url><url><loc> /b/ </loc></url>
    <url><loc>https://external.com/x</loc></url><url><loc>  </loc></url><url><loc>https://example.com/a</loc></url></urlset>"""
    prefixed = '<s:urlset xmlns:s="x"><s:url><s:loc>https://example.com/p</s:loc></s:url></s:urlset>'
    df = spark.createDataFrame([("1", body), ("2", "<not-valid"), ("3", prefixed), ("4", "<sitemapindex><url><loc>https://example.com/q</loc></url></sitemapindex>")], "url string, text string")
    docs = S.parse_documents(df).withColumn("base_url", F.lit("https://example.com")).withColumnRenamed("url", "doc")
    rows = [(r.doc, r.url, r.path, r.last_modified, r.source) for r in S.urlset_rows(docs).orderBy("doc", "pos").collect()]
    assert rows == [
        ("1", "https://example.com/a", "/a", "2024-01-01", "sitemap"), ("1", "https://example.com/b", "/b/", None, "sitemap"),
        ("1", "https://example.com/a", "/a", None, "sitemap"), ("3", "https://example.com/p", "/p", None, "sitemap"),
    ]
    assert [r.url for r in S.urlset_rows(docs, exclude=["/b"]).where("doc = '1'").collect()] == ["https://example.com/a"] * 2


def test_index_nesting(spark):
    site = "https://example.com"
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{site}/{n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    leaf = lambda n: f"<urlset><url><loc>{site}/{n}</loc></url></urlset>"
    bodies = [("i0", index("i1", "l1", "i0")), ("i1", index("i2", "l2")), ("i2", index("l3")), ("l1", leaf("one")), ("l2", leaf("two")), ("l3", leaf("three"))]
    df = spark.createDataFrame([(f"{site}/{n}", b) for n, b in bodies], "url string, text string")
    located = spark.createDataFrame([(1, site, f"{site}/i0"), (2, site, f"{site}/l1"), (3, site, None)], "seed_id int, base_url string, sitemap_url string")
    rows = S.read_sitemaps(located, df).orderBy("seed_id", "trail", "pos").collect()
    assert [(r.seed_id, r.url) for r in rows] == [(1, f"{site}/three"), (1, f"{site}/two"), (1, f"{site}/one"), (2, f"{site}/one")]
    # With a limit the document three levels below the root index is not read.
    rows = S.read_sitemaps(located, df, max_levels=3).orderBy("seed_id", "trail", "pos").collect()
    assert [(r.seed_id, r.url) for r in rows] == [(1, f"{site}/two"), (1, f"{site}/one"), (2, f"{site}/one")]


def test_robots(spark):
    df = spark.createDataFrame([("User-agent: *\nSitemap: https://example.com/sitemap.xml\nSitemap: x\n",), ("none",)], "b string")
    assert [r[0] for r in df.select(S.robots_sitemap(F.col("b"))).collect()] == ["https://example.com/sitemap.xml", ""]
