"""Limits are arguments: by default everything is kept, and what a limit cuts leaves a flag or an error row."""

from pyspark.sql import functions as F

from webgleaner.operators import discovery, fetching, links, sitemaps
from webgleaner.session import work_folder
from webgleaner.sources.readers import read_raw_pages

PAGE = "<html><body><p>" + "a calm and readable sentence about boats. " * 10 + "</p></body></html>"


def test_pdf_pages(spark):
    rows = [("d", n, f"page {n}") for n in range(120)] + [("e", 0, " ")]
    pdf = spark.createDataFrame(rows, "doc_url string, page_no int, text string")
    whole = {r.doc_url: r for r in fetching.assemble_pdf(pdf).collect()}
    assert whole["d"].text.endswith("page 119") and not whole["d"].truncated and whole["e"].error
    cut = {r.doc_url: r for r in fetching.assemble_pdf(pdf, 50).collect()}
    assert cut["d"].text.endswith("page 49") and cut["d"].truncated and not cut["e"].truncated


def test_sitemap_bytes(spark):
    body = "<urlset><url><loc>https://lake.org/a</loc></url></urlset>"
    df = spark.createDataFrame([("https://lake.org/sitemap.xml", body)], "url string, text string")
    assert sitemaps.parse_documents(df).first().urls and sitemaps.parse_documents(df).first().error is None
    row = sitemaps.parse_documents(df, max_bytes=10).first()
    assert not row.urls and row.error == f"Sitemap too large ({len(body)} bytes)"


def test_raw_files(spark, tmp_path):
    (tmp_path / "small.html").write_text("<p>s</p>")
    (tmp_path / "large.html").write_text("<p>" + "l" * 500 + "</p>")
    assert read_raw_pages(spark, str(tmp_path)).where("error is null and html is not null").count() == 2
    got = {r.path.rsplit("/")[-1]: r for r in read_raw_pages(spark, str(tmp_path), max_bytes=100).collect()}
    assert got["small.html"].html and got["large.html"].html is None and got["large.html"].error == "File too large (507 bytes)"


def test_bodies(spark):
    rows = [("https://lake.org/", None, 200, None, "<a href='/x'>x</a>" + " " * 1000)]
    df = spark.createDataFrame(rows, "url string, final_url string, status int, content_length long, html string")
    assert links.fetched_links(df).first().links == ["https://lake.org/x"]
    row = links.fetched_links(df, max_bytes=100).first()
    assert row.links == [] and row.error == "Response too large (>100 bytes)"


def test_static_reason_stays(spark):
    rows = [("https://lake.org/a", 404, PAGE, PAGE), ("https://lake.org/b", 200, PAGE, PAGE), ("https://lake.org/c", 503, None, None)]
    df = spark.createDataFrame(rows, "url string, status int, html string, rendered_html string")
    got = {r.url[-1]: r for r in fetching.scrape(df).collect()}
    assert (got["a"].fetch_method, got["a"].error, got["a"].static_error) == ("playwright", None, "HTTP 404")
    assert (got["b"].fetch_method, got["b"].static_error) == ("httpx", None)
    assert got["c"].error and got["c"].static_error == "HTTP 503"
    small = fetching.scrape(df.where("status = 200"), max_bytes=10).first()
    assert small.fetch_method == "playwright" and small.static_error == "Response too large (>10 bytes)"


def test_one_version_per_requested_url(spark):
    rows = [("https://lake.org/a", 500, ""), ("https://lake.org/a", 200, PAGE), ("https://lake.org/a", 200, PAGE), ("https://lake.org/z", 200, PAGE)]
    responses = spark.createDataFrame(rows, "url string, status int, html string")
    urls = spark.createDataFrame([(1, "https://lake.org/a"), (2, "https://lake.org/a"), (3, "https://lake.org/missing")], "request_id int, url string")
    got = {r.request_id: r for r in fetching.scrape_urls(urls, responses).collect()}
    assert len(got) == 3 == fetching.scrape_urls(urls, responses).count()
    assert got[1].fetch_method == got[2].fetch_method == "httpx" and got[3].fetch_method == "playwright-failed" and got[3].markdown_content == ""


def test_full_sitemaps_parse_no_page(spark):
    site = "https://lake.org"
    requests = spark.createDataFrame([(1, site, "sitemap", 1, 3), (2, site, "hybrid", 2, 3)], "seed_id int, url string, discovery_method string, max_urls int, max_depth int")
    files = spark.createDataFrame(
        [(f"{site}/sitemap.xml", 200, "application/xml", f"<urlset><url><loc>{site}/a</loc></url><url><loc>{site}/b</loc></url><url><loc>{site}/c</loc></url></urlset>")],
        "url string, status int, content_type string, text string",
    )
    # Reading a page would fail.
    pages = spark.range(1).select(
        F.lit(site).alias("url"), F.lit(site).alias("resolved_url"), F.array(F.raise_error(F.lit("page read")).cast("string")).alias("links")
    )
    urls, _ = discovery.run_discovery(requests, pages, files)
    assert sorted((r.seed_id, r.url, r.rank) for r in urls.collect()) == [(1, f"{site}/a", 1), (2, f"{site}/a", 1), (2, f"{site}/b", 2)]


def test_work_folders_are_not_shared(spark):
    assert work_folder(spark, "x") != work_folder(spark, "x")
