"""Links and visited URLs in buckets: what a level of a traversal shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from webgleaner.operators import crawl as T
from webgleaner.operators import scale
from webgleaner.operators.discovery import run_discovery
from webgleaner.operators.sitemaps import read_sitemaps
from webgleaner.session import bucketed, work_folder


@pytest.fixture
def shuffle_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange ", plan(df).split("Initial Plan")[0]))


def test_joins_on_the_keys_read_the_table_as_it_lies(shuffle_joins):
    spark = shuffle_joins
    rows = spark.range(1000).selectExpr("id % 7 AS seed_id", "concat('u', id) AS url", "id AS rank")
    table = bucketed(rows, work_folder(spark, "test"), ["seed_id", "url"])
    other = spark.range(500).selectExpr("id % 7 AS seed_id", "concat('u', id) AS url")
    grouped = other.groupBy("seed_id", "url").count()
    # One shuffle, for the aggregate of the other side.
    assert exchanges(grouped.join(table, ["seed_id", "url"], "left_anti")) == 1
    twice = grouped.join(table, ["seed_id", "url"], "left_anti").join(table.select("seed_id", "url"), ["seed_id", "url"], "left_anti")
    assert exchanges(twice) == 1 and twice.count() == 0
    assert table.count() == 1000 and table.agg(F.sum("rank")).first()[0] == 499500


def test_no_level_shuffles_links_or_earlier_levels(shuffle_joins, monkeypatch):
    """The plan of each written level: exchanges stand over the frontier and the children, not over link table or visited levels."""
    spark, plans = shuffle_joins, {}

    def noted(df, path, keys):
        plans[path.rsplit("/", 1)[-1]] = plan(df)
        return bucketed(df, path, keys)

    monkeypatch.setattr(T, "bucketed", noted)
    links = [(f"http://a.test/{i}", [f"http://a.test/{2 * i + k}" for k in (1, 2)]) for i in range(200)]
    pages = spark.createDataFrame(links, "url string, links array<string>")
    seeds = spark.createDataFrame([(1, "http://a.test/0", 4, 100), (2, "http://a.test/3", 3, 9)], "seed_id int, url string, max_depth int, max_urls int")
    order = T.traverse(seeds, T.child_table(pages), redirects=True, skip=spark.createDataFrame([(1, "http://a.test/2")], "seed_id int, url string"))
    rows = {(r.seed_id, r.url.rsplit("/", 1)[1]): r.rank for r in order.collect()}
    assert len(rows) == sum(1 for s, _ in rows if s == 1) + 9 and (1, "2") not in rows and rows[1, "0"] == 1
    joined = [text for name, text in plans.items() if name.startswith("final-")]
    assert joined
    for text in joined:
        # The link table is the side of the join that has no exchange above its scan.
        scans = [line for line in text.splitlines() if "FileScan" in line and "resolved_url" in line]
        assert scans and all("Bucketed: true" in line for line in scans)


def test_rules_by_seed_filter_children(spark):
    links = [(f"http://a.test/{i}", [f"http://a.test/{2 * i + k}" for k in (1, 2)]) for i in range(50)]
    pages = spark.createDataFrame(links, "url string, links array<string>")
    seeds = spark.createDataFrame([(s, "http://a.test/0", 2, 100) for s in (1, 2)], "seed_id int, url string, max_depth int, max_urls int")
    order = T.traverse(seeds, T.child_table(pages), keep=lambda found: found.where("seed_id = 1 OR NOT url LIKE '%/2'"))
    got = {s: {r.url.rsplit("/", 1)[1] for r in order.where(f"seed_id = {s}").collect()} for s in (1, 2)}
    assert got == {1: set("0123456"), 2: set("0134")}


def test_buckets_up_to_the_limit(spark):
    rows = spark.range(5000).selectExpr("id % 4 AS k", "id div 4 AS place", "CAST(id % 4 * 400 AS INT) AS most").where("k < 3 OR place < 30")
    cut = scale.first_buckets(rows, ["k"], F.floor(F.col("place") / 64), F.col("most"), work_folder(spark, "test"))
    got = {(r.k, r.bucket): (r.before, r.total) for r in cut.collect()}
    # Nothing of a key whose limit is 0; the last bucket of a key starts below its limit; a key with few rows has all its buckets.
    want = {(1, b): (64 * b, 1250) for b in range(7)} | {(2, b): (64 * b, 1250) for b in range(13)} | {(3, 0): (0, 30)}
    assert got == want
    empty = scale.first_buckets(rows.where("k > 9"), ["k"], F.col("place"), F.col("most"), work_folder(spark, "test"))
    assert empty.count() == 0 and empty.columns == ["k", "bucket", "before", "total"]


def test_only_rows_up_to_the_limit_are_numbered(spark, monkeypatch):
    """Each level numbers at most the limit and one bucket of parents per seed; results are those of the whole level."""
    numbered = {}

    def noted(df, path, keys):
        name = path.rsplit("/", 1)[-1]
        out = bucketed(df, path, keys)
        if name.startswith("level-") and name != "level-0":
            windows = []

            def walk(node):
                if node.nodeName() == "Window":
                    windows.append(node)
                for i in range(node.children().size()):
                    walk(node.children().apply(i))

            walk(df._jdf.queryExecution().optimizedPlan())
            below = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), windows[0].child())
            numbered[name] = below.count()
        return out

    monkeypatch.setattr(T, "bucketed", noted)
    monkeypatch.setattr(T, "_PARENTS_PER_BUCKET", 2)
    # Ten links a page: the third level has 1,000 pages.
    links = [(f"http://a.test/{i}", [f"http://a.test/{10 * i + k}" for k in range(1, 11)]) for i in range(1200)]
    pages = spark.createDataFrame(links, "url string, links array<string>")
    seeds = [(1, "http://a.test/0", 3, 130), (2, "http://a.test/0", 3, 5), (3, "http://a.test/0", 1, 4000)]
    order = T.traverse(spark.createDataFrame(seeds, "seed_id int, url string, max_depth int, max_urls int"), T.child_table(pages))
    got = {s: [int(r.url.rsplit("/", 1)[1]) for r in order.where(f"seed_id = {s}").orderBy("rank").collect()] for s in (1, 2, 3)}
    assert got == {1: list(range(130)), 2: list(range(5)), 3: list(range(11))}
    # Level 3: one bucket of two parents has 20 URLs, more than seed 1 lacks; without the cut-off it would be 1,000.
    assert numbered == {"level-1": 30, "level-2": 100, "level-3": 20}


def test_sitemap_documents_beyond_the_limit_are_left(spark):
    site = "https://lake.org"
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>{site}/m{i}.xml</loc></sitemap>" for i in range(4)) + "</sitemapindex>"
    lists = [
        (f"{site}/m{i}.xml", 200, "text/xml", "<urlset>" + "".join(f"<url><loc>{site}/{i}/{j}</loc></url>" for j in range(6)) + "</urlset>") for i in range(4)
    ]
    files = spark.createDataFrame([(f"{site}/sitemap.xml", 200, "text/xml", index), *lists], "url string, status int, content_type string, text string")
    fetched = spark.createDataFrame([(f"{site}/", f"{site}/", [f"{site}/0/0", f"{site}/new"])], "url string, resolved_url string, links array<string>")
    requests = [(n, site, "hybrid", n, 1) for n in (1, 6, 8, 24, 25, 99)]
    asked = spark.createDataFrame(requests, "seed_id int, url string, discovery_method string, max_urls int, max_depth int")
    urls, _ = run_discovery(asked, fetched, files)
    got = {n: [r.path for r in urls.where(f"seed_id = {n}").orderBy("rank").collect()] for n, *_ in requests}
    listed = [f"/{i}/{j}" for i in range(4) for j in range(6)]
    assert got == {1: listed[:1], 6: listed[:6], 8: listed[:8], 24: listed, 25: [*listed, "/"], 99: [*listed, "/", "/new"]}


def test_site_files_are_made_once(spark):
    """What makes the sitemap bodies does not run again for every nesting level."""
    site = "https://sea.org"
    index = lambda name: f"<sitemapindex><sitemap><loc>{site}/{name}.xml</loc></sitemap></sitemapindex>"
    leaf = f"<urlset><url><loc>{site}/a</loc></url></urlset>"
    rows = [("sitemap", index("m1")), ("m1", index("m2")), ("m2", index("m3")), ("m3", leaf)]
    made = spark.sparkContext.accumulator(0)

    def body(text):
        made.add(1)
        return text

    made_text = F.udf(body, "string").asNondeterministic()
    files = spark.createDataFrame([(f"{site}/{n}.xml", 200, "text/xml", t) for n, t in rows], "url string, status int, content_type string, text string")
    files = files.withColumn("text", made_text("text"))
    fetched = spark.createDataFrame([(f"{site}/", f"{site}/", [])], "url string, resolved_url string, links array<string>")
    asked = spark.createDataFrame([(1, site, "sitemap", 5, 1)], "seed_id int, url string, discovery_method string, max_urls int, max_depth int")
    urls, _ = run_discovery(asked, fetched, files)
    assert [r.path for r in urls.collect()] == ["/a"]
    assert made.value == len(rows)
    located = spark.createDataFrame([(1, site, f"{site}/sitemap.xml")], "seed_id int, base_url string, sitemap_url string")
    assert [r.path for r in read_sitemaps(located, files.select("url", "text")).collect()] == ["/a"]
    assert made.value == 2 * len(rows)
