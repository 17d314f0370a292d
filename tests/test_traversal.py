"""Traversal against a plain queue on random graphs: redirects, skip sets, caps, depths."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from webgleaner.operators import crawl as T
from webgleaner.operators import scale

ROOT = "https://s.example.org/"


def walk(seed, pages, depth_limit, cap, skip=(), redirects=False):
    """Visit order of one seed, one page at a time."""
    seen, queue, out = {seed, *skip}, deque([(seed, 0)]), []
    while queue and len(out) < cap:
        url, depth = queue.popleft()
        final, links = pages.get(url, (url, []))
        out.append((url, depth))
        if redirects:
            seen.add(final)
        if depth == depth_limit:
            continue
        for child in links:
            if child not in seen:
                seen.add(child)
                queue.append((child, depth + 1))
    return out


def random_case(rng):
    nodes = [f"{ROOT}{i}" for i in range(rng.randint(2, 14))]
    pages = {}
    for n in nodes:
        if rng.random() < 0.85:
            links = [rng.choice(nodes) for _ in range(rng.randint(0, 5))]
            pages[n] = (rng.choice(nodes) if rng.random() < 0.3 else n, list(dict.fromkeys(links)))
    return nodes, pages


@pytest.mark.parametrize("redirects", [False, True])
def test_random_graphs(spark, redirects):
    """Forty graphs in one traversal: each gets its own URL prefix."""
    rng = random.Random(5 if redirects else 6)
    seeds, rows, skips, expected = [], [], [], {}
    for case in range(40):
        nodes, pages = random_case(rng)
        mark = lambda u, c=case: u.replace("//s.", f"//s{c}.")
        skip = [n for n in nodes[1:] if redirects and rng.random() < 0.15]
        depth, cap = rng.randint(0, 4), rng.randint(1, 12)
        seeds.append((case, mark(nodes[0]), depth, cap))
        rows += [(mark(u), mark(f), [mark(x) for x in ls]) for u, (f, ls) in pages.items()]
        skips += [(case, mark(n)) for n in skip]
        expected[case] = [(mark(u), d) for u, d in walk(nodes[0], pages, depth, cap, skip, redirects)]
    df = spark.createDataFrame(seeds, "seed_id int, url string, max_depth int, max_urls int")
    links = spark.createDataFrame(rows, "url string, resolved_url string, links array<string>")
    skip_df = spark.createDataFrame(skips, "seed_id int, url string") if skips else None
    order = T.traverse(df, T.child_table(links), skip=skip_df, redirects=redirects).orderBy("seed_id", "rank").collect()
    got = {case: [(r.url, r.depth) for r in order if r.seed_id == case] for case in expected}
    assert got == expected
    assert all(r.rank == i + 1 for case in expected for i, r in enumerate([x for x in order if x.seed_id == case]))


def test_two_seeds_share_a_site_and_missing_pages_count(spark):
    seeds = spark.createDataFrame([("a", ROOT, 2, 10), ("b", ROOT + "x", 2, 2)], "seed_id string, url string, max_depth int, max_pages int")
    scraped = spark.createDataFrame(
        [(ROOT, "httpx", "text", 4, None, [ROOT + "x", ROOT + "y"]), (ROOT + "x", "httpx", "t", 1, None, [ROOT + "y", ROOT + "z"])],
        "url string, fetch_method string, markdown_content string, content_length int, error string, links array<string>",
    )
    rows = T.crawl(seeds, scraped).orderBy("seed_id", "rank").collect()
    assert [(r.seed_id, r.url[len(ROOT):], r.depth, r.fetch_method, r.links_found) for r in rows] == [
        ("a", "", 0, "httpx", 2), ("a", "x", 1, "httpx", 2), ("a", "y", 1, "playwright-failed", 0), ("a", "z", 2, "playwright-failed", 0),
        ("b", "x", 0, "httpx", 2), ("b", "y", 1, "playwright-failed", 0),
    ]


def test_hot_keys_keep_all_rows(spark):
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    right = spark.range(2500).selectExpr("id AS k", "id * 2 AS v").unionByName(spark.createDataFrame([(0, -1)], "k bigint, v bigint"))
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).select("id", "k", "v")
        spread = scale.spread_join(left, right, ["k"], how).select("id", "k", "v")
        assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, spread.collect()), key=repr)


def test_small_side_is_broadcast_whatever_the_size_of_the_other(spark):
    left = spark.range(3_000_000).selectExpr("id", "id % 3 AS k")
    right = scale.small_or_whole(spark.range(2).selectExpr("id AS k", "id AS v"))
    plan = scale.spread_join(left, right, ["k"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_running_totals_and_numbers_by_bucket(spark):
    df = spark.range(2000).selectExpr("id % 3 AS g", "id * 7919 % 2003 AS t", "id % 5 AS v")
    got = scale.running_totals(df, ["g"], F.floor(F.col("t") / 50), [F.col("t")], {"s": F.col("v")})
    want = df.selectExpr(
        "*", "sum(v) OVER (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING) AS s"
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    numbered = scale.number_rows(df, ["g"], F.floor(F.col("t") / 50), [F.col("t")], "n", at_most=1500)
    short = scale.number_rows(df, ["g"], F.floor(F.col("t") / 50), [F.col("t")], "n", at_most=10)
    want = df.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY t) AS n")
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, want.where("n <= 10").collect()))
