"""Markdown by the tag pass and main content by density."""

import random
import re

import pytest
from pyspark.sql import functions as F

from webgleaner.functions import content as C
from webgleaner.functions import markup as M

LONG = "Long enough to be the main text of the page by itself, with all its words."


def markdown(spark, *pages):
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    return [r.markdown for r in C.with_markdown(df).collect()]


def test_null_empty_and_plain(spark):
    assert markdown(spark, None, "", "<!-- x -->", "a < b &amp; c", "<p>") == ["", "", "", "a < b & c", ""]


def test_nested_lists(spark):
    html = f"<main><p>{LONG}</p><ol><li>a<ul><li>b<ol><li>c</li><li>d</li></ol>tail</li></ul></li><li>e</li></ol><p>end</main>"
    assert markdown(spark, html) == [f"{LONG}\n\n1. a\n  - b\n    1. c\n    2. d\ntail\n2. e\n\nend"]


@pytest.mark.parametrize("depth", [1, 3, 40])
def test_list_depth(spark, depth):
    html = f"<main><p>{LONG}</p>" + "".join(f"<ul><li>{i}" for i in range(depth)) + "</li></ul>" * depth + "</main>"
    lines = [f"{'  ' * i}- {i}" for i in range(depth)]
    assert markdown(spark, html) == ["\n".join([LONG, "", *lines])]


def test_tables(spark):
    table = "<table><tr><th>A<th>B<tr><td>1</td><td><p>x|y</p></td></tr><tr><td><ul><li>z</ul></table>"
    nested = "<table><tr><td>out<table><tr><td>in</td></tr></table></td></tr></table>"
    html = f"<main><p>{LONG}</p>{table}{nested}<p>end</p></main>"
    assert markdown(spark, html) == [
        f"{LONG}\n\n| A | B |\n| --- | --- |\n| 1 | x\\|y |\n| \n- z |\n\n| out in |\n| --- |\n\nend".replace("| \n- z", "|\n- z")
    ]


def test_code_keeps_its_white_space(spark):
    html = f"<main><p>{LONG} <code>a  b</code></p><pre><code>if x:\n\ty  =  '&lt;b&gt;'\n\n\n    z</code></pre></main>"
    assert markdown(spark, html) == [f"{LONG} `a b`\n\n```\nif x:\n\ty  =  '<b>'\n\n\n    z\n```"]


def test_marks_that_are_not_closed(spark):
    html = f"<main><p>{LONG} <b>open</p><p>next</b> <i>in</i> <a href='/x'>lost<p><a>no</a> <a href=/y class=z><b>kept</b></a></main>"
    assert markdown(spark, html) == [f"{LONG} open\n\nnext *in* lost\n\nno [**kept**](/y)"]


def test_many_tokens(spark):
    """More tokens than one inner pass takes: the stack is carried on."""
    items = "".join(f"<li><b>{i}</b>" for i in range(3 * M._PASS))
    html = f"<main><p>{LONG}</p><ol>{items}</ol></main>"
    assert markdown(spark, html) == ["\n".join([LONG, "", *(f"{i + 1}. **{i}**" for i in range(3 * M._PASS))])]


def brute_run(blocks):
    """The best run of blocks by trying all: (chars outside and inside links, cost) per block."""
    own = [outside - inside for outside, inside, _ in blocks]

    def near(i):
        return max(-M.NEAR, min(M.NEAR, own[i])) if 0 <= i < len(own) else 0

    score = [4 * own[i] + near(i - 1) + near(i + 1) - blocks[i][2] for i in range(len(own))]
    runs = [(sum(score[i : j + 1]), -j, i) for j in range(len(own)) for i in range(j + 1)]
    best = max(runs, default=(0, 0, 0))
    return (best[2], -best[1], sum(sum(blocks[i][:2]) for i in range(best[2], -best[1] + 1))) if best[0] > 0 else None


def test_densest_run_matches_brute_force(spark):
    rng = random.Random(1)
    pages, want = [], []
    for _ in range(200):
        sizes = [(rng.choice([0, 5, 30, 50, 80, 300]), rng.choice([0, 0, 0, 20, 90])) for _ in range(rng.choice([0, 1, 4, 12]))]
        tags = [rng.choice(["p", "div", "li", "h2", "TR", "section"]) for _ in sizes]
        pages.append("".join(f"<{tag} class=x>{'x ' * a}</p> <A href='/y'>{'y ' * b}</a>" for tag, (a, b) in zip(tags, sizes)))
        # What stands before the first start tag is a block too.
        run = brute_run([(0, 0, M.COST), *((a, b, M.HEADING_COST if tag == "h2" else M.COST) for tag, (a, b) in zip(tags, sizes))])
        want.append(run)
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: r.run and (r.run["first"], r.run["last"], r.run["chars"]) for r in df.select("i", M.dense_run(F.col("html")).alias("run")).collect()}
    assert [got[i] for i in range(len(pages))] == want


def test_dense_text_without_article(spark):
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>menu entry {i}</a></li>" for i in range(20)) + "</ul></div>"
    text = f"<h2>Head line of the text</h2><p>{LONG}</p><p>{LONG}</p>"
    html = f"<body>{menu}<div>{text}</div><div>{menu}</div></body>"
    assert markdown(spark, html) == [f"## Head line of the text\n\n{LONG}\n\n{LONG}"]
    # Without a run that is long enough the whole body stays.
    assert markdown(spark, "<body><div>one</div><div>two</div></body>") == ["one\n\ntwo"]
    run = C.with_main_content(spark.createDataFrame([(html,), ("<p>x",), (None,)], "html string")).select("run").collect()
    assert [r.run is not None for r in run] == [True, False, False]
    assert re.sub(r"<[^>]*>", "", run[0].run["markup"]) == f"Head line of the text{LONG}{LONG}"
