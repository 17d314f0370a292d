"""The tag pass in Python workers gives the Markdown of the native one."""

import random

from pyspark.sql import functions as F

from webgleaner.catalog import all_queries
from webgleaner.functions import content as C
from webgleaner.functions import markdown_pass as P
from webgleaner.functions import markup as M

TEXTS = [
    "word", " ", "\n", "a  b", "x|y", "tab\there", "\r\n", "\xa0", "\xa0 \xa0", "&amp;", "&lt;b&gt;", "&nbsp;", "&#65;", "&#x1F600;", "&#0;", "&#xD800;", "&#65279;",
    "&nope;", "&amp;lt;", "&NotEqualTilde;", "&#9999999;", "<", "< 5", "a<b", "é\U0001f600", " ", "\f", "*", "`", "long text of some words here. " * 3,
]
OTHERS = [
    "<a href='/x'>", '<a class="k" href="/y z">', "<a href=/q>", "<a>", "<A HREF=\n'/up\n'>", "<LI>", "<Td class=x>", "<h1x>", "<span>", "</span>", "<img src=x/>", "</ x>", "<!doctype x>",
    "<?php x ?>", "<br/>", "<hr />", "<p\nclass='a>b'>", "<é>", "<h2 id=1>", "</H2>", "<kbd>", "<" + "div " + "x" * 80 + ">",
]


def pages(count):
    rng, tags = random.Random(21), [f"<{n}>" for n in M._TAGS]
    nested = [t for t in tags if t.strip("</>") in ("ul", "ol", "li", "table", "tr", "td", "th", "pre", "code", "b", "a", "i")]
    out = [None, "", "<p>", "</td></tr></table></ul></pre>", "plain", "\x01\x03<p>control\x06s"]
    for size in (rng.randrange(1, 120) for _ in range(count)):
        of = rng.choice([tags, nested, nested + OTHERS, tags + OTHERS])
        body = "".join(rng.choice(TEXTS) if rng.random() < 0.45 else rng.choice(of) for _ in range(size))
        out.append(f"<main>{'Enough text for the main element of a page, in any case. ' * rng.randrange(2)}{body}</main>")
    return out


def test_both_passes_give_the_same(spark):
    df = spark.createDataFrame(list(enumerate(pages(1500))), "id int, html string")
    native = C.with_markdown(df).select("id", F.col("markdown").alias("native"))
    both = C.with_markdown(df, in_python=True).join(native, "id").collect()
    assert len(both) == 1506 and sum(len(r.native) > 20 for r in both) > 1000
    assert [(r.html, r.native, r.markdown) for r in both if r.native != r.markdown] == []


def test_forgotten_moves_change_nothing(monkeypatch):
    texts = [p for p in pages(200) if p]
    whole = [*map(P.converter(), texts)]
    monkeypatch.setattr(P, "MOST_MOVES", 3)
    assert [*map(P.converter(), texts)] == whole


def test_orders_are_dealt_once_and_converted_by_workers(spark):
    plan = all_queries()["c1_nested_markdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "markdown_arrays" in plan
