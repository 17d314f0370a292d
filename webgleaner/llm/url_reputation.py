"""URL filter by rules and by an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. Each level is a beta-binomial:
a node's bad rate has a Beta prior whose mean is its parent's posterior mean and whose strength comes from the spread
of the level's nodes around their parents (method of moments). A host with few labels so leans on its domain, a domain
on its suffix, a suffix on the whole. A host is blocked when the lower bound of its posterior bad rate,
``mean - z * sd``, is above ``max_bad``; explicit rules go first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Second-level labels under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

# Strength of a prior, in labels, when a level shows no spread that could be measured, and its limits.
DEFAULT_SPREAD, LEAST_SPREAD, MOST_SPREAD = 0.1, 1e-4, 0.99


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """Host without user name, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?\.*$", "")


def host_suffix(name: Column) -> Column:
    """Last label, or the last two where names are registered under a second-level label; addresses are whole."""
    second = "|".join(SECOND_LEVEL)
    two = F.regexp_extract(name, rf"(?:^|\.)((?:{second})\.[a-z][a-z])$", 1)
    one = F.regexp_extract(name, r"([^.]*)$", 1)
    return F.when(_is_address(name), name).when(two != "", two).otherwise(one)


def registered_domain(name: Column, suffix: Column) -> Column:
    """The suffix and one label before it."""
    before = F.left(name, F.greatest(F.length(name) - F.length(suffix) - 1, F.lit(0)))
    label = F.regexp_extract(before, r"([^.]*)$", 1)
    return F.when(_is_address(name) | (label == ""), name).otherwise(F.concat_ws(".", label, suffix))


def _is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9.]+$") | name.contains(":")


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """One outcome per labelled id: ``page_id, bad``; bad is toxic or of quality 0. Rows without id or label are left out."""
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull())
    return labels.where(known).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))


def host_reputation(
    pages: DataFrame, outcomes: DataFrame, max_bad: float = 0.5, z: float = 1.645
) -> DataFrame:
    """One row per host: ``host, domain, suffix, n_labelled, n_bad, bad_rate, bad_low, blocked``.

    ``pages`` has ``page_id, host``; ``outcomes`` has one row per labelled page: ``page_id, bad``. Hosts without labels
    get their domain's prior. Without any label every rate is 0.5 and nothing is blocked. Only sums per host are shuffled.
    """
    known = outcomes.select(F.col("page_id").alias("_id"), F.col("bad").cast("int").alias("_bad"))
    rows = pages.select("page_id", "host").join(known, F.col("page_id") == F.col("_id"), "left")
    hosts = rows.groupBy("host").agg(
        F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("k")
    )
    name = bare_host(F.col("host"))
    hosts = hosts.withColumn("suffix", host_suffix(name))
    hosts = hosts.withColumn("domain", registered_domain(name, F.col("suffix")))
    whole = hosts.agg(
        ((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior")
    )
    by_domain = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = _posterior(by_suffix.withColumn("prior", whole.scalar()))
    parents = suffixes.select("suffix", F.col("rate").alias("prior"))
    domains = _posterior(by_domain.join(parents, "suffix"))
    parents = domains.select("domain", "suffix", F.col("rate").alias("prior"))
    scored = _posterior(hosts.join(parents, ["domain", "suffix"]))
    low = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return scored.select(
        "host",
        "domain",
        "suffix",
        F.col("n").alias("n_labelled"),
        F.col("k").alias("n_bad"),
        F.col("rate").alias("bad_rate"),
        F.greatest(low, F.lit(0.0)).alias("bad_low"),
        (low > max_bad).alias("blocked"),
    )


def _posterior(nodes: DataFrame) -> DataFrame:
    """Add ``strength`` and ``rate`` to nodes with ``n, k, prior`` (the parent's mean).

    With rho = 1 / (strength + 1), n * (k/n - prior)^2 is expected to be prior * (1 - prior) * (1 + (n - 1) * rho).
    """
    spread = F.col("prior") * (1 - F.col("prior"))
    off = F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("prior"), F.lit(2)) - spread)
    room = F.when(F.col("n") > 0, (F.col("n") - 1) * spread)
    level = nodes.agg(F.sum(off).alias("_off"), F.sum(room).alias("_room")).select(
        F.coalesce(
            F.when(F.col("_room") > 0, F.greatest(F.lit(LEAST_SPREAD), F.least(F.lit(MOST_SPREAD), F.col("_off") / F.col("_room")))),
            F.lit(DEFAULT_SPREAD),
        ).alias("_rho")
    )
    strength = (1 - F.col("_rho")) / F.col("_rho")
    return (
        nodes.withColumn("_rho", level.scalar())
        .withColumn("strength", strength)
        .withColumn("rate", (F.col("k") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))
        .drop("_rho")
    )


def rules_table(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    return pages.sparkSession.createDataFrame(
        [(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string"
    )


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: the rules whose host is the host or a parent of it, longest first."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts)))
    )
    names = hosts.select("host").where("host != ''").select("host", F.explode(suffixes).alias("rule_host"))
    text = F.concat("rule_host", "rule_path")
    entry = F.struct(F.length(text).alias("size"), text.alias("rule"), F.col("rule_path").alias("start"), "verdict")
    return (
        names.join(rules.dropDuplicates(["rule_host", "rule_path"]), "rule_host")
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(entry), asc=False).alias("rules"))
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame = (),
    max_bad: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """Verdict per row of ``pages`` (``page_id, url``).

    Returns ``page_id, host, path, rule, verdict, n_labelled, bad_rate, bad_low``, one row per input row. A rule fits its
    host and all subdomains if the path starts with the rule's path; the longest rule wins (of equally long ones the
    last in code point order). A null url or one without ``://`` has an empty host and path; its rows are one more host.
    Repeated rows stay. Extra columns are ignored. The rules of one host travel as an array: rule lists are
    configuration, while hosts and pages may grow without bound. Hot hosts are only summed (combined before the shuffle) and joined
    to a table of hosts, which Spark broadcasts while it is small and splits by skew otherwise.
    """
    urls = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    if not isinstance(rules, DataFrame):
        rules = rules_table(pages, rules)
    reputation = host_reputation(urls, outcomes, max_bad, z)
    known = reputation.join(rules_of_hosts(reputation, rules), "host", "left").select(
        F.col("host").alias("_host"), "rules", "n_labelled", "bad_rate", "bad_low", "blocked"
    )
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    return (
        urls.join(known, F.col("host") == F.col("_host"), "left")
        .withColumn("_rule", F.try_element_at(fitting, F.lit(1)))
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
            "n_labelled",
            "bad_rate",
            "bad_low",
        )
    )
