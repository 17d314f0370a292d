"""Rules that differ by request: domain and path rules as one table, met by equi joins on (request, host suffix) and on request.

A rule is a row (request_id, kind, value); kinds are ``allow``, ``block`` (domains), ``include``, ``exclude`` (path patterns).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import clean_domain, host_suffixes
from ..functions.text import is_blank
from ..functions.urls import split_url, url_host
from .scale import small_or_whole, spread_join

# Request fields with rules and their kinds.
RULE_FIELDS = {"allow_domains": "allow", "block_domains": "block", "include_paths": "include", "exclude_paths": "exclude"}


def request_rules(checked: DataFrame, request: str = "request_id", doc: str = "doc") -> DataFrame:
    """Rule rows of requests given as VARIANT documents (see ``check_requests``); blank entries are no rules."""

    def listed(field: str, kind: str) -> Column:
        values = F.try_variant_get(F.col(doc), f"$.{field}", "array<string>")
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    lists = F.array(*(listed(field, kind) for field, kind in RULE_FIELDS.items()))
    rows = checked.select(F.col(request).alias("request_id"), F.explode(F.flatten(lists)).alias("rule"))
    return rows.select("request_id", "rule.kind", "rule.value").where(~is_blank(F.col("value"))).distinct()


def longest_literal(pattern: str) -> str:
    """A text that stands in everything the pattern matches, as long as it is easy to see; empty where it is not."""
    if re.search(r"[|()\[\]{}\\]", pattern):
        return ""
    # A character before a quantifier that allows none need not occur.
    return max(re.split(r"[.^$+]|.?[*?]", pattern), key=len)


def _patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch["value"].to_pylist()
        usable = []
        for value in values:
            try:
                re.compile(value)
                usable.append(True)
            except (re.error, OverflowError):
                usable.append(False)
        literals = [longest_literal(v) if ok else "" for v, ok in zip(values, usable)]
        yield pa.RecordBatch.from_arrays([batch["value"], pa.array(usable), pa.array(literals)], names=["value", "usable", "literal"])


def compiled_patterns(rules: DataFrame) -> DataFrame:
    """Distinct path patterns with ``usable`` (it is a pattern) and ``literal``, which must occur for it to match."""
    values = rules.where(F.col("kind").isin("include", "exclude")).select("value").distinct()
    return values.mapInArrow(_patterns, "value string, usable boolean, literal string")


def _domain_verdicts(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, host) of ``pairs`` that the domain rules reject."""
    domains = rules.where(F.col("kind").isin("allow", "block"))
    domains = domains.select("request_id", "kind", clean_domain(F.col("value")).alias("suffix")).where("suffix <> ''").distinct()
    domains = small_or_whole(domains)
    limited = domains.where("kind = 'allow'").select("request_id").distinct().withColumn("limited", F.lit(True))
    hosts = pairs.select("request_id", "host").distinct()
    met = hosts.select("request_id", "host", F.explode(host_suffixes(F.col("host"))).alias("suffix")).join(domains, ["request_id", "suffix"])
    met = met.groupBy("request_id", "host").agg(
        F.bool_or(F.col("kind") == "block").alias("blocked"), F.bool_or(F.col("kind") == "allow").alias("allowed")
    )
    joined = hosts.join(limited, "request_id", "left").join(met, ["request_id", "host"], "left")
    bad = F.coalesce("blocked", F.lit(False)) | (F.coalesce("limited", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)))
    return joined.where(bad).select("request_id", "host")


def _path_verdicts(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, path) of ``pairs`` that the path rules reject: an exclude pattern matches, or there are include patterns and none does.

    Each pattern is tried on each distinct path of its request that holds its literal; unusable patterns never match.
    """
    patterns = rules.where(F.col("kind").isin("include", "exclude")).select("request_id", "kind", "value").distinct()
    patterns = small_or_whole(patterns.join(small_or_whole(compiled_patterns(rules)), "value"))
    paths = pairs.select("request_id", "path").distinct()
    tried = paths.join(patterns, "request_id")
    hit = F.when(F.col("usable") & F.contains("path", F.col("literal")), F.rlike("path", F.col("value"))).otherwise(False)
    met = tried.groupBy("request_id", "path").agg(
        F.bool_or(hit & (F.col("kind") == "exclude")).alias("banned"),
        F.bool_or(hit & (F.col("kind") == "include")).alias("wanted"),
        F.bool_or(F.col("kind") == "include").alias("limited"),
    )
    return met.where(F.col("banned") | (F.col("limited") & ~F.col("wanted"))).select("request_id", "path")


def filter_by_request_rules(
    urls: DataFrame,
    rules: DataFrame,
    request: str = "request_id",
    url: str = "url",
    domains: bool = True,
    paths: bool = True,
) -> DataFrame:
    """Rows of ``urls`` that the rules of their request let pass; a request without rules of a kind passes.

    Domains: block wins, a request with allow rules needs one of them, a URL without host is rejected. Paths: see ``path_allowed``, per request.
    Rows keep their columns, repeated rows stay, rows without a request pass like those of a request without rules. The rules meet the
    distinct hosts and paths of each request, not the rows.
    """
    keyed = urls.withColumn("_host", url_host(F.col(url))).withColumn("_path", F.coalesce(split_url(F.col(url))["path"], F.lit("")))
    pairs = keyed.where(F.col(request).isNotNull()).select(
        F.col(request).alias("request_id"), F.col("_host").alias("host"), F.col("_path").alias("path")
    )
    kept = keyed
    if domains:
        kept = kept.where("_host <> ''")
        bad = _domain_verdicts(pairs.where("host <> ''"), rules).select(F.col("request_id").alias(request), F.col("host").alias("_host"))
        kept = spread_join(kept, small_or_whole(bad), [request, "_host"], "left_anti")
    if paths:
        bad = _path_verdicts(pairs, rules).select(F.col("request_id").alias(request), F.col("path").alias("_path"))
        kept = spread_join(kept, small_or_whole(bad), [request, "_path"], "left_anti")
    return kept.select(*urls.columns)

