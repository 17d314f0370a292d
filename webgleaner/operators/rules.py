"""Rule tables against URL tables: domain rules, resolved addresses, whole-request gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import (
    MEDIA_DOMAINS,
    clean_domain,
    domain_allowed,
    host_suffixes,
    is_blocked_address,
    is_private_host,
    is_safe_url,
)
from ..functions.text import is_blank, strip
from ..functions.urls import url_host
from .scale import small_or_whole, spread_join


def merge_rule_tables(*tables: DataFrame, domain: str = "domain") -> DataFrame:
    """Union of rule tables: trimmed, lower case, blanks dropped, distinct."""
    merged = tables[0].select(domain)
    for table in tables[1:]:
        merged = merged.unionByName(table.select(domain))
    return (
        merged.where(~is_blank(F.col(domain)))
        .select(F.lower(strip(F.col(domain))).alias(domain))
        .distinct()
    )


def with_media_rules(rules: DataFrame, domain: str = "domain") -> DataFrame:
    """Block rules plus the fixed media sites."""
    media = rules.sparkSession.createDataFrame([(d,) for d in MEDIA_DOMAINS], f"{domain} string")
    return merge_rule_tables(rules, media, domain=domain)


def hosts_under(hosts: DataFrame, rules: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """Hosts equal to or below a rule domain.

    Each host is exploded into its suffixes, so the suffix test becomes an equi join.
    """
    keys = rules.select(clean_domain(F.col(domain)).alias("_suffix")).where("_suffix <> ''").distinct()
    suffixes = hosts.select(host).distinct().select(host, F.explode(host_suffixes(F.col(host))).alias("_suffix"))
    return suffixes.join(small_or_whole(keys), "_suffix", "left_semi").select(host).distinct()


def filter_by_rules(
    urls: DataFrame,
    url: str = "url",
    allow: DataFrame | None = None,
    block: DataFrame | None = None,
    domain: str = "domain",
) -> DataFrame:
    """Keep URLs whose host passes rule tables of any size: block wins, empty allow allows all.

    The rules meet the distinct hosts, not the URLs. The verdicts come back by host; hot hosts are
    split over several tasks.
    """
    keyed = urls.withColumn("_host", url_host(F.col(url))).where("_host <> ''")
    hosts = keyed.select(F.col("_host").alias("host")).distinct()
    verdicts = hosts
    if block is not None:
        verdicts = verdicts.join(hosts_under(hosts, block, domain=domain), "host", "left_anti")
    if allow is not None and not allow.where(~is_blank(F.col(domain))).isEmpty():
        verdicts = verdicts.join(hosts_under(hosts, allow, domain=domain), "host", "left_semi")
    verdicts = small_or_whole(verdicts.withColumnRenamed("host", "_host"))
    return spread_join(keyed, verdicts, ["_host"], "inner").select(*urls.columns)


def blocked_hosts(hosts: DataFrame, dns: DataFrame, host: str = "host", ip: str = "ip") -> DataFrame:
    """Every distinct host with ``blocked``: by name or literal address, or by any resolved address.

    ``dns`` holds one row per host and address. A host without addresses passes. Blocked ranges are
    range predicates on the address number, so there is no range join.
    """
    names = hosts.select(F.col(host)).distinct()
    bad = (
        dns.where(is_blocked_address(F.regexp_replace(F.col(ip), r"%.*\z", "")))
        .select(F.col(host), F.lit(True).alias("_resolved_bad"))
        .distinct()
    )
    literal = is_blocked_address(F.col(host)) | is_private_host(F.col(host))
    return names.join(bad, host, "left").select(
        host, (literal | F.coalesce(F.col("_resolved_bad"), F.lit(False))).alias("blocked")
    )


def safe_urls(urls: DataFrame, url: str = "url", dns: DataFrame | None = None) -> DataFrame:
    """Keep URLs that may be fetched; with ``dns`` hosts resolving to a blocked address go too."""
    kept = urls.where(is_safe_url(F.col(url)))
    if dns is None:
        return kept
    bad = (
        dns.where(is_blocked_address(F.regexp_replace(F.col("ip"), r"%.*\z", "")))
        .select(F.lower("host").alias("_host"))
        .distinct()
    )
    keyed = kept.withColumn("_host", url_host(F.col(url)))
    return spread_join(keyed, small_or_whole(bad), ["_host"], "left_anti").select(*urls.columns)


def request_gate(
    specs: DataFrame,
    ok: Column,
    request: str = "request_id",
) -> DataFrame:
    """One row per request: ``blocked_urls`` and ``accepted`` (no URL is blocked)."""
    return specs.groupBy(request).agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(~ok).alias("blocked_urls"),
        (F.count_if(~ok) == 0).alias("accepted"),
    )


def accepted_requests(
    specs: DataFrame,
    allow: Iterable[str] = (),
    block: Iterable[str] = (),
    request: str = "request_id",
    url: str = "url",
) -> DataFrame:
    """All-or-nothing gate: the specs of requests in which every URL is allowed and safe."""
    ok = domain_allowed(F.col(url), allow, block) & is_safe_url(F.col(url))
    rejected = specs.where(~ok).select(request).distinct()
    return specs.join(rejected, request, "left_anti")
