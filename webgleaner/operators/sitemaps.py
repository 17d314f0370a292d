"""Sitemaps: location, body decoding, URL sets and nested indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import decode_body
from ..functions.hosts import is_private_host, is_safe_url
from ..functions.python_workers import gunzip_series
from ..functions.text import is_blank, let, strip
from ..functions.urls import (
    absolute_parts,
    canonical_text,
    is_internal,
    normalize_url,
    path_allowed,
    resolve_url,
    same_site,
    split_url,
    url_host,
)
from ..session import materialize, work_folder
from .scale import spread_join

# The usual limits, for ``max_bytes`` and ``max_levels``.
MAX_SITEMAP_BYTES = 50 * 1024 * 1024
MAX_INDEX_DEPTH = 3

_ROOT = r"(?s)\A(?:\s|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>)*+<(?:[\w.\-]+:)?([\w.\-]+)"
_XML = "url ARRAY<STRUCT<loc STRING, lastmod STRING>>, sitemap ARRAY<STRUCT<loc STRING>>"


def robots_sitemap(body: Column) -> Column:
    """First ``Sitemap:`` directive of a robots.txt body, ``''`` when there is none."""
    return F.regexp_extract(body, r"(?i)(?<![^\r\n])\s*sitemap:\s*(\S+)", 1)


def root_tag(xml: Column) -> Column:
    """Name of the root element without prefix."""
    return F.regexp_extract(xml, _ROOT, 1)


def decoded_bodies(bodies: DataFrame) -> DataFrame:
    """Text of sitemap bodies: gzip by header or magic bytes, else UTF-8; broken gzip gives ``''``.

    Only the compressed rows go through Python workers.
    """
    zipped = F.contains(F.lower(F.coalesce("content_encoding", F.lit(""))), F.lit("gzip")) | (
        F.substring("body", 1, 2) == F.lit(b"\x1f\x8b")
    )
    rest = [c for c in bodies.columns if c != "body"]
    unpack = F.pandas_udf(gunzip_series, "binary")
    keyed = bodies.withColumn("_zipped", F.coalesce(zipped, F.lit(False)))
    plain = keyed.where(~F.col("_zipped")).select(*rest, decode_body(F.col("body")).alias("text"))
    packed = keyed.where(F.col("_zipped")).select(
        *rest, F.coalesce(decode_body(unpack("body")), F.lit("")).alias("text")
    )
    return plain.unionByName(packed)


def locate_sitemaps(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """(seed_id, base_url, sitemap_url): ``/sitemap.xml`` when it looks like one, else robots.txt.

    ``responses`` has url, status, content_type, text. A robots directive that leaves the site or
    names a private host counts as none.
    """
    parts = split_url(F.col("base_url"))
    origin = F.concat("_p.scheme", F.lit("://"), "_p.netloc")
    asked = seeds.select("seed_id", "base_url", parts.alias("_p")).select(
        "seed_id",
        "base_url",
        F.concat(origin, F.lit("/sitemap.xml")).alias("_map_url"),
        F.concat(origin, F.lit("/robots.txt")).alias("_robots_url"),
    )
    head = F.trim(F.col("text"), F.lit(" \t\r\n"))
    is_map = (F.col("status") == 200) & (
        F.contains(F.coalesce("content_type", F.lit("")), F.lit("xml")) | head.rlike(r"\A<(?:\?xml|urlset|sitemapindex)")
    )
    maps = responses.where(F.endswith("url", F.lit("/sitemap.xml")) & F.coalesce(is_map, F.lit(False))).select(
        F.col("url").alias("_map_url"), F.lit(True).alias("_has_map")
    )
    robots = responses.where(F.endswith("url", F.lit("/robots.txt")) & (F.col("status") == 200)).select(
        F.col("url").alias("_robots_url"), robots_sitemap(F.col("text")).alias("_directive")
    )
    # Many seeds may share a site: nothing stands on top of the joins, so that adaptive execution may split hot sites.
    joined = spread_join(spread_join(asked, maps, ["_map_url"], "left"), robots, ["_robots_url"], "left")
    usable = (
        (F.col("_directive") != "")
        & is_internal(F.col("_directive"), F.col("base_url"))
        & ~is_private_host(url_host(F.col("_directive")))
    )
    return joined.select(
        "seed_id",
        "base_url",
        F.when(F.col("_has_map"), F.col("_map_url")).when(usable, F.col("_directive")).alias("sitemap_url"),
    )


def parse_documents(bodies: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(url, root, urls, sitemaps, error) of each sitemap body; both arrays are empty for broken XML.

    Name-space prefixes are removed first; ``urls`` counts under ``urlset`` only and ``sitemaps``
    under ``sitemapindex`` only. With ``max_bytes`` a larger body is not parsed and ``error`` says so; by default bodies of any
    size are.
    """
    fits = F.lit(True) if max_bytes is None else F.octet_length("text") <= max_bytes
    text = F.regexp_replace(F.when(fits, F.col("text")), r"(</?)[\w.\-]+:", "$1")
    too_large = F.concat(F.lit("Sitemap too large ("), F.octet_length("text").cast("string"), F.lit(" bytes)"))
    parsed = bodies.select(
        "url", root_tag(F.col("text")).alias("root"), F.from_xml(text, F.lit(_XML)).alias("_x"), F.when(~fits, too_large).alias("error")
    )
    return parsed.select(
        "url",
        "root",
        F.when(F.col("root") == "urlset", F.col("_x.url")).alias("urls"),
        F.when(F.col("root") == "sitemapindex", F.col("_x.sitemap")).alias("sitemaps"),
        "error",
    )


def urlset_rows(
    documents: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_subdomains: bool = False,
    strip_query: bool = False,
) -> DataFrame:
    """Accepted ``<url>`` entries in document order, duplicates kept.

    ``documents`` has base_url and urls beside any key columns. Path filter and site test look at the
    resolved URL; the result shows its canonical form and the path as found.
    """
    keys = [c for c in documents.columns if c not in ("urls", "sitemaps", "root", "error")]

    def row(entry: Column, target: Column, pos: Column) -> Column:
        ok = path_allowed(target["path"], include, exclude) & same_site(
            target, F.col("_base"), include_subdomains
        )
        made = F.struct(
            pos.alias("pos"),
            canonical_text(target, strip_query).alias("url"),
            F.when(target["path"] == "", "/").otherwise(target["path"]).alias("path"),
            F.lit(0).alias("depth"),
            F.lit("sitemap").alias("source"),
            F.when(entry["lastmod"] != "", strip(entry["lastmod"])).alias("last_modified"),
        )
        return F.when(ok, made)

    def accepted(entry: Column, pos: Column) -> Column:
        loc = strip(entry["loc"])
        found = let(absolute_parts(F.col("_base"), loc), lambda target: row(entry, target, pos))
        return F.when(~is_blank(entry["loc"]), found)

    # Row-local: the base is split once per document, each entry once; rejected ones go before the explode.
    split = documents.select(*keys, "urls", split_url(F.col("base_url")).alias("_base"))
    rows = split.select(*keys, F.array_compact(F.transform("urls", accepted)).alias("_rows"))
    return rows.select(*keys, F.explode("_rows").alias("_r")).select(*keys, "_r.*").where(F.col("url") != "")


def read_sitemaps(
    located: DataFrame,
    bodies: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_subdomains: bool = False,
    strip_query: bool = False,
    folder: str | None = None,
    max_bytes: int | None = None,
    max_levels: int | None = None,
) -> DataFrame:
    """Entries of each seed's sitemap: the documents of ``sitemap_documents`` through ``urlset_rows``.

    Result: seed_id, base_url, trail, pos, url, path, depth, source, last_modified; the document order is (trail, pos).
    """
    folder = folder or work_folder(located.sparkSession, "sitemaps")
    bodies = materialize(bodies.select("url", "text"), f"{folder}/bodies")
    documents = sitemap_documents(located, bodies, folder, max_bytes, max_levels)
    return urlset_rows(documents, include, exclude, include_subdomains, strip_query)


def sitemap_documents(
    located: DataFrame, bodies: DataFrame, folder: str | None = None, max_bytes: int | None = None, max_levels: int | None = None
) -> DataFrame:
    """Documents of each seed's sitemap, nested indexes followed to the end (a document already read is not read again).

    ``located`` has seed_id, base_url, sitemap_url; ``bodies`` has url, text. Result: seed_id, base_url,
    trail (place of the document in the nesting), urls. A document listed twice is read once, at its first place. Each level parses only the
    bodies it lists, but reads ``bodies`` anew: they should be a written table. ``max_levels`` stops the nesting and ``max_bytes`` leaves larger bodies unparsed.
    """
    folder = folder or work_folder(located.sparkSession, "sitemaps")
    bodies = bodies.where(is_safe_url(F.col("url"))).select(F.col("url").alias("_doc"), "text")
    refs = located.where(F.col("sitemap_url").isNotNull()).select(
        "seed_id",
        "base_url",
        F.col("sitemap_url").alias("_ref"),
        normalize_url(F.col("sitemap_url")).alias("_key"),
        F.array().cast("array<int>").alias("trail"),
    )
    visits, documents = [], []
    while max_levels is None or len(visits) < max_levels:
        level = len(visits)
        first = refs.groupBy("seed_id", "_key").agg(F.min(F.struct("trail", "_ref", "base_url")).alias("f"))
        if visits:
            seen = located.sparkSession.read.schema(visit.schema).parquet(*visits).select("seed_id", "_key")
            first = first.join(seen, ["seed_id", "_key"], "left_anti")
        at_level = F.lit(level).alias("level")
        visit = materialize(first.select(at_level, "seed_id", "_key", "f.*"), f"{folder}/visit-{level}")
        if level > 0 and visit.isEmpty():
            break
        visits.append(f"{folder}/visit-{level}")
        listed_docs = visit.select(F.col("_ref").alias("_doc")).distinct()
        found = bodies.join(listed_docs, "_doc", "left_semi").withColumnRenamed("_doc", "url")
        parsed = materialize(parse_documents(found, max_bytes).select(at_level, "*"), f"{folder}/documents-{level}")
        documents.append(f"{folder}/documents-{level}")
        indexes = parsed.where(F.col("sitemaps").isNotNull()).select(F.col("url").alias("_ref"), "sitemaps")
        listed = spread_join(visit, indexes, ["_ref"]).select(
            "seed_id", "base_url", "trail", F.col("_ref").alias("_doc"), F.posexplode("sitemaps").alias("i", "s")
        )
        refs = (
            listed.where(F.col("s.loc") != "")
            .withColumn("_ref", resolve_url(F.col("_doc"), strip(F.col("s.loc"))))
            .select(
                "seed_id",
                "base_url",
                "_ref",
                normalize_url(F.col("_ref")).alias("_key"),
                F.array_append("trail", F.col("i")).alias("trail"),
            )
        )
    # A level's documents meet that level's visits. All levels are read as one table: what follows is planned once, not per level.
    spark = located.sparkSession
    lists = spark.read.schema(parsed.schema).parquet(*documents).where(F.col("urls").isNotNull()).select("level", F.col("url").alias("_ref"), "urls")
    all_visits = spark.read.schema(visit.schema).parquet(*visits)
    return spread_join(all_visits, lists, ["_ref", "level"]).select("seed_id", "base_url", "trail", "urls")
