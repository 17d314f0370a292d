"""Connected components of links between 64-bit ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them: the larger ones, or the smaller ones and the node itself."""
    if small:
        sided = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        sided = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    lowest = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = sided.join(lowest, "u")
    if small:
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(lowest.select("u", "m"))
    else:
        moved = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, root`` for every id in ``links`` (``a, b``); the root is the smallest id of the component.

    Each round is written to the shared folder. Only minima and links are shuffled; a node with very many links is
    an ordinary join key, which Spark splits when it is skewed. No group is gathered. No links: no rows.
    """
    links = stage(links.where("a != b").select("a", "b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        links = stage(_stars(_stars(links, small=False), small=True), "links")
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if now == seen:
            return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct()
            )
        seen = now
    raise RuntimeError("components did not settle")
