"""Helpers that keep joins and ordered computations balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, work_folder

def small_or_whole(df: DataFrame) -> DataFrame:
    """``df`` written once: Spark then knows its size and broadcasts it up to ``spark.sql.autoBroadcastJoinThreshold``.

    Beyond that the join is a shuffle join. Nothing is counted and nothing passes through one task.
    """
    return materialize(df, work_folder(df.sparkSession, "lookup"))


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join whose hot left keys may be split over several tasks.

    A small side of known size (see ``small_or_whole``) is broadcast: the other rows stay where they are. Otherwise both sides are shuffled
    on the key alone and nothing is put on top of the join, so that adaptive execution splits partitions in which a hot key
    lies (``configure`` switches that on). All rows are kept.
    """
    return left.join(right, list(on), how)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Running sums per key in the given order, computed bucket by bucket.

    ``bucket`` must not decrease along ``order``. Sums inside a bucket are window sums; the totals of
    the earlier buckets are added from a table with one row per key and bucket. No task sees more
    than one bucket of a key, or more than the bucket totals of a key.
    """
    keys = list(keys)
    # Needed twice, for the rows and for the bucket totals: written once.
    parts = materialize(df.withColumn("_bucket", bucket), work_folder(df.sparkSession, "buckets"))
    inner = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = parts.select(
        "*", *(F.sum(value).over(inner).alias(f"_in_{name}") for name, value in totals.items())
    )
    sizes = parts.groupBy(*keys, "_bucket").agg(
        *(F.sum(value).alias(f"_sum_{name}") for name, value in totals.items())
    )
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *keys,
        "_bucket",
        *(
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
            for name in totals
        ),
    )
    same = [local[k].eqNullSafe(offsets[k]) for k in [*keys, "_bucket"]]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    joined = local.join(offsets, condition, "left")
    return joined.select(
        *(local[c] for c in df.columns),
        *((F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(name) for name in totals),
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str,
    at_most: int | None = None,
) -> DataFrame:
    """1-based row number per key in the given order, by bucket; with ``at_most`` only the first rows stay."""
    numbered = running_totals(df, keys, bucket, order, {name: F.lit(1)})
    return numbered if at_most is None else numbered.where(F.col(name) <= at_most)


def first_buckets(rows: DataFrame, keys: Sequence[str], bucket: Column, limit: Column, path: str) -> DataFrame:
    """Where the first ``limit`` rows per key lie: (keys, bucket, before, total), one row per bucket, written to ``path``.

    A histogram of the order: ``bucket`` must not decrease along it. ``before`` is the number of rows in earlier buckets, ``total`` that of
    the key. Buckets that start at or beyond the limit are left out, so whoever reads only the buckets listed reads the limit and one
    bucket at most. ``limit`` is the same for all rows of a key. Only counts are shuffled and written.
    """
    placed = rows.select(*keys, bucket.alias("bucket"), limit.alias("_limit"))
    counts = placed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("_rows"), F.max("_limit").alias("_limit"))
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.select(
        *keys,
        "bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("before"),
        F.sum("_rows").over(of_key).alias("total"),
        "_limit",
    )
    return materialize(found.where(F.col("before") < F.col("_limit")).drop("_limit"), path)
