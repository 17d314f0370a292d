"""Mix sources to target weights by weighted sampling without replacement.

Efraimidis-Spirakis: a document with weight w gets the key -ln(u) / w; the documents with the smallest keys are a
weighted sample. Within a source the documents are taken in key order until the words reach the budget. Where the
budget exceeds the source, complete epochs over all documents come first and the key order decides on the last,
fractional one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, stage, word_count

# Documents per bucket of the key order, about; only one bucket per source is sorted.
BUCKET_ROWS = 20_000

# Sources are configuration: their totals are handled as one small table. More are refused, not dropped.
MAX_SOURCES = 100_000


def sampling_key(doc_id: Column, weight: Column, seed: int = 0) -> Column:
    """Exponential key with rate ``weight``; u in (0, 1) comes from an md5 of seed and id, so reruns agree."""
    text = F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def quality_weight(labels: DataFrame) -> DataFrame:
    """``doc_id, weight``: 2 for documents labelled good, 0.5 for bad; the highest label of an id counts."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("weight"))
    )


def source_targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Targets per source from ``source, source_size``: ``source, source_size, target``.

    Sources in code point order, null last, get ``weights`` in turn and share all words by them; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight until none is above. That is
    target = min(cap, level * weight) with one common level: with the sources sorted by cap / weight, the first ones
    that reach their cap are found by running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = totals.withColumn("_w", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = ranked.withColumn("_level", left / F.sum("_w").over(after))
    free = level.withColumn("_free", F.col("_level") * F.col("_w") < F.col("_cap"))
    common = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(everything)
    return free.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("_cap"), common["_level"] * F.col("_w")), F.col("_cap")).alias("target"),
    )


def mix(
    docs: DataFrame,
    labels: DataFrame | None = None,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Words each document contributes to the mix: ``doc_id, size, source_size, target, taken``, a row per input row.

    ``docs`` has ``doc_id, text, source``; null texts have size 0, a null source is a source of its own, repeated ids
    are separate rows with one key. Weights come from ``labels`` (``doc_id, quality``); documents without a label, or
    without an id, weigh 1. Whole documents are taken; the one at the boundary is taken if that brings the source
    nearer to its target, so a source misses its target by half a document at most. Ties in key go by id and size.

    The sums are taken per source and bucket of the key order first; only the bucket in which a source reaches its
    budget is sorted, so a hot source is never sorted whole.
    """
    rows = docs.select("doc_id", "source", word_count("text").alias("size"))
    if labels is None:
        rows = rows.withColumn("_weight", F.lit(1.0))
    else:
        known = quality_weight(labels).select(F.col("doc_id").alias("_id"), "weight")
        rows = rows.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
        rows = rows.withColumnRenamed("weight", "_weight").fillna({"_weight": 1.0})
    rows = stage(rows.withColumn("_key", sampling_key(F.col("doc_id"), F.col("_weight"), seed)), "mix-keys")
    n_rows = rows.count()
    # Keys are exponential with rates near 1: 1 - exp(-key) spreads them over (0, 1), so buckets get similar shares.
    buckets = max(1, n_rows // bucket_rows)
    rows = rows.withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key"))) * buckets).cast("long"))
    sums = stage(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    totals = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    if n_rows and totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = source_targets(totals, weights, most)
    # Complete epochs, and the words of the fractional one.
    size = F.col("source_size")
    targets = targets.withColumn("_epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    targets = stage(targets.withColumn("_part", F.col("target") - F.col("_epochs") * size), "mix-targets")
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        _same_source(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0))), targets)
        .where("_before + _sum >= _part and _part > 0")
        .groupBy("source")
        .agg(F.min(F.struct("_bucket", "_before")).alias("_edge"))
    )
    # One row per source, at most MAX_SOURCES: broadcast, so that a hot source's rows stay where they are.
    plan = F.broadcast(stage(_same_source(targets, edges), "mix-plan"))
    facts = _same_source(rows, plan).withColumns({"_at": F.col("_edge._bucket"), "_start": F.col("_edge._before")})
    whole = facts.where("_at is null or _bucket != _at").withColumn(
        "_more", F.coalesce((F.col("_bucket") < F.col("_at")).cast("int"), F.lit(0))
    )
    in_order = (
        Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    edge = facts.where("_bucket = _at").withColumn(
        "_done", F.col("_start") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    )
    # Taken while it brings the sum nearer to the budget: its middle lies before the budget.
    edge = edge.withColumn("_more", (F.col("_done") + F.col("size") / 2 <= F.col("_part")).cast("int")).drop("_done")
    return whole.unionByName(edge).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("_epochs") + F.col("_more"))).cast("long").alias("taken"),
        (F.col("_epochs") + F.col("_more")).cast("int").alias("copies"),
    )


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the source, null matching null."""
    others = [F.col(f"_r.{c}").alias(c) for c in right.columns if c != "source" and c not in left.columns]
    packed = right.select(F.col("source").alias("_source"), F.struct(*right.columns).alias("_r"))
    return left.join(packed, left["source"].eqNullSafe(packed["_source"]), "left").select(*left.columns, *others)


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The documents of the mix with their columns, a row for each time one is taken; rows with one id go together."""
    taken = mix(docs, labels, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    taken = lookup(stage(taken.where("_copies > 0"), "mix-taken"))
    whole = docs.select(F.struct("*").alias("_row"))
    repeated = whole.join(taken, F.col("_row.doc_id").eqNullSafe(F.col("_id"))).select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))
    )
    return repeated.select("_row.*")
