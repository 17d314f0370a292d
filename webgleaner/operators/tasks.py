"""Background task status from task events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import running_totals

# Seconds a task is visible after its creation.
TASK_TTL_S = 600


def latest_status(events: DataFrame) -> DataFrame:
    """Last state per task: (task_id, status, result, query, created_at). Aggregates only.

    ``events``: task_id, ts, status (processing when created, done, error), result, query. Events of
    tasks that were never created do not count.
    """
    created = F.min(F.when(F.col("status") == "processing", F.col("ts")))
    return (
        events.groupBy("task_id")
        .agg(
            F.max(F.struct("ts", F.col("status") != "processing", "status", "result")).alias("last"),
            F.min(F.when(F.col("status") == "processing", F.struct("ts", "query"))).alias("first"),
            created.alias("created_at"),
        )
        .where(F.col("created_at").isNotNull())
        .select(
            "task_id",
            F.col("last.status").alias("status"),
            F.col("last.result").alias("result"),
            F.col("first.query").alias("query"),
            "created_at",
        )
    )


def task_status(asked: DataFrame, events: DataFrame, now: Column, ttl_s: int = TASK_TTL_S) -> DataFrame:
    """Answer per asked id: processing, done, error or not_found (unknown or expired)."""
    alive = latest_status(events).where(
        F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl_s))
    )
    joined = asked.join(alive, "task_id", "left")
    status = F.coalesce("status", F.lit("not_found"))
    return joined.select(
        "task_id",
        status.alias("status"),
        F.when(status != "not_found", F.col("query")).alias("query"),
        F.when(status == "done", F.col("result")).alias("result"),
        F.when(
            status == "error",
            F.when(F.coalesce("result", F.lit("")) == "", "Unknown error").otherwise(F.col("result")),
        ).alias("error"),
    )


def inflight(events: DataFrame) -> DataFrame:
    """Tasks still processing, one row."""
    return latest_status(events).agg(F.count_if(F.col("status") == "processing").alias("inflight"))


def time_bucket(rows: DataFrame, keys: list[str], most_rows: int = 500_000) -> Column:
    """Bucket number of ``ts``, as narrow as it takes for a bucket of one key to hold about ``most_rows`` rows: an hour at most.

    The width comes from the fullest hour, found by counts. It decides on the partitions only, not on the result.
    """
    hours = rows.groupBy(*keys, F.date_trunc("hour", "ts").alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    fullest = hours.agg(F.max("_n")).first()[0] or 1
    micros = max(1, min(3_600_000_000, 3_600_000_000 * most_rows // fullest))
    return F.floor(F.unix_micros("ts") / F.lit(micros))


def inflight_over_time(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Running number of open tasks after each start (+1) or end (-1), in time order.

    The running sum is taken per time bucket and carried over by bucket totals, so no task sorts everything.
    """
    steps = events.select(
        "task_id", "ts", F.when(F.col("status") == "processing", 1).otherwise(-1).alias("step")
    ).withColumn("_all", F.lit(0))
    totals = running_totals(
        steps,
        ["_all"],
        time_bucket(steps, []) if bucket is None else bucket,
        [F.col("ts"), F.desc("step"), F.col("task_id")],
        {"open_tasks": F.col("step")},
    )
    return totals.drop("_all")


def count_runs(calls: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Add the running number of successes and of failures (``nth``) per service in time order.

    The counts are taken per time bucket and carried over, so a busy service is spread over many tasks.
    """
    return running_totals(
        calls,
        ["service"],
        time_bucket(calls, ["service"]) if bucket is None else bucket,
        [F.col("ts"), F.col("call_id")],
        {"successes": F.when(F.col("ok"), 1).otherwise(0), "nth": F.when(F.col("ok"), 0).otherwise(1)},
    )


def failure_runs(calls: DataFrame, threshold: int = 5, bucket: Column | None = None) -> DataFrame:
    """Runs of consecutive failures per service that reach ``threshold``.

    ``calls``: service, ts, call_id, ok. Runs are numbered by the successes before them. Result:
    service, failures, started_at, tripped_at (the failure that reaches the threshold), ended_at.
    """
    failed = count_runs(calls, bucket).where(~F.col("ok"))
    runs = (
        failed.groupBy("service", "successes")
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.min("ts").alias("started_at"),
            F.max("ts").alias("ended_at"),
            (F.min("nth") + threshold - 1).alias("nth"),
        )
        .where(F.col("failures") >= threshold)
    )
    trips = failed.select("service", "nth", F.col("ts").alias("tripped_at"))
    return runs.join(trips, ["service", "nth"]).select(
        "service", "failures", "started_at", "tripped_at", "ended_at"
    )
