"""Page arrival, seen URLs, task state, rate windows, counters, failure runs, history.

Aggregates leave out rows behind their watermark; failure alerts write late rows to a table of their own.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import normalize_url
from ..operators.fetching import scrape
from ..operators.history import history_rows
from ..operators.links import with_links
from ..operators.tasks import TASK_TTL_S, count_runs
from ..session import materialize, work_folder


def page_stream(pages: DataFrame) -> DataFrame:
    """Arriving pages with content and links. Stateless."""
    made = scrape(pages, keep_html=True)
    return with_links(made, "raw_html", "url").drop("raw_html")


def new_urls(urls: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First sight of each canonical URL; the state is dropped after the watermark delay."""
    keyed = urls.withColumn("norm_url", normalize_url(F.col("url"))).where("norm_url <> ''")
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["norm_url"])


def task_states(events: DataFrame, delay: str = f"{TASK_TTL_S} seconds") -> DataFrame:
    """Last state per task and day, by aggregates; ``merge_task_states`` joins the days.

    Grouping by day as well lets the state of a task go once the watermark has passed its day.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("task_id", F.window("ts", "1 day").alias("day"))
        .agg(
            F.max("ts").alias("last_ts"),
            F.max_by(F.struct("status", "result"), F.col("ts")).alias("last"),
            F.min(F.when(F.col("status") == "processing", F.col("ts"))).alias("created_at"),
        )
        .select("task_id", F.col("day.start").alias("day"), "last_ts", "last.status", "last.result", "created_at")
    )


def merge_task_states(updates: DataFrame, now: Column | None = None, ttl_s: int = TASK_TTL_S) -> DataFrame:
    """(task_id, status, result, created_at) from the updates of ``task_states``; never created tasks go.

    With ``now`` tasks created more than ``ttl_s`` seconds before it are expired and go too.
    """
    days = latest_updates(updates, ["task_id", "day"])
    merged = days.groupBy("task_id").agg(
        F.max_by(F.struct("status", "result"), F.col("last_ts")).alias("last"), F.min("created_at").alias("created_at")
    )
    if now is not None:
        merged = merged.where(F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl_s)))
    return merged.where("created_at IS NOT NULL").select("task_id", "last.status", "last.result", "created_at")


def rate_windows(requests: DataFrame, limit: int = 30, delay: str = "1 minute") -> DataFrame:
    """Requests per client and minute, and how many exceed the limit."""
    counted = (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 minute"), "client")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return counted.select(
        F.col("window.start").alias("minute"),
        "client",
        "requests",
        F.greatest(F.col("requests") - limit, F.lit(0)).alias("over_limit"),
    )


def counter_windows(rows: DataFrame, labels: list[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and duration sums per label combination and time window."""
    counted = (
        rows.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), *labels)
        .agg(F.count(F.lit(1)).alias("total"), F.sum("duration_s").alias("duration_sum"))
    )
    return counted.select(F.col("window.start").alias("window_start"), *labels, "total", "duration_sum")


def failure_alerts(
    calls: DataFrame, path: str, checkpoint: str, threshold: int = 5, once: bool = True
) -> StreamingQuery:
    """Write one alert each time a service reaches ``threshold`` failures in a row.

    ``calls``: service, ts, call_id, ok. Inside a micro-batch the runs are counted with running totals,
    spread over time buckets; between batches a small table carries the open run and the last time per service. A row
    that is older than its service's last time comes too late to change a reported run: it is written under ``late``
    and not counted. All outputs are written per batch number, so a repeated batch replaces its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        carried = _carried_runs(batch, path, batch_id)
        # Written once: several outputs are made from it.
        rows = materialize(batch, work_folder(spark, "calls"))
        timed = rows.join(carried.select("service", "last_ts"), "service", "left").withColumn(
            "_late", F.coalesce(F.col("ts") < F.col("last_ts"), F.lit(False))
        )
        timed.where("_late").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        counted = materialize(count_runs(timed.where("not _late").select(*batch.columns)), work_folder(spark, "runs"))
        failed = counted.where(~F.col("ok"))
        runs = failed.groupBy("service", "successes").agg(
            F.count(F.lit(1)).alias("failures"), F.min("nth").alias("first_nth")
        )
        # The first run of the batch continues the carried one.
        before = F.when(F.col("successes") == 0, F.coalesce("open_failures", F.lit(0))).otherwise(0)
        runs = runs.join(carried.select("service", "open_failures"), "service", "left").withColumn("before", before)
        tripping = runs.where(
            (F.col("before") < threshold) & (F.col("before") + F.col("failures") >= threshold)
        ).select("service", (F.col("first_nth") + threshold - 1 - F.col("before")).alias("nth"))
        alerts = failed.join(tripping, ["service", "nth"]).select(
            "service", F.col("ts").alias("tripped_at"), F.lit(threshold).alias("failures")
        )
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")
        ends = counted.groupBy("service").agg(F.max("successes").alias("successes"), F.max("ts").alias("last_ts"))
        tails = ends.join(runs, ["service", "successes"], "left").select(
            "service", (F.coalesce("before", F.lit(0)) + F.coalesce("failures", F.lit(0))).alias("open_failures"), "last_ts"
        )
        quiet = carried.join(ends, "service", "left_anti")
        tails.unionByName(quiet).write.mode("overwrite").parquet(f"{path}/open/batch_id={batch_id}")

    writer = calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _carried_runs(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    spark = batch.sparkSession
    schema = "service string, open_failures bigint, last_ts timestamp"
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/open/batch_id={batch_id - 1}")


def append_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet, exactly once."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()


def history_stream(entries: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append history rows as they arrive, partitioned by kind and day."""
    writer = (
        history_rows(entries)
        .writeStream.format("parquet")
        .partitionBy("kind", "dt")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write every update of an aggregating stream with its batch number.

    A batch that runs again replaces its own folder. ``latest_updates`` reads the result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key of a table written by ``upsert_stream``."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("v"))
    return newest.select(*keys, "v.*")
