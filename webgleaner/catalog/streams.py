"""Streams over the given tables, run to the end of the data, results read back."""

from pyspark.sql import functions as F

from ..session import work_folder
from ..streaming import jobs as J
from .common import table
from .content import markdown_sql
from .links import NORM, _LINKS
from .reports import _CALL, _HISTORY, _SHOWN_SQL, _TASK, _TASK_SQL, _shown, ORACLES as _REPORTS

QUERIES, ORACLES = {}, {}


def _stream(spark, sf, name):
    """The table as a stream. It may be one file or a folder of them: a stream takes a single file by a pattern only."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.[p]arquet")


def _finish(query):
    query.awaitTermination()
    return query


def _paths(spark, label):
    folder = work_folder(spark, label)
    return f"{folder}/out", f"{folder}/state"


def t1_page_arrival(spark, sf):
    out, state = _paths(spark, "t1")
    made = J.page_stream(_stream(spark, sf, "pages"))
    made = made.select("page_id", "fetch_method", F.col("content_length_out").alias("content_length"), F.size("links").alias("links_found"))
    _finish(J.append_stream(made, out, state))
    return spark.read.parquet(out)


ORACLES["t1_page_arrival"] = f"""WITH {markdown_sql('pages')}, {_LINKS}, n AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1)
SELECT page_id, CASE WHEN length(md) >= 200 THEN 'httpx' ELSE 'playwright-failed' END AS fetch_method,
 CAST(CASE WHEN length(md) >= 200 THEN length(md) ELSE 0 END AS INTEGER) AS content_length,
 CAST(CASE WHEN length(md) >= 200 THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS links_found FROM md LEFT JOIN n USING (page_id)"""


def t2_new_urls(spark, sf):
    """Canonical URLs seen for the first time; every page arrives under three spellings."""
    out, state = _paths(spark, "t2")
    arrivals = _stream(spark, sf, "pages").selectExpr(
        "explode(array(url, concat(url, '#again'), upper(substr(url, 1, 4)) || substr(url, 5))) AS url",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(page_id % 60 AS INT), 0) AS ts",
    )
    _finish(J.append_stream(J.new_urls(arrivals).select("norm_url"), out, state))
    return spark.read.parquet(out)


ORACLES["t2_new_urls"] = f"SELECT DISTINCT {NORM} AS norm_url FROM pages"


def t3_task_states(spark, sf):
    out, state = _paths(spark, "t3")
    _finish(J.upsert_stream(J.task_states(_stream(spark, sf, "events").selectExpr(*_TASK)), out, state))
    last = J.merge_task_states(spark.read.parquet(out))
    return last.select("task_id", "status", F.coalesce("result", F.lit("~")).alias("result"), F.unix_micros("created_at").alias("created_us"))


ORACLES["t3_task_states"] = f"WITH {_TASK_SQL} SELECT task_id, status, result, epoch_us(created_at) AS created_us FROM l"


def t4_rate_windows(spark, sf):
    out, state = _paths(spark, "t4")
    requests = _stream(spark, sf, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "concat('c', user_id % 3) AS client")
    _finish(J.upsert_stream(J.rate_windows(requests, limit=1), out, state))
    last = J.latest_updates(spark.read.parquet(out), ["minute", "client"])
    return last.select(F.unix_micros("minute").alias("minute_us"), "client", "requests", "over_limit")


ORACLES["t4_rate_windows"] = """SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, concat('c', user_id % 3) AS client, count(*) AS requests,
 greatest(count(*) - 1, 0) AS over_limit FROM events GROUP BY 1, 2"""


def t5_counter_windows(spark, sf):
    out, state = _paths(spark, "t5")
    rows = _stream(spark, sf, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS status", "value AS duration_s")
    _finish(J.upsert_stream(J.counter_windows(rows, ["status"]), out, state))
    last = J.latest_updates(spark.read.parquet(out), ["window_start", "status"])
    return last.select(F.unix_micros("window_start").alias("hour_us"), "status", "total", F.round("duration_sum", 2).alias("duration_sum"))


ORACLES["t5_counter_windows"] = """SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type AS status, count(*) AS total, round(sum(value), 2) AS duration_sum FROM events GROUP BY 1, 2"""


def t6_failure_alerts(spark, sf):
    out, state = _paths(spark, "t6")
    _finish(J.failure_alerts(_stream(spark, sf, "events").selectExpr(*_CALL), out, state))
    return spark.read.parquet(f"{out}/alerts").select("service", F.unix_micros("tripped_at").alias("tripped_us"))


ORACLES["t6_failure_alerts"] = f"SELECT service, tripped_at AS tripped_us FROM ({_REPORTS['w4_failure_runs']})"


def t7_history_append(spark, sf):
    out, state = _paths(spark, "t7")
    _finish(J.history_stream(_stream(spark, sf, "events").selectExpr(*_HISTORY), out, state))
    return _shown(spark.read.parquet(out))


ORACLES["t7_history_append"] = _SHOWN_SQL

for _f in (t1_page_arrival, t2_new_urls, t3_task_states, t4_rate_windows, t5_counter_windows, t6_failure_alerts, t7_history_append):
    QUERIES[_f.__name__] = _f
