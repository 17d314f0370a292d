"""History, task status, counters, logs over ``events`` and ``orders``."""

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import metrics as M
from ..operators import tasks as K
from ..session import work_folder
from ..sources.readers import hit_titles, parse_log_lines, search_hits
from .common import table

QUERIES, ORACLES = {}, {}

_KIND = "CASE event_id % 4 WHEN 0 THEN 'research' WHEN 1 THEN 'crawl' WHEN 2 THEN 'map' ELSE 'extract' END"
_HISTORY = (
    "concat('task-', event_id) AS id",
    f"{_KIND} AS kind",
    "CASE WHEN event_id % 50 = 0 THEN repeat('q', 3000) ELSE concat('query ', user_id) END AS query_or_url",
    "CASE event_id % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{\"max_results\":5}' END AS params",
    "CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status",
    "CASE event_id % 3 WHEN 0 THEN concat('{\"total_results\":', event_id, ',\"results\":[1,2,3],\"ai_summary\":\"S\"}') WHEN 1 THEN '[1,2]' ELSE 'plain' END AS result",
    "CAST(event_id % 30 AS INT) AS result_size",
    "CASE WHEN event_type = 'error' THEN 'boom' END AS error",
    "CAST(ts AS TIMESTAMP) AS created_at",
)
_RESULT_SQL = """CASE event_id % 3 WHEN 0 THEN concat('{"ai_summary":"S","total_results":', event_id, '}') WHEN 1 THEN '[1,2]' ELSE 'plain' END"""


def _history(spark, sf):
    """The events as history entries, written to and read back from the partitioned table."""
    path = work_folder(spark, "history")
    H.append_history(table(spark, sf, "events").selectExpr(*_HISTORY), path)
    return H.read_history(spark, path)


def _shown(df):
    return df.select(
        "id", "kind", F.md5("query_or_url").alias("query_md5"), F.coalesce("params", F.lit("")).alias("params"), "status", "result", "result_size",
        F.coalesce("error", F.lit("")).alias("error"), F.unix_micros("created_at").alias("created_us"),
    )


_SHOWN_SQL = f"""SELECT concat('task-', event_id) AS id, {_KIND} AS kind,
 md5(CASE WHEN event_id % 50 = 0 THEN repeat('q', 3000) ELSE concat('query ', user_id) END) AS query_md5,
 CASE WHEN event_id % 3 = 1 THEN '{{"max_results":5}}' ELSE '' END AS params, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
 {_RESULT_SQL} AS result, CAST(event_id % 30 AS INTEGER) AS result_size, CASE WHEN event_type = 'error' THEN 'boom' ELSE '' END AS error,
 epoch_us(ts) AS created_us FROM events"""


def s8_history_append(spark, sf):
    return _shown(_history(spark, sf))


ORACLES["s8_history_append"] = _SHOWN_SQL


def s9_history_get(spark, sf):
    """Point reads of one entry, with its JSON opened."""
    entry = H.get_entry(_history(spark, sf), "task-42")
    return entry.select("id", "status", F.try_variant_get("result_json", "$.total_results", "int").alias("total_results"), F.col("params_json").isNull().alias("no_params"))


ORACLES["s9_history_get"] = """SELECT concat('task-', event_id) AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
 CAST(event_id AS INTEGER) AS total_results, true AS no_params FROM events WHERE event_id = 42"""


def s10_history_list(spark, sf):
    return _shown(H.list_entries(_history(spark, sf), "crawl", limit=500, offset=10))


ORACLES["s10_history_list"] = f"SELECT * FROM ({_SHOWN_SQL}) WHERE kind = 'crawl' ORDER BY created_us DESC, id LIMIT 200 OFFSET 10"


def k1_newest_entries(spark, sf):
    return _shown(H.list_entries(_history(spark, sf), None, limit=0, offset=-5)).unionByName(_shown(H.list_entries(_history(spark, sf), "map")))


ORACLES["k1_newest_entries"] = f"""(SELECT * FROM ({_SHOWN_SQL}) ORDER BY created_us DESC, id LIMIT 1)
 UNION ALL (SELECT * FROM ({_SHOWN_SQL}) WHERE kind = 'map' ORDER BY created_us DESC, id LIMIT 50)"""


def r5_history_query(spark, sf):
    """Entries and stored sizes per kind and status."""
    return _history(spark, sf).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("entries"), F.sum("result_size").alias("results"))


ORACLES["r5_history_query"] = f"SELECT kind, status, count(*) AS entries, CAST(sum(result_size) AS BIGINT) AS results FROM ({_SHOWN_SQL}) GROUP BY 1, 2"


def s11_history_purge(spark, sf):
    """Rows kept and removed when entries older than 12 days go."""
    history = _history(spark, sf)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    staged = work_folder(spark, "history-kept")
    removed = H.purge(history, 12, staged, now)
    kept = H.read_history(spark, staged)
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("kept")).withColumn("removed_in_all", F.lit(removed).cast("bigint"))


ORACLES["s11_history_purge"] = f"""WITH h AS (SELECT {_KIND} AS kind, ts >= TIMESTAMP '2024-01-19' AS keep FROM events)
SELECT kind, count(*) FILTER (keep) AS kept, (SELECT count(*) FROM h WHERE NOT keep) AS removed_in_all FROM h GROUP BY 1 HAVING count(*) FILTER (keep) > 0"""

_LINE = """CASE WHEN event_type = 'error' THEN concat('Traceback ', event_id) ELSE to_json(named_struct('timestamp', CAST(ts AS TIMESTAMP), 'level', 'INFO', 'message', event_type,
 'line', event_id, 'duration_ms', CAST(value * 1000 AS BIGINT), 'query', CASE WHEN event_id % 2 = 0 THEN concat('q', user_id) END)) END"""


def s13_log_ingest(spark, sf):
    lines = table(spark, sf, "events").selectExpr(f"{_LINE} AS value")
    parsed = parse_log_lines(lines)
    return parsed.select(
        F.coalesce("level", F.lit("?")).alias("level"), F.coalesce("message", "_corrupt_record").alias("message"), F.coalesce("line", F.lit(-1)).alias("line"),
        F.coalesce("query", F.lit("")).alias("query"),
    )


ORACLES["s13_log_ingest"] = """SELECT CASE WHEN event_type = 'error' THEN '?' ELSE 'INFO' END AS level,
 CASE WHEN event_type = 'error' THEN concat('Traceback ', event_id) ELSE event_type END AS message,
 CAST(CASE WHEN event_type = 'error' THEN -1 ELSE event_id END AS INTEGER) AS line,
 CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN concat('q', user_id) ELSE '' END AS query FROM events"""

_METHOD = "CASE event_type WHEN 'click' THEN 'httpx' WHEN 'view' THEN 'playwright' WHEN 'error' THEN 'playwright-failed' WHEN 'signup' THEN 'pdf' ELSE 'pdf-failed' END"


def a1_scrape_counter(spark, sf):
    return M.scrape_counter(table(spark, sf, "events").selectExpr(f"{_METHOD} AS fetch_method"))


ORACLES["a1_scrape_counter"] = f"""SELECT {_METHOD} AS fetch_method, CASE WHEN event_type IN ('error', 'purchase') THEN 'failure' ELSE 'success' END AS status,
 count(*) AS total FROM events GROUP BY 1, 2"""


def a2_duration_histogram(spark, sf):
    df = table(spark, sf, "events").selectExpr(f"{_METHOD} AS fetch_method", "value AS duration_s")
    out = None
    for stage, bounds in M.BUCKETS.items():
        part = M.histogram(df, "duration_s", bounds, ["fetch_method"]).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("duration_sum", F.round("duration_sum", 2))


def _histogram_sql(stage, bounds):
    cells = " UNION ALL ".join(
        [f"SELECT fetch_method, '{b:g}' AS le, count(*) FILTER (d <= {b}) AS bucket_count, count(*) AS observations, round(sum(d), 2) AS duration_sum, '{stage}' AS stage FROM e GROUP BY 1" for b in bounds]
        + [f"SELECT fetch_method, '+Inf', count(*), count(*), round(sum(d), 2), '{stage}' FROM e GROUP BY 1"]
    )
    return cells


ORACLES["a2_duration_histogram"] = f"""WITH e AS (SELECT {_METHOD} AS fetch_method, value AS d FROM events) {' UNION ALL '.join(_histogram_sql(s, b) for s, b in M.BUCKETS.items())}"""


def a3_tier_fallbacks(spark, sf):
    return M.tier_fallbacks(table(spark, sf, "events").selectExpr("event_type IN ('view', 'error') AND event_id % 2 = 0 AS fell_back"))


ORACLES["a3_tier_fallbacks"] = "SELECT count(*) FILTER (event_type IN ('view', 'error') AND event_id % 2 = 0) AS fallbacks FROM events"

_SEARCH = (
    "o_orderkey AS request_id",
    "concat('q', o_custkey) AS query",
    "CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'success' END AS status",
    """CASE WHEN o_orderstatus <> 'F' THEN transform(sequence(1, CAST(o_orderkey % 9 + 1 AS INT)), i -> named_struct('url', concat('https://r', i, '.example.com/', o_orderkey),
 'title', CASE WHEN i % 2 = 0 THEN concat('T', i) END, 'content', CAST(NULL AS STRING))) END AS results""",
)


def s2_search_hits(spark, sf):
    df = table(spark, sf, "orders").selectExpr(*_SEARCH)
    return search_hits(df, 5).select("request_id", "query", "rank", "url", "title", "content")


ORACLES["s2_search_hits"] = """SELECT o_orderkey AS request_id, concat('q', o_custkey) AS query, CAST(i AS INTEGER) AS rank, concat('https://r', i, '.example.com/', o_orderkey) AS url,
 CASE WHEN i % 2 = 0 THEN concat('T', i) ELSE '' END AS title, '' AS content FROM orders, generate_series(1, 5) t(i) WHERE o_orderstatus <> 'F' AND i <= o_orderkey % 9 + 1"""


def a4_search_counters(spark, sf):
    return M.search_counters(table(spark, sf, "orders").selectExpr(*_SEARCH))


ORACLES["a4_search_counters"] = """SELECT CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'success' END AS status, count(*) AS requests,
 CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 9 + 1 END) AS BIGINT) AS results FROM orders GROUP BY 1"""


def j1_hit_titles(spark, sf):
    """Title per request and URL; of a URL listed twice the later title counts."""
    df = table(spark, sf, "orders").selectExpr(*_SEARCH)
    hits = search_hits(df, 20).withColumn("url", F.concat(F.lit("https://r"), (F.col("rank") % 3).cast("string"), F.lit(".example.com/")))
    return hit_titles(hits)


ORACLES["j1_hit_titles"] = """WITH h AS (SELECT o_orderkey AS request_id, i, concat('https://r', i % 3, '.example.com/') AS url, CASE WHEN i % 2 = 0 THEN concat('T', i) ELSE '' END AS title
 FROM orders, generate_series(1, 9) t(i) WHERE o_orderstatus <> 'F' AND i <= o_orderkey % 9 + 1) SELECT request_id, url, arg_max(title, i) AS title FROM h GROUP BY 1, 2"""


def a5_outcome_totals(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status", "CASE WHEN event_id % 2 = 0 THEN 'combined' ELSE 'per_page' END AS mode",
        "event_id % 3 = 0 AS has_schema",
    )
    out = M.counter_with_totals(df, ["status", "mode", "has_schema"])
    return out.select(*(F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in ("status", "mode", "has_schema")), "total")


ORACLES["a5_outcome_totals"] = """WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
 CASE WHEN event_id % 2 = 0 THEN 'combined' ELSE 'per_page' END AS mode, event_id % 3 = 0 AS has_schema FROM events)
SELECT coalesce(status, 'all') AS status, coalesce(mode, 'all') AS mode, coalesce(CAST(has_schema AS VARCHAR), 'all') AS has_schema, count(*) AS total
FROM e GROUP BY ROLLUP (status, mode, has_schema)"""


def a9_research_summary(spark, sf):
    return M.research_summary(table(spark, sf, "documents").selectExpr("source AS request_id", "CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS content_length"))


ORACLES["a9_research_summary"] = """SELECT source AS request_id, count(*) AS total_results, count(*) FILTER (doc_id % 4 <> 0 AND n_chars > 0) AS success_count FROM documents GROUP BY 1"""

# Each user session of events is a task: the first event creates it, errors and purchases end it.
_TASK = (
    "concat('t', event_id div 3) AS task_id",
    "CAST(ts AS TIMESTAMP) AS ts",
    "event_id",
    "CASE WHEN event_id % 3 = 0 AND event_type <> 'signup' THEN 'processing' WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status",
    "CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN '' ELSE concat('r', event_id) END END AS result",
    "CASE WHEN event_id % 3 = 0 THEN concat('q', user_id) END AS query",
)
_TASK_SQL = """e AS (SELECT concat('t', event_id // 3) AS task_id, ts, event_id,
 CASE WHEN event_id % 3 = 0 AND event_type <> 'signup' THEN 'processing' WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
 CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN '' ELSE concat('r', event_id) END END AS result,
 CASE WHEN event_id % 3 = 0 THEN concat('q', user_id) END AS query FROM events),
l AS (SELECT task_id, arg_max(status, ts) AS status, arg_max(coalesce(result, '~'), ts) AS result, min(CASE WHEN status = 'processing' THEN ts END) AS created_at,
 arg_min(query, CASE WHEN status = 'processing' THEN ts END) AS query FROM e GROUP BY 1 HAVING min(CASE WHEN status = 'processing' THEN ts END) IS NOT NULL)"""


def _tasks(spark, sf):
    return table(spark, sf, "events").selectExpr(*_TASK)


def w3_latest_status(spark, sf):
    out = K.latest_status(_tasks(spark, sf))
    return out.select("task_id", "status", F.coalesce("result", F.lit("~")).alias("result"), "query", F.unix_micros("created_at").alias("created_us"))


ORACLES["w3_latest_status"] = f"WITH {_TASK_SQL} SELECT task_id, status, result, query, epoch_us(created_at) AS created_us FROM l"


def r6_task_status(spark, sf):
    """Every task id is asked for, and as many unknown ones; tasks of the last ten days are alive."""
    events = _tasks(spark, sf)
    asked = table(spark, sf, "events").selectExpr("explode(array(concat('t', event_id div 3), concat('u', event_id))) AS task_id").distinct()
    out = K.task_status(asked, events, F.lit("2024-01-31 00:00:00").cast("timestamp"), ttl_s=10 * 86400)
    return out.select("task_id", "status", *(F.coalesce(c, F.lit("")).alias(c) for c in ("query", "result", "error")))


ORACLES["r6_task_status"] = f"""WITH {_TASK_SQL}, asked AS (SELECT concat('t', event_id // 3) AS task_id FROM events UNION SELECT concat('u', event_id) FROM events),
j AS (SELECT task_id, coalesce(status, 'not_found') AS status, query, result FROM asked LEFT JOIN (SELECT * FROM l WHERE created_at >= TIMESTAMP '2024-01-21') USING (task_id))
SELECT task_id, status, CASE WHEN status <> 'not_found' THEN query ELSE '' END AS query, CASE WHEN status = 'done' THEN replace(result, '~', '') ELSE '' END AS result,
 CASE WHEN status = 'error' THEN CASE WHEN result IN ('', '~') THEN 'Unknown error' ELSE result END ELSE '' END AS error FROM j"""


def a13_inflight(spark, sf):
    return K.inflight(_tasks(spark, sf))


ORACLES["a13_inflight"] = f"WITH {_TASK_SQL} SELECT count(*) FILTER (status = 'processing') AS inflight FROM l"


def a13_inflight_over_time(spark, sf):
    out = K.inflight_over_time(_tasks(spark, sf))
    return out.select("task_id", F.unix_micros("ts").alias("ts_us"), "step", "open_tasks")


ORACLES["a13_inflight_over_time"] = f"""WITH {_TASK_SQL}, s AS (SELECT task_id, ts, CASE WHEN status = 'processing' THEN 1 ELSE -1 END AS step FROM e)
SELECT task_id, epoch_us(ts) AS ts_us, step, CAST(sum(step) OVER (ORDER BY ts, step DESC, task_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open_tasks FROM s"""

_CALL = ("CASE WHEN user_id % 3 = 0 THEN 'busy' ELSE concat('s', user_id % 7) END AS service", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS call_id", "event_type NOT IN ('error', 'click', 'view') AS ok")


def w4_failure_runs(spark, sf):
    out = K.failure_runs(table(spark, sf, "events").selectExpr(*_CALL))
    return out.select("service", "failures", *(F.unix_micros(c).alias(c) for c in ("started_at", "tripped_at", "ended_at")))


ORACLES["w4_failure_runs"] = """WITH c AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'busy' ELSE concat('s', user_id % 7) END AS service, epoch_us(ts) AS ts, event_id,
 event_type NOT IN ('error', 'click', 'view') AS ok FROM events),
g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY ts, event_id) AS island FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY service, island ORDER BY ts, event_id) AS i FROM g WHERE NOT ok)
SELECT service, count(*) AS failures, min(ts) AS started_at, max(CASE WHEN i = 5 THEN ts END) AS tripped_at, max(ts) AS ended_at
FROM n GROUP BY service, island HAVING count(*) >= 5"""

for _f in (
    s8_history_append, s9_history_get, s10_history_list, k1_newest_entries, r5_history_query, s11_history_purge, s13_log_ingest, a1_scrape_counter,
    a2_duration_histogram, a3_tier_fallbacks, s2_search_hits, a4_search_counters, j1_hit_titles, a5_outcome_totals, a9_research_summary, w3_latest_status,
    r6_task_status, a13_inflight, a13_inflight_over_time, w4_failure_runs,
):
    QUERIES[_f.__name__] = _f
