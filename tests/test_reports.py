"""History, task status, failure runs, counters, streams in several batches."""

import datetime as dt

from pyspark.sql import functions as F

from webgleaner.operators import history as H
from webgleaner.operators import metrics as M
from webgleaner.operators import tasks as K
from webgleaner.session import work_folder
from webgleaner.sources import parse_log_lines
from webgleaner.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
ENTRY = "id string, kind string, query_or_url string, params string, status string, result string, result_size int, error string, created_at timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def entry(name, kind="crawl", seconds=0, **other):
    base = dict(query_or_url="q", params='{"max_results":5}', status="done", result='{"total_results":3,"results":[1,2]}', result_size=3, error=None)
    base.update(other)
    return (name, kind, base["query_or_url"], base["params"], base["status"], base["result"], base["result_size"], base["error"], at(seconds))


def one_day(history):
    return history.where("id = 'task-1'").first().dt


def test_history(spark):
    path = work_folder(spark, "test-history")
    rows = [entry("task-1", "research"), entry("c1", seconds=1), entry("c2", seconds=2), entry("c3", seconds=2), entry("m1", "map", -40 * 86400), entry(None, "map", 5, params="{}", query_or_url="x" * 3000)]
    H.append_history(spark.createDataFrame(rows, ENTRY), path)
    history = H.read_history(spark, path)
    one = H.get_entry(history, "task-1").select("result", F.variant_get("params_json", "$.max_results", "int").alias("n"), F.variant_get("result_json", "$.total_results", "int").alias("r")).first()
    assert (one.result, one.n, one.r) == ('{"total_results":3}', 5, 3)
    assert H.get_entry(history, "unknown").count() == 0
    assert [r.id for r in H.list_entries(history, "crawl").collect()] == ["c2", "c3", "c1"]
    assert [r.id for r in H.list_entries(history, "crawl", limit=1, offset=1).collect()] == ["c3"]
    assert H.list_entries(history, None, limit=0).count() == 1 and H.list_entries(history).count() == 6
    new = history.where("kind = 'map' AND id <> 'm1'").first()
    assert len(new.id) == 36 and new.params is None and len(new.query_or_url) == 3000
    assert H.history_rows(spark.createDataFrame(rows[-1:], ENTRY), max_query_chars=2048).first().query_or_url == "x" * 2048
    assert H.get_entry(history, "task-1", "research", str(one_day(history))).count() == 1 and H.get_entry(history, "task-1", "map").count() == 0
    assert H.purge(history, 30, work_folder(spark, "kept"), F.lit(at(0))) == 1
    assert H.retained(history, 0).count() == 6


def rows_scanned(df):
    """Rows that leave the scan of files."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_point_reads_skip_row_groups(spark):
    path = work_folder(spark, "test-history")
    # Even numbers only: odd ones lie between them, so only the Bloom filter tells that they are not there.
    rows = spark.range(0, 4000, 2).selectExpr(
        "concat('t', 10000 + id) AS id", "'crawl' AS kind", "'q' AS query_or_url", "'{}' AS params", "'done' AS status", "'{}' AS result", "1 AS result_size",
        "CAST(NULL AS STRING) AS error", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 4 AS INT)) AS created_at",
    )
    H.append_history(rows, path)
    history = H.read_history(spark, path)
    assert rows_scanned(history) == 2000
    assert rows_scanned(H.get_entry(history, "t10001")) == 0
    found = H.get_entry(history, "t12222")
    # Two days hold the rows; the files of one are skipped.
    assert [r.id for r in found.collect()] == ["t12222"] and 0 < rows_scanned(found) <= 1000


EVENTS = "task_id string, ts timestamp, status string, result string, query string"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_task_status(spark):
    df = events(spark, [
        ("a", at(0), "processing", None, "q"), ("b", at(0), "processing", None, "q"), ("b", at(5), "done", "R", None), ("c", at(0), "processing", None, "q"), ("c", at(1), "error", "boom", None),
        ("old", at(-10000), "processing", None, "q"), ("ghost", at(0), "done", "R", None), ("d", at(0), "processing", None, "q"), ("d", at(1), "error", "", None),
    ])
    asked = spark.createDataFrame([(t,) for t in "a b c d old ghost nobody".split()], "task_id string")
    got = {r.task_id: (r.status, r.result, r.error) for r in K.task_status(asked, df, F.lit(at(600))).collect()}
    gone = ("not_found", None, None)
    assert got == {"a": ("processing", None, None), "b": ("done", "R", None), "c": ("error", None, "boom"), "d": ("error", None, "Unknown error"), "old": gone, "ghost": gone, "nobody": gone}
    assert K.inflight(df).first().inflight == 2
    assert max(r.open_tasks for r in K.inflight_over_time(df.where("task_id NOT IN ('ghost', 'old')")).collect()) == 4


CALLS = "service string, ts timestamp, call_id int, ok boolean"


def calls(text, service="s", start=0, gap=1200):
    return [(service, at((start + i) * gap), start + i, c == "+") for i, c in enumerate(text)]


def test_failure_runs(spark):
    df = spark.createDataFrame(calls("---") + calls("-+-", "t") + calls("+-----+--", "u"), CALLS)
    runs = {r.service: (r.failures, r.tripped_at) for r in K.failure_runs(df, 3).collect()}
    assert runs == {"s": (3, at(2400)), "u": (5, at(3 * 1200))}
    assert {r.service for r in K.failure_runs(df, 2).collect()} == {"s", "u"}


def test_failure_alerts_across_batches(spark):
    """The runs cross the borders of the batches; the alerts equal those of one batch job."""
    source, out, state = (work_folder(spark, n) for n in ("calls", "alerts", "state"))
    text = "--+---" + "--+" + "-" + "-" + "-----" + "+-" + "--" + "--"
    cuts = [0, 2, 6, 9, 10, 11, 16, 18, 20, 22]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = calls(text[a:b], "s", a)
        if number != 4:
            part = part + calls("-", "t", a)
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CALLS).parquet(source)
        J.failure_alerts(stream, out, state, threshold=3).awaitTermination()
    got = sorted((r.service, r.tripped_at) for r in spark.read.parquet(f"{out}/alerts").collect())
    whole = K.failure_runs(spark.read.schema(CALLS).parquet(source), 3)
    assert got == sorted((r.service, r.tripped_at) for r in whole.collect())
    assert len(got) == 4
    # A row older than what was counted changes nothing and is kept apart.
    spark.createDataFrame(calls("-", "s", 1), CALLS).coalesce(1).write.mode("append").parquet(source)
    J.failure_alerts(spark.readStream.schema(CALLS).parquet(source), out, state, threshold=3).awaitTermination()
    assert sorted((r.service, r.tripped_at) for r in spark.read.parquet(f"{out}/alerts").collect()) == got
    assert spark.read.parquet(f"{out}/late").count() == 1


def test_task_states_over_batches(spark):
    source, out, state = (work_folder(spark, n) for n in ("events", "states", "state"))
    for rows in ([("a", at(0), "processing", None, "q"), ("b", at(1), "processing", None, "q")], [("a", at(60), "done", "R", None), ("b", at(86400), "error", "E", None)]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        J.upsert_stream(J.task_states(spark.readStream.schema(EVENTS).parquet(source)), out, state).awaitTermination()
    last = J.merge_task_states(spark.read.parquet(out))
    assert {r.task_id: (r.status, r.result) for r in last.collect()} == {"a": ("done", "R"), "b": ("error", "E")}
    assert J.merge_task_states(spark.read.parquet(out), F.lit(at(600))).count() == 2
    assert [r.task_id for r in J.merge_task_states(spark.read.parquet(out), F.lit(at(601))).collect()] == ["b"]


def test_histogram_and_logs(spark):
    df = spark.createDataFrame([("x", 0.5), ("x", 0.6), ("x", 100.0), ("y", None)], "m string, d double")
    got = {(r.m, r.le): r.bucket_count for r in M.histogram(df, "d", M.BUCKETS["scrape"], ["m"]).collect()}
    assert got[("x", "0.5")] == 1 and got[("x", "1")] == 2 and got[("x", "60")] == 2 and got[("x", "+Inf")] == 3
    lines = spark.createDataFrame([('{"level":"INFO","line":3,"url":"u"}',), ("oops",)], "value string")
    rows = parse_log_lines(lines).collect()
    assert (rows[0].level, rows[0].line, rows[0].url, rows[0]._corrupt_record) == ("INFO", 3, "u", None) and rows[1]._corrupt_record == "oops"
