"""One hour that holds all rows is spread over many buckets."""

from pyspark.sql import functions as F

from webgleaner.operators import tasks


def test_one_hour_of_one_service(spark):
    calls = spark.range(5000).selectExpr(
        "'s' AS service", "timestamp'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id * 0.5) AS ts", "id AS call_id", "id % 7 < 2 AS ok"
    )
    bucket = tasks.time_bucket(calls, ["service"], most_rows=100)
    sizes = [r["count"] for r in calls.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 200
    narrow = tasks.failure_runs(calls, bucket=bucket).collect()
    assert sorted(narrow) == sorted(tasks.failure_runs(calls).collect()) and len(narrow) == 714
    events = calls.selectExpr("CAST(call_id div 2 AS STRING) AS task_id", "ts", "CASE WHEN call_id % 2 = 0 THEN 'processing' ELSE 'done' END AS status")
    rows = tasks.inflight_over_time(events, tasks.time_bucket(events, [], most_rows=100))
    assert rows.agg(F.min("open_tasks"), F.max("open_tasks")).first() == (0, 1)
