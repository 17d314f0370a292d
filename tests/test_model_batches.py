from pyspark.sql import functions as F

from webgleaner.operators.extraction import with_model


def test_model_batches_are_bounded_by_bytes(spark):
    """A batch of long prompts must not hold 10,000 of them."""

    def count_model(threads):
        for _ in threads:
            yield f"{len(threads)} {sum(map(len, threads))}"

    prompts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("messages"))
    rows = with_model(prompts, count_model).select("id", "raw").collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    assert all(int(r.raw.split()[1]) <= 9 << 20 for r in rows)
    assert all(int(r.raw.split()[0]) <= 2000 for r in rows)
