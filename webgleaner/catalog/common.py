"""Inputs the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# SQL text of derived columns, valid in Spark and in the checking engine alike.
HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1))"
SITE = "regexp_extract(url, '^([^:]+://[^/?#]*)', 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(*columns)
