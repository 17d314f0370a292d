"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are tuned for; all may be overridden by the cluster.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Page conversion is heavy per byte: smaller scan splits keep tasks short.
    "spark.sql.files.maxPartitionBytes": "32m",
    # Python workers hold a batch of rows several times over: prompts are long, so that a batch is bounded by bytes, not by 10,000 rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Model answers may repeat a JSON key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Folders of local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    # local-cluster has executors of its own: it needs a shared folder like any cluster.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="webgleaner-")
    return _LOCAL_FOLDERS[application]


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_folder(spark)}/webgleaner/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives executor loss, gives real sizes."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Write ``df`` once, dealt by ``keys`` into as many buckets as there are shuffle partitions.

    Joins and aggregates on all of ``keys`` then read it as it lies: only the other side is shuffled, however often it is joined.
    The files are in the shared folder; the table's name lasts as long as the session.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"webgleaner_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    placed.option("path", path).saveAsTable(name)
    return spark.table(name)
