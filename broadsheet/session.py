"""Session defaults, shared scratch space and size checks for broadcast sides."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when Catalyst's own estimate or a bounded row check says it fits.
BROADCAST_ROW_LIMIT = 100_000


def build_session(app: str = "broadsheet", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on. Explicit ``conf`` wins over the defaults below."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``).

    Where the setting is absent, a folder of our own is made in local mode only: on a cluster no folder of one
    machine is seen by the others, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    configured = tempfile.mkdtemp(prefix="broadsheet-")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage through a table in the shared folder, so a lost executor never forces a recompute."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on an input that comes in fewer splits than there are cores (a small table, or one
    large row group), by hashing it on a key. Larger inputs are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """All rows of ``df`` when there are at most ``limit`` of them, else None (nothing is truncated)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcast only after checking its row count; a larger side is left to a shuffle
    join, where adaptive execution splits skewed partitions."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df
