"""Session defaults that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings for large joins: Spark re-plans from measured sizes at run time, so no
# operator needs a broadcast hint and hot partitions are split where they occur.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a few hundred kilobytes of keys can fan out to gigabytes of columns, so they stay spread over all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32KB",
    # estimates see the size of a file, not what a fan-out or an aggregation makes of it: only tables whose
    # rows have been counted are sent to the driver and from there to all tasks
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    # the JVM never compiles methods beyond 8000 bytes of bytecode; such stages run faster unfused
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "cartolith", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session with the library's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def planning_session(spark: SparkSession) -> SparkSession:
    """A session on the same context, with the caller's settings and the library's defaults over them."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **DEFAULTS}.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over twice the cores, for steps that make many rows of each; a small file would be one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only local sessions without one get their own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Lineage ends here, the data survives lost executors, and the file sizes tell the planner
    whether the table is small enough to be broadcast.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
