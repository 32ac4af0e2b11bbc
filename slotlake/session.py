"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even if that costs one more exchange further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "slotlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a session without
    that setting, such as a test on one machine, gets a folder of its own. Each application has
    a subfolder, so that one may clear its own and no other's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        return f"{named.rstrip('/')}/slotlake-{context.applicationId}"
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="slotlake-"))
    return f"{context.getCheckpointDir()}/slotlake-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def clear_workspace(spark: SparkSession) -> None:
    """Remove what was written to the shared folder; for the end of a job, when its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(workspace(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table once and continue from the written files.

    This cuts the lineage, survives the loss of executors, and leaves Catalyst with the
    true file size, so that a later join broadcasts the table only while it is small.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
