"""Session helpers: scratch tables in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own_dirs: dict[str, str] = {}


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC everywhere; a cast must not depend on where the job runs."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        _own_dirs[app] = tempfile.mkdtemp(prefix="wardline-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wardline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write a result that several branches share, and read it back.

    It cuts the lineage with a plain table: a lost executor re-reads files instead of re-running
    the branch, values that depend on partitioning stay fixed, and readers still prune columns
    and push filters.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression) if compression else df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
