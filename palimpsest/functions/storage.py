"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, the context's checkpoint folder, or in
    local mode a temporary one; on a cluster that is an error, since executors do not share one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='palimpsest-')}")
    return spark.sparkContext.getCheckpointDir()


def store(df: DataFrame) -> DataFrame:
    """Cut lineage: a Parquet table in the shared folder, which survives lost executors. ``release``
    deletes it; what a lazy result still reads stays until the folder's owner clears it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}.parquet"
    # Shuffle files of earlier steps go once the driver's collector has seen that nothing holds them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


#: The same; steps that only cut lineage name it so.
cut = store


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
