"""The attempt log as a stream: landed pages against the latest known hashes.

An extension of the batch capture: file-source stream, one micro-batch at a time, idempotent
by batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PAGES = "page_id long, url string, html string"


def landed(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def changes(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """url, sha256 and status (captured or unchanged) of a batch's pages; the last page of a url counts."""
    new = batch.groupBy("url").agg(F.max_by(F.sha2("html", 256), "page_id").alias("sha256"))
    if known is None:
        return new.withColumn("status", F.lit("captured"))
    old = known.groupBy("url").agg(F.max_by("sha256", "batch").alias("old"))
    same = F.coalesce(F.col("sha256") == F.col("old"), F.lit(False))
    return new.join(old, "url", "left").select("url", "sha256", F.when(same, "unchanged").otherwise("captured").alias("status"))


def follow(pages: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's attempts to ``log``, partitioned by batch; a batch run again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(log)
        exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        known = spark.read.schema("url string, sha256 string, status string, batch long").parquet(log).filter(F.col("batch") < number) if exists else None
        changes(batch, known).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
