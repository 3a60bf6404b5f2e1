"""Incremental state over a stream of events (an extension: windows with late data)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as files arrive.  The path may be one file: as a pattern it is taken like a folder."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event type and window; events later than ``late`` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("begin"), "event_type", "n")


def first_seen(links: DataFrame, key: str = "url") -> DataFrame:
    """Each key once, however often it is found again."""
    return links.dropDuplicates([key])


def drained_windows(spark: SparkSession, path: str) -> DataFrame:
    """Run the windows over all files there are, and read what the stream left.

    Every batch writes its changed windows under its number, so a batch that is
    run again replaces itself; the newest count of a window is the one that holds.
    """
    sc = spark.sparkContext
    base = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir().rpartition("/")[0]).rstrip("/") + f"/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = windows(event_stream(spark, path)).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("begin", "event_type").agg(F.max_by("n", "batch").alias("n"))
