"""Incremental work over the append-only event log, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import vectors as vx


def event_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and type; a window closes once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def embed_new(memories: DataFrame, index_path: str, model: str, checkpoint: str, dim: int = 64) -> DataStreamWriter:
    """Append vectors of memories (id, text) that the index at index_path lacks, a micro-batch at a time.

    A batch that is run again after a failure finds its own rows in the index and adds none.
    """

    def append(batch: DataFrame, _: int) -> None:
        made = vx.hash_embeddings(batch.dropDuplicates(["id"]), dim).select(F.col("id").alias("memory_id"), F.lit(model).alias("model_id"), "vector")
        spark = batch.sparkSession
        jvm = spark._jvm.org.apache.hadoop.fs
        there = jvm.Path(index_path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            made = made.join(spark.read.parquet(index_path).select("memory_id", "model_id"), ["memory_id", "model_id"], "left_anti")
        made.write.mode("append").parquet(index_path)

    return memories.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append)
