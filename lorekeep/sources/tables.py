"""The driver's tables bound to the relations of a knowledge store.

documents become memories, events the versioned preferences and states, conversations the
event log; what has no column is derived from the ids, so that every binding is repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "given:64"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, scope, subject, tags, kind, status, salience, created_at (the id: no clock in the table)."""
    d = table(spark, sf_dir, "documents")
    scope = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("persona:")).otherwise(F.lit("project:")), F.col("source"))
    kind = F.when(F.col("doc_id") % 3 == 0, "episodic").when(F.col("doc_id") % 3 == 1, "identity").otherwise("semantic")
    status = F.when(F.col("doc_id") % 11 == 0, "superseded").when(F.col("doc_id") % 13 == 0, "deleted").otherwise("active")
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), scope.alias("scope"), F.col("lang").alias("subject"), F.array("source").alias("tags"), kind.alias("kind"), status.alias("status"),
        F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("salience"), F.col("doc_id").alias("created_at"),
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log: scope, key, value, statement, written in the order of (created_at, id)."""
    e = table(spark, sf_dir, "events")
    scope = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").alias("id"), scope.alias("scope"), F.col("event_type").alias("key"), F.col("value"),
        F.concat_ws(" ", "event_type", F.lit("="), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))).alias("statement"), F.lit(1.0).alias("confidence"), F.col("ts").alias("created_at"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    project = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), project.alias("project_id"), F.concat(F.lit("project:"), project).alias("scope"), F.col("props").alias("state"), F.col("ts").alias("created_at"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("memory_id"), F.lit(MODEL).alias("model_id"), F.col("embedding").cast("array<double>").alias("vector"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
