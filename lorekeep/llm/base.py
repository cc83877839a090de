"""Helpers that the training-data operators share: tables, shared checkpoints, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task handles at once.
PIECE_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to a Python task; the default of 64 MB is dear where tasks hold whole texts.
BATCH_BYTES = 4 << 20
PLAN_CHARS = 20_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: So many ids, of some 24 bytes each in a hashed relation, are sent to all tasks rather than shuffled with whole texts.
BROADCAST_IDS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Python tasks of the session get rows in batches of BATCH_BYTES from here on,
    and the driver remembers PLAN_CHARS of a plan's text: an operator runs many, some with large literals."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty); extra columns and clashing names go."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which driver and executors share.

    Where the setting is missing, a local session takes a temporary folder; a cluster has none that
    every node sees, so there it is an error.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{shared.rstrip('/')}/lorekeep-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, *seen: Column) -> DataFrame:
    """df as a table written to the shared folder and read again: short lineage, and sizes as they are.

    With aggregates `seen`, what they give over the rows as they are written is in the result's
    `seen` attribute, at no further pass.
    """
    spark, at = df.sparkSession, shared_folder(df.sparkSession)
    watch = Observation() if seen else None
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what the write shuffled is of no use once the table is there
    try:
        (df.observe(watch, *seen) if watch else df).write.parquet(at)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.at, out.seen = at, watch.get if watch else {}
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of checkpointed() that no later plan reads."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t.at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """The rows of docs whose doc_id is among n_ids ids (id): by broadcast up to BROADCAST_IDS of them, else by a shuffle."""
    side = ids.select(F.col("id").alias("wanted_id"))
    return docs.join(F.broadcast(side) if n_ids <= BROADCAST_IDS else side, F.col("doc_id") == F.col("wanted_id"), "left_semi")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, to size shards and buckets by."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def parts_for(n_bytes: int, each: int, least: int = 8) -> int:
    return max(least, -(-n_bytes // each))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of runs of rows of up to limit bytes; a longer text is a run alone."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    start, size, run = 0, 0, []
    for i, value in enumerate(col):
        raw = value.as_py() or b""
        if run and size + len(raw) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield start, run


def runs_of_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of up to limit bytes of a string column; a longer text is a run alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > limit:
            yield first, i - first
            first, held = i, 0
        held += size
    if len(sizes):
        yield first, len(sizes) - first
