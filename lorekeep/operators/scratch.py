"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str = "work") -> str:
    """A new path in the folder that spark.checkpoint.dir names; without one, only a local session may take a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{shared.rstrip('/')}/lorekeep-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What a write in here shuffled is deleted once its table is there, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str = "work") -> DataFrame:
    """df as a table written once and read again: each use costs a scan, not the plan. Its attribute `at` is the path."""
    at = shared_folder(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.at = at
    return out
