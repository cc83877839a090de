"""A folder of notes as a DataFrame, by Spark's binary reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# What is read and left out unless the caller says otherwise.
INCLUDE, EXCLUDE = ("**/*.md",), (".obsidian/**", ".trash/**", ".git/**", "AI Memory/**", "**/*.md.bak", "**/*.tmp")


def scan(spark: SparkSession, root: str, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    """(rel_path, text, modified, size) of the notes under root that a pattern includes and none excludes."""
    return _notes(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, include, exclude)


def stream(spark: SparkSession, root: str, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE, files_a_batch: int = 1000) -> DataFrame:
    """scan() as a stream: each micro-batch has the files that came since. A file is read once, by its path; a note that changes must come as a new file."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_a_batch)).load(root)
    return _notes(files, root, include, exclude)


def _notes(files: DataFrame, root: str, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    base = root.rstrip("/") + "/"
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    rel = F.substring_index(path, base, -1)
    found = files.select(rel.alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), tx.iso_millis(F.col("modificationTime")).alias("modified"), F.col("length").alias("size"))
    wanted = F.lit(False)
    for p in include:
        wanted = wanted | tx.matches_glob(F.col("rel_path"), p)
    for p in exclude:
        wanted = wanted & ~tx.matches_glob(F.col("rel_path"), p)
    # A byte that is no UTF-8 becomes U+FFFD rather than an end of the job.
    return found.filter(wanted & ~F.col("rel_path").rlike(r"(^|/)\.(?!obsidian)[^/]*/"))


def in_order(notes: DataFrame) -> DataFrame:
    """Notes by path, case left aside, for reports."""
    return notes.orderBy(F.lower("rel_path"), "rel_path")
