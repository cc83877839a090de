"""Versioned tables as append-only logs: current rows, history, supersede links, counts.

"Current" is what was written last: the latest (created_at, id) of a key, or by the order given. The window needs one
shuffle by key; a key's versions are sorted, not held in memory. Where only the current row is
wanted, max_by is combined before the shuffle, so that a hot key stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("created_at", "id")


def current(log: DataFrame, key: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return last.select(*key, *[F.col(f"row.`{c}`").alias(c) for c in rest]).select(*log.columns)


def history(log: DataFrame, key: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Every version with its number and the id that superseded it (null: current)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("version", F.row_number().over(w).cast("long")).withColumn("superseded_by", F.lead("id").over(w))


def dangling(linked: DataFrame) -> DataFrame:
    """Rows whose superseded_by names no row."""
    known = linked.select(F.col("id").alias("known"))
    return linked.filter("superseded_by IS NOT NULL").join(known, F.col("superseded_by") == F.col("known"), "left_anti")


def fold_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows with each id's last status change applied; revision counts the changes.

    changes: (id, seq, status, superseded_by). A change of an unknown id has no effect.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct("status", "superseded_by"), "seq").alias("last"), F.count("*").alias("changes"))
    joined = rows.join(last, "id", "left")
    return joined.select(
        *[c for c in rows.columns if c not in ("status", "superseded_by", "revision")],
        F.coalesce("last.status", "status").alias("status"), F.col("last.superseded_by").alias("superseded_by"), (F.lit(1) + F.coalesce("changes", F.lit(0))).cast("int").alias("revision"),
    )


def without(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """The rows whose id isn't listed. A store's delete (store.py) refuses rows that others point to."""
    return rows.join(deleted.select("id").distinct(), "id", "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """new's rows in place of those with their key; the last of equal keys by seq counts."""
    fresh = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in key]), "seq").alias("row"))
    fresh = fresh.select(*key, *[F.col(f"row.{c}").alias(c) for c in table.columns if c not in key]).select(*table.columns)
    return table.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(fresh)
