"""Quantiles of groups of any size, by counts, ranges and running totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def nearest_rank(rows: DataFrame, key: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """(key, a column for each name of shares): the value at the nearest rank of each share, of each key's rows.

    Equal values are counted before the shuffle; the counts are parted by ranges of (key, value), and
    a part's place in its key is the total of the parts before it, so a key with most of all rows is
    spread over many tasks. Null values are left out.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = written(counts.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("part", "key").agg(F.sum("n").alias("own"))  # a row for each part and key in it
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.col("key").alias("of"), F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy("key")).alias("all_rows"))
    inside = Window.partitionBy("part", "key").orderBy("value")
    placed = parts.withColumn("upto", F.sum("n").over(inside)).join(totals.withColumnRenamed("part", "of_part"), (F.col("part") == F.col("of_part")) & F.col("key").eqNullSafe(F.col("of")))
    last = F.col("before") + F.col("upto")

    def at(share: float):
        rank = F.greatest(F.lit(1), F.ceil(F.col("all_rows") * share))
        return F.max(F.when((rank <= last) & (rank > last - F.col("n")), F.col("value")))

    return placed.groupBy(F.col("key").alias(key)).agg(*[at(share).alias(name) for name, share in shares.items()])
