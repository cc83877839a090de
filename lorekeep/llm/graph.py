"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, discard

#: A node with more than one edge in so many is looked up from a broadcast table, of 2 * HOT rows at most.
HOT = 64


def looked_up(rows: DataFrame, key: str, nodes: DataFrame, n_rows: int) -> DataFrame:
    """rows with the columns (id, least, n) of nodes whose id is the row's key; null where there is none.

    n is at least how many rows have the id as key. The nodes of most rows are few, whatever the
    table's size, and meet the rows by broadcast; so no task of the other join gets more than one
    row in HOT of one key.
    """
    hot = F.col("n") > max(1, n_rows // HOT)
    many = F.broadcast(nodes.filter(hot))
    few = rows.join(F.broadcast(nodes.filter(hot).select("id")), F.col(key) == F.col("id"), "left_anti")
    return rows.join(many, F.col(key) == F.col("id")).unionByName(few.join(nodes.filter(~hot), F.col(key) == F.col("id"), "left"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the least id reachable.

    Rounds of large and small stars: first each node's larger neighbours are tied to its least
    one, then its smaller neighbours and the node itself. Edges never grow in number, and even a
    path with shuffled ids takes rounds by the logarithm of its length. It ends when every node
    has either one smaller neighbour alone or none. An empty edge table gives no rows.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    tree = checkpointed(ends, F.count(F.lit(1)).alias("n"))
    while True:
        n_edges = tree.seen["n"]
        both = tree.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(tree.select(F.col("b").alias("id"), F.col("a").alias("other")))
        nodes = both.groupBy("id").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("n"))
        nodes = checkpointed(nodes, F.coalesce(F.sum(((F.col("least") < F.col("id")) & (F.col("n") > 1)).cast("int")), F.lit(0)).alias("open"))
        if not nodes.seen["open"]:
            return nodes.select("id", F.least("id", "least").alias("component"))
        large = looked_up(tree, "a", nodes, n_edges).select(F.least("a", "least").alias("a"), "b")
        large = checkpointed(large, F.count(F.lit(1)).alias("n"))
        discard(nodes, tree)
        below = large.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("least"), F.count(F.lit(1)).alias("n"))
        small = looked_up(large, "b", below, large.seen["n"]).select("least", F.explode(F.array("a", "b")).alias("b")).filter("least <> b")
        tree = checkpointed(small.select(F.col("least").alias("a"), "b").distinct(), F.count(F.lit(1)).alias("n"))
        discard(large)
