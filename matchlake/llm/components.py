"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b as long): the smallest node reachable.

    Each round every node points to its smallest neighbour if that is smaller than
    itself, pointers are followed, and edges are rewritten to where their ends point.
    A round at least halves what a node can still reach by descending, so few rounds
    are needed; all tables are written to the shared folder and nothing but a count
    comes to the driver. Null ends, loops and repeated edges have no effect.
    """
    pair = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    work = written(pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        # Both directions, combined per node before the shuffle: the smallest end it has.
        ends = work.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(work.select(F.col("b").alias("node"), F.col("a").alias("other")))
        point = ends.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to"))
        point = written(point, "pointers")
        for _ in range(3):  # follow pointers: after k steps over 2^k of them
            next_to = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
            point = point.join(next_to, "to").select("node", F.col("far").alias("to"))
        point = written(point, "pointers")
        if labels is None:
            labels = point.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(point.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = written(labels, "labels")
        left = point.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = point.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        moved = work.join(left, "a").join(right, "b").where("ra <> rb")
        work = written(moved.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        if work.isEmpty():
            return labels
