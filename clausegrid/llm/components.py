"""Connected components of an edge table by contraction.

Each round every node points to its smallest neighbour (or itself), pointers are followed once more, and
the edges are rewritten to what their ends point to; loops and repeats go. Ids are scrambled first, so that
what is smallest doesn't follow from how a table was numbered: a star, whatever its hub's id, is done in two
rounds, and a path loses a good part of its nodes in each. Each round's tables are written to the
shared folder; nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, stored


def _ranked(name: str):
    """An id behind its scramble, which orders it."""
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("id")).alias(name)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node."""
    named = edges.select("a", "b").where("a <> b")
    left = stored(named.select(_ranked("a"), _ranked("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("to")))
        points = stored(both.groupBy("node").agg(F.min("to").alias("to")), "pointers")
        again = points.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jumped = points.join(again, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        jumped = stored(jumped, "jumped")
        if labels is None:
            after = jumped.select("node", F.col("to").alias("component"))
        else:
            after = labels.join(jumped.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        after = stored(after, "labels")
        a = jumped.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = jumped.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = left.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        moved = stored(moved, "edges")
        for old in (left, points, jumped, labels):
            if old is not None:
                forget(old)
        left, labels = moved, after
    if labels is None:
        return left.select(F.col("a.id").alias("node"), F.col("b.id").alias("component"))
    least = labels.groupBy("component").agg(F.min("node.id").alias("least"))
    return labels.join(least, "component").select(F.col("node.id").alias("node"), F.col("least").alias("component"))
