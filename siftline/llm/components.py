"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import written


def scrambled(node: Column) -> Column:
    """A one-to-one reshuffling of 64-bit numbers, so that the order of ids says nothing about links.

    Contraction to the smallest neighbour halves a chain in each round if the order
    along it is random, but takes one node off it if ids ascend along it. The hash of one
    64-bit number multiplies by odd numbers, rotates and shifts, so it can be undone: no two nodes share one.
    """
    return F.xxhash64(node)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``, both long; component is the smallest node reachable.

    Every round maps each node to the smallest of its neighbourhood and replaces
    edges by those between the images, until none is left. Each round's mapping and
    remaining edges are written to the shared folder, so lineage stays short and a
    lost executor costs one round at most. A hub is pre-aggregated per task by the
    ``min``; its edges meet in plain joins that adaptive execution may split.

    Null ends and loops are dropped; repeated edges and an empty table are fine.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    nodes = written(ends.groupBy("node").agg(scrambled(F.col("node")).alias("at")), "cc-nodes")
    current = edges.select(scrambled(F.col("a")).alias("a"), scrambled(F.col("b")).alias("b")).where("a <> b")
    current = written(current.distinct(), "cc-edges")
    mapping = None
    while not current.isEmpty():
        both = current.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        smallest = both.select("e.a", "e.b").groupBy("a").agg(F.min("b").alias("m"))
        step = written(smallest.select(F.col("a").alias("from"), F.least("a", "m").alias("to")), "cc-step")
        moved = (
            current.join(step.select(F.col("from").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        )
        current = written(moved.distinct(), "cc-edges")
        if mapping is None:
            mapping = step
        else:
            onward = step.select(F.col("from").alias("to"), F.col("to").alias("next"))
            mapping = written(
                mapping.join(onward, "to", "left").select("from", F.coalesce("next", "to").alias("to")), "cc-map"
            )
    if mapping is None:
        return nodes.select("node", F.col("node").alias("component"))
    placed = written(nodes.join(mapping.withColumnRenamed("from", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("to")), "cc-to")
    smallest = placed.groupBy("to").agg(F.min("node").alias("component"))
    return placed.join(smallest, "to").select("node", "component")
