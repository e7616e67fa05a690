"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, settle


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked with the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are linked with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, and then nothing hangs on it: no step is left to do."""
    up, down = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")), edges.select(F.col("v").alias("node"), F.lit(0).alias("up"))
    node = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not node.agg(F.max((F.col("up") > 1) | (F.col("up") > F.col("least")))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", kind: str = "long") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node.

    Nodes are of any type with an order, ``kind``.

    Edges with a null end, loops and repeated edges are harmless. The edges live in tables in the
    shared scratch folder; only whether stars are left reaches the driver.
    """
    now = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).distinct())
    while not _stars(now):
        # the mid step is a table too: a skewed join can be split only if nothing above needs its order;
        # it has a row for each edge at most, so its repeated rows can wait for the next step
        mid = settle(_large(now).where("u <> v"))
        new = settle(_small(mid).where("u <> v").distinct())
        discard(mid)
        discard(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
