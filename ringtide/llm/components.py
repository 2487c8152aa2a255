"""Connected components of a graph that lies in a table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Edges of a task.
EDGES = 1 << 17


def packed(edges: DataFrame) -> DataFrame:
    """A checkpointed table of edges in as many partitions as its rows fill, so that few of them cost few files and tasks."""
    return edges.coalesce(max(1, -(-edges.count() // EDGES)))


def _round(edges: DataFrame) -> DataFrame:
    """The larger neighbours of every node, then the smaller ones, hung below its smallest neighbour."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    # every edge now points from the larger to the smaller end
    hung = larger.join(larger.groupBy("a").agg(F.min("b").alias("m")), "a")
    ends = hung.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    return ends.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one other, and none that others hang below."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.where("below + above > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `comp`, the smallest node reachable, for every node of `edges` (`a`, `b`).

    The rounds end when only stars are left, after a number of them that grows
    with the logarithm of the graph. A hub's edges are never gathered: its
    minimum is a partial aggregate and is joined back. Self-loops and repeated
    edges are allowed; null ends are left out.
    """
    edges = packed(checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    while not _stars(edges):
        # a round names its edges several times: the plan of two rounds at once fills the driver
        edges = packed(checkpointed(_round(edges)))
    hung = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    return hung.union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, whose ends are components of `comp` or nodes that it does not name."""
    moved = checkpointed(components(links))
    again = comp.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("__to")), "comp", "left")
    named = again.select("node", F.coalesce("__to", "comp").alias("comp"))
    return checkpointed(named.union(moved.join(comp.select("node"), "node", "left_anti")))
