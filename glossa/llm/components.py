"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.texts import gathered
from glossa.session import cut, small_side


def _star(edges: DataFrame, large: bool, nodes: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    low_of = small_side(low, nodes)
    if large:  # a row a link at most: the small star that follows leaves out repeats
        return both.join(low_of, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    moved = both.join(low_of, "a").where("b < a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return moved.where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link to a node that has none: then the links are the answer."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (a, root) for every node that isn't its component's least
    id. Each round halves the trees' depth or better and is cut off; hubs meet
    only sums that combine before the shuffle and joins that Spark may split."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    current, links = gathered(cut(edges.where("a != b").select(high.alias("a"), low.alias("b")).distinct()))
    nodes = 2 * links  # at most; stars add none
    while not _settled(current):
        current, _ = gathered(cut(_star(_star(current, True, nodes), False, nodes)))
    return current.select("a", F.col("b").alias("root"))
