"""Connected components of a table of edges, by alternating star joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(edges: DataFrame) -> DataFrame:
    """The least of each node and its neighbours; a node with many neighbours is summed up task by task."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the least node of its component, for every node of ``edges`` (u, v).

    A large star links all greater neighbours of a node to its least one, a small star the smaller ones and the node
    itself.  Rounds end when the edges no longer change; ``rounds`` is far above the few that are needed (they grow
    with the logarithm of the longest chain), and passing it is an error, never a result.
    """
    links = written(edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").selectExpr("v AS u", "m AS v").filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("explode(array(v, u)) AS u", "m AS v").filter("u <> v").distinct()
        links = written(small, "edges")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.selectExpr("u AS node", "v AS root").union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")
