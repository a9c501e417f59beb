"""Connected components of an edge table, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """Per node its smallest neighbour or itself; both directions of every edge count."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component; nodes are the ends of ``edges`` (a, b).

    Alternates star steps: hang every larger neighbour under the smallest one,
    then every smaller neighbour likewise, until the edges form stars around the minima.
    Each step is a partial minimum and a join on written tables, so a node with a third
    of all edges is combined before the shuffle and split by the skew join.  Self
    loops and repeated edges do no harm; no edges give no rows."""
    now = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .filter("a is not null and b is not null").distinct())
    mark = None
    while True:
        # large star: larger neighbours of u move to the smallest of u's neighbourhood
        small = cut_lineage(_least(now))
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = cut_lineage(both.join(small, "a").filter("b > a")
                          .select(F.col("m").alias("a"), "b").filter("a < b").distinct())
        # small star: smaller neighbours and u itself move to the smallest of them
        low = cut_lineage(now.groupBy("b").agg(F.min("a").alias("m")))
        down = now.join(low, "b")
        now = cut_lineage(down.select(F.col("m").alias("a"), F.col("a").alias("c"))
                          .unionByName(down.select(F.col("m").alias("a"), F.col("b").alias("c")))
                          .filter("a < c").distinct().withColumnRenamed("c", "b"))
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if (state["n"], state["s"]) == mark:
            break
        mark = (state["n"], state["s"])
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))) \
        .filter("node is not null").distinct()
    up = now.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return nodes.join(up, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
