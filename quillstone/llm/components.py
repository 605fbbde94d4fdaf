"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import shared_dir


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node of links (a, b).

    Alternating star contraction: every node's larger neighbours, then all its neighbours, are hung on the least node
    among itself and its neighbours, until nothing changes; that takes about log(nodes) rounds. Each round is cut off by checkpoint().
    """
    shared_dir(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["node"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = small.where("a <> b").distinct().checkpoint()
        # a forest of stars is a fixed point: no root hangs on another node
        roots = now.select(F.col("b").alias("a")).distinct()
        if now.join(roots, "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
        edges = now
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
