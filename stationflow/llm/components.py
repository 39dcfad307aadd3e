"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import drop_stage, write_stage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b), for every node in a link.

    Alternates two steps, each a shuffle on the node: every node hands the smallest
    of its neighbours and itself to its larger neighbours, then to its smaller ones. Links only
    ever move towards smaller nodes and the tables shrink to one link a node, in a
    number of rounds that grows with the logarithm of the longest path. Each round
    is written to the shared folder, and the one before removed. Self links and repeated links do no harm.
    """
    edges = write_stage(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u <> v").distinct(), "cc")

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each node hands the smallest of its neighbours and itself to its larger neighbours
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # and then to its smaller ones and itself
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = write_stage(small.distinct(), "cc")
        # Done when neither step changes anything: the links are stars whose centre is the smallest node.
        open_ends = nxt.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or nxt.join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        drop_stage(edges)
        edges = nxt
        if not open_ends:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
