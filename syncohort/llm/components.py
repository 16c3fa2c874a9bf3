"""Connected components of a table of links, by repeated contraction.

Every round points each node to the neighbour (or itself) with the lowest hash and
replaces nodes by what they point to; the number of links falls by a constant
factor. A hub's neighbours are reduced by a map-side minimum, and the joins on hubs
are plain sort-merge joins, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncohort.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the lowest node.

    Loops, repeated and reversed links are allowed; links with a null are ignored.
    An empty table gives an empty table. Each round's result is written to the
    shared folder, so a lost executor repeats one round at most.
    """
    links = cut(links.select("a", "b").dropna(), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut(ends.select("node", F.col("node").alias("root")), "labels")
    links = links.where("a <> b")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        lowest = both.groupBy("a").agg(F.min(rank("b")).alias("n"))
        to = cut(
            lowest.select(F.col("a").alias("node"), F.least(rank("a"), "n")["id"].alias("to")), "to"
        )
        labels = cut(
            labels.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "labels",
        )
        moved = (
            links.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        links = cut(moved, "links")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
