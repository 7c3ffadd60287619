"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is a few joins and aggregates whose keys are aggregated before the shuffle;
the links are written to the shared checkpoint folder between rounds.  The number of
rounds grows with the logarithm of the longest chain.  With ``split`` the least neighbours are
written too, which lets the join split a node with a large share of all links over tasks, for
two more small tables a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbin.llm.frames import settle


def _star(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    """Connect neighbours of each node to the least of node and neighbours (edges point u > v)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = settle(least) if split else least
    to = both.join(least, "a")
    if large:
        out = to.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = to.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, split: bool = False) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the least node."""
    edges = settle(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        out = _star(edges, True, split)
        edges = settle(_star(settle(out) if split else out, False, split))
        # done when every node has one link and the node that it links to has none
        out = edges.groupBy("a").agg(F.count("*").alias("n"))
        loose = out.where("n > 1").select("a").unionByName(edges.select(F.col("b").alias("a")).join(out, "a", "left_semi"))
        if loose.isEmpty():
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
