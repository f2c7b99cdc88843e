"""Connected components of a table of links, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

JUMPS = 2  # of parents to their parents, a round


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each node of links the least node of its component.

    Each round hooks every node to the first of itself and its neighbours, follows parents JUMPS times, and replaces the ends
    of links by where they got; links that fall together vanish. Every second round the order of nodes is that of a hash of
    the round's own, under which at most half of the linked nodes are expected to be first among their neighbours, so the
    nodes left halve at least every two rounds whatever the links: 2 log2(nodes) rounds are expected at most. In the other
    rounds it is the nodes' own order, which joins a star in two. Each round's tables are written to the shared folder. Null
    ends and links of a node with itself give nothing; repeated links count once; an empty table gives an empty one."""
    links = materialise(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b"), "links")
    labels, n = None, 0
    while True:
        order = F.xxhash64("b", F.lit(n)) if n % 2 else F.lit(0)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.groupBy("a").agg(F.min(F.struct(order.alias("o"), "b")).alias("m"))
        own = F.struct((F.xxhash64("a", F.lit(n)) if n % 2 else F.lit(0)).alias("o"), F.col("a").alias("b"))
        parents = materialise(both.select(F.col("a").alias("node"), F.least("m", own)["b"].alias("parent")), "parents")
        for _ in range(JUMPS):
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
            parents = parents.join(above, "parent").select("node", F.col("_above").alias("parent"))
        parents = materialise(parents, "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            up = parents.select(F.col("node").alias("label"), "parent")
            labels = materialise(labels.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        links = links.join(pa, "a").join(pb, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a != b").distinct()
        links, n = materialise(links, "links"), n + 1
        if links.isEmpty():
            least = labels.groupBy("label").agg(F.min("node").alias("least"))
            return labels.join(least, "label").select("node", F.col("least").alias("label"))
