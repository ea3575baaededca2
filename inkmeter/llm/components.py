"""Connected components of a table of links, by alternating large and small stars.

Each round joins every node's links with its least neighbour; the hot side of a join is a written table, so
adaptive execution can split a node that a great many links share. Nothing is collected but two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the least node that each linked node reaches, itself included.

    Links may repeat and stand in either direction; nulls and links of a node to itself are ignored. Nodes
    without a link aren't listed. No links give an empty table.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stable(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high, low).distinct(), "links")
    while True:
        heads = edges.select(F.col("v").alias("u")).distinct()
        both = edges.join(heads, "u", "left_semi").limit(1).count()
        if not both and not edges.groupBy("u").count().filter("count > 1").limit(1).count():
            break
        # large star: every larger neighbour of a node is linked to the least neighbour
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stable(sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        big = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stable(big.distinct(), "large-star")
        # small star: every smaller neighbour of a node, and the node, are linked to the least one
        least = stable(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


class UnionFind:
    """Classes of integers, each named by its least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while x != root:
            p[x], x = root, p.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
