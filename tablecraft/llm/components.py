"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.storage import cut

LINKS_PER_TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node of its component. Large-star and small-star rounds: each
    hangs the neighbours of a node on the smallest of them, by a combined minimum and a join that can be split, until nothing moves.
    The work of a round is in proportion to the links, and rounds grow with the logarithm of the longest chain."""

    def packed(edges: DataFrame, n: int) -> DataFrame:
        """As many tasks as the links need, so that rounds over few links leave few files."""
        return edges.coalesce(n // LINKS_PER_TASK + 1)

    def both(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size, state = edges.count(), None
    while True:
        edges = packed(edges, size)
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = packed(large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), size)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b")))
        edges = cut(packed(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), size))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        size, state = now[0], now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
