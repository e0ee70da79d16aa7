"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _larger_to_smallest(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours link to the smallest node that it sees, itself included."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _smaller_to_smallest(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours link to the smallest of them.  Links have ``a > b`` here."""
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def stars(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` but the roots: the smallest node it can reach.

    A round is two joins on the node.  Minima combine before they move; they are written before they are
    joined, so that Spark can split the joins at a node with very many links.  Rounds grow with the logarithm of a component's size.  Every round is
    written, so a lost executor never costs earlier rounds.  An empty table gives an empty result; links
    to itself and repeated links do no harm.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, before = written(links.distinct(), "links"), None
    while True:
        stars_now = _smaller_to_smallest(_larger_to_smallest(links)).where("a <> b").distinct()
        links = written(stars_now, "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
