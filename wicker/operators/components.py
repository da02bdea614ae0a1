"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.session import checkpoint_folder


def saved(df: DataFrame) -> DataFrame:
    """The rows, cut from their lineage, in the checkpoint folder that the cluster names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an undirected graph; root is the smallest of its component.

    Alternates two contractions until nothing changes: each node's larger
    neighbours, then its smaller ones, are hung under the smallest of them. The
    number of rounds grows with the logarithm of the longest chain. The driver
    sees one count and one checksum a round. Loops and repeated edges are
    allowed; no edges give no rows.
    """
    now = saved(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = saved(small.filter("a <> b").distinct())
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == mark:
            roots = now.select("b").distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
        mark = seen
