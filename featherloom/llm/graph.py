"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, gathered


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v")


def _written(edges: DataFrame) -> tuple[DataFrame, int, tuple]:
    """The edges, their number, and what tells them from another round's."""
    out, seen = counted(edges, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash"))
    return out, seen["n"], (seen["n"], seen["hash"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node with a link to another: comp is the smallest node that can be reached.

    Nodes are integers; repeated links and links of a node to itself change nothing; no links give no rows. Each round
    is written to the checkpoint folder. A node with many links is aggregated in part before the shuffle, and the
    joins that follow can be split by adaptive execution. A round never has more links than the first, whose number decides
    how many parts they stand in.
    """
    edges, n, seen = _written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    edges, before = gathered(edges, n), None
    while seen != before and n:
        before = seen
        large = gathered(gathered(_large_star(edges), n).distinct(), n)
        edges, _, seen = _written(gathered(gathered(_small_star(large), n).distinct(), n))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
