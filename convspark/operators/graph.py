"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    ``links`` has two columns of the same orderable type. Large-star and small-star steps alternate until the links no
    longer change: every node then points at its root. Each step takes a minimum per node, which combines map-side, and
    joins it back to the links of the node. Both sides of these joins are checkpoints in the shared folder, so neither is
    tied to the partitions of an aggregate, and the links of a hub are split at run time. Links with a null end and links
    from a node to itself are ignored.
    """
    left, right = links.columns
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    edges = cut_lineage(edges.filter(links[left].isNotNull() & links[right].isNotNull() & (F.col("a") != F.col("b"))).distinct())
    seen = _state(edges)
    while seen[0]:
        both = edges.union(edges.select("b", "a"))
        low = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")))
        large = both.join(low, "a").filter(F.col("b") > F.col("a"))
        large = cut_lineage(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select("b", "m").filter(F.col("b") != F.col("m")))
        edges = cut_lineage(small.distinct())
        now = _state(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
