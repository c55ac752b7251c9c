"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.common import discard, written


def _step(edges: DataFrame) -> DataFrame:
    """Every node's neighbours move to its least neighbour. Least ones come from a pre-aggregated groupBy, so that a
    node with very many neighbours is no single task's group; the joins may be split by skew."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(down.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(a, b) links -> node, root: the least node of its component. Nodes without links don't appear.

    Each round is written to the shared folder and read back; the number of rounds grows with the logarithm of the size.
    """
    print_of = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), label)
    seen = print_of(now)
    while True:
        # A step leaves as many links as it finds, at most.
        before, now = now, written(_step(now), label, seen[0])
        discard(before)
        new = print_of(now)
        if new == seen:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        seen = new
