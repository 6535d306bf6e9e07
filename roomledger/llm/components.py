"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.sources.tables import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b); all nodes of a component share their root.

    In each round a node points at its least neighbour or itself, pointers are followed once more, and
    both ends of every link are replaced by what they point at. Links inside a group vanish, so the
    tables shrink until none is left. A node with very many links is one row per task before the
    shuffle, and every join has unique keys on one side. Each round is a written table.
    """
    edges = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(),
        "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        next_to = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
        to = materialize(to.join(next_to, "to").select("node", F.col("further").alias("to")), "pointers")
        left = to.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(left, "a").join(right, "b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = materialize(moved.filter("a < b").distinct(), "links")
        step = to.select(F.col("node").alias("root"), "to")
        roots = materialize(
            roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return roots
