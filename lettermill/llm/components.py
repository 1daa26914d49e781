"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node it is joined to.

    In a round every node takes the smallest of itself and its neighbours as its parent
    (counted map-side, so a centre with very many edges is a few rows per task); parents
    are followed to the root by doubling; then edges are drawn between roots only and those
    inside one tree are gone. Few edges are left for a second round, so all rounds together
    read little more than the first. Every step is written: a lost executor costs one step.
    """
    left, _ = written(_ordered(edges, "a", "b"), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        parents, _ = written(
            both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
            "parents",
        )
        roots = _followed(parents)
        rounds.append(roots)
        ends = left.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b")
        left, _ = written(_ordered(ends, "root_a", "root_b"), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = rounds[0]
    for later in rounds[1:]:
        found = found.join(later.toDF("label", "next"), "label", "left").select(
            "node", F.coalesce("next", "label").alias("label")
        )
    return written(found, "components")[0]


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge once, from the smaller to the larger end, without loops."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _followed(parents: DataFrame) -> DataFrame:
    """(node, label) with every label a root, by jumps of doubled length."""
    while True:
        jump = parents.toDF("label", "next")
        after, _ = written(
            parents.join(jump, "label").select("node", F.col("label").alias("old"), F.col("next").alias("label")), "parents"
        )
        done = after.where("old != label").isEmpty()
        parents = after.select("node", "label")
        if done:
            return parents
