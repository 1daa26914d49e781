"""MAUVE-style divergence of two text sets over shared cells."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DIVERGENCE_POINTS, DIVERGENCE_SCALE


def kmeans_cells(
    df: DataFrame, vector: str, cells: int, seed: int = 41, out: str = "cell"
) -> DataFrame:
    """Quantise vectors of both sets together."""
    ready = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol=out).fit(ready)
    return model.transform(ready).drop("_v")


def mauve(df: DataFrame, cell: str, is_first: Column) -> DataFrame:
    """One row: (mauve, n_p, n_q) for set P (``is_first`` true) against Q.

    Rows are counted per cell, each cell gives its term for every weight of the grid,
    and terms are summed per weight: only as many rows as weights are ever gathered.
    """
    counts = df.groupBy(cell).agg(
        F.count(F.when(is_first, 1)).alias("p"), F.count(F.when(~is_first, 1)).alias("q")
    )
    totals = counts.agg(F.sum("p").alias("n_p"), F.sum("q").alias("n_q"))
    last = DIVERGENCE_POINTS - 1
    grid = [1e-6 + (1 - 2e-6) * i / last for i in range(DIVERGENCE_POINTS)]
    p, q = F.col("p") / F.col("n_p"), F.col("q") / F.col("n_q")
    mixed = F.col("w") * p + (1 - F.col("w")) * q

    def kl(own: Column) -> Column:
        return F.sum(F.when(own > 0, own * F.ln(own / mixed)).otherwise(0.0))

    points = (
        counts.crossJoin(F.broadcast(totals))
        .select("p", "q", "n_p", "n_q", F.posexplode(F.array(*map(F.lit, grid))).alias("i", "w"))
        .groupBy("n_p", "n_q", "i")
        .agg(F.exp(-DIVERGENCE_SCALE * kl(q)).alias("x"), F.exp(-DIVERGENCE_SCALE * kl(p)).alias("y"))
    )
    # 25 points plus the two end points (1, 0) and (0, 1), in order of the weight.
    curve = points.groupBy("n_p", "n_q").agg(
        F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("inner")
    )
    def end(i: int, x: float, y: float) -> Column:
        return F.array(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")))

    whole = curve.withColumn(
        "c", F.concat(end(-1, 1.0, 0.0), F.col("inner"), end(DIVERGENCE_POINTS, 0.0, 1.0))
    )

    def area(a: str, b: str) -> Column:
        steps = F.sequence(F.lit(0), F.size("c") - 2)
        return F.aggregate(
            steps,
            F.lit(0.0),
            lambda s, i: s
            + F.abs(F.get("c", i + 1)[a] - F.get("c", i)[a])
            * (F.get("c", i + 1)[b] + F.get("c", i)[b])
            / 2,
        )

    return whole.select(
        ((area("x", "y") + area("y", "x")) / 2).alias("mauve"), "n_p", "n_q"
    )
