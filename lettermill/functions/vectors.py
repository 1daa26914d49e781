"""Vector expressions on ``ARRAY<FLOAT>`` columns; arithmetic is DOUBLE."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equally long vectors."""

    def gap(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda total, x: total + x)


def relevance(distance2: Column) -> Column:
    """Relevance of a hit: 1 - d2 / sqrt(2); negative for far vectors."""
    return 1.0 - distance2 / F.lit(math.sqrt(2.0))
