"""Exact-size train/test splits and samples without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SEED
from .ordering import find_cut, hash_keys, not_after


def _first_rows(df: DataFrame, keys: list[Column], rank: int, total: int) -> Column:
    """A predicate true for exactly the first ``rank`` of ``total`` rows."""
    if rank <= 0:
        return F.lit(False)
    if rank >= total:
        return F.lit(True)
    return not_after(keys, find_cut(df, keys, rank))


def split_train_test(
    df: DataFrame,
    id_col: str,
    test_split: float,
    split_type: str = "random",
    order_key: Column | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: 'train' for the first int(n * (1 - test_split)) rows, else 'test'.

    Row order is md5(seed:id) for ``random``; ``order_key`` (a BIGINT such as
    epoch microseconds) and then the id for ``chronological``. The result is a
    narrow projection with a literal bound. ``test_split`` 0 uses every row for
    both parts. Ids must be unique.
    """
    if split_type not in ("random", "chronological"):
        raise ValueError(f"unknown split type {split_type!r}")
    if test_split == 0:
        both = F.array(F.lit("train"), F.lit("test"))
        return df.withColumn("split", F.explode(both))
    if split_type == "random":
        keys = hash_keys(F.col(id_col), seed)
    else:
        if order_key is None:
            raise ValueError("a chronological split needs an order key")
        numeric = dict(df.dtypes)[id_col] in ("int", "bigint", "smallint", "tinyint")
        ties = [F.col(id_col)] if numeric else hash_keys(F.col(id_col), seed)
        keys = [order_key, *ties]
    total = df.count()
    in_train = _first_rows(df, keys, int(total * (1 - test_split)), total)
    return df.withColumn("split", F.when(in_train, F.lit("train")).otherwise(F.lit("test")))


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same ones on every run."""
    keys = hash_keys(F.col(id_col), seed)
    return df.where(_first_rows(df, keys, n, df.count()))


def leaked_bodies(split: DataFrame, text_col: str) -> DataFrame:
    """Bodies that occur in both parts: (body_md5, n_train, n_test)."""
    return (
        split.groupBy(F.md5(F.col(text_col)).alias("body_md5"))
        .agg(
            F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
            F.count(F.when(F.col("split") == "test", 1)).alias("n_test"),
        )
        .where((F.col("n_train") > 0) & (F.col("n_test") > 0))
    )
