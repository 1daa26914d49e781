"""Order-based operators that stay distributed however uneven the groups are.

A window over one group puts the whole group in one task. Groups of more than
``rows_per_task`` rows are therefore cut into ranges of their rows in order: a range
partitioning by (group, order) samples the keys, so ranges hold similar numbers of rows
whatever the keys look like. Windows run over (group, range), and only what has to cross
a range border travels separately. Groups may have NULL keys. The order key must be
unique within its group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_TASK = 1 << 16
BROADCAST_KEYS = 1_000_000
FINISH_ROWS = 100_000
RADIX_BITS = 16


def same_keys_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of ``left`` stay."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def _ranged(df: DataFrame, group: list[str], order: str, rows_per_task: int) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ``_range``, and the rows of groups that have several ranges (or None).

    Counting reads the group columns only. A group that fits one task has range 0.
    """
    heavy = df.groupBy(*group).count().where(F.col("count") > rows_per_task)
    found = cut_lineage(heavy)
    total = found.agg(F.sum("count")).first()[0]
    if total is None:
        return df.withColumn("_range", F.lit(0)), None
    keys = found.select(*group)
    parts = -(-total // rows_per_task) + 1
    split = cut_lineage(
        same_keys_join(df, keys, group, "left_semi")
        .repartitionByRange(parts, *group, order)
        .withColumn("_range", F.spark_partition_id())
    )
    rest = same_keys_join(df, keys, group, "left_anti").withColumn("_range", F.lit(0))
    return rest.unionByName(split), split


def previous_in_group(
    df: DataFrame,
    group: list[str],
    order: str,
    value: Column,
    outs: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``outs``: ``value`` one, two, ... rows before in the same group, else NULL."""
    n = len(outs)
    ranged, wide = _ranged(df.withColumn("_value", value), group, order, rows_per_task)
    w = Window.partitionBy(*group, "_range").orderBy(order)
    inside = ranged.select(
        "*",
        F.row_number().over(w).alias("_place"),
        *[F.lag("_value", i).over(w).alias(f"_lag{i}") for i in range(1, n + 1)],
    )
    if wide is None:
        return inside.select(*df.columns, *[F.col(f"_lag{i}").alias(out) for i, out in enumerate(outs, 1)])
    # The last n values of every range; a range may be shorter than n.
    tails = (
        first_in_group(wide, [*group, "_range"], [F.col(order).desc()], n)
        .groupBy(*group, "_range")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "_value"))).alias("_tail"))
    )
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(-n, -1)
    carried = tails.select(
        *group, "_range", F.flatten(F.reverse(F.collect_list("_tail").over(before))).alias("_carried")
    )
    place = F.col("_place")
    joined = same_keys_join(inside, carried, [*group, "_range"], "left")
    found = [
        F.when(place <= i, F.get("_carried", F.lit(i) - place)["_value"])
        .otherwise(F.col(f"_lag{i}"))
        .alias(out)
        for i, out in enumerate(outs, 1)
    ]
    return joined.select(*df.columns, *found)


def rank_in_group(
    df: DataFrame, group: list[str], order: str, out: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``out``: the 0-based position of a row within its group."""
    ranged, wide = _ranged(df, group, order, rows_per_task)
    w = Window.partitionBy(*group, "_range").orderBy(order)
    inside = ranged.withColumn("_inside", F.row_number().over(w) - 1)
    if wide is None:
        return inside.withColumn(out, F.col("_inside").cast("bigint")).drop("_range", "_inside")
    before = (
        Window.partitionBy(*group)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        wide.groupBy(*group, "_range")
        .count()
        .select(*group, "_range", F.sum("count").over(before).alias("_before"))
    )
    return (
        same_keys_join(inside, offsets, [*group, "_range"], "left")
        .withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0)))
        .drop("_range", "_inside", "_before")
    )


def first_in_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group with their 1-based ``rank``.

    Spark prunes to n rows per group before and after the shuffle, so no task
    sees more than n rows of a group per input partition. It does so for n up to
    spark.sql.optimizer.windowGroupLimitThreshold (1000 unless set).
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def uneven_join(
    many: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` (few keys may own most rows) to ``table`` on ``keys``.

    A key with more than ``rows_per_task`` rows is spread over as many tasks as it needs
    by a hash of ``spread_by``, and only its rows of ``table`` are repeated. The list of
    such keys has at most rows / rows_per_task entries; its size is checked before it is
    broadcast. Rows without a key match nothing and are spread too. ``counts`` are the rows
    of ``many`` per key as ``count``, where a caller has them already.
    """
    heavy = cut_lineage(
        (many.groupBy(*keys).count() if counts is None else counts)
        .where(F.col("count") > rows_per_task)
        .select(*keys, F.ceil(F.col("count") / rows_per_task).cast("int").alias("_salts"))
        .dropna()
    )
    known = F.broadcast(heavy) if heavy.count() <= BROADCAST_KEYS else heavy
    hashed = F.xxhash64(*spread_by)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.when(no_key, F.pmod(hashed, F.lit(1 << 20))).otherwise(
        F.pmod(hashed, F.coalesce("_salts", F.lit(1)))
    )
    salted = many.join(known, keys, "left").withColumn("_salt", salt.cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    repeated = table.join(known, keys, "left").withColumn("_salt", every)
    return salted.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def hash_keys(value: Column, seed: int) -> list[Column]:
    """Two BIGINT keys that order rows like ``md5(seed:value)`` does."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))
    return [
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"),
        F.conv(F.substring(digest, 16, 15), 16, 10).cast("bigint"),
    ]


def not_after(keys: list[Column], cut: tuple[int, ...]) -> Column:
    """Lexicographic ``keys <= cut``."""
    result = F.lit(True)
    for key, limit in reversed(list(zip(keys, cut))):
        result = (key < F.lit(limit)) | ((key == F.lit(limit)) & result)
    return result


def find_cut(df: DataFrame, keys: list[Column], rank: int) -> tuple[int, ...]:
    """The key tuple of the ``rank``-th row (1-based) in ascending key order.

    Radix selection instead of a global sort: each pass counts rows per leading
    bits of the current key (at most 2**RADIX_BITS counters reach the driver),
    picks the counter that holds the wanted rank and narrows to it. No row is
    shuffled; a pass reads the key columns only. Once few rows remain they are
    ordered directly.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[k.cast("bigint").alias(n) for k, n in zip(keys, names)])
    fixed: list[tuple[str, int]] = []
    for name in names:
        here = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), fixed, base)
        low, high, rows = here.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        while low < high:
            if rows <= FINISH_ROWS:
                left = here.where(F.col(name).between(low, high))
                top = left.orderBy(*names).limit(rank)
                row = top.agg(F.max(F.struct(*names)).alias("k")).first()["k"]
                return tuple(row[n] for n in names)
            shift = max(0, (high ^ low).bit_length() - RADIX_BITS)
            slot = F.shiftright(F.col(name), shift)
            counts = (
                here.where(F.col(name).between(low, high))
                .groupBy(slot.alias("slot"))
                .count()
                .orderBy("slot")
                .collect()
            )
            for slot_value, rows in counts:
                if rank <= rows:
                    break
                rank -= rows
            low = max(low, slot_value << shift)
            high = min(high, ((slot_value + 1) << shift) - 1)
        fixed.append((name, low))
    return tuple(v for _, v in fixed)
