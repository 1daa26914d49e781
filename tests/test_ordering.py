"""Distributed ordering against plain Python, with uneven groups and far-apart keys."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lettermill.functions.dates import parse_iso, sort_micros
from lettermill.operators import ordering, splitting
from lettermill.operators.threads import thread_head, thread_rows


@pytest.fixture(scope="module")
def uneven(spark):
    """One group owns a third of the rows; keys cross several ranges."""
    rng = random.Random(3)
    rows = []
    for group in range(21):
        n = 200 if group == 0 else 20
        keys = rng.sample(range(-200_000, 400_000), n)
        rows += [(group, k, f"{group}/{k}") for k in keys]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g int, k bigint, v string")


def by_group(rows):
    groups = {}
    for g, k, v in sorted(rows):
        groups.setdefault(g, []).append((k, v))
    return groups


def test_previous_in_group(uneven):
    rows, df = uneven
    got = ordering.previous_in_group(df, ["g"], "k", F.col("v"), ["p1", "p2", "p3"])
    want = set()
    for g, items in by_group(rows).items():
        vs = [None, None, None] + [v for _, v in items]
        for i, (k, _) in enumerate(items):
            want.add((g, k, vs[i + 2], vs[i + 1], vs[i]))
    assert {(r.g, r.k, r.p1, r.p2, r.p3) for r in got.collect()} == want


def test_rank_in_group(uneven):
    rows, df = uneven
    got = {(r.g, r.k): r.r for r in ordering.rank_in_group(df, ["g"], "k", "r").collect()}
    want = {(g, k): i for g, items in by_group(rows).items() for i, (k, _) in enumerate(items)}
    assert got == want


def test_thread_head_and_rows(uneven):
    rows, df = uneven
    whole = {(r.g, r.k): r.n_before for r in thread_rows(df, "g", "k").collect()}
    groups = by_group(rows)
    assert whole == {(g, k): i for g, vs in groups.items() for i, (k, _) in enumerate(vs)}
    got = thread_head(df, "g", "k", "v", 2).collect()
    groups = by_group(rows)
    assert len(got) == len(rows)
    for r in got:
        earlier = [v for k, v in groups[r.g] if k < r.k]
        assert (r.n_before, r.thread) == (len(earlier), earlier[:2])


@pytest.mark.parametrize("how", ["left", "inner"])
def test_uneven_join_equals_join(spark, how):
    rng = random.Random(5)
    many = [(0 if rng.random() < 0.4 else rng.randint(1, 60), i) for i in range(6000)]
    table = [(k, f"t{k}") for k in range(0, 50)]
    left = spark.createDataFrame(many, "k int, i int")
    right = spark.createDataFrame(table, "k int, t string")
    got = ordering.uneven_join(left, right, ["k"], ["i"], how, rows_per_task=300).collect()
    want = left.join(right, "k", how).collect()
    assert sorted((r.k, r.i, str(r.t)) for r in got) == sorted((r.k, r.i, str(r.t)) for r in want)


@pytest.mark.parametrize("finish", [0, 5, 100_000])
def test_find_cut_is_the_ranked_row(spark, monkeypatch, finish):
    monkeypatch.setattr(ordering, "FINISH_ROWS", finish)
    monkeypatch.setattr(ordering, "RADIX_BITS", 4)
    rng = random.Random(1)
    # A third of all rows share one first key; extremes of the domain occur.
    rows = [(7 if rng.random() < 0.33 else rng.randint(-(2**62), 2**62), i) for i in range(400)]
    rows += [(-(2**63), 400), (2**63 - 1, 401)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    ordered = sorted(rows)
    for rank in (1, 2, 57, 200, 260, 401, 402):
        cut = ordering.find_cut(df, [F.col("a"), F.col("b")], rank)
        below = df.where(ordering.not_after([F.col("a"), F.col("b")], cut)).count()
        assert below == rank
        assert ordered[rank - 1][: len(cut)] == cut


def test_random_split_is_exact_and_hash_ordered(spark):
    df = spark.range(500).withColumn("t", F.lit("x"))
    got = splitting.split_train_test(df, "id", 0.3, seed=41).collect()
    order = sorted(range(500), key=lambda i: hashlib.md5(f"41:{i}".encode()).hexdigest())
    assert {r.id for r in got if r.split == "train"} == set(order[: int(500 * (1 - 0.3))])
    assert len(got) == 500


@pytest.mark.parametrize("n, test, train", [(10, 0.9, 0), (10, 1.0, 0), (10, 0.05, 9), (3, 0.5, 1)])
def test_split_sizes_round_down(spark, n, test, train):
    got = splitting.split_train_test(spark.range(n), "id", test).where("split = 'train'").count()
    assert got == train == int(n * (1 - test))


def test_chronological_split_with_missing_and_equal_dates(spark):
    rows = [(0, None), (1, "2024-01-02T00:00:00+02:00"), (2, "2024-01-01T23:30:00"), (3, None)]
    rows += [(i, "2024-01-01T00:00:00Z") for i in range(4, 8)]
    df = spark.createDataFrame(rows, "id int, d string").withColumn("date", parse_iso(F.col("d")))
    got = splitting.split_train_test(
        df, "id", 0.5, "chronological", sort_micros(F.col("date"))
    ).collect()
    assert {r.id for r in got if r.split == "train"} == {0, 3, 4, 5}


def test_split_with_string_ids(spark):
    df = spark.createDataFrame([(f"m{i}", 0) for i in range(40)], "id string, d bigint")
    got = splitting.split_train_test(df, "id", 0.25, "chronological", F.col("d"))
    assert got.where("split = 'train'").count() == 30


def test_zero_split_uses_all_rows_twice(spark):
    got = splitting.split_train_test(spark.range(4), "id", 0).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 4, "test": 4}


def test_unknown_split_type_raises(spark):
    with pytest.raises(ValueError):
        splitting.split_train_test(spark.range(4), "id", 0.5, "sideways")


def test_sample_is_exact_and_repeatable(spark):
    a = {r.id for r in splitting.sample_exact(spark.range(300), "id", 128).collect()}
    b = {r.id for r in splitting.sample_exact(spark.range(300).repartition(7), "id", 128).collect()}
    assert len(a) == 128 and a == b
    assert splitting.sample_exact(spark.range(5), "id", 128).count() == 5


def test_leaks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "t string, split string")
    (row,) = splitting.leaked_bodies(df, "t").collect()
    assert (row.n_train, row.n_test) == (1, 1)


@pytest.mark.parametrize("rows_per_task", [7, 64, 10_000])
def test_ranges_hold_counted_rows(spark, rows_per_task):
    """Time-stamp keys far apart, NULL groups, one group with a third of all rows."""
    rng = random.Random(8)
    stamps = rng.sample(range(10**15, 2 * 10**15), 600)
    rows = [(None if i < 200 else i % 40, k, f"v{k}") for i, k in enumerate(stamps)]
    df = spark.createDataFrame(rows, "g int, k bigint, v string").repartition(4)
    groups = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((k, v))
    ranks = {(r.g, r.k): r.n for r in ordering.rank_in_group(df, ["g"], "k", "n", rows_per_task).collect()}
    assert ranks == {(g, k): i for g, vs in groups.items() for i, (k, _) in enumerate(vs)}
    outs = ["p1", "p2"]
    before = ordering.previous_in_group(df, ["g"], "k", F.col("v"), outs, rows_per_task).collect()
    for r in before:
        place = ranks[(r.g, r.k)]
        vs = [v for _, v in groups[r.g]]
        assert (r.p1, r.p2) == tuple(vs[place - i] if place >= i else None for i in (1, 2))
    if rows_per_task == 7:
        ranged, _ = ordering._ranged(df, ["g"], "k", rows_per_task)
        assert ranged.groupBy("g", "_range").count().agg(F.max("count")).first()[0] <= 5 * rows_per_task


def test_uneven_join_with_many_heavy_keys(spark):
    """More than a thousand heavy keys, and a key that owns 30 % of the rows."""
    many = spark.range(30_000).select(
        F.when(F.col("id") % 10 < 3, -1).when(F.col("id") % 97 == 5, F.lit(None)).otherwise(F.col("id") % 1200).cast("int").alias("k"),
        F.col("id").cast("int").alias("i"),
    )
    table = spark.range(-1, 1100).select(F.col("id").cast("int").alias("k"), F.col("id").cast("string").alias("t"))
    got = ordering.uneven_join(many, table, ["k"], ["i"], "left", rows_per_task=10)
    want = many.join(table, "k", "left")
    assert got.count() == want.count() == 30_000 and got.exceptAll(want.select(got.columns)).isEmpty()
