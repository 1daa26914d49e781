"""All nearest-neighbour strategies against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.operators import retrieval as R


def frames(spark, queries, chunks):
    def df(rows, name):
        data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
        return spark.createDataFrame(data, f"{name} bigint, vector array<float>")

    return df(queries, "query_id"), df(chunks, "chunk_id")


def brute(queries, chunks, k):
    q = np.asarray(queries, dtype=np.float32).astype(float)
    c = np.asarray(chunks, dtype=np.float32).astype(float)
    out = set()
    for i, v in enumerate(q):
        d2 = ((c - v) ** 2).sum(axis=1)
        order = sorted(range(len(c)), key=lambda j: (d2[j], j))[:k]
        out |= {(i, j, r + 1, round(float(d2[j]), 6)) for r, j in enumerate(order)}
    return out


def found(hits):
    return {(r.query_id, r.chunk_id, r["rank"], round(r.distance2, 6)) for r in hits.collect()}


def clustered(seed, n, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 6)) * 10
    rows = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, 6))
    if copies:
        rows[rng.permutation(n)[:copies]] = rows[0]
    return rows


WAYS = [{}, {"broadcast_bytes": 0, "block_rows": 16}, {"broadcast_bytes": 0, "cells": 3, "block_rows": 7}]


@pytest.mark.parametrize("way", WAYS)
def test_exact_ways_equal_brute_force(spark, way):
    queries, chunks = clustered(1, 60), clustered(2, 150)
    got = R.nearest(*frames(spark, queries, chunks), 4, **way)
    assert found(got) == brute(queries, chunks, 4)


@pytest.mark.parametrize("way", WAYS)
def test_a_third_of_all_vectors_are_copies(spark, way):
    rows = clustered(3, 120, copies=40)
    got = R.nearest(*frames(spark, rows, rows), 5, **way)
    assert found(got) == brute(rows, rows, 5)


@pytest.mark.parametrize("way", WAYS)
def test_fewer_chunks_than_k(spark, way):
    queries, chunks = clustered(4, 5), clustered(5, 3)
    got = R.nearest(*frames(spark, queries, chunks), 10, **way)
    assert found(got) == brute(queries, chunks, 10)


def test_all_probes_are_exact_and_more_probes_find_more(spark):
    rows = clustered(6, 260)  # queries come from the clusters of the chunks
    queries, chunks = rows[:60], rows[60:]
    q, c = frames(spark, queries, chunks)
    want = {(a, b) for a, b, _, _ in brute(queries, chunks, 10)}
    recall = []
    for probes in (1, 3, 8):
        hits = R.nearest(q, c, 10, cells=8, probes=probes)
        recall.append(len({(a, b) for a, b, _, _ in found(hits)} & want) / len(want))
    assert recall == sorted(recall) and recall[-1] == 1.0 and recall[1] >= 0.9


def test_string_ids_and_ranks(spark):
    q = spark.createDataFrame([("q", [0.0, 0.0])], "query_id string, vector array<float>")
    c = spark.createDataFrame(
        [("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.5, 0.0])],
        "chunk_id string, vector array<float>",
    )
    for way in WAYS:
        rows = R.nearest(q, c, 3, **way).orderBy("rank").collect()
        assert [r.chunk_id for r in rows] == ["z", "a", "b"]
        assert rows[0].score == pytest.approx(1 - 0.25 / math.sqrt(2))


def test_empty_store_has_no_hits(spark):
    q, c = frames(spark, [[1.0, 2.0]], [[1.0, 2.0]])
    hits = R.nearest(q, c.where("chunk_id < 0"), 3)
    assert hits.count() == 0 and hits.columns[:2] == ["query_id", "chunk_id"]
    assert R.no_hits(q).count() == 0


def test_threshold_applies_after_top_k(spark):
    q, c = frames(spark, [[0.0, 0.0]], [[0.1, 0.0], [1.0, 0.0], [3.0, 0.0]])
    hits = R.above_threshold(R.nearest(q, c, 2), 0.2)
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == [0, 1]
    assert R.above_threshold(R.nearest(q, c, 3), 0.9).count() == 1


def test_neighbours_drop_contained_and_keep_rows(spark):
    rows = spark.createDataFrame(
        [(1, "alpha beta", [0.0, 0.0]), (2, "beta", [0.0, 0.1]), (3, "gamma", [9.0, 9.0])],
        "id bigint, text string, vector array<float>",
    )
    chunks = rows.withColumnRenamed("id", "chunk_id")
    hits = R.nearest(rows, chunks.where("chunk_id < 3"), 2, query_id="id")
    payload = F.struct(F.col("text").alias("email"))
    got = {
        r.id: [h.serialized_email.email for h in r.relevant_emails]
        for r in R.with_neighbours(
            rows, hits, chunks, "id", "text", "chunk_id", "text", payload
        ).collect()
    }
    assert got == {1: [], 2: ["alpha beta"], 3: ["beta", "alpha beta"]}
    own = F.col("id") == F.col("chunk_id")
    got = R.with_neighbours(
        rows, hits, chunks, "id", "text", "chunk_id", "text", payload,
        drop_contained=False, exclude_self=own,
    ).collect()
    assert {r.id: len(r.relevant_emails) for r in got} == {1: 1, 2: 1, 3: 2}
    scores = [h.score for r in got for h in r.relevant_emails if r.id == 3]
    assert scores == sorted(scores, reverse=True)


def test_results_do_not_depend_on_partitioning(spark):
    rows = clustered(8, 80, copies=20)
    q, c = frames(spark, rows, rows)
    a = found(R.nearest(q.repartition(1), c.repartition(9), 3, broadcast_bytes=0, block_rows=10))
    b = found(R.nearest(q.repartition(16), c.repartition(1), 3))
    assert a == b


def test_nearest_pivot_through_the_tree():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 20
    pivots = np.concatenate([c + rng.normal(size=(20, 8)) for c in centres] + [np.zeros((2, 8))])
    vectors = np.concatenate([pivots[:40], rng.normal(size=(60, 8)) * 15])
    cell, reach = R.nearest_pivot(vectors, pivots, R.pivot_tree(pivots))
    d2 = ((vectors[:, None] - pivots[None]) ** 2).sum(axis=2)
    assert (cell == d2.argmin(axis=1)).all() and np.allclose(reach, np.sqrt(d2.min(axis=1)))


def test_odd_chunk_vectors(spark):
    """Rows without a vector match nothing, also in first place; uneven ones are an error."""
    kind = "id string, vector array<float>"
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None), ("empty", [])], kind)
    chunks = spark.createDataFrame([("a", None), ("b", []), ("c", [1.0, 0.5])], kind)
    hits = R.nearest(
        queries.withColumnRenamed("id", "query_id"), chunks.withColumnRenamed("id", "chunk_id"), 2
    )
    assert [(r.query_id, r.chunk_id) for r in hits.collect()] == [("q", "c")]
    uneven = chunks.union(spark.createDataFrame([("d", [1.0])], kind)).withColumnRenamed("id", "chunk_id")
    with pytest.raises(ValueError):
        R.nearest(queries.withColumnRenamed("id", "query_id"), uneven, 2)


def routed(n, seed=11, k=5):
    """(pairs measured, visits) of n clustered queries against sqrt(n) pivots of n chunks."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(40, 6))[rng.integers(0, 40, n)] * 10 + rng.normal(size=(n, 6)) * 0.3
    pivots = rows[: math.isqrt(n)]
    tree = R.pivot_tree(pivots)
    cell, dist = R.nearest_pivot(rows, pivots, tree)
    filled = np.bincount(cell, minlength=len(pivots))
    reach = np.full(len(pivots), -np.inf)
    np.maximum.at(reach, cell, dist)
    gaps = R._gaps(rows, tree[0])
    bound, first = R.k_bounds(rows, pivots, tree, reach, filled, k, gaps)
    who, cells, _, then = R.pivots_within(rows, pivots, tree, reach, bound, gaps)
    return rows, cell, bound, set(zip(who.tolist(), cells.tolist())), gaps[0].size + first + then, k


def test_routing_keeps_every_cell_that_matters():
    rows, cell, bound, visits, _, k = routed(900)
    for i, v in enumerate(rows[::7]):
        d = np.sqrt(((rows - v) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[:k]
        assert d[near[-1]] <= bound[7 * i]
        assert all((7 * i, int(cell[j])) in visits for j in near)


def test_queries_do_not_meet_all_pivots():
    sizes = (2_500, 10_000, 40_000)
    measured = [routed(n)[4] for n in sizes]
    # All pivots would be n * sqrt(n) pairs, 8 times as many for 4 times the vectors.
    assert measured[2] < 40_000 * 200 * 0.7
    assert all(b < 7 * a for a, b in zip(measured, measured[1:]))


def test_no_pivots_are_wanted_where_cells_are_empty():
    pivots = np.eye(4)
    reach = np.array([0.5, -np.inf, 0.5, -np.inf])
    who, cells, _, _ = R.pivots_within(np.zeros((2, 4)), pivots, R.pivot_tree(pivots), reach, np.full(2, np.inf))
    assert sorted(zip(who, cells)) == [(0, 0), (0, 2), (1, 0), (1, 2)]


@pytest.mark.parametrize("recall", [0.5, 0.9, 1.0])
def test_search_with_measured_recall(spark, recall):
    rows = clustered(8, 400)
    q, c = frames(spark, rows, rows)
    sample = q.where(F.col("query_id") % 20 == 0)
    search = R.recalling(sample, c, 6, recall=recall, cells=20)
    exact = R.nearest(sample, c, 6)
    counted = R.found_of(search(sample, c, 6), exact).agg(F.sum("n_found"), F.sum("n_exact")).first()
    assert counted[1] == 120 and counted[0] >= recall * counted[1]
    if recall == 1.0:
        assert found(search(sample, c, 6)) == found(exact)


def test_recall_of_nothing(spark):
    q, c = frames(spark, clustered(9, 30), clustered(10, 30))
    search = R.recalling(q.limit(0), c, 3, cells=4)
    assert search.slack == pytest.approx(0, abs=1e-6)
    assert search(q, c, 3).groupBy("query_id").count().count() == 30
    with pytest.raises(ValueError, match="keep 3 ids"):
        search(q, c, 4)


def test_products_in_single_precision_lose_nothing():
    rng = np.random.default_rng(5)
    for scale, shift in ((1.0, 0.0), (1e-18, 0.0), (1.0, 1e4), (1e16, 0.0)):
        chunks = rng.normal(size=(1500, 16)) * scale + shift * scale
        chunks[700:760] = chunks[3]
        queries = np.concatenate([chunks[::50], rng.normal(size=(20, 16)) * scale])
        rows, cols, d2 = R.block_top_k(queries, chunks, 4)
        every = ((queries[:, None] - chunks[None]) ** 2).sum(axis=2)
        want = np.argsort(every, axis=1, kind="stable")[:, :4]
        assert (cols.reshape(-1, 4) == want).all(), (scale, shift)


def test_a_query_is_not_sent_once_per_cell():
    """Vectors without structure: every cell can hold a hit, but a query meets few blocks."""
    rng = np.random.default_rng(6)
    pivots = rng.normal(size=(400, 32))
    filled = rng.integers(0, 200, 400)
    cells = R.Cells(None, pivots, np.ones(400), filled, 5)
    home, most = R.cell_blocks(cells, 16)
    held = np.bincount(home, weights=filled)
    assert held.max() <= most and len(held) <= 2 * R.BLOCKS
    filled[7] = 10**6
    home, most = R.cell_blocks(cells, 16)
    assert most == -(-filled.sum() // R.BLOCKS) and filled[home == home[7]].sum() == filled[7]


def test_few_queries_against_many_chunks(spark):
    rows = clustered(12, 300, copies=20)
    q, c = frames(spark, rows, rows)
    few = q.where("query_id < 9").unionByName(q.where("query_id = 3"))
    want = found(R.nearest(few, c, 6))
    size = 1 << 13  # the chunks do not fit, these queries do
    plan = R.nearest(few, c.repartition(5), 6, broadcast_bytes=size)
    assert "cogroup" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found(plan) == want


def test_chunks_are_repeated_per_large_group_of_queries(spark, monkeypatch):
    """Groups of queries are larger than blocks of chunks; hits stay those of brute force."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(400, 4)).astype("float32"), rng.normal(size=(300, 4)).astype("float32")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "query_id long, vector array<float>")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "chunk_id long, vector array<float>")
    seen, real = [], R.block_top_k

    def made(rows, schema=None, **options):
        if schema == "block int, chunk_blocks int, query_blocks int":
            seen.extend(rows)
        return original(rows, schema, **options)

    original = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *args, **options: made(*args, **options))
    hits = R.nearest(queries, chunks, 3, broadcast_bytes=0, cells=4, block_rows=100).collect()
    assert seen and max(n for _, _, n in seen) == 1
    rows, cols, _ = real(a.astype(float), b.astype(float), 3)
    assert sorted((h.query_id, h.chunk_id) for h in hits) == sorted(zip(rows.tolist(), cols.tolist()))


def test_broadcast_matrix_is_single_precision(spark, monkeypatch):
    """The shared matrix is half as large; distances are those of double precision."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(20, 5)).astype("float32"), rng.normal(size=(2000, 5)).astype("float32")
    single, double = R.block_top_k(a.astype(float), b, 3), R.block_top_k(a.astype(float), b.astype(float), 3)
    assert all((x == y).all() for x, y in zip(single, double)) and single[2].dtype == np.float64
    queries = spark.createDataFrame([(1, a[0].tolist())], "query_id long, vector array<float>")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b[:9])], "chunk_id long, vector array<float>")
    kinds, original = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(
        type(spark.sparkContext), "broadcast", lambda self, value: kinds.append(value[1].dtype) or original(self, value)
    )
    assert R.nearest(queries, chunks, 3).count() == 3
    assert kinds == [np.float32]
