"""k-nearest-neighbour joins and what is done with the hits.

``nearest`` has several ways, none of which pairs every query with every chunk in
one task or emits more than k hits per query and block:

* broadcast: the chunk vectors were counted and fit BROADCAST_BYTES. Queries
  are not shuffled at all.
* few queries: their vectors fit FEW_QUERIES and BROADCAST_BYTES. Chunks are not shuffled; a
  task keeps the k nearest of its chunks.
* blocks, exact: chunk vectors are grouped around pivots; a query is sent only
  to blocks with cells that, by the triangle inequality, can hold one of its k nearest.
  Neighbouring cells share a block, and a block grows with the table up to BLOCK_MOST rows:
  vectors without structure meet in about BLOCKS x BLOCKS pairs of blocks, and a query is
  sent at most BLOCKS times, not once per cell. Larger cells are several blocks.
* blocks with ``slack``: approximate, with a recall that was measured. A query visits every
  cell whose pivot is at most ``slack`` farther than its nearest pivot; ``calibrate``
  finds the least slack that reaches the wanted recall on queries with exact answers.
* blocks with ``probes``: approximate, a query visits that many nearest cells.

Queries find their cells through a tree of centres over the pivots (``pivots_within``), so
a query is measured against the pivots of the centres that can matter, not against all.

Copies of one vector are folded before anything is compared: only the k smallest
ids of equal vectors can be among the k nearest, and equal queries share hits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import RELEVANCE_THRESHOLD
from ..functions.vectors import relevance
from ..session import cut_lineage, shuffles_freed
from .ordering import BROADCAST_KEYS, first_in_group, uneven_join

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 2048
FEW_QUERIES = 1 << 14
FEW_HITS = 1 << 18
BLOCKS = 32
BLOCK_MOST = 1 << 15
QUERY_GROUP = 4
FOUND_ROWS = 1 << 24
PIVOT_BYTES = 64 << 20
HEAD_BYTES = 16
DIGEST_BYTES = 16
HITS_AT_ONCE = 64
_BASE = 0x9E3779B97F4A7C15
_CELLS_AT_ONCE = 2_000_000
_GROUP = 64


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _halves(chunks: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """(-2 c, |c|^2) as columns in single precision, filled up to whole groups; None if too large for it."""
    if not norms.max() < 1e30:
        return None
    padded = np.zeros((chunks.shape[1] + 1, -(-len(chunks) // _GROUP) * _GROUP), dtype=np.float32)
    np.multiply(chunks.T, -2.0, out=padded[:-1, : len(chunks)], casting="same_kind")
    padded[-1, : len(chunks)], padded[-1, len(chunks) :] = norms, np.inf
    return padded


def _may_be_near(queries: np.ndarray, norms: np.ndarray, halves: np.ndarray, chunk_norms: np.ndarray, k: int):
    """(query row, chunk row) of all pairs that can be among the k nearest; None if too many.

    The minima of k groups of chunks are k chunks, so the k-th smallest minimum bounds the k-th
    distance and only the groups below it are looked into. Products are in single precision;
    what they may be off by is allowed for.
    """
    if not norms.max() < 1e30:
        return None
    asked = np.ones((len(queries), len(halves)), dtype=np.float32)
    asked[:, :-1] = queries
    estimate = (asked @ halves).reshape(len(queries), -1, _GROUP)
    least = estimate.min(axis=2)
    off = 2.4e-7 * (len(halves) + 4) * (norms + chunk_norms.max()) + 1e-30
    limit = (np.partition(least, k - 1, axis=1)[:, k - 1] + 2.0 * off).astype(np.float32)
    limit = np.nextafter(limit, np.float32(np.inf))
    rows, groups = np.nonzero(least <= limit[:, None])
    if len(rows) > 4 * (k + 8) * len(queries):
        return None
    at, place = np.nonzero(estimate[rows, groups] <= limit[rows][:, None])
    cols = groups[at] * _GROUP + place
    real = cols < len(chunk_norms)
    return rows[at][real], cols[real]


def block_top_k(queries: np.ndarray, chunks: np.ndarray, k: int):
    """Top k of every query against one block; chunk rows must be in id order.

    Chunks may be of single precision; they are measured in double precision all the same.

    Distances are estimated by one matrix product; all rows the estimate cannot
    exclude are measured again directly, so equal vectors tie exactly. Returns
    (query row, chunk row, squared distance).
    """
    found = []
    chunk_norms = np.einsum("ij,ij->i", chunks, chunks, dtype=np.float64)
    step = max(1, _CELLS_AT_ONCE // max(1, len(chunks)))
    halves = _halves(chunks, chunk_norms) if len(chunks) > 4 * k * _GROUP else None
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        norms = (part * part).sum(axis=1)
        may = _may_be_near(part, norms, halves, chunk_norms, k) if halves is not None else None
        if may is None:
            estimate = norms[:, None] + chunk_norms[None, :] - 2.0 * (part @ chunks.T)
        if may is not None:
            rows, cols = may
        elif len(chunks) > k:
            kth = np.partition(estimate, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * (1.0 + norms + chunk_norms.max())
            rows, cols = np.nonzero(estimate <= (kth + slack)[:, None])
        else:
            rows, cols = (a.ravel() for a in np.indices(estimate.shape))
        d2 = np.empty(len(rows))
        pairs = max(1, _CELLS_AT_ONCE // max(1, chunks.shape[1]))
        for at in range(0, len(rows), pairs):
            gap = part[rows[at : at + pairs]] - chunks[cols[at : at + pairs]]
            d2[at : at + pairs] = (gap * gap).sum(axis=1)
        order = np.lexsort((cols, d2, rows))
        rows, cols, d2 = rows[order], cols[order], d2[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        found.append((rows[keep] + start, cols[keep], d2[keep]))
    if not found:
        return (np.empty(0, int), np.empty(0, int), np.empty(0))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _broadcast_hits(queries: DataFrame, few: pd.DataFrame, k: int, types) -> DataFrame:
    """Every query against a small chunk matrix: a narrow map over the queries."""
    few = few.sort_values("cid", kind="stable").reset_index(drop=True)
    # Vectors are of single precision: as such they are exact and half as large in every worker.
    shared = queries.sparkSession.sparkContext.broadcast(
        (few["cid"].to_numpy(), np.stack(few["v"].to_numpy()).astype(np.float32))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for batch in batches:
            if len(batch) == 0:
                continue
            rows, cols, d2 = block_top_k(_matrix(batch["v"]), matrix, k)
            yield pd.DataFrame(
                {
                    "qid": batch["qid"].to_numpy()[rows],
                    "cid": ids[cols],
                    "rank": (np.arange(len(rows)) - np.searchsorted(rows, rows) + 1).astype("int32"),
                    "d2": d2,
                }
            )

    return queries.mapInPandas(search, f"qid {types[0]}, cid {types[1]}, rank int, d2 double")


def _few_queries_hits(queries: DataFrame, chunks: DataFrame, k: int, types) -> DataFrame:
    """Every chunk against a few queries: a narrow map over the chunks, k hits per query and task."""
    spark = queries.sparkSession
    few = queries.toPandas()
    shared = spark.sparkContext.broadcast(_matrix(few["v"]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if len(batch) == 0:
                continue
            batch = batch.sort_values("cid", kind="stable")
            rows, cols, d2 = block_top_k(shared.value, _matrix(batch["v"]), k)
            new = pd.DataFrame({"row": rows, "cid": batch["cid"].to_numpy()[cols], "d2": d2})
            if best is not None:
                both = pd.concat([best, new]).sort_values(["row", "d2", "cid"], kind="stable")
                new = both.groupby("row", sort=False).head(k)
            best = new
        if best is not None:
            yield best

    found = chunks.mapInPandas(search, f"row bigint, cid {types[1]}, d2 double")
    best = first_in_group(found, ["row"], [F.col("d2"), F.col("cid")], k)
    ids = spark.createDataFrame(list(enumerate(few["qid"].tolist())), f"row bigint, qid {types[0]}")
    return best.join(F.broadcast(ids), "row").select("qid", "cid", "rank", "d2")


def pivot_tree(pivots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """About sqrt(p) of the pivots as centres, the pivots nearest to each, their radius."""
    centres = pivots[:: max(1, math.isqrt(len(pivots)))]
    _, owner, d2 = block_top_k(pivots, centres, 1)
    owned = [np.flatnonzero(owner == c) for c in range(len(centres))]
    return centres, owned, np.array([np.sqrt(d2[o].max()) if len(o) else -np.inf for o in owned])


def nearest_pivot(vectors: np.ndarray, pivots: np.ndarray, tree) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every vector and its distance; the first of equally near ones.

    A centre's pivots are looked at only by the vectors for which, by the triangle
    inequality, one of them can be nearer than the best so far: about 2 sqrt(p)
    comparisons where vectors are clustered.
    """
    centres, owned, radius = tree
    norms, own_norms = (vectors**2).sum(axis=1), (centres**2).sum(axis=1)
    square = norms[:, None] + own_norms[None, :] - 2.0 * (vectors @ centres.T)
    slack = 1e-6 * (1.0 + np.sqrt(norms + own_norms.max()))  # of a distance by products
    gap = np.sqrt(np.maximum(square, 0.0))
    cell = np.full(len(vectors), len(pivots), dtype=np.int64)
    best = np.full(len(vectors), np.inf)

    def look(rows: np.ndarray, c: int) -> None:
        _, found, d2 = block_top_k(vectors[rows], pivots[owned[c]], 1)
        found = owned[c][found]
        better = (d2 < best[rows]) | ((d2 == best[rows]) & (found < cell[rows]))
        cell[rows[better]], best[rows[better]] = found[better], d2[better]

    own = gap.argmin(axis=1)
    for c in range(len(centres)):
        rows = np.flatnonzero(own == c)
        if len(rows) and len(owned[c]):
            look(rows, c)
    for c in range(len(centres)):
        may = (gap[:, c] - radius[c] <= np.sqrt(best) + slack) & (own != c)
        if len(owned[c]) and may.any():
            look(np.flatnonzero(may), c)
    return cell.astype(np.int32), np.sqrt(best)


def _nearest_pivot(groups: DataFrame, pivots: np.ndarray, id_type: str) -> DataFrame:
    shared = groups.sparkSession.sparkContext.broadcast((pivots, pivot_tree(pivots)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            cell, reach = nearest_pivot(_matrix(batch["v"]), *shared.value)
            yield batch.assign(cell=cell, reach=reach)

    return groups.mapInPandas(
        assign,
        f"rep {id_type}, ids array<{id_type}>, v array<float>, no bigint, cell int, reach double",
    )


def _gaps(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances by matrix products, and what each may be off by."""
    norms, own = (vectors**2).sum(axis=1), (centres**2).sum(axis=1)
    square = norms[:, None] + own[None, :] - 2.0 * (vectors @ centres.T)
    return np.sqrt(np.maximum(square, 0.0)), 1e-6 * (1.0 + np.sqrt(norms + own.max(initial=0.0)))


def pivots_within(
    vectors: np.ndarray, pivots: np.ndarray, tree, reach: np.ndarray, limit: np.ndarray, gaps=None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All (vector, pivot) with distance - reach[pivot] <= limit[vector], their distances, and
    the number of pairs that were measured.

    By the triangle inequality a centre is skipped if none of its pivots can satisfy that.
    Pivots with a reach of -inf are never wanted. ``gaps`` are those to the centres, if known.
    """
    centres, owned, _ = tree
    gap, off = gaps or _gaps(vectors, centres)
    rows, cols, dist, measured = [], [], [], 0 if gaps else gap.size
    for c, mine in enumerate(owned):
        mine = mine[reach[mine] > -np.inf]
        if not len(mine):
            continue
        to_pivot = np.sqrt(((pivots[mine] - centres[c]) ** 2).sum(axis=1))
        may = np.flatnonzero(gap[:, c] - (to_pivot + reach[mine]).max() <= limit + off)
        step = max(1, _CELLS_AT_ONCE // len(mine))
        for at in range(0, len(may), step):
            part = may[at : at + step]
            d, slip = _gaps(vectors[part], pivots[mine])
            r, m = np.nonzero(d - reach[mine] <= (limit[part] + slip)[:, None])
            measured += d.size
            rows.append(part[r])
            cols.append(mine[m])
            dist.append(d[r, m])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), measured
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist), measured


def k_bounds(
    vectors: np.ndarray, pivots: np.ndarray, tree, reach: np.ndarray, filled: np.ndarray, k: int, gaps=None
) -> tuple[np.ndarray, int]:
    """For every vector a distance within which k chunk vectors certainly are (inf if there
    are fewer), and the number of (vector, pivot) pairs measured.

    First by centres: nearest-first ones whose cells together hold k vectors. Then by the
    pivots of the nearest centre: k pivots are k vectors, and so are cells that hold k.
    """
    centres, owned, _ = tree
    held = np.array([filled[o].sum() for o in owned])
    span = np.full(len(centres), -np.inf)
    for c, mine in enumerate(owned):
        if held[c]:
            span[c] = (np.sqrt(((pivots[mine] - centres[c]) ** 2).sum(axis=1)) + reach[mine]).max()
    gap, off = gaps or _gaps(vectors, centres)
    order = np.argsort(gap, axis=1)
    enough = held[order].cumsum(axis=1) >= k
    worst = np.maximum.accumulate(np.take_along_axis(gap, order, 1) + span[order], axis=1)
    first = enough.argmax(axis=1)
    everyone = np.arange(len(vectors))
    bound = np.where(enough.any(axis=1), worst[everyone, first], np.inf)
    own, measured = order[:, 0] if len(centres) else np.zeros(len(vectors), int), 0 if gaps else gap.size
    for c, mine in enumerate(owned):
        rows, mine = np.flatnonzero(own == c), mine[filled[mine] > 0]
        step = max(1, _CELLS_AT_ONCE // max(1, len(mine)))
        for at in range(0, len(rows) if len(mine) else 0, step):
            part = rows[at : at + step]
            d, _ = _gaps(vectors[part], pivots[mine])
            measured += d.size
            if len(mine) >= k:
                bound[part] = np.minimum(bound[part], np.partition(d, k - 1, axis=1)[:, k - 1])
            far = d + reach[mine]
            by = np.argsort(far, axis=1)
            has = filled[mine][by].cumsum(axis=1) >= k
            at_k = np.take_along_axis(far, by, 1)[np.arange(len(part)), has.argmax(axis=1)]
            bound[part] = np.where(has.any(axis=1), np.minimum(bound[part], at_k), bound[part])
    return bound + off, measured


@dataclass(frozen=True)
class Cells:
    """Chunk vectors grouped around pivots: what a search by cells needs."""

    assigned: DataFrame  # rep, ids, v, no, cell, reach: one row per distinct vector, numbered
    pivots: np.ndarray
    reach: np.ndarray  # distance of a cell's farthest vector, -inf where it has none
    filled: np.ndarray  # distinct vectors in a cell
    k: int  # ids kept of equal vectors


def chunk_cells(chunks: DataFrame, k: int, wanted: int, id_type: str) -> Cells:
    """``wanted`` cells of (cid, v)."""
    few_copies = first_in_group(chunks, ["v"], [F.col("cid")], k)
    groups = cut_lineage(
        few_copies.groupBy("v")
        .agg(F.sort_array(F.collect_list("cid")).alias("ids"))
        .select(F.element_at("ids", 1).alias("rep"), "ids", "v", F.monotonically_increasing_id().alias("no"))
    )
    picked = groups.orderBy(F.md5(F.col("rep").cast("string")), "rep").limit(wanted)
    pivots = _matrix(picked.select("v").toPandas()["v"])
    assigned = cut_lineage(_nearest_pivot(groups, pivots, id_type))
    reach, filled = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)), F.max("reach")).collect()  # a row per pivot
    for cell, n, far in sizes:
        reach[cell], filled[cell] = far, n
    return Cells(assigned, pivots, reach, filled, k)


def cell_blocks(cells: Cells, block_rows: int) -> tuple[np.ndarray, int]:
    """The block of every cell, and how many rows a block may have.

    Cells under one centre follow each other and fill a block; a larger cell has its own.
    """
    most = max(block_rows, min(-(-int(cells.filled.sum()) // BLOCKS), BLOCK_MOST))
    home, block, rows = np.zeros(len(cells.pivots), dtype=np.int32), 0, 0
    for cell in np.concatenate(pivot_tree(cells.pivots)[1]):
        if rows and rows + cells.filled[cell] > most:
            block, rows = block + 1, 0
        home[cell], rows = block, rows + cells.filled[cell]
    return home, most


def _visit(
    queries: DataFrame, cells: Cells, k: int, probes: int | None, slack: float | None, id_type: str, home: np.ndarray
) -> DataFrame:
    """Add ``blocks``: where a query has to look. ``home`` is the block of every cell."""
    shared = queries.sparkSession.sparkContext.broadcast(
        (cells.pivots, pivot_tree(cells.pivots), cells.reach, cells.filled)
    )

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, tree, reach, filled = shared.value
        for batch in batches:
            if len(batch) == 0:
                continue
            vectors = _matrix(batch["v"])
            if probes is not None:
                rows, cols, _ = block_top_k(vectors, pivots, probes)
            elif slack is not None:
                _, near = nearest_pivot(vectors, pivots, tree)
                none = np.where(filled > 0, 0.0, -np.inf)
                rows, cols, _, _ = pivots_within(vectors, pivots, tree, none, near + slack)
            else:
                gaps = _gaps(vectors, tree[0])
                bound, _ = k_bounds(vectors, pivots, tree, reach, filled, k, gaps)
                rows, cols, _, _ = pivots_within(vectors, pivots, tree, reach, bound, gaps)
            width = int(home.max()) + 1
            rows, blocks = np.divmod(np.unique(rows.astype(np.int64) * width + home[cols]), width)
            picked = np.split(blocks.astype(np.int32), np.searchsorted(rows, np.arange(1, len(vectors))))
            yield batch.assign(blocks=picked)

    return queries.mapInPandas(choose, f"rep {id_type}, v array<float>, blocks array<int>")


def calibrate(cells: Cells, queries: DataFrame, exact: DataFrame, recall: float) -> float:
    """The least slack with which the share ``recall`` of all exact hits is in a visited cell.

    ``queries`` are (qid, v), ``exact`` their exact hits (qid, cid). For every hit it is
    asked how much farther its cell's pivot is than the query's nearest pivot.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((cells.pivots, pivot_tree(cells.pivots)))

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, tree = shared.value
        for batch in batches:
            if len(batch) == 0:
                continue
            vectors = _matrix(batch["v"])
            _, near = nearest_pivot(vectors, pivots, tree)
            own = np.sqrt(((vectors - pivots[batch["cell"].to_numpy()]) ** 2).sum(axis=1))
            yield pd.DataFrame({"gap": np.maximum(own - near, 0.0)})

    homes = cells.assigned.select(F.explode("ids").alias("cid"), "cell")
    asked = exact.select("qid", "cid").join(homes, "cid").join(queries, "qid").select("v", "cell")
    found = asked.mapInPandas(gaps, "gap double").agg(
        F.expr(f"percentile_disc({float(recall)}) WITHIN GROUP (ORDER BY gap)")
    )
    least = found.first()[0]
    return 1e-9 + (least or 0.0)


def cells_wanted(n_chunks: int, width: int) -> int:
    """About sqrt(n) cells. What bounds their number is the broadcast of the pivots alone:
    64 MiB are 131 072 cells of 64 dimensions."""
    return max(1, min(math.isqrt(n_chunks), PIVOT_BYTES // (8 * max(1, width))))


def _block_hits(queries: DataFrame, cells: Cells, k: int, probes, slack, block_rows, types) -> DataFrame:
    q_type, c_type = types
    spark = queries.sparkSession
    assigned, filled = cells.assigned, cells.filled
    distinct = queries.groupBy("v").agg(F.min("qid").alias("rep")).select("rep", "v")
    # An approximate search promises certain cells, so each is a block of its own.
    home = np.arange(len(filled), dtype=np.int32)
    if probes is None and slack is None:
        home, block_rows = cell_blocks(cells, block_rows)
    # Chunks are repeated per group of queries, so these groups are larger than blocks of chunks.
    query_rows = max(block_rows, min(QUERY_GROUP * block_rows, BLOCK_MOST))
    held = np.bincount(home, weights=filled).astype(np.int64)
    routed = cut_lineage(_visit(distinct, cells, k, probes, slack, q_type, home))
    visits = routed.select("rep", "v", F.explode("blocks").alias("block"))
    visitors = dict(visits.groupBy("block").count().collect())
    # One row per pivot cell.
    homes = spark.createDataFrame([(c, int(b)) for c, b in enumerate(home)], "cell int, block int")
    sizes = [
        (b, -(-int(n) // block_rows), -(-int(visitors.get(b, 0)) // query_rows))
        for b, n in enumerate(held)
        if n and visitors.get(b, 0)
    ]

    def block(id_col: str, of: str) -> Column:
        return F.pmod(F.xxhash64(id_col), F.col(of).cast("bigint")).cast("int")

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(c) == 0:
            return pd.DataFrame({"qid": [], "rep": [], "no": [], "d2": []})
        c = c.sort_values("rep", kind="stable")
        rows, cols, d2 = block_top_k(_matrix(q["v"]), _matrix(c["v"]), k)
        return pd.DataFrame(
            {
                "qid": q["qid"].to_numpy()[rows],
                "rep": c["rep"].to_numpy()[cols],
                "no": c["no"].to_numpy()[cols],
                "d2": d2,
            }
        )

    def best_of(some: list[tuple[int, int, int]]) -> DataFrame:
        key = ["block", "qb", "cb"]
        several = F.broadcast(spark.createDataFrame(some, "block int, chunk_blocks int, query_blocks int"))
        left = (
            visits.join(several, "block")
            .withColumn("qb", block("rep", "query_blocks"))
            .withColumn("cb", each("chunk_blocks"))
            .select(*key, F.col("rep").alias("qid"), "v")
        )
        right = (
            assigned.join(F.broadcast(homes), "cell")
            .join(several, "block")
            .withColumn("cb", block("rep", "chunk_blocks"))
            .withColumn("qb", each("query_blocks"))
            .select(*key, "rep", "no", "v")
        )
        found = (
            left.groupBy(*key)
            .cogroup(right.groupBy(*key))
            .applyInPandas(search, f"qid {q_type}, rep {c_type}, no bigint, d2 double")
        )
        return first_in_group(found, ["qid"], [F.col("d2"), F.col("rep")], k).drop("rank")

    # Every visit finds k vectors: some blocks at a time, so that what is shuffled for them fits
    # the disk whatever the number of queries. Ids of equal vectors are looked up for the best alone.
    rounds = max(1, -(-sum(visitors.get(b, 0) for b, _, _ in sizes) * k // FOUND_ROWS))
    with shuffles_freed(spark):
        parts = [cut_lineage(best_of(sizes[at::rounds])) for at in range(min(rounds, len(sizes)) or 1)]
        best = parts[0]
        if len(parts) > 1:
            every = reduce(DataFrame.unionByName, parts)
            best = cut_lineage(first_in_group(every, ["qid"], [F.col("d2"), F.col("rep")], k).drop("rank"))
        named = uneven_join(best, assigned.select("no", "ids"), ["no"], ["qid"], how="inner")
    ids = named.select("qid", F.explode("ids").alias("cid"), "d2")
    hits = first_in_group(ids, ["qid"], [F.col("d2"), F.col("cid")], k)
    # Back from distinct query vectors to all queries: at most k hits per vector.
    packed = hits.groupBy(F.col("qid").alias("rep")).agg(
        F.collect_list(F.struct("cid", "rank", "d2")).alias("hits")
    )
    by_vector = packed.join(routed.select("rep", "v"), "rep").select("v", "hits")
    return (
        uneven_join(queries, by_vector, ["v"], ["qid"], how="inner")
        .select("qid", F.explode("hits").alias("h"))
        .select("qid", "h.cid", "h.rank", "h.d2")
    )


def _are_few(queries: DataFrame, k: int, broadcast_bytes: int) -> bool:
    size = F.size("v") * 8 + F.octet_length(F.col("qid").cast("string"))
    n, total = queries.agg(F.count(F.lit(1)), F.sum(size)).first()
    return 0 < n <= min(FEW_QUERIES, FEW_HITS // k) and total is not None and total <= broadcast_bytes


def nearest(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "vector",
    probes: int | None = None,
    cells: int | Cells | None = None,
    slack: float | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, chunk_id, rank, distance2, score): the k nearest chunks per query.

    Ordered by squared Euclidean distance, then chunk id. Exact unless ``probes`` (cells
    visited per query) or ``slack`` (from ``calibrate``) is given. ``cells`` is their number,
    or ``Cells`` made before. An empty chunk table gives no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    vectors = F.col(vector).cast("array<float>").alias("v")
    q = queries.select(F.col(query_id).alias("qid"), vectors)
    c = chunks.select(F.col(chunk_id).alias("cid"), vectors)
    types = dict(q.dtypes)["qid"], dict(c.dtypes)["cid"]
    # Rows without a vector (NULL or empty) match nothing; uneven ones are an error.
    q, c = (df.where(F.coalesce(F.size("v"), F.lit(0)) > 0) for df in (q, c))
    n_chunks, low, width, size = c.agg(
        F.count(F.lit(1)),
        F.min(F.size("v")),
        F.max(F.size("v")),
        F.sum(F.size("v") * 8 + F.octet_length(F.col("cid").cast("string"))),
    ).first()
    if n_chunks == 0:
        return no_hits(queries, query_id, chunk_id, types)
    if low != width:
        raise ValueError(f"chunk vectors have from {low} to {width} numbers")
    if probes is None and slack is None and size <= broadcast_bytes:
        few = first_in_group(c, ["v"], [F.col("cid")], k).select("cid", "v").toPandas()
        hits = _broadcast_hits(q, few, k, types)
    elif probes is None and slack is None and cells is None and _are_few(q, k, broadcast_bytes):
        hits = _few_queries_hits(q, c, k, types)
    else:
        if not isinstance(cells, Cells):
            cells = chunk_cells(c, k, cells or cells_wanted(n_chunks, width), types[1])
        elif cells.k < k:
            raise ValueError(f"these cells keep {cells.k} ids of equal vectors, {k} are asked for")
        hits = _block_hits(q, cells, k, probes, slack, block_rows, types)
    return hits.select(
        F.col("qid").alias(query_id),
        F.col("cid").alias(chunk_id),
        "rank",
        F.col("d2").alias("distance2"),
        relevance(F.col("d2")).alias("score"),
    )


@dataclass(frozen=True)
class Recalling:
    """Approximate search whose recall was measured: call it like ``nearest``."""

    cells: Cells
    slack: float

    def __call__(self, queries: DataFrame, chunks: DataFrame, k: int, **options) -> DataFrame:
        return nearest(queries, chunks, k, **{"cells": self.cells, "slack": self.slack, **options})


def recalling(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    recall: float = 0.9,
    cells: int | None = None,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "vector",
) -> Recalling:
    """An approximate search over ``chunks`` that finds the share ``recall`` of the k nearest
    of ``queries``: a bounded sample of the queries to come, answered exactly to calibrate it."""
    vectors = F.col(vector).cast("array<float>").alias("v")
    c = chunks.select(F.col(chunk_id).alias("cid"), vectors).where(F.coalesce(F.size("v"), F.lit(0)) > 0)
    n, width = c.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    made = chunk_cells(c, k, cells or cells_wanted(n, width or 1), dict(c.dtypes)["cid"])
    exact = nearest(queries, chunks, k, query_id, chunk_id, vector)
    asked = queries.select(F.col(query_id).alias("qid"), vectors)
    hits = exact.select(F.col(query_id).alias("qid"), F.col(chunk_id).alias("cid"))
    return Recalling(made, calibrate(made, asked, hits, recall))


def found_of(hits: DataFrame, exact: DataFrame, query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """(query_id, n_exact, n_found): how many of the exact hits a search has found."""
    got = hits.select(query_id, chunk_id, F.lit(1).alias("got"))
    return (
        exact.select(query_id, chunk_id)
        .join(got, [query_id, chunk_id], "left")
        .groupBy(query_id)
        .agg(F.count(F.lit(1)).alias("n_exact"), F.count("got").alias("n_found"))
    )


#: What finds chunks for queries: the arguments of ``nearest``, its hit table.
Retriever = Callable[..., DataFrame]


def never(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id", **_) -> DataFrame:
    """A retriever that finds nothing."""
    return no_hits(queries, query_id, chunk_id, (dict(queries.dtypes)[query_id], dict(chunks.dtypes)[chunk_id]))


def no_hits(
    queries: DataFrame,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    types: tuple[str, str] | None = None,
) -> DataFrame:
    """The hit table of a retriever that never finds anything."""
    q_type, c_type = types or (dict(queries.dtypes)[query_id], "string")
    return queries.sparkSession.createDataFrame(
        [],
        f"{query_id} {q_type}, {chunk_id} {c_type}, rank int, distance2 double, score double",
    )


def above_threshold(hits: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """Drop hits below a score after the top-k; nothing is refilled."""
    return hits.where(F.col("score") >= threshold)


def not_contained(query_text: Column, chunk_text: Column) -> Column:
    """True for a hit whose chunk is no part of the query text."""
    return ~F.contains(query_text, chunk_text)


class _Windows:
    """Polynomial hashes of the windows of a text, modulo 2^64: products and sums wrap around.

    A text's print is the sum of byte[j] * base^j. The base is odd, so it has an inverse, and
    the print of any window is a difference of two running sums times a power of it.
    """

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def sums(self, text: bytes) -> np.ndarray:
        n = len(text)
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            self.powers, self.inverse = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
                for base in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(np.frombuffer(text, np.uint8) * self.powers[:n], out=out[1:])
        return out

    def places(self, sums: np.ndarray, size: int, print_: int) -> np.ndarray:
        """Where windows of ``size`` bytes have that print: wherever a text with it is, and
        hardly anywhere else."""
        n = len(sums) - size
        return np.flatnonzero((sums[size:] - sums[:n]) * self.inverse[:n] == np.uint64(print_))


def text_marks(windows: _Windows, text: bytes) -> tuple[int, bytes, int, bytes]:
    """(bytes, first bytes, print, digest) of a text: enough to find it in another one."""
    own = int(windows.sums(text)[-1])
    digest = hashlib.sha256(text).digest()[:DIGEST_BYTES]
    return len(text), text[:HEAD_BYTES], own - (own >> 63 << 64), digest


def holds(windows: _Windows, text: bytes, marks: list[tuple[int, bytes, int, bytes]]) -> list[bool]:
    """For each of the marks whether ``text`` contains the text they are of.

    A window counts if its SHA-256 digest is the same; first bytes and prints only tell which
    windows to digest, so that a text is read a few times at most for each of the marks.
    """
    sums, found = None, []
    for size, head, own, digest in marks:
        inside = size <= len(text) and head in text
        if inside and size > HEAD_BYTES:
            sums = windows.sums(text) if sums is None else sums
            inside = any(
                hashlib.sha256(text[at : at + size]).digest()[:DIGEST_BYTES] == digest
                for at in windows.places(sums, size, own & (1 << 64) - 1).tolist()
            )
        found.append(inside)
    return found


MARKS = "size int, head binary, print bigint, digest binary"


def marked(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _mark) of every row that has a text."""
    kind = dict(texts.dtypes)[id_col]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows()
        for batch in batches:
            rows = [text_marks(windows, text.as_py()) for text in batch.column("_text")]
            columns = [batch.column("_id"), *([r[i] for r in rows] for i in range(4))]
            types = (batch.schema.field("_id").type, pa.int32(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)],
                names=["_id", "size", "head", "print", "digest"],
            )

    rows = texts.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    marks = rows.where(F.col("_text").isNotNull()).mapInArrow(mark, f"_id {kind}, {MARKS}")
    return marks.select(F.col("_id").alias(id_col), F.struct("size", "head", "print", "digest").alias("_mark"))


def contained(text: Column, marks: Column) -> Column:
    """ARRAY<BOOLEAN>: which of an array of marks belong to texts that are in ``text``."""

    @F.arrow_udf("array<boolean>")
    def look(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        windows = _Windows()
        for asked, sought in batches:
            yield pa.array(
                [
                    holds(windows, t.as_py(), [(m["size"], m["head"], m["print"], m["digest"]) for m in ms.as_py()])
                    for t, ms in zip(asked, sought)
                ],
                pa.list_(pa.bool_()),
            )

    return look.asNondeterministic()(text.cast("binary"), marks)


def _kept(hits: DataFrame, marks: DataFrame, words: DataFrame, query_id: str, chunk_id: str, wide: int) -> DataFrame:
    """``hits`` whose chunk is no part of the query's text.

    A hit travels with the marks of its chunk, not with its text, and a query's text meets
    HITS_AT_ONCE hits at a time: per hit some hundred bytes are shuffled, per query one text.
    """
    # A chunk may be near to very many queries, so its copies are spread.
    told = uneven_join(hits, marks, [chunk_id], [query_id], how="inner")
    part = [F.floor(F.col("rank") / HITS_AT_ONCE).alias("_part")] if wide > HITS_AT_ONCE else []
    packs = told.groupBy(query_id, *part).agg(F.collect_list(F.struct(*hits.columns, "_mark")).alias("_hits"))
    asked = packs.join(words, query_id).select("_hits", contained(F.col("_asked"), F.col("_hits._mark")).alias("_in"))
    each = asked.select(F.explode(F.arrays_zip("_hits", "_in")).alias("_hit")).where(~F.col("_hit._in"))
    return each.select(*[F.col("_hit")["_hits"][c].alias(c) for c in hits.columns])


def nearest_kept(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    query_text: str,
    chunk_text: str,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "vector",
    exclude_self: Column | None = None,
    search: Callable[..., DataFrame] | None = None,
    widen: int = 4,
    query_texts: DataFrame | None = None,
    chunk_texts: DataFrame | None = None,
) -> DataFrame:
    """The k nearest chunks per query that are no part of the query's own text.

    Filtering a top k leaves fewer; here the rows that lost hits are searched again with
    ``widen`` times as many, until k are left or the chunk table ends. Rows that are full
    leave the search. Columns as of ``nearest``, ranks counted anew.
    ``exclude_self`` is a predicate over the id columns of hits to be left out as well.
    ``query_texts`` and ``chunk_texts`` are tables with the ids and texts, where ``queries``
    and ``chunks`` do not have the texts themselves.
    """
    search = search or nearest
    spark = queries.sparkSession
    words = (queries if query_texts is None else query_texts).select(query_id, F.col(query_text).alias("_asked"))
    words = words.where(F.col("_asked").isNotNull())
    texts = chunks if chunk_texts is None else chunk_texts
    with shuffles_freed(spark):
        n_chunks = chunks.count()
        marks = cut_lineage(marked(texts, chunk_id, chunk_text))
        open_rows, open_words, wide, done = queries, words, max(k + 1, k * widen // 2), []
        while True:
            last = wide >= n_chunks
            hits = cut_lineage(search(open_rows, chunks, min(wide, max(n_chunks, 1)), query_id=query_id, chunk_id=chunk_id, vector=vector))
            if exclude_self is not None:
                hits = hits.where(~exclude_self)
            kept = cut_lineage(_kept(hits, marks, open_words, query_id, chunk_id, wide))
            full = kept.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(query_id)
            done.append(kept if last else kept.join(full, query_id, "left_semi"))
            if last:
                break
            # Rows without an id or a text keep nothing however wide they look.
            still = cut_lineage(open_words.select(query_id).join(full, query_id, "left_anti").distinct())
            n_open = still.count()
            if n_open == 0:
                break
            few = F.broadcast(still) if n_open <= BROADCAST_KEYS else still
            open_rows, open_words = (df.join(few, query_id, "left_semi") for df in (queries, words))
            wide *= widen
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    order = rows.withColumnRenamed("rank", "_rank")
    return first_in_group(order, [query_id], [F.col("_rank")], k).select(
        query_id, chunk_id, "rank", "distance2", "score"
    )


def with_neighbours(
    rows: DataFrame,
    hits: DataFrame,
    chunks: DataFrame,
    row_id: str,
    row_text: str,
    chunk_id: str,
    chunk_text: str,
    payload: Column,
    out: str = "relevant_emails",
    drop_contained: bool = True,
    exclude_self: Column | None = None,
    payloads: DataFrame | None = None,
) -> DataFrame:
    """Add ``out``: the row's hits as ``{serialized_email, score, chunk}`` in rank order.

    Hits whose chunk is contained in the row's own text are dropped, rows without
    hits get an empty array. The array is bounded by k. ``hits`` is used twice
    (a popular chunk may be hit by a large share of all rows, and its copies are
    spread), so it is written once. ``exclude_self`` is a predicate over the hit
    columns marking hits on the row itself. With ``payloads`` (doc_id, payload: one row per
    doc_id) ``payload`` is an expression over that table, joined after the top k.
    """
    if exclude_self is not None:
        hits = hits.where(~exclude_self)
    hits = cut_lineage(hits.select(row_id, chunk_id, "rank", "score"))
    if payloads is None:
        texts = chunks.select(chunk_id, F.col(chunk_text).alias("_chunk"), payload.alias("_payload"))
        carried = uneven_join(hits, texts, [chunk_id], [row_id], how="inner")
    else:
        # Documents are read for the hits alone, once per document.
        texts = chunks.select(chunk_id, F.col(chunk_text).alias("_chunk"), F.col("doc_id").alias("_doc"))
        found = cut_lineage(uneven_join(hits, texts, [chunk_id], [row_id], how="inner"))
        stored = payloads.select(F.col("doc_id").alias("_doc"), payload.alias("_payload"))
        carried = uneven_join(found, stored, ["_doc"], [row_id, chunk_id], how="inner")
    arrays = carried.groupBy(row_id).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "rank",
                    F.col("_payload").alias("serialized_email"),
                    "score",
                    F.col("_chunk").alias("chunk"),
                )
            )
        ).alias("_hits")
    )
    joined = rows.join(arrays, row_id, "left")
    kept = F.col("_hits")
    if drop_contained:
        kept = F.filter(kept, lambda h: not_contained(F.col(row_text), h["chunk"]))
    plain = F.transform(
        kept,
        lambda h: F.struct(
            h["serialized_email"].alias("serialized_email"),
            h["score"].alias("score"),
            h["chunk"].alias("chunk"),
        ),
    )
    empty = F.array().cast(joined.select(plain.alias("x")).schema["x"].dataType)
    return joined.withColumn(out, F.coalesce(plain, empty)).drop("_hits")


RETRIEVERS: dict[str, Retriever] = {"nearest": nearest, "none": never}
