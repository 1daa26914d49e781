"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words. A document of a source whose rate
(target / size) is ``r`` is taken floor(r) times for certain and once more with
probability frac(r). Which documents get the extra copy is a balanced sample: per
source, the drawn words and the drawn number of documents stay at their expectation.

The *flight* moves the vector of probabilities along the null space of the two balance
constraints until a unit is 0 or 1, with three undecided units at a time, so each step
settles at least one of them. It runs in chunks of about CHUNK documents of one source;
what a chunk leaves undecided (at most two units) goes to the next level, where it is
chunked again, so a source of any size is never one task. When a source's undecided units
fit one chunk, at most two are left; this *landing* takes the rounding of them that is
nearest to the balance.

Defined cases: null text has no words; size 0 documents are taken like others but change
no total; NULL is a source, last in order; rows that repeat are separate units; a source
without words has target 0; an empty table gives an empty result. Reruns agree: order and
random numbers come from hashes of the ids. Ids of any type are carried as text, so large ones
stay exact beside null ones. Sources are a table like any other: their order, targets and
chunks are computed by Spark, only totals come to the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import uneven_join
from .common import WORD, fresh, small, text_or_empty, written

CHUNK = 2000
WEIGHTS = (1.0, 2.0, 3.0)
MAX_RATE = 3.0
EPS = 1e-9

UNITS = "doc_id string, row_key bigint, size bigint, place bigint, p double"


def targets(sizes: list[float], weights: list[float], total: float, max_rate: float = MAX_RATE) -> list[float]:
    """Shares of ``total`` by weight; none above ``max_rate`` times its size.

    The excess over a stop goes to the sources below theirs by weight, again and again
    until none is above.
    """
    got = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    rest = float(total)
    while free and rest > 0:
        unit = rest / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > max_rate * sizes[i]]
        if not over:
            for i in free:
                got[i] = unit * weights[i]
            break
        for i in over:
            got[i] = max_rate * sizes[i]
            rest -= got[i]
        free = [i for i in free if i not in set(over)]
    return got


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` to 0/1 keeping x.T @ p, until at most x.shape[1] units are undecided."""
    p = p.copy()
    need = x.shape[1] + 1
    queue = iter(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist())
    held = list(itertools.islice(queue, need))
    draws = rng.random(len(p) + need)
    step = 0
    while len(held) == need:
        a, b, c = (x[i] for i in held)
        # The null vector of two constraints on three units is a cross product.
        u = np.array(
            [b[0] * c[1] - b[1] * c[0], c[0] * a[1] - c[1] * a[0], a[0] * b[1] - a[1] * b[0]]
        )
        if not u.any():  # equal rows: any direction that keeps the count
            u = np.array([1.0, -1.0, 0.0])
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + u * up if draws[step] * (up + down) < down else q - u * down
        step += 1
        q[q < EPS], q[q > 1 - EPS] = 0.0, 1.0
        p[held] = q
        held = [i for i, v in zip(held, q) if 0.0 < v < 1.0]
        held += list(itertools.islice(queue, need - len(held)))
    return p


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Round the few undecided units so that the totals are as near as possible."""
    left = np.flatnonzero((p > 0) & (p < 1))
    scale = np.maximum(np.abs(x).max(axis=0), 1.0) if len(x) else np.ones(x.shape[1])
    best = min(
        itertools.product((0.0, 1.0), repeat=len(left)),
        key=lambda v: (float(np.abs(((np.array(v) - p[left]) @ x[left]) / scale).sum()), v),
    )
    p = p.copy()
    p[left] = best
    return p


def _settle(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "doc_id", "row_key", "size", "p"], kind="stable", na_position="last")
        p = rows["p"].to_numpy(dtype=float).copy()
        p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
        x = np.column_stack([rows["size"].to_numpy(dtype=float), np.ones(len(rows))])
        seed = [int(k) & 0x7FFFFFFF for k in key]
        p = flight(p, x, np.random.default_rng(seed))
        if last:
            p = landing(p, x)
        return rows.assign(p=p)[["doc_id", "row_key", "size", "place", "p"]]

    return run


def _beside(many: DataFrame, table: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """``many`` with the columns of ``table``, of which it has a row per key; one key may own
    a large part of ``many``."""
    marked = small(table, rows)
    return many.join(marked, keys) if marked is not table else uneven_join(many, table, keys, ["doc_id", "row_key"], "inner")


def balanced_sample(units: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Settle the probabilities ``p`` of (doc_id, row_key, size, place, p) to 0 or 1, per ``place``.

    Each level keeps the decided rows and sends the undecided on.
    """
    id_type = dict(units.dtypes)["doc_id"]
    units = units.withColumn("doc_id", F.col("doc_id").cast("string"))
    done: list[DataFrame] = []
    level = 0
    while True:
        parts, _ = written(
            units.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("bigint").alias("parts")), "mix-parts"
        )
        places, most = parts.agg(F.count(F.lit(1)), F.max("parts")).first()
        last = (most or 1) == 1
        hashed = F.xxhash64("doc_id", "row_key", F.lit(level))
        dealt = _beside(units, parts, places, ["place"]).select(
            *units.columns, hashed.alias("h"), F.pmod(hashed, F.col("parts")).alias("part")
        )
        # ``parts`` of a source does not change the other sources' chunks.
        settled, _ = written(
            dealt.groupBy("place", "part", F.lit(level).alias("level")).applyInPandas(_settle(last), UNITS), "mix-level"
        )
        if last:
            done.append(settled)
            break
        open_units = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(settled.where(~open_units))
        units = settled.where(open_units)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def numbered_sources(rows: DataFrame) -> DataFrame:
    """(unnamed, name, size, place): total sizes of sources, numbered by code point, NULL last."""
    sums = rows.groupBy("unnamed", "name").agg(F.sum("size").alias("size"))
    # Ranges in order; the id of a sorted row is its range and its place there.
    ordered = sums.repartitionByRange("unnamed", "name").sortWithinPartitions("unnamed", "name")
    ordered, _ = written(ordered.withColumn("at", F.monotonically_increasing_id()), "mix-order")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ordered.withColumn("range", F.shiftright("at", 33))
    # One row per range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return ranged.join(F.broadcast(offsets), "range").select(
        "unnamed", "name", "size", (F.col("offset") + within).alias("place")
    )


def source_rates(rows: DataFrame, weights: tuple[float, ...], max_rate: float, share: float) -> tuple[DataFrame, int]:
    """(unnamed, name, place, source_size, target, base, p) of all sources, and their number.

    The targets of ``targets``, found as one level: a source gets level * weight words, or
    ``max_rate`` times its size if that is less. Each round takes the stopped sources'
    words off the total and raises the level, until no further source is stopped.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources, _ = written(numbered_sources(rows).withColumn("weight", weight), "mix-sources")
    size = F.col("size").cast("double")
    n, total, level = sources.agg(
        F.count(F.lit(1)), F.sum(size) * share, F.sum(size) * share / F.sum(F.when(size > 0, F.col("weight")))
    ).first()
    stopped = -1
    while level is not None and n:
        over = (size > 0) & (F.col("weight") * level > size * max_rate)
        free = (size > 0) & ~over
        count, held, rest = sources.agg(
            F.count_if(over), F.sum(F.when(over, size * max_rate)), F.sum(F.when(free, F.col("weight")))
        ).first()
        if count == stopped:
            break
        stopped = count
        if not rest:
            level = float("inf")
            break
        level = (total - (held or 0.0)) / rest
    wanted = F.least(F.col("weight") * F.lit(level or 0.0), size * max_rate)
    rate = F.when(size > 0, F.col("target") / size).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < EPS, F.round(rate)).otherwise(rate)
    table = sources.withColumn("target", F.when(size > 0, wanted).otherwise(0.0)).withColumn("_rate", rate)
    return table.select(
        "unnamed",
        "name",
        "place",
        F.col("size").alias("source_size"),
        "target",
        F.floor("_rate").cast("bigint").alias("base"),
        (F.col("_rate") - F.floor("_rate")).alias("p"),
    ), n


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_rate: float = MAX_RATE,
    share: float = 1.0,
    row_key=None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, row_key, source.

    ``weights`` repeat over the sources in code point order.
    """
    key = F.lit(0).cast("bigint") if row_key is None else row_key
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")
    source = F.col(source_col).cast("string")
    rows, _ = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            key.alias("row_key"),
            source.isNull().alias("unnamed"),
            F.coalesce(source, F.lit("")).alias("name"),
            size.alias("size"),
        ),
        "mix-sizes",
    )
    rates, n = source_rates(rows, weights, max_rate, share)
    table, _ = written(rates, "mix-rates")
    placed = _beside(rows, table.select("unnamed", "name", "place", "p"), n, ["unnamed", "name"])
    drawn = balanced_sample(placed.select("doc_id", "row_key", "size", "place", "p"))
    copies = F.col("base") + F.col("p_drawn").cast("bigint")
    return _beside(drawn.withColumnRenamed("p", "p_drawn"), table.drop("p"), n, ["place"]).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).alias("taken"),
        copies.alias("copies"),
        "row_key",
        F.when(~F.col("unnamed"), F.col("name")).alias("source"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row 0, 1 or more times, all columns as they came."""
    body = [c for c in docs.columns if c != id_col]
    row_key = F.xxhash64(*[F.col(f"`{c}`") for c in body]) if body else F.lit(0).cast("bigint")
    decided = mix(docs, id_col, text_col, row_key=row_key, **options)
    ids, keys = fresh(docs, "_mix_id"), fresh(docs, "_mix_key")
    times, rows = fresh(docs, "_mix_times"), fresh(docs, "_mix_rows")
    one, each = fresh(docs, "_mix_copy"), fresh(docs, "_mix_row")
    plan, _ = written(
        decided.groupBy("doc_id", "row_key").agg(
            F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")
        ),
        "mix-plan",
    )
    plan = plan.select(
        F.col("doc_id").alias(ids), F.col("row_key").alias(keys), F.col("copies").alias(times), F.col("n").alias(rows)
    ).where(F.col(times) > 0)
    marked = docs.withColumn(each, row_key)
    same = marked[f"`{id_col}`"].eqNullSafe(plan[ids]) & (marked[each] == plan[keys])
    # Equal rows share their copies: all of them go through the first, which is the same.
    joined = marked.join(plan, same)
    if not plan.where(F.col(rows) > 1).isEmpty():
        joined = joined.dropDuplicates([ids, keys])
    return joined.withColumn(one, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
