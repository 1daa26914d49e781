"""Exact deduplication of whole texts against immutable snapshots.

Texts are equal when their normal forms (every run of ``[\\x20\\x09-\\x0D]`` replaced by
one space) have the same bytes. A *snapshot* is an immutable set of groups: one row
per digest with the smallest doc_id and the number of rows, in exact buckets, and one
binary fuse filter (8-bit fingerprints, three probes) per bucket. An incoming batch is
handled so:

1. its own duplicates are grouped by digest (counted before the shuffle, so a text that
   makes up a third of the rows is one row per task);
2. the distinct digests are screened by the filters of each snapshot; a miss is certain;
3. only the positives join the exact buckets, which removes the filter's false ones;
4. the texts of all rows in groups of two or more are compared byte for byte: grouped by
   (digest, text). Different texts under one digest become different groups.

Defined cases: null text is the empty text, and all empty texts are equal to each other;
doc_id NULL never beats a number and stays only where a group has nothing else; rows that
repeat doc_id and text are all returned, ``kept`` is true for one of them; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, mix64, small, text_or_empty, written

BUCKET_KEYS = 1024  # digests a filter holds on average
DIGEST_BITS = 256


def normal_form(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def digest_of(text: str | Column, bits: int = DIGEST_BITS) -> Column:
    """Lowercase hex SHA-256 of the normal form; fewer ``bits`` only to test collisions."""
    whole = F.sha2(normal_form(text), 256)
    return whole if bits == 256 else F.substring(whole, 1, bits // 4)


# --- binary fuse filters --------------------------------------------------------


def _layout(n: int) -> tuple[int, int, int]:
    """Segment length, number of segment starts and array length for ``n`` keys."""
    if n < 2:
        segment = 4
    else:
        segment = 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    slots = int(round(n * factor)) if n > 1 else 4
    count = max(1, -(-slots // segment) - 2)
    return segment, count, (count + 2) * segment


def _probes(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) places, one in each of three neighbouring segments, and fingerprints."""
    h = mix64(keys ^ np.uint64(seed))
    start = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    one = start + np.uint64(segment)
    two = start + np.uint64(2 * segment)
    places = np.stack(
        [start, one ^ ((h >> np.uint64(18)) & mask), two ^ (h & mask)], axis=1
    ).astype(np.int64)
    return places, ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, count, fingerprint array) of a binary fuse filter over ``keys``.

    Peeling: a place that only one key still uses fixes that key's last place; keys
    are assigned in reverse order so that the three fingerprints xor to the key's own.
    A seed that leaves keys unpeeled is replaced by the next one.
    """
    keys = np.unique(keys)
    segment, count, length = _layout(len(keys))
    for seed in range(1, 1000):
        places, prints = _probes(keys, int(seed) * 0x9E3779B97F4A7C15 % 2**64, int(segment), int(count))
        uses = np.bincount(places.ravel(), minlength=length)
        owner = np.zeros(length, dtype=np.int64)  # xor of the keys (by number) at a place
        np.bitwise_xor.at(owner, places.ravel(), np.repeat(np.arange(len(keys)), 3))
        uses, owner, rows = uses.tolist(), owner.tolist(), places.tolist()
        stack, ready = [], [p for p in range(length) if uses[p] == 1]
        while ready:
            p = ready.pop()
            if uses[p] != 1:
                continue
            key = owner[p]
            stack.append((key, p))
            for q in rows[key]:
                uses[q] -= 1
                owner[q] ^= key
                if uses[q] == 1:
                    ready.append(q)
        if len(stack) == len(keys):
            break
    else:
        raise ValueError("no seed peels these keys")
    cells, prints = [0] * length, prints.tolist()
    for key, p in reversed(stack):
        a, b, c = rows[key]
        cells[p] = prints[key] ^ cells[a] ^ cells[b] ^ cells[c] ^ cells[p]
    return seed, segment, count, bytes(cells)


def maybe_in(keys: np.ndarray, seed: int, segment: int, count: int, cells: bytes) -> np.ndarray:
    """False only for keys that are certainly not in the filter."""
    table = np.frombuffer(cells, dtype=np.uint8)
    places, prints = _probes(keys, int(seed) * 0x9E3779B97F4A7C15 % 2**64, int(segment), int(count))
    return (table[places[:, 0]] ^ table[places[:, 1]] ^ table[places[:, 2]]) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(d[:16], 16) for d in digests], dtype=np.uint64)


def bucket_of(digest: str | Column, buckets: int) -> Column:
    col = F.col(digest) if isinstance(digest, str) else digest
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter row per bucket of an immutable table with a ``digest`` column."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, count, cells = build_filter(_keys(rows["digest"]))
        return pd.DataFrame(
            {"bucket": [key[0]], "seed": [seed], "segment": [segment], "count": [count], "cells": [cells]}
        )

    return (
        groups.select(bucket_of("digest", buckets).alias("bucket"), "digest")
        .groupBy("bucket")
        .applyInPandas(build, "bucket int, seed int, segment int, count int, cells binary")
    )


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The rows of ``digests`` (distinct) that some filter does not rule out."""

    def probe(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(held):
            return rows.iloc[:0][["digest"]]
        f = held.iloc[0]
        hit = maybe_in(_keys(rows["digest"]), f["seed"], f["segment"], f["count"], f["cells"])
        return rows.loc[hit, ["digest"]]

    marked = digests.select(bucket_of("digest", buckets).alias("bucket"), "digest")
    return marked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest string")


# --- the operator ---------------------------------------------------------------


def _grouped(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def merge_batch(held: list[tuple[DataFrame, DataFrame, int]], batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Screen the groups of one batch against snapshots given as (groups, filters, buckets).

    Returns the batch's groups no snapshot has, and (digest, keep_id, group_size) of the
    others. The exact join decides; a filter only spares it the certain misses.
    """
    if not held:
        return batch, batch.limit(0)
    found = [
        screen(batch, filters, buckets)
        .join(groups.select("digest"), "digest", "left_semi")
        for groups, filters, buckets in held
    ]
    known = reduce(DataFrame.union, found)
    return batch.join(known, "digest", "left_anti"), batch.join(known, "digest", "left_semi")


def exact_groups(keyed: DataFrame, batches: int = 2) -> DataFrame:
    """(digest, keep_id, group_size) of every digest in ``keyed`` (doc_id, digest, batch)."""
    held: list[tuple[DataFrame, DataFrame, int]] = []
    repeats: list[DataFrame] = []
    for number in range(batches):
        batch, _ = written(_grouped(keyed.where(F.col("batch") == number)), "exact-batch")
        new, again = merge_batch(held, batch)
        if held:
            new, _ = written(new, "exact-new")
            repeats.append(again)
        if number + 1 < batches:
            buckets = max(1, -(-new.count() // BUCKET_KEYS))
            filters, _ = written(snapshot_filters(new, buckets), "exact-filters")
            held.append((new, filters, buckets))
        else:
            held.append((new, new, 0))
    snapshots = reduce(DataFrame.union, [groups for groups, _, _ in held])
    if not repeats:
        return snapshots
    # A digest is in one snapshot only; what later batches add to it is a few rows each.
    added = (
        reduce(DataFrame.union, repeats)
        .groupBy("digest")
        .agg(F.min("keep_id").alias("_keep"), F.sum("group_size").alias("_size"))
    )
    return snapshots.join(added, "digest", "left").select(
        "digest",
        F.least("keep_id", "_keep").alias("keep_id"),
        (F.col("group_size") + F.coalesce("_size", F.lit(0))).alias("group_size"),
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 2,
    digest_bits: int = DIGEST_BITS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The table is taken in as ``batches`` parts (by a hash of the id): each becomes an
    immutable snapshot that screens the parts after it.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    keyed, _ = written(
        base.select("doc_id", digest_of("text", digest_bits).alias("digest"), part.alias("batch")), "exact-keys"
    )
    groups, _ = written(exact_groups(keyed, batches).where("group_size > 1"), "exact-groups")
    n_groups = groups.count()

    # Byte check: all rows of groups of two or more, by digest and text together.
    texts = base.select("doc_id", normal_form("text").alias("text")).select(
        "doc_id", "text", F.sha2("text", 256).substr(1, digest_bits // 4).alias("digest")
    )
    variants, _ = written(
        texts.join(small(groups.select("digest"), n_groups), "digest", "left_semi")
        .groupBy("digest", "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "text", "keep_id", "group_size"),
        "exact-bytes",
    )
    split = variants.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    split, _ = written(split, "exact-collisions")

    rows = keyed.select("doc_id", "digest")
    alone = rows.join(small(groups.select("digest"), n_groups), "digest", "left_anti").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    merged = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("_times"))
    checked = variants.join(small(split, n_groups), "digest", "left_anti").select("digest", "keep_id", "group_size")
    parts = [alone, _per_row(merged.join(small(checked, n_groups), "digest"))]
    if not split.isEmpty():
        apart = texts.join(small(split, n_groups), "digest", "left_semi")
        apart = apart.groupBy("digest", "text", "doc_id").agg(F.count(F.lit(1)).alias("_times"))
        parts.append(_per_row(apart.join(variants, ["digest", "text"])))
    return reduce(DataFrame.union, parts)


def _per_row(groups: DataFrame) -> DataFrame:
    """Rows that repeat doc_id and text were counted; give them back one by one."""
    return groups.select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_copy")
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the later copies; all columns as they came."""
    found = exact_dedup(docs, id_col, text_col)
    stays, _ = written(found.where("kept").select("doc_id", "text_sha256"), "exact-kept")
    name, key = fresh(docs, "_exact_digest"), fresh(docs, "_exact_id")
    marked = docs.withColumn(name, digest_of(F.col(f"`{text_col}`")))
    stays = stays.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(f"{name}_"))
    same = marked[f"`{id_col}`"].eqNullSafe(stays[key]) & (marked[name] == stays[f"{name}_"])
    out = marked.join(stays, same, "left_semi")
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return out.drop(name)
    # Repeated ids: of the rows that repeat id and text, one stays.
    return out.dropDuplicates([name, id_col]).drop(name)
