"""Similarity join on word n-grams: Jaccard of five-word shingle sets of 0.8 or more.

1. *Sketch*: each text becomes a set of hashed shingles, of which are kept a digest, the
   size, 40 band keys of five MinHash values each, and the low byte of 128 values. A text of
   one to four words is one shingle.
2. Texts with equal sets are one *unit*; only units go on. Units are numbered in the order of
   their smallest ids and digests, so that different texts with one id are different units.
3. *Candidates* meet in a bucket of equal band keys. A pair at 0.8 shares a bucket with
   probability 1 - (1 - 0.8**5)**40 = 1 - 1.3e-7. Buckets of one unit are dropped before
   anything is fetched for them; large ones are compared block against block.
4. *Bayesian pruning*: the bytes of a pair are compared STEP at a time. After n values with m
   equal the posterior of its similarity (flat prior) is Beta(m + 1, n - m + 1); the pair is
   dropped as soon as the probability of reaching the threshold is below TOLERANCE. Pairs are
   looked at in the first band they share only, and leave the task as a spanning forest.
5. *Verification*: what the surviving pairs connect is a family. Shingle sets of families
   are fetched and all pairs of a family compared exactly, block against block, by products
   of incidence matrices. Only here are links counted; they never become rows.

The result has one row per document: its class (the smallest doc_id that verified links
connect it to), the number of other documents it is linked to (copies counted), and whether
it is the one that stays.

Defined cases: null, empty and blank texts have no shingles and no links, each is its own
class; doc_id NULL takes part, its class is NULL unless a document with an id is in it;
equal texts are linked; rows that repeat are rows, one row of a class stays; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, fresh, mix64, pieces, small, text_or_empty, words_in, written
from .components import components

WORDS = 5
THRESHOLD = (4, 5)  # similarity as a fraction: whole-number comparisons are exact
BANDS, ROWS = 40, 5
COMPARED, STEP = 128, 16
TOLERANCE = 1e-6
BLOCK = 256  # units of one side of a block comparison
FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
OFFSETS = mix64(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64)).astype(np.uint32)


def shingles_in(raw: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, _, _, first = words_in(raw, starts, NOT_SPACE)
    total = np.zeros(max(len(hashes) - WORDS + 1, 0), dtype=np.uint64)
    for i in range(WORDS):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(total)]
    total = mix64(total)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WORDS:
            yield np.unique(total[a : b - WORDS + 1])
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = mix64(np.array([short ^ h]))[0]
            yield np.array([short], dtype=np.uint64)
        else:
            yield np.empty(0, dtype=np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    for first in range(0, len(low), 512):
        np.minimum(best, ((low[first : first + 512, None] ^ OFFSETS) * FACTORS).min(axis=0), out=best)
    return best


def sketch_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, digest, bands, sketch) of (text, doc_id, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bands, sketches = [], [], [], []
            for _, _, raw, starts in pieces(batch):
                for found in shingles_in(raw, starts):
                    n.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    low = min_hashes(found)
                    keys = np.zeros(BANDS, dtype=np.uint64)
                    for i in range(ROWS):
                        keys = mix64(keys ^ low[i::ROWS].astype(np.uint64))
                    bands.append(keys.astype(np.uint32).tobytes())
                    sketches.append(mix64(low[:COMPARED].astype(np.uint64)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "row", "n", "digest", "bands", "sketch"],
            )

    return docs.select("text", "doc_id", "row").mapInArrow(
        run, "doc_id bigint, row string, n bigint, digest binary, bands binary, sketch binary"
    )


def enough_matches(threshold: float, tolerance: float) -> np.ndarray:
    """Fewest equal values of n = STEP, 2*STEP, ... that keep a pair in the race.

    P(Beta(m+1, n-m+1) >= t) is the probability of at most m successes in n+1 draws at t.
    """
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which rows of two (pairs, COMPARED) byte tables are still in the race at the end."""
    left = np.arange(len(a))
    same = np.zeros(len(a), dtype=np.int64)
    for i, least in enumerate(need):
        cut = slice(i * STEP, (i + 1) * STEP)
        same = same + (a[left, cut] == b[left, cut]).sum(axis=1)
        keep = same >= least
        left, same = left[keep], same[keep]
    return left


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of an in-memory graph on 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def grouped_batches(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.Table]:
    """Re-cut batches sorted by ``key`` so that no key is split between two tables."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut == 0 and rest and rest[-1].column(batch.schema.get_field_index(key))[-1].as_py() == keys[-1]:
            rest.append(batch)
            continue
        done = [*rest, batch.slice(0, cut)]
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done).combine_chunks()
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def bytes_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def in_blocks(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Give every row its block comparisons: ``key`` and, for two blocks, its ``side``.

    A group of at most BLOCK rows is one comparison of a block with itself. A larger one
    is cut into blocks (by a hash of ``unit``); each pair of blocks is one comparison, so
    no task ever holds a whole large group.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    marked = rows.withColumn("_blocks", blocks).withColumn(
        "_own", F.pmod(F.xxhash64("unit", F.lit(11)), F.col("_blocks")).cast("int")
    )
    spread = marked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return spread.select(
        *rows.columns,
        F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"),
        F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int")).alias("side"),
    )


def candidate_edges(units: DataFrame, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b): spanning edges of what Bayesian pruning leaves, of (unit, bands, sketch)."""
    need = enough_matches(threshold[0] / threshold[1], tolerance)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS)
                bucket = (np.arange(BANDS, dtype=np.int64) << 32) | keys.astype(np.int64)
                unit = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(unit)], ["bucket", "unit"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches):
            key, side = table["key"].to_numpy(), table["side"].to_numpy()
            unit, band = table["unit"].to_numpy(), table["bucket"].to_numpy() >> 32
            bands = bytes_of(table["bands"], 4 * BANDS).view(np.uint32)
            sketch = bytes_of(table["sketch"], COMPARED)
            found_a, found_b = [], []
            for gap in range(1, len(key)):
                a = np.flatnonzero(key[:-gap] == key[gap:])
                if not len(a):
                    break
                a = a[(side[a] == 2) | (side[a] != side[a + gap])]
                for first in range(0, len(a), 20_000):
                    i = a[first : first + 20_000]
                    j = i + gap
                    owner = (bands[i] == bands[j]).argmax(axis=1) == band[i]
                    i, j = i[owner], j[owner]
                    left = survivors(sketch[i], sketch[j], need)
                    found_a.append(i[left])
                    found_b.append(j[left])
            if found_a:
                label = smallest_labels(len(key), np.concatenate(found_a), np.concatenate(found_b))
                moved = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(unit[moved]), pa.array(unit[label[moved]])], ["a", "b"])

    keyed, _ = written(units.select("unit", "bands").mapInArrow(explode, "bucket bigint, unit bigint"), "ngram-bands")
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared, _ = written(shared, "ngram-buckets")
    members = keyed.join(shared, "bucket")
    fetched = members.join(units.select("unit", "bands", "sketch"), "unit")
    dealt = in_blocks(fetched, "bucket", "size").select("key", "side", "unit", "bucket", "bands", "sketch")
    pairs = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a bigint, b bigint")
    return written(pairs.where("a != b").distinct(), "ngram-edges")[0]


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(m, m) sizes of the intersections of m sets, by products of incidence matrices."""
    m = len(sets)
    out = np.zeros((m, m), dtype=np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column) > 1
    keep = several[column]
    owner, column = owner[keep], (np.cumsum(several) - 1)[column[keep]]
    width = int(several.sum())
    for first in range(0, width, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        x = np.zeros((m, min(4096, width - first)), dtype=np.float32)
        x[owner[a:b], column[a:b] - first] = 1.0
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def verify(members: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(unit, links, root, blocks): exact links inside each comparison of (family, size, unit,
    copies, shingles); ``root`` is the smallest unit that links connect it to there."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches):
            key = table["key"].to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            all_units, all_sides = table["unit"].to_numpy(), table["side"].to_numpy()
            all_copies, shingles = table["copies"].to_numpy(), table["shingles"]
            units, links, roots = [], [], []
            for a, b in zip(edges[:-1], edges[1:]):
                sets = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in shingles[a:b]]
                n = np.array([len(s) for s in sets], dtype=np.float64)
                both = common_counts(sets)
                near = den * both >= num * (n[:, None] + n[None, :] - both)
                side, unit, copies = all_sides[a:b], all_units[a:b], all_copies[a:b]
                near &= (side[:, None] == 2) | (side[:, None] != side[None, :])
                np.fill_diagonal(near, False)
                order = np.argsort(unit)
                i, j = np.nonzero(np.triu(near[np.ix_(order, order)]))
                label = smallest_labels(len(unit), i, j)
                units.append(unit[order])
                links.append((near @ copies)[order])
                roots.append(unit[order][label])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(units)), pa.array(np.concatenate(links).astype(np.int64)), pa.array(np.concatenate(roots))],
                ["unit", "links", "root"],
            )

    dealt = in_blocks(members, "family", "size").select("key", "side", "unit", "copies", "shingles")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "unit bigint, links bigint, root bigint")


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(unit, shingles) of (text, unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, starts in pieces(batch):
                sets = [s.tobytes() for s in shingles_in(raw, starts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[first:end], pa.array(sets, pa.binary())], ["unit", "shingles"]
                )

    return docs.select("text", "unit").mapInArrow(run, "unit bigint, shingles binary")


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: tuple[int, int] = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, stays, row (a hash of the text)."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.md5(text).alias("row"))
    # ``seq`` tells rows apart that repeat id and text.
    sketched, _ = written(sketch_rows(base).withColumn("seq", F.monotonically_increasing_id()), "ngram-sketch")
    filled = sketched.where("n > 0")

    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "seq")
    sized = filled.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
    sized = sized.select("digest", "copies", "first.*").repartitionByRange("no_id", "doc_id", "digest")
    sized = sized.sortWithinPartitions("no_id", "doc_id", "digest").withColumn("unit", F.monotonically_increasing_id())
    sized, _ = written(sized.drop("no_id"), "ngram-units")
    # The first row of each unit carries its sketch.
    units = filled.select("seq", "digest", "bands", "sketch").join(
        sized.select("unit", "copies", "digest", "seq"), ["digest", "seq"]
    )
    units, _ = written(units.select("unit", "copies", "bands", "sketch"), "ngram-unit-sketches")

    families = components(candidate_edges(units, threshold, tolerance))
    sizes = families.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    families, _ = written(
        families.join(sizes, "label").select(F.col("node").alias("unit"), F.col("label").alias("family"), "size"),
        "ngram-families",
    )
    n_members = families.count()
    wanted = sized.select("unit", "doc_id", "row").join(small(families.select("unit"), n_members), "unit", "left_semi")
    wanted, _ = written(wanted, "ngram-wanted")
    same = base["doc_id"].eqNullSafe(wanted["doc_id"]) & (base["row"] == wanted["row"])
    texts = base.join(small(wanted, n_members), same).select("text", "unit")
    members = (
        shingle_rows(texts)
        .dropDuplicates(["unit"])
        .join(families, "unit")
        .join(units.select("unit", "copies"), "unit")
    )
    linked, _ = written(verify(members, threshold), "ngram-links")
    totals = linked.groupBy("unit").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    across = families.where(F.col("size") > BLOCK).select("unit")
    bridges = linked.join(across, "unit", "left_semi").where("unit != root")
    joined = components(bridges.select(F.col("unit").alias("a"), F.col("root").alias("b")))
    labelled = totals.join(joined.withColumnRenamed("node", "unit"), "unit", "left").select(
        "unit", "links", F.coalesce("label", "root").alias("label")
    )
    found, _ = written(
        sized.join(labelled, "unit", "left")
        .where("copies > 1 OR links > 0")
        .select(
            "digest",
            F.coalesce("label", "unit").alias("label"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "ngram-classes",
    )
    stay = sized.select(F.col("unit").alias("label"), F.col("doc_id").alias("class_id"), F.col("seq").alias("stay"))
    stay, _ = written(stay.join(found.select("label").distinct(), "label"), "ngram-stay")
    found, _ = written(found.join(small(stay, stay.count()), "label").drop("label"), "ngram-found")
    out = sketched.select("doc_id", "row", "digest", "n", "seq").join(
        small(found, found.count()), (F.col("n") > 0) & (sketched["digest"] == found["digest"]), "left"
    )
    return out.select(
        "doc_id",
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.col("n_links").isNull() | (F.col("seq") == F.col("stay"))).alias("stays"),
        "row",
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class; all columns as they came. Of rows that repeat
    id and text any one can be the one that stays."""
    found = ngram_join(docs, id_col, text_col, **options)
    linked = found.where("n_links > 0").groupBy("doc_id", "row")
    linked = linked.agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1")
    linked, _ = written(linked, "ngram-gone")
    gone, repeated = linked.where(~F.col("stays")), linked.where("stays")
    ids, rows = fresh(docs, "_ngram_id"), fresh(docs, "_ngram_row")
    own_id, own_row = docs[f"`{id_col}`"].cast("bigint"), F.md5(text_or_empty(docs[f"`{text_col}`"]))

    def among(linked: DataFrame, how: str) -> DataFrame:
        linked = linked.select(F.col("doc_id").alias(ids), F.col("row").alias(rows))
        return docs.join(small(linked, linked.count()), own_id.eqNullSafe(linked[ids]) & (own_row == linked[rows]), how)

    if repeated.isEmpty():
        return among(gone, "left_anti")
    once = among(repeated, "left_semi").withColumns({ids: own_id, rows: own_row}).dropDuplicates([ids, rows])
    return among(linked, "left_anti").union(once.drop(ids, rows))
