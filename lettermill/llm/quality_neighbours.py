"""Quality by nearest-neighbour voting in a latent semantic space.

Features are hashed byte trigrams of the whole text, case and symbols kept (junk shows in
its shapes), weighted (1 + ln tf) * idf with unit length. The latent space are the leading
right singular vectors of the labelled sample's matrix, each direction divided by the
root of its singular value so that the few that separate languages do not drown the rest.
Every document is compared with all labelled vectors by exact cosine: blocks of documents
times the whole labelled matrix. The K nearest vote with their similarity to a power.

What is broadcast is bounded: MAX_EXAMPLES vectors of DIMENSIONS numbers and the
FEATURES x DIMENSIONS projection.

Defined cases: a text without a trigram has no direction and gets the share of label 1;
null labels and null ids are not learnt from; without any label every score is 0.5;
rows that repeat are scored alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, pieces, share, shared, text_or_empty, written

FEATURE_BITS = 11
FEATURES = 1 << FEATURE_BITS
DIMENSIONS = 48
MAX_EXAMPLES = 3000
NEIGHBOURS = 25
POWER = 4.0
FOLDS, HELD_OUT = 5, 0
BLOCK_ROWS = 512


def trigram_slots(raw: np.ndarray, bits: int) -> np.ndarray:
    """Hashed slot of the trigram that starts at each byte but the last two."""
    wide = raw.astype(np.uint32)
    packed = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    return (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def trigram_counts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) counts; trigrams lie within one text."""
    n = len(starts) - 1
    if len(raw) < 3:
        return np.zeros((n, FEATURES), dtype=np.int64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    inside = owner[:-2] == owner[2:]
    cell = owner[:-2][inside] * FEATURES + trigram_slots(raw, FEATURE_BITS)[inside]
    return np.bincount(cell, minlength=n * FEATURES).reshape(n, FEATURES)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(counts.shape, dtype=np.float32)
    np.log(counts, out=x, where=counts > 0, dtype=np.float32)
    x += counts > 0
    return unit(x * idf)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Space:
    idf: np.ndarray
    projection: np.ndarray  # (FEATURES, dimensions)
    vectors: np.ndarray  # (examples, dimensions), unit length
    labels: np.ndarray
    ids: np.ndarray
    prior: float

    def place(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.idf) @ self.projection)

    def scores(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Votes of the k labelled vectors with the largest cosines, rows in blocks."""
        out = np.full(len(counts), self.prior)
        k = min(k, len(self.ids))
        for first in range(0, len(counts), BLOCK_ROWS):
            part = counts[first : first + BLOCK_ROWS]
            cosine = self.place(part) @ self.vectors.T
            # Whole-number keys: equal cosines are ordered by place, whatever the block's shape.
            rank = np.round(cosine * 1e5).astype(np.int64) * len(self.ids) - np.arange(len(self.ids))
            near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3) ** POWER
            vote = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
            some = part.any(axis=1)
            out[first : first + BLOCK_ROWS][some] = vote[some]
        return np.clip(np.round(out, 4), 0.0, 1.0)


def latent_space(counts: np.ndarray, labels: np.ndarray, ids: np.ndarray, dimensions: int = DIMENSIONS) -> Space:
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    x = weighted(counts, idf).astype(np.float64)
    values, vectors = np.linalg.eigh(x.T @ x)
    top = np.argsort(-values)[:dimensions]
    top = top[values[top] > 1e-9]
    projection = (vectors[:, top] / np.sqrt(np.sqrt(values[top]))).astype(np.float32)
    # A singular vector's sign is free; fix it.
    projection *= np.where(projection[np.abs(projection).argmax(axis=0), np.arange(len(top))] < 0, -1, 1)
    placed = unit(weighted(counts, idf) @ projection)
    return Space(idf, projection, placed, labels.astype(np.float64), ids, float(labels.mean()))


def fit(
    docs: DataFrame,
    marks: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_examples: int = MAX_EXAMPLES,
) -> Space | None:
    """Learn from labelled rows outside the held-out fold, at most ``max_examples`` of them
    (by smallest hash of the id: a bounded sample)."""
    picked, _ = written(
        marks.where((fold(id_col, FOLDS) != HELD_OUT) & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("example"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("example"), "example")
        .limit(max_examples),
        "quality-examples",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, starts in pieces(batch):
                counts = trigram_counts(raw, starts).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[first:end], batch.column(2)[first:end], pa.array([r.tobytes() for r in counts], pa.binary())],
                    ["example", "label", "counts"],
                )

    texts = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).alias("example"))
    rows = texts.join(F.broadcast(picked), "example").select("text", "example", "label")
    found = (
        rows.mapInArrow(run, "example bigint, label int, counts binary")
        .toPandas()
        .sort_values(["example", "counts"])
        .drop_duplicates("example")
    )
    if not len(found):
        return None
    counts = np.stack([np.frombuffer(c, dtype=np.int32) for c in found["counts"]])
    return latent_space(counts, found["label"].to_numpy(), found["example"].to_numpy())


def score(docs: DataFrame, space: Space | None, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = share(docs.sparkSession, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared(model)
        for batch in batches:
            values = [np.empty(0)]
            for first, end, raw, starts in pieces(batch):
                if space is None:
                    values.append(np.full(end - first, 0.5))
                else:
                    values.append(space.scores(trigram_counts(raw, starts)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(values))], ["doc_id", "score"])

    rows = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted")
    )
