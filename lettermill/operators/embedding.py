"""Text to vectors. A model is any function ``(df, text_col, out_col) -> df``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from ..functions.text import metric_tokens
from .chunking import chunk_fixed, chunk_recursive

Model = Callable[[DataFrame, str, str], DataFrame]


MOST_DIMENSIONS = 1 << 16


KNOWN_WORDS = 1 << 18
TEXTS_AT_ONCE = 256


def bucket(word: bytes, dimensions: int) -> int:
    """By the first 28 bits of the word's md5: the same in any engine."""
    return int(hashlib.md5(word).hexdigest()[:7], 16) % dimensions


def bucket_counts(tokens: pa.ListArray, dimensions: int, known: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Words per text and bucket, some texts at a time. ``known`` keeps the buckets of words
    between calls: a word is digested once, not every time it occurs."""
    step = max(1, min(TEXTS_AT_ONCE, (1 << 21) // dimensions))
    for start in range(0, len(tokens), step):
        texts = tokens.slice(start, step)
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        coded = texts.flatten().dictionary_encode()
        if len(known) > KNOWN_WORDS:
            known.clear()
        place = np.zeros(len(coded.dictionary), dtype=np.int64)
        for i, word in enumerate(coded.dictionary.cast(pa.binary()).to_pylist()):
            if (found := known.get(word)) is None:
                found = known[word] = bucket(word, dimensions)
            place[i] = found
        at = np.repeat(np.arange(len(texts)) * dimensions, sizes) + place[coded.indices.to_numpy()]
        yield np.bincount(at, minlength=len(texts) * dimensions).reshape(len(texts), dimensions)


def fit_idf(df: DataFrame, text_col: str, dimensions: int = 256) -> DataFrame:
    """(bucket, n_with, n_docs, idf) for every bucket: a small table to keep with the index.

    Texts that have a bucket are counted per task; only these counts are shuffled. idf is
    ln((n_docs + 1) / (n_with + 1)); buckets that no text has are rows as well.
    """
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        with_it = np.zeros(dimensions, dtype=np.int64)
        for batch in batches:
            for counts in bucket_counts(batch.column("t"), dimensions, known):
                with_it += (counts > 0).sum(axis=0)
        some = np.flatnonzero(with_it)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(with_it[some])], names=["bucket", "n"])

    texts = df.select(metric_tokens(F.col(text_col)).alias("t"))
    seen = texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n_with"))
    n_docs = texts.count()
    spark = df.sparkSession
    counted = spark.range(dimensions).withColumnRenamed("id", "bucket").join(F.broadcast(seen), "bucket", "left")
    n_with = F.coalesce("n_with", F.lit(0).cast("bigint"))
    n = F.lit(n_docs).cast("bigint")
    return counted.select(
        "bucket", n_with.alias("n_with"), n.alias("n_docs"), F.log((n + 1) / (n_with + 1)).alias("idf")
    )


def hashed_terms(dimensions: int = 256, idf: DataFrame | None = None) -> Model:
    """Unit-length vectors of hashed terms: tokens on the JVM, then counts, idf, length 1 by Arrow.

    Without ``idf`` (from ``fit_idf``) plain counts are taken; then nothing is fitted. Either
    way an embedding is narrow and the same in batch and streaming.
    """
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions")
    # One number per dimension.
    scale = None if idf is None else [r["idf"] for r in idf.orderBy("bucket").select("idf").collect()]
    if scale is not None and len(scale) != dimensions:
        raise ValueError(f"an idf table of {len(scale)} buckets for {dimensions} dimensions")

    weights = 1.0 if scale is None else np.array(scale)

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, int] = {}
        for tokens in batches:
            rows = [np.empty((0, dimensions), dtype=np.float32)]
            for counts in bucket_counts(tokens, dimensions, known):
                weighed = counts * weights
                # Squares are added one after another, as any engine may repeat it.
                length = np.sqrt((weighed * weighed).cumsum(axis=1)[:, -1:])
                rows.append((weighed / np.where(length > 0, length, 1.0)).astype(np.float32))
            ends = np.arange(len(tokens) + 1, dtype=np.int32) * dimensions
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).ravel()))

    # Marked so that the optimizer does not copy the call into filters: it would run twice.
    once = vectors.asNondeterministic()

    def embed(df: DataFrame, text_col: str, out: str) -> DataFrame:
        return df.withColumn(out, once(metric_tokens(F.col(text_col))))

    return embed


def python_model(factory: Callable[[], Callable[[list[str]], np.ndarray]]) -> Model:
    """A model from a factory called once per Python worker task.

    The product maps a list of texts to a 2-d array, one row per text.
    """

    def embed(df: DataFrame, text_col: str, out: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for texts in batches:
                yield pd.Series(list(np.asarray(model(texts.tolist()), dtype=np.float32)))

        return df.withColumn(out, run(F.col(text_col)))

    return embed


#: Models by name; a factory takes its own parameters.
MODELS: dict[str, Callable[..., Model]] = {"hashed_terms": hashed_terms, "python": python_model}


def index_chunks(
    docs: DataFrame,
    id_col: str,
    body_col: str,
    index_name: str,
    model: Model | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    recursive: bool = True,
) -> DataFrame:
    """Chunk store rows of documents of any type: keys, chunk text and vector.

    What else a document has stays in its payload row (``payloads``), once per document and
    not once per chunk, and is joined to the few chunks that a search returns.
    """
    cut = chunk_recursive if recursive else chunk_fixed
    bodies = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(body_col).alias("_body"))
    chunks = cut(bodies, "_body", size, overlap).drop("_body")
    embedded = (model or hashed_terms())(chunks, "chunk", "vector")
    return embedded.select("doc_id", "chunk_no", "chunk", "vector", F.lit(index_name).alias("index_name"))


def payloads(docs: DataFrame, id_col: str, index_name: str, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, payload, index_name): the columns of a document type as one struct."""
    kept = columns or [c for c in docs.columns if c != id_col]
    return docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("payload"),
        F.lit(index_name).alias("index_name"),
    )


def build_index(
    emails: DataFrame,
    id_col: str,
    index_name: str,
    model: Model | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    recursive: bool = True,
) -> DataFrame:
    """Self-contained chunk rows of clean emails: chunk text, its vector, the whole email.

    For small indexes; ``index_chunks`` and ``payloads`` keep an email once.
    ``emails`` has email, subject, thread, date (ISO text) and summary columns.
    """
    cut = chunk_recursive if recursive else chunk_fixed
    packed = emails.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.struct("email", "subject", "thread", "date", "summary").alias("email_row"),
        F.col("email").alias("_body"),
    )
    chunks = cut(packed, "_body", size, overlap).drop("_body")
    embedded = (model or hashed_terms())(chunks, "chunk", "vector")
    return embedded.select(
        "doc_id",
        "chunk_no",
        "chunk",
        F.col("email_row").alias("email"),
        "vector",
        F.lit(index_name).alias("index_name"),
    )
