"""The corpus pipeline: documents through five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``docs``; the last gives the encoded corpus. Every stage works on all that the
one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import bpe_codec, exact_dedup, ngram_join, source_mix, toxicity
from lettermill.llm.common import documents, labels, new_work_path, release
from lettermill.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    return toxicity.keep_mild(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text."""
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8 or more."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced mix takes them."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, encoded and decoded: counts and digests."""
    return bpe_codec.round_trip(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe_codec", encode),
]

# Learned scores, balanced draws and merges have no SQL form. The pipeline test holds exact
# deduplication against a brute-force version, the toxicity and join stages against their own
# operators, the mix and the encoding against row sets and totals; it does not call run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = new_work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what this stage has read and rewritten
            release(spark, before)
        before = path
    return docs
