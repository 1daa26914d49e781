"""Corpus perplexity under an add-one bigram model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import metric_tokens
from ..session import cut_lineage
from .ordering import uneven_join


def _bigrams(texts: DataFrame) -> DataFrame:
    """(id, w1, w2): a row per bigram."""
    tokens = texts.select("id", metric_tokens(F.col("text")).alias("t"))
    # Short texts have no pairs; a filter on their size would find the tokens a second time.
    followers = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.arrays_zip(
        F.slice("t", F.lit(1), followers).alias("w1"), F.slice("t", F.lit(2), followers).alias("w2")
    )
    return tokens.select("id", F.explode(pairs).alias("b")).select("id", "b.w1", "b.w2")


def row_perplexity(
    train: DataFrame, test: DataFrame, id_col: str, text_col: str
) -> DataFrame:
    """(id, n_bigrams, log_prob, perplexity) of every test row with two words or more.

    p(w2 | w1) = (count(w1, w2) + 1) / (count(w1) + V), counts and the vocabulary
    V (distinct words of any bigram) from the training rows. Both parts are
    counted per bigram in one pass, training rows under the id NULL; bigrams of a
    test row mostly differ and are not counted per row first. Probabilities are
    looked up once per distinct bigram; common bigrams and words are spread.
    """
    texts = test.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learnt = train.select(
        F.lit(None).cast(texts.schema["id"].dataType).alias("id"), F.col(text_col).alias("text")
    )
    pairs = cut_lineage(
        _bigrams(texts.unionByName(learnt))
        .groupBy("w1", "w2")
        .agg(F.count_if(F.col("id").isNull()).alias("c12"), F.count("id").alias("asked"))
    )
    # Per word: its count as a first word, how many pairs ask for it (so who is common is known
    # from here), and whether a training row has it.
    trained = (F.col("c12") > 0).alias("trained")
    as_first = F.struct(F.col("w1").alias("w"), F.col("c12").alias("c1"), (F.col("asked") > 0).alias("asks"), trained)
    as_second = F.struct(F.col("w2").alias("w"), F.lit(0).cast("bigint").alias("c1"), F.lit(False).alias("asks"), trained)
    first = cut_lineage(
        pairs.select(F.inline(F.array(as_first, as_second)))
        .groupBy(F.col("w").alias("w1"))
        .agg(F.sum("c1").alias("c1"), F.count_if("asks").alias("count"), F.max("trained").alias("trained"))
    )
    vocabulary = first.where("trained").count()
    logp = uneven_join(
        pairs.where("asked > 0").select("w1", "w2", "c12"),
        first.where("count > 0").select("w1", "c1"),
        ["w1"],
        ["w2"],
        counts=first.select("w1", "count"),
    ).select(
        "w1",
        "w2",
        F.ln((F.col("c12") + 1) / (F.coalesce("c1", F.lit(0)) + F.lit(vocabulary))).alias("lp"),
    )
    asked = _bigrams(texts.where(F.col("id").isNotNull()))
    counts = pairs.select("w1", "w2", F.col("asked").alias("count"))
    scored = uneven_join(asked, logp, ["w1", "w2"], ["id"], how="inner", counts=counts)
    per_row = scored.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_bigrams"), F.sum("lp").alias("log_prob")
    )
    return per_row.select(
        F.col("id").alias(id_col),
        "n_bigrams",
        "log_prob",
        F.exp(-F.col("log_prob") / F.col("n_bigrams")).alias("perplexity"),
    )


def corpus_perplexity(per_row: DataFrame) -> DataFrame:
    """One row over all texts: (n_rows, n_bigrams, cross_entropy, perplexity)."""
    totals = per_row.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_bigrams").alias("n_bigrams"),
        (-F.sum("log_prob") / F.sum("n_bigrams")).alias("cross_entropy"),
    )
    return totals.withColumn("perplexity", F.exp("cross_entropy"))
