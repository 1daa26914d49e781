"""The preparation stages, composed. Every stage returns a lazy DataFrame.

Write a stage with ``sources.store.materialise`` where a later one reads it
more than once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (
    CACHED_NEIGHBOURS,
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    PROMPT_RAG_EMAILS,
    PROMPT_THREAD_EMAILS,
    RELEVANCE_THRESHOLD,
    SEED,
)
from ..functions.dates import sort_micros
from ..operators import cleaning, prompting
from ..operators.embedding import Model, hashed_terms, index_chunks
from ..operators.embedding import payloads as payload_rows
from ..operators.generation import GeneratorFactory, generate
from ..operators.retrieval import Retriever, nearest, nearest_kept, with_neighbours
from ..operators.splitting import split_train_test
from ..session import cut_lineage
from ..sources import mbox


@dataclass(frozen=True)
class Settings:
    """Parameters of a run, with the defaults users know."""

    addresses: tuple[str, ...]
    seed: int = SEED
    test_split: float = 0.0
    split_type: str = "random"
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    neighbours: int = CACHED_NEIGHBOURS
    relevance_threshold: float = RELEVANCE_THRESHOLD
    rag_emails: int = PROMPT_RAG_EMAILS
    thread_emails: int = PROMPT_THREAD_EMAILS
    index_name: str = "emails"
    system_preamble: str = prompting.SYSTEM_PREAMBLE
    user_preamble: str = ""
    chat_model: str = "llama"
    rag_preamble: str = prompting.RAG_PREAMBLE
    thread_preamble: str = prompting.THREAD_PREAMBLE
    # Approximate retrieval: cells visited per query, and how many there are.
    probes: int | None = None
    cells: int | None = None


def extract(
    spark: SparkSession,
    path: str | list[str],
    settings: Settings,
    detect_language: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Mailbox files to flagged parts: scan, part walk and all rules; messages are not shuffled.

    Only plain text of the wanted senders is decoded.
    """
    messages = mbox.read_mbox(spark, path)
    parts = mbox.part_date(mbox.explode_parts(messages, settings.addresses, plain_only=True))
    flagged = cleaning.flag_parts(parts, list(settings.addresses), detect_language)
    return flagged.withColumn("email_id", F.concat_ws("#", "msg_id", "part_no"))


def instruct(
    emails: DataFrame, factory: GeneratorFactory, validate: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Emails with a generated instruction in ``summary``, and the rejected ones.

    With ``validate`` a reply must hold the keyword exactly once and the text
    behind it is kept; otherwise every reply is taken as it is. Replies are
    written before they are told apart, so the generator runs once per email.
    """
    asked = emails.withColumn("_prompt", prompting.summary_prompt(F.col("email")))
    answered = generate(asked, "_prompt", factory, "_reply").drop("_prompt", "sample_no")
    answered = cut_lineage(answered)
    if not validate:
        return answered.withColumnRenamed("_reply", "summary"), answered.where(F.lit(False))
    valid = prompting.has_one_instruction(F.col("_reply"))
    kept = answered.where(valid).withColumn(
        "summary", prompting.instruction_behind_key(F.col("_reply"))
    )
    return kept.drop("_reply"), answered.where(~valid).withColumnRenamed("_reply", "reply")


def split(emails: DataFrame, settings: Settings, id_col: str = "email_id") -> DataFrame:
    return split_train_test(
        emails,
        id_col,
        settings.test_split,
        settings.split_type,
        sort_micros(F.col("date")) if "date" in emails.columns else None,
        settings.seed,
    )


def index(
    train: DataFrame, settings: Settings, model: Model | None = None, id_col: str = "email_id"
) -> DataFrame:
    """Chunks and vectors of the training emails; the emails themselves are ``payloads``."""
    return index_chunks(
        train, id_col, "email", settings.index_name, model, settings.chunk_size, settings.chunk_overlap
    )


def payloads(train: DataFrame, settings: Settings, id_col: str = "email_id") -> DataFrame:
    """The training emails as the payload table of their index, one row each."""
    emails = train.select(id_col, "email", "subject", "thread", F.col("date_iso").alias("date"), "summary")
    return payload_rows(emails, id_col, settings.index_name)


def enrich(
    train: DataFrame,
    chunks: DataFrame,
    settings: Settings,
    model: Model | None = None,
    id_col: str = "email_id",
    query_text: Column | None = None,
    drop_contained: bool = True,
    exclude_self: bool = True,
    retriever: Retriever = nearest,
    stored: DataFrame | None = None,
    refill: bool = False,
) -> DataFrame:
    """Training emails with their nearest stored emails in ``relevant_emails``.

    ``chunks`` are keyed chunks of ``stored`` payloads (by default of ``train`` itself), or
    self-contained ones with an ``email`` column. With ``refill`` contained hits are replaced
    by the next nearest ones, as far as there are any.

    By default a row asks with its own body and loses the hits it contains.
    ``query_text=instruction_of(summary)`` with ``drop_contained=False`` and
    ``exclude_self=False`` asks the way a prompt does at writing time.
    """
    keyed = chunks.withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_no"))
    asked = train.select(id_col, (F.col("email") if query_text is None else query_text).alias("q"))
    queries = (model or hashed_terms())(asked, "q", "vector")
    options = {"probes": settings.probes, "cells": settings.cells}
    chunk_of = F.regexp_replace("chunk_id", r"#[0-9]+\z", "")
    own = (chunk_of == F.col(id_col)) if exclude_self else None
    if refill:
        queries = cut_lineage(queries.join(train.select(id_col, F.col("email").alias("_body")), id_col))
        search = partial(retriever, **options)
        hits = nearest_kept(
            queries, keyed, settings.neighbours, "_body", "chunk", id_col, exclude_self=own, search=search
        )
    else:
        hits = retriever(queries, keyed, settings.neighbours, query_id=id_col, **options)
    whole = "email" in chunks.columns
    return with_neighbours(
        train,
        hits,
        keyed,
        id_col,
        "email",
        "chunk_id",
        "chunk",
        F.col("email" if whole else "payload"),
        drop_contained=drop_contained and not refill,
        exclude_self=own,
        payloads=None if whole else (payloads(train, settings, id_col) if stored is None else stored),
    )


def training_pairs(
    enriched: DataFrame, settings: Settings, build_prompt: Callable[..., Column] = prompting.email_prompt
) -> DataFrame:
    """Prompt and response of every row with a summary, plus the length check.

    ``build_prompt`` has the arguments of ``email_prompt``.
    """
    hits = None
    if settings.rag_emails > 0:
        near = F.filter(
            "relevant_emails", lambda h: h["score"] >= settings.relevance_threshold
        )
        hits = F.transform(
            F.slice(near, 1, settings.rag_emails), lambda h: h["serialized_email"]["email"]
        )
    prompt = build_prompt(
        prompting.instruction_of(F.col("summary")),
        settings.system_preamble,
        settings.user_preamble,
        hits=hits,
        rag_preamble=settings.rag_preamble,
        thread=F.col("thread"),
        thread_emails=settings.thread_emails,
        thread_preamble=settings.thread_preamble,
    )
    paired = enriched.select(
        "email_id",
        prompting.pair_prompt(prompt, settings.chat_model).alias("prompt"),
        prompting.pair_response(F.col("email"), settings.chat_model).alias("response"),
    )
    fits = prompting.within_length(F.col("prompt"), F.col("response"))
    return paired.withColumn("fits", fits)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while a later action runs, without a job of its own."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
