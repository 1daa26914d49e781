"""Bulk answering and scoring of a test table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import RELEVANCE_THRESHOLD
from ..operators import prompting
from ..operators.divergence import kmeans_cells, mauve
from ..operators.embedding import Model, hashed_terms
from ..operators.generation import GeneratorFactory, generate
from ..operators.ordering import rank_in_group
from ..operators.retrieval import Retriever, above_threshold, nearest, with_neighbours
from ..operators.scoring import ROUGE_KEYS, bleu, metric_means, rouge
from ..session import cut_lineage


@dataclass
class Evaluation:
    """responses: one row per prompt and sample; goldens: one row per golden;
    scores: one row per sample; metrics: one row."""

    responses: DataFrame
    goldens: DataFrame
    scores: DataFrame | None
    metrics: DataFrame | None


def _with_hits(
    prompts: DataFrame,
    chunks: DataFrame,
    k: int,
    threshold: float,
    model: Model,
    search: Callable[..., DataFrame],
    stored: DataFrame | None,
) -> DataFrame:
    """Add ``hits``: bodies of the stored emails nearest to each prompt."""
    keyed = chunks.withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_no"))
    queries = model(prompts.select("prompt_id", "prompt"), "prompt", "vector")
    hits = above_threshold(search(queries, keyed, k, query_id="prompt_id"), threshold)
    found = with_neighbours(
        prompts,
        hits,
        keyed,
        "prompt_id",
        "prompt",
        "chunk_id",
        "chunk",
        F.col("email" if stored is None else "payload"),
        drop_contained=False,
        payloads=stored,
    )
    bodies = F.transform("relevant_emails", lambda h: h["serialized_email"]["email"])
    return found.withColumn("hits", bodies).drop("relevant_emails")


def evaluate(
    test: DataFrame,
    factory: GeneratorFactory,
    prompt: str = "summary",
    seq: str = "seq",
    email: str = "email",
    thread: str = "thread",
    samples: int = 1,
    use_thread: bool = False,
    thread_emails: int = 0,
    chunks: DataFrame | None = None,
    stored: DataFrame | None = None,
    rag_emails: int = 0,
    threshold: float = RELEVANCE_THRESHOLD,
    goldens_for_divergence: str = "all",
    cells: int = 16,
    model: Model | None = None,
    system_preamble: str = prompting.SYSTEM_PREAMBLE,
    user_preamble: str = "",
    rag_preamble: str = prompting.RAG_PREAMBLE,
    thread_preamble: str = prompting.THREAD_PREAMBLE,
    build_prompt: Callable[..., Column] = prompting.email_prompt,
    retriever: Retriever = nearest,
    probes: int | None = None,
    search_cells: int | None = None,
    compute_metrics: bool = True,
) -> Evaluation:
    """Answer every distinct prompt of ``test`` and score against all its goldens.

    Rows with one prompt share their goldens; the last thread counts. The prompt
    id is a hash of the prompt, so goldens find their prompt without a join.
    Replies are generated once and written before they are scored. With
    ``chunks`` and ``rag_emails`` the prompt shows retrieved emails; keyed chunks need their
    payload table ``stored`` as well. Without
    ``compute_metrics`` prompts are only answered.
    """
    embed = model or hashed_terms()
    keyed = test.withColumn("prompt_id", F.md5(F.col(prompt)))
    prompts = keyed.groupBy("prompt_id", F.col(prompt).alias("prompt")).agg(
        F.max_by(thread, seq).alias("thread"), F.min(seq).alias("first_seq")
    )
    if not use_thread:
        prompts = prompts.withColumn("thread", F.lit(None).cast("array<string>"))
    hits = None
    search = partial(retriever, probes=probes, cells=search_cells)
    if chunks is not None and rag_emails > 0:
        prompts = _with_hits(cut_lineage(prompts), chunks, rag_emails, threshold, embed, search, stored)
        hits = F.col("hits")
    full_prompt = build_prompt(
        F.col("prompt"),
        system_preamble,
        user_preamble,
        hits=hits,
        rag_preamble=rag_preamble,
        thread=F.col("thread") if use_thread else None,
        thread_emails=thread_emails,
        thread_preamble=thread_preamble,
    )
    asked = prompts.select("prompt_id", "prompt", "thread", "first_seq", full_prompt.alias("full_prompt"))
    answered = generate(asked, "full_prompt", factory, samples=samples)
    responses = cut_lineage(
        answered.withColumn("response", prompting.strip_boilerplate(F.col("response"))).withColumn(
            "sample_id", F.concat_ws("#", "prompt_id", F.col("sample_no").cast("string"))
        )
    )
    # Numbered densely, so that ranges of goldens are full.
    answers = keyed.where(F.col(email).isNotNull()).select("prompt_id", F.col(seq).alias("_seq"), F.col(email).alias("golden"))
    numbered = rank_in_group(answers, ["prompt_id"], "_seq", "golden_no").select("prompt_id", "golden_no", "golden")
    if not compute_metrics:
        return Evaluation(responses, numbered, None, None)
    # Read several times by BLEU and ROUGE: numbered, and so shuffled, once for them.
    goldens = cut_lineage(numbered)
    replies = responses.select("sample_id", "prompt_id", "response")
    scores = cut_lineage(
        replies.select("sample_id", "prompt_id")
        .join(bleu(replies, goldens), "sample_id", "left")
        .join(rouge(replies, goldens), "sample_id", "left")
    )
    # The start of k-means depends on the order of rows, which a table does not keep.
    compared = numbered
    if goldens_for_divergence == "first":
        compared = numbered.groupBy("prompt_id").agg(F.min_by("golden", "golden_no").alias("golden"))
    both = replies.select(F.col("response").alias("t"), F.lit(True).alias("is_reply")).union(
        compared.select("golden", F.lit(False))
    )
    vectors = cut_lineage(embed(both, "t", "vector").select("vector", "is_reply"))
    divergence = mauve(kmeans_cells(vectors, "vector", cells), "cell", F.col("is_reply"))
    # Two one-row tables side by side.
    one = F.lit(1).alias("one")
    means = metric_means(scores, "bleu", *ROUGE_KEYS).select("*", one)
    metrics = means.join(divergence.select("mauve", one), "one", "left").drop("one")
    return Evaluation(responses, goldens, scores, metrics)
