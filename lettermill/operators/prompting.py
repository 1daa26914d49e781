"""Prompts and prompt/response pairs as column expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    INSTRUCTION_KEY,
    INSTRUCTION_SEPARATOR,
    ITEM_TAIL,
    MAX_PAIR_TOKENS,
    RAG_ITEM_HEAD,
    RAG_PREAMBLE,
    REPLY_LITERAL,
    REPLY_PATTERNS,
    SUMMARY_TEMPLATE,
    SYSTEM_PREAMBLE,
    THREAD_PREAMBLE,
)
from ..functions.templates import chat_markers, fill
from ..functions.text import after_last, before_first, strip, word_count


def rag_context(bodies: Column) -> Column:
    """Retrieved bodies, in rank order, one block each."""
    blocks = F.transform(
        bodies, lambda b: F.concat(F.lit(RAG_ITEM_HEAD), b, F.lit(ITEM_TAIL))
    )
    return F.array_join(blocks, "")


def thread_head(thread: Column, n: int) -> Column:
    """The first ``n`` (oldest) thread entries."""
    return F.slice(F.coalesce(thread, F.array().cast("array<string>")), 1, n)


def thread_context(thread: Column) -> Column:
    return F.array_join(F.transform(thread, lambda t: F.concat(t, F.lit(ITEM_TAIL))), "")


def email_prompt(
    instruction: Column,
    system_preamble: str = SYSTEM_PREAMBLE,
    user_preamble: str = "",
    hits: Column | None = None,
    rag_preamble: str = RAG_PREAMBLE,
    thread: Column | None = None,
    thread_emails: int = 0,
    thread_preamble: str = THREAD_PREAMBLE,
    emit_empty_rag: bool = True,
    emit_empty_thread: bool = True,
) -> Column:
    """The prompt: stripped non-empty sections, a blank line after each, instruction.

    ``hits`` is an array of retrieved bodies (None: retrieval is off). With
    retrieval on and no hits the preamble is still written around an empty
    context unless ``emit_empty_rag`` is False (the older behaviour).
    """
    if hits is not None and not rag_preamble:
        raise ValueError("a retrieval preamble is needed when hits are given")
    if thread_emails > 0 and not thread_preamble:
        raise ValueError("a thread preamble is needed when thread emails are used")
    sections = [F.lit(system_preamble.strip()), F.lit(user_preamble.strip())]
    if hits is not None:
        section = strip(fill(rag_preamble, rag_context=rag_context(hits)))
        if not emit_empty_rag:
            section = F.when(F.size(hits) > 0, section).otherwise("")
        sections.append(section)
    if thread is not None and thread_emails > 0:
        head = thread_head(thread, thread_emails)
        section = strip(fill(thread_preamble, threading_context=thread_context(head)))
        if not emit_empty_thread:
            section = F.when(F.size(head) > 0, section).otherwise("")
        sections.append(section)
    written = [F.when(s != "", F.concat(s, F.lit("\n\n"))).otherwise("") for s in sections]
    return F.concat(*written, F.lit(INSTRUCTION_KEY), instruction)


def legacy_email_prompt(instruction: Column, **sections) -> Column:
    """The older builder: empty sections vanish, contexts are chunk texts."""
    return email_prompt(
        instruction, **sections, emit_empty_rag=False, emit_empty_thread=False
    )


def summary_prompt(body: Column, template: str = SUMMARY_TEMPLATE) -> Column:
    return strip(fill(template, email=body))


def user_message(prompt: Column) -> Column:
    """A one-message chat."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def conversation(prompt: Column, reply: Column) -> Column:
    return F.array(
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
        F.struct(F.lit("assistant").alias("role"), reply.alias("content")),
    )


def pair_prompt(prompt: Column, model_name: str | Column) -> Column:
    """Everything up to where the response starts."""
    m = chat_markers(model_name)
    return F.concat(m["prompt_start"], prompt, m["prompt_end"], m["response_start"])


def pair_response(reply: Column, model_name: str | Column) -> Column:
    return F.concat(strip(reply), chat_markers(model_name)["response_end"])


def within_length(
    prompt: Column, response: Column, max_tokens: int = MAX_PAIR_TOKENS
) -> Column:
    """True if the pair has at most ``max_tokens`` whitespace tokens."""
    return word_count(prompt) + word_count(response) <= max_tokens


def instruction_of(summary: Column) -> Column:
    """The instruction inside a stored summary."""
    return after_last(summary, INSTRUCTION_SEPARATOR)


def has_one_instruction(generated: Column) -> Column:
    """Exactly one ``Instruction: `` keyword in a generated summary."""
    return F.regexp_count(generated, F.lit(INSTRUCTION_KEY)) == 1


def instruction_behind_key(generated: Column) -> Column:
    return after_last(generated, INSTRUCTION_KEY)


def strip_boilerplate(reply: Column) -> Column:
    """Drop the opening phrases of instruction-tuned models, every occurrence."""
    out = F.replace(reply, F.lit(REPLY_LITERAL), F.lit(""))
    for pattern in REPLY_PATTERNS:
        out = F.regexp_replace(out, "(?d)" + pattern, "")
    return out


def generated_text(decoded: Column, model_name: str) -> Column:
    """The reply inside a decoded model output with its chat markers."""
    from ..fixed_values import CHAT_MARKERS

    family = next((f for f in CHAT_MARKERS if f in model_name.lower()), None)
    if family is None:
        raise ValueError(f"no chat markers for model {model_name}")
    _, prompt_end, _, response_end = CHAT_MARKERS[family]
    return strip(before_first(after_last(decoded, prompt_end), response_end))
