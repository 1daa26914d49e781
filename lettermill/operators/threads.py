"""Threads for input where every message of a conversation is a row of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import first_in_group, rank_in_group, uneven_join


def thread_rows(messages: DataFrame, group: str, order: str) -> DataFrame:
    """Add ``n_before``: the complete thread of every message in linear form.

    A message's thread are the rows of its group with a smaller ``n_before``; arrays of
    them would grow with the square of the conversation.
    """
    return rank_in_group(messages, [group], order, "n_before")


def thread_head(
    messages: DataFrame, group: str, order: str, text: str, n: int
) -> DataFrame:
    """Add ``thread`` (the first ``n`` messages before this one) and ``n_before``.

    Prompts read a thread from its oldest message on, so this keeps its head;
    ``n_before`` is the full length and ``thread_rows`` the whole thread. The head is built once per
    conversation, however many messages read it.
    """
    heads = (
        first_in_group(messages.select(group, order, text), [group], [F.col(order)], n)
        .groupBy(group)
        .agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_head"))
    )
    ranked = rank_in_group(messages, [group], order, "n_before")
    earlier = F.filter("_head", lambda h: h[order] < F.col(order))
    return (
        uneven_join(ranked, heads, [group], [order])
        .withColumn("thread", F.transform(earlier, lambda h: h[text]))
        .drop("_head")
    )


thread_so_far = thread_head
