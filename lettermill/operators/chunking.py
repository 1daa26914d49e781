"""Cutting bodies into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_SIZE


def chunk_fixed(df: DataFrame, text_col: str, size: int, overlap: int) -> DataFrame:
    """One row per window of ``size`` characters, each ``size - overlap`` further on.

    The last window is the first one that reaches the end of the text; empty
    texts give no row. Adds ``chunk_no`` and ``chunk``.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    step = size - overlap
    n = F.length(text_col)
    last = F.greatest(F.ceil((n - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
    # Steps are cut once, in one pass over the text; a window is a few whole steps.
    # Taking substrings at growing offsets would read the text again for each.
    steps = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(1), last + 1),
        lambda i: F.left(
            F.array_join(F.slice("_steps", i, F.lit(-(-size // step))), ""), F.lit(size)
        ),
    )
    return (
        df.withColumn("_steps", steps)
        .select("*", F.posexplode(F.when(n > 0, windows)).alias("chunk_no", "chunk"))
        .drop("_steps")
    )


def _slide(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``; start the next chunk with at most
    ``overlap`` characters of the last one, as far as the next piece still fits."""
    start = end = length = 0
    for piece in pieces:
        if length + len(piece) > size:
            if chunk := "".join(pieces[start:end]).strip():
                yield chunk
            while length > overlap or (length and length + len(piece) > size):
                length -= len(pieces[start])
                start += 1
        length += len(piece)
        end += 1
    if chunk := "".join(pieces[start:end]).strip():
        yield chunk


def split_recursively(
    text: str, size: int, overlap: int, separators: tuple[str, ...] = CHUNK_SEPARATORS
) -> Iterator[str]:
    """Chunks of one text: cut at the coarsest separator it contains, keep the
    separator in front of its piece, and cut too long pieces more finely."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        head, *tail = text.split(separator)
        pieces = [p for p in [head, *(separator + t for t in tail)] if p]
    else:
        pieces = list(text)
    run: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
            continue
        if run:
            yield from _slide(run, size, overlap)
            run = []
        if finer:
            yield from split_recursively(piece, size, overlap, finer)
        else:
            yield piece
    if run:
        yield from _slide(run, size, overlap)


def chunk_recursive(
    df: DataFrame, text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk, cut at paragraph, line, word or character borders."""
    if overlap > size:
        raise ValueError("overlap must not exceed the chunk size")

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [list(split_recursively(t or "", size, overlap)) for t in texts], dtype=object
            )

    return df.select("*", F.posexplode(cut(F.col(text_col))).alias("chunk_no", "chunk"))
