"""Batch text generation behind one extension point.

A generator factory is called once per task on the executors and returns a
function from a pandas Series of prompts to a Series of replies, so a model is
loaded once, not per row or per batch. Batch size is Spark's Arrow batch size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Generator = Callable[[pd.Series], pd.Series]
GeneratorFactory = Callable[[], Generator]


def echo() -> Generator:
    """Answers ``Received: <prompt>``; for tests."""
    return lambda prompts: "Received: " + prompts


def extractive() -> Generator:
    """A stand-in for a real model: the last prompt paragraph's first sentence,
    written as an instruction."""
    sentence = re.compile(r"\s*(.+?[.!?])(\s|\Z)", re.DOTALL)

    def run(prompts: pd.Series) -> pd.Series:
        def one(prompt: str) -> str:
            last = prompt.strip().rsplit("\n\n", 1)[-1]
            found = sentence.match(last)
            return "Instruction: Write an email saying: " + (found.group(1) if found else last)

        return prompts.map(one)

    return run


GENERATORS: dict[str, GeneratorFactory] = {"echo": echo, "extractive": extractive}


GENERATION_ROWS = 256


def by_length(prompts: pd.Series, model: Generator, batch_rows: int) -> pd.Series:
    """Replies in the order of ``prompts``, asked for in batches of like length."""
    size = prompts.str.len().fillna(0)
    order = size.argsort(kind="stable").to_numpy()
    replies = np.empty(len(prompts), dtype=object)
    for at in range(0, len(order), batch_rows):
        rows = order[at : at + batch_rows]
        replies[rows] = np.asarray(model(prompts.iloc[rows]), dtype=object)
    return pd.Series(replies, index=prompts.index)


def generate(
    df: DataFrame,
    prompt_col: str,
    factory: GeneratorFactory,
    out: str = "response",
    samples: int = 1,
    batch_rows: int = GENERATION_ROWS,
) -> DataFrame:
    """Add ``sample_no`` and ``out``: ``samples`` replies per row, keys kept.

    Only the prompt column goes through Python. The call is marked so that the
    optimizer never repeats it. A model gets prompts of like length together, at most
    ``batch_rows`` at a time, so what it pads them with stays small; replies go back to
    their prompts' places.
    """

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield by_length(prompts, model, batch_rows)

    asked = df.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return asked.withColumn(out, run.asNondeterministic()(F.col(prompt_col)))
