"""Language identification: naive Bayes over hashed character trigrams.

The model is a table of integer log-probabilities with one row per trigram
bucket and one column per language: at most BUCKETS x MAX_LANGUAGES numbers
whatever the corpus size, so it can be broadcast. Scores are sums of integers
and therefore the same in any order of evaluation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
MAX_LANGUAGES = 64
MICRO = 1_000_000
CHARS_AT_ONCE = 1 << 20
_A, _B = 961, 31
_NONE = np.empty(0, dtype=np.int64)


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket numbers of all trigrams of the text padded by one space each side."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    codes = codes.astype(np.int64)
    return (codes[:-2] * _A + codes[1:-1] * _B + codes[2:]) % BUCKETS


def slices(texts: list[str | None], most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` characters together: what is looked at in one go."""
    start = chars = 0
    for at, text in enumerate(texts):
        chars += len(text or "")
        if chars >= most:
            yield start, at + 1
            start, chars = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def trigram_counts(
    df: DataFrame, text_col: str, lang_col: str, max_languages: int = MAX_LANGUAGES
) -> DataFrame:
    """(lang, bucket, n) over the whole texts, counted before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                if lang not in seen:
                    if len(seen) >= max_languages:
                        raise ValueError("more languages than max_languages")
                    seen[lang] = np.zeros(BUCKETS, dtype=np.int64)
                texts = texts.tolist()
                for start, end in slices(texts):
                    buckets = np.concatenate([trigram_buckets(t) for t in texts[start:end]])
                    seen[lang] += np.bincount(buckets, minlength=BUCKETS)
        for lang, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": counts[used]})

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    return (
        rows.mapInPandas(count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def train_profile(
    df: DataFrame, text_col: str, lang_col: str, max_languages: int = MAX_LANGUAGES
) -> tuple[list[str], np.ndarray]:
    """Languages in name order and their (BUCKETS, languages) table of micro-nats.

    The counts come to the driver and the table is broadcast: half a megabyte a language,
    so ``max_languages`` is what bounds both. More languages are an error, not left out.
    """
    counts = trigram_counts(df, text_col, lang_col, max_languages)
    names = [r[0] for r in df.select(lang_col).dropna().distinct().limit(max_languages + 1).collect()]
    if len(names) > max_languages:
        raise ValueError("more languages than max_languages")
    langs = sorted(names)
    table = np.zeros((BUCKETS, len(langs)), dtype=np.int64)
    got = counts.toPandas()
    place = {lang: i for i, lang in enumerate(langs)}
    table[got["bucket"].to_numpy(), got["lang"].map(place).to_numpy()] = got["n"].to_numpy()
    logp = np.log((table + 1) / (table.sum(axis=0) + BUCKETS))
    return langs, np.round(logp * MICRO).astype(np.int64)


def language_detector(
    df: DataFrame, profile: tuple[list[str], np.ndarray]
) -> Callable[[Column], Column]:
    """A function from a text column to its most likely language.

    NULL for texts without a letter (nothing to detect) and for NULL texts; on
    equal scores the language first by name wins.
    """
    langs, table = profile
    shared = df.sparkSession.sparkContext.broadcast((langs, table))

    @F.pandas_udf("string")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, logp = shared.value
        names = np.array(names, dtype=object)
        for batch in batches:
            texts = batch.tolist()
            out = np.full(len(texts), None, dtype=object)
            for begin, end in slices(texts):
                # Many texts at once: one run of trigrams, one sum per text.
                runs = [trigram_buckets(t) if t is not None else _NONE for t in texts[begin:end]]
                length = np.array([len(r) for r in runs])
                some = np.flatnonzero(length)
                if len(some):
                    starts = np.append(0, np.cumsum(length[some])[:-1])
                    buckets = np.concatenate([runs[i] for i in some])
                    total = np.stack([np.add.reduceat(column[buckets], starts) for column in logp.T], axis=1)
                    out[begin + some] = names[total.argmax(axis=1)]
            yield pd.Series(out, dtype=object)

    # Marked so that the optimizer neither copies the call into filters nor runs it twice.
    once = best.asNondeterministic()
    return lambda text: once(F.when(text.rlike(r"\p{L}"), text))
