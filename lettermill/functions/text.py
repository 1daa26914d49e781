"""String expressions with Python's idea of whitespace, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import WS, WS_CHARS

# The whitespace class and its complement with the common case first: printable
# ASCII and most Latin letters are settled by one range test per character.
_PLAIN = r"\x21-\x84\x{a1}-\x{167f}"
SPACE = rf"[[^{_PLAIN}]&&[{WS}]]"
NOT_SPACE = rf"[{_PLAIN}[^{WS}]]"


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends (a plain trim only knows the space)."""
    return F.btrim(text, F.lit(WS_CHARS))


def words(text: Column) -> Column:
    """Whitespace-separated tokens as an array, empty for blank text."""
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def collapse_whitespace(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "), F.lit(" "))


def normalise_for_metrics(text: Column) -> Column:
    """Lower-case text without ASCII punctuation, single spaces between tokens."""
    return collapse_whitespace(_lower_without_punctuation(text))


def metric_tokens(text: Column) -> Column:
    """The tokens of ``normalise_for_metrics``, split in one pass."""
    return words(_lower_without_punctuation(text))


def _lower_without_punctuation(text: Column) -> Column:
    # \p{Punct} is exactly the 32 ASCII marks.
    return F.lower(F.regexp_replace(text, r"\p{Punct}+", ""))


def rouge_tokens(text: Column) -> Column:
    """Tokens of ``[a-z0-9]`` runs, any other character separating them."""
    clean = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.array_remove(F.split(clean, " ", -1), "")


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, in order, joined by one space."""
    grams = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - n + 1),
        lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "),
    )
    return F.when(F.size(tokens) >= n, tokens if n == 1 else grams).otherwise(
        F.array().cast("array<string>")
    )


def explode_ngrams(df: DataFrame, tokens: str, max_n: int, keep: list[str]) -> DataFrame:
    """One row ``(keep..., n, gram)`` per n-gram of a token array, n = 1..max_n.

    The array is zipped with itself shifted by 1, 2, ... and exploded, so a row
    holds the words its n-grams need. Plain expressions throughout: generated
    code, no lambda per element.
    """
    size = F.size(tokens)
    shifted = [
        F.slice(tokens, F.lit(i), F.greatest(size - (i - 1), F.lit(0))).alias(f"w{i}")
        for i in range(1, max_n + 1)
    ]
    rows = df.select(*keep, F.explode(F.arrays_zip(*shifted)).alias("w"))

    def gram(n: int) -> Column:
        # NULL where the text ends before the n-th word.
        parts = [F.col("w.w1")]
        for i in range(2, n + 1):
            parts += [F.lit(" "), F.col(f"w.w{i}")]
        return F.struct(F.lit(n).alias("n"), F.concat(*parts).alias("gram"))

    grams = F.explode(F.array(*[gram(n) for n in range(1, max_n + 1)])).alias("g")
    return rows.select(*keep, grams).where(F.col("g.gram").isNotNull()).select(*keep, "g.*")


def username(address: Column) -> Column:
    """The part of an address before the first ``@``."""
    return F.substring_index(address, "@", 1)


def after_last(text: Column, marker: str) -> Column:
    """The text behind the last occurrence of ``marker``, or all of it."""
    return F.substring_index(text, marker, -1)


def before_first(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, 1)
