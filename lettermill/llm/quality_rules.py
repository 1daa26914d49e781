"""Line-first cleaning and quality rules, in DataFrame functions only.

Every line is judged first; a line goes if it fails one of

* punctuation: symbols ``# * $ % & | < > { }`` or doubled ``!!`` / ``??`` on more than a
  fifth of its words;
* navigation: three or more separators (``|``, ``>>`` and the like), or a short line that
  is a menu word list;
* boilerplate: a short line with a stock phrase (cookies, sign in, all rights reserved, ...),
  or a line of ten words or more that says the same few over and over (distinct words are
  fewer than a quarter).

A document is rejected if what is left has too few words, or if more than MAX_LOSS percent
of its words went with the lines. Base rules on the whole text reject it before that: fewer
than MIN_WORDS words, or more than MAX_REPEATED percent of its words in 8-word windows that
occur twice or more.

Repeated windows are found within the row: hashes of all windows are sorted with their
places, equal neighbours mark their places, and the covered words are the sum of
least(8, distance to the next marked place). Texts with no repeated window, nearly all of
them, end at a comparison of two array sizes. Nothing is shuffled.

Defined cases: a null, empty or blank text has no words, fails the base rules and has no
lines to judge; every row is judged by itself, so repeated rows and null ids are rows like
any other; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, text_or_empty

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
MAX_LOSS = 50

SYMBOLS = r"[#*$%&|<>]"
LINE_SYMBOLS = r"[#*$%&|<>{}]|!!|\?\?"
SEPARATORS = r"[|»›•·]|>>|::"
MENU = r"(?i)^[ \t]*(home|about|contact|login|search|menu|next|previous|share|help)([ \t]+(us|in|home|about|contact|login|search|menu|next|previous|share|help))*[ \t]*$"
STOCK = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie(s| policy)|sign (in|up)\b"
    r"|log ?in\b|subscribe to|newsletter|click here|read more|javascript|lorem ipsum)"
)
STOCK_WORDS = 15
STUTTER_WORDS, STUTTER = 10, 4


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_fails(line: Column) -> Column:
    """Whether one line goes."""
    n = F.regexp_count(line, F.lit(WORD))
    signs = F.regexp_count(line, F.lit(LINE_SYMBOLS))
    return (
        (signs * 5 > n)
        | (F.regexp_count(line, F.lit(SEPARATORS)) >= 3)
        | line.rlike(MENU)
        | ((n <= STOCK_WORDS) & line.rlike(STOCK))
        | ((n >= STUTTER_WORDS) & (F.size(F.array_distinct(words_of(line))) * STUTTER < n))
    )


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: words inside windows of WINDOW words that occur twice or more in the row.

    Each step is its own projection: what is used twice is computed once.
    """
    n = F.size(words)
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_windows", windows)
    # Only rows with a repeated window carry the sorted pairs on.
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(some, pairs)).drop("_windows")

    def marked(pair: Column, k: Column) -> Column:
        before, after = F.get("_sorted", k - 1)["h"], F.get("_sorted", k + 1)["h"]
        return pair["h"].eqNullSafe(before) | pair["h"].eqNullSafe(after)

    places = F.transform(F.filter("_sorted", marked), lambda pair: pair["i"])
    df = df.withColumn("_places", F.sort_array(places)).drop("_sorted")
    covered = F.aggregate(
        F.transform(
            "_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW)))
        ),
        F.lit(0).cast("bigint"),
        lambda total, step: total + step,
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_places")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_kept_words, n_lines, n_bad_lines, clean_text."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
    ).withColumn("n_words", F.size("words").cast("bigint"))
    rows = repeated_words(rows, "words", "n_repeat_words").drop("words", "text")
    rows = rows.withColumn("good", F.filter("lines", lambda line: ~line_fails(line)))
    rows = rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("bigint").alias("n_bad_lines"),
        F.array_join("good", "\n").alias("clean_text"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    )
    rows = rows.withColumn("n_kept_words", F.regexp_count("clean_text", F.lit(WORD)).cast("bigint"))
    loses = 100 * (F.col("n_words") - F.col("n_kept_words")) > MAX_LOSS * F.col("n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_kept_words") >= MIN_WORDS) & ~loses)
