"""From message parts to clean emails, with a reason for every discarded part.

All rules are columns of one narrow projection over the parts: no shuffle, one
scan, and the language detector only sees text that passed the cheap rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ATTRIBUTION, ATTRIBUTION_STRICT, FORWARD_TAG, MIN_WORDS, WS
from ..functions.text import strip, word_count


def sent_by(from_addr: Column, addresses: list[str]) -> Column:
    """True if any address occurs, case-sensitively, in the From header."""
    found = F.lit(False)
    for address in addresses:
        found = found | F.contains(from_addr, F.lit(address))
    return F.coalesce(found, F.lit(False))


def is_forwarded(text: Column) -> Column:
    return F.contains(text, F.lit(FORWARD_TAG))


def decoded(payload: Column) -> Column:
    """The payload as text if it is valid UTF-8, else NULL."""
    text = payload.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def strip_attribution(text: Column, strict: bool = False) -> Column:
    """Cut the "On ... wrote" / "Am ... schrieb" line.

    The default pattern lets ``.`` cross lines: it cuts from the first line that
    starts with On/Am, if wrote/schrieb follows anywhere, to the end of the text.
    ``strict`` only removes complete one-line attributions.
    """
    if strict:
        return strip(F.regexp_replace(text, "(?dm)" + ATTRIBUTION_STRICT, ""))
    may_match = F.contains(text, F.lit("wrote")) | F.contains(text, F.lit("schrieb"))
    cut = F.regexp_replace(text, "(?dms)" + ATTRIBUTION, "")
    return F.when(may_match & (cut != text), strip(cut)).otherwise(text)


def drop_quoted_lines(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda l: ~F.startswith(l, F.lit(">")))
    return F.array_join(kept, "\n")


def quote_lines(text: Column) -> Column:
    """Lines as ``(level, line)``: the number of leading ``>`` and the rest."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda l: F.struct(
            F.length(F.regexp_extract(l, "^>*", 0)).alias("level"),
            F.regexp_replace(l, rf"\A>*[{WS}]*", "").alias("line"),
        ),
    )


def quote_groups(lines: Column) -> Column:
    """Per quote level, in first-seen order, its lines joined and stripped."""
    return F.transform(
        F.array_distinct(lines["level"]),
        lambda level: F.struct(
            level.alias("level"),
            strip(
                F.array_join(
                    F.transform(
                        F.filter(lines, lambda x: x["level"] == level), lambda x: x["line"]
                    ),
                    "\n",
                )
            ).alias("text"),
        ),
    )


def split_thread(df: DataFrame, text_col: str, strict_attribution: bool = False) -> DataFrame:
    """Add ``main`` (first-seen quote level) and ``thread`` (the others, oldest first).

    The split goes through a one-row generator: filters on what it gives are not moved
    below it, so the lines of a message are taken apart once however often they are asked.
    """
    return (
        df.withColumn("_lines", quote_lines(F.col(text_col)))
        .withColumn("_groups", quote_groups(F.col("_lines")))
        .withColumn(
            "_groups",
            F.transform("_groups", lambda g: strip_attribution(g["text"], strict_attribution)),
        )
        .withColumn("_groups", F.explode_outer(F.array("_groups")))
        .withColumn("main", F.element_at("_groups", 1))
        .withColumn(
            "thread",
            F.reverse(F.slice("_groups", F.lit(2), F.greatest(F.size("_groups"), F.lit(0)))),
        )
        .drop("_lines", "_groups")
    )


def flag_parts(
    parts: DataFrame,
    addresses: list[str],
    detect_language: Callable[[Column], Column] | None = None,
    keep_language: str = "en",
    strict_attribution: bool = False,
) -> DataFrame:
    """Add ``text``, ``main``, ``thread`` and ``reason`` (NULL for clean parts).

    ``parts`` has from_addr, date_raw, date_us, content_type and payload. The
    first rule that applies gives the reason. ``detect_language`` maps a text
    column to a language column; without it the language rule is off.
    """
    flagged = (
        parts.withColumn("text", decoded(F.col("payload")))
        .withColumn(
            "_early",
            F.when(~sent_by(F.col("from_addr"), addresses), "other_sender")
            .when(F.coalesce(F.col("date_raw"), F.lit("")) == "", "missing_date")
            .when(F.col("date_us").isNull(), "bad_date")
            .when(~F.col("content_type").eqNullSafe("text/plain"), "not_plain_text")
            .when(F.col("text").isNull(), "cant_decode_utf8")
            .when(is_forwarded(F.col("text")), "forwarded"),
        )
        .withColumn("_body", F.when(F.col("_early").isNull(), F.col("text")))
    )
    flagged = split_thread(flagged, "_body", strict_attribution)
    flagged = flagged.withColumn(
        "_early",
        F.coalesce(
            "_early", F.when(word_count(F.col("main")) < MIN_WORDS, F.lit("short"))
        ),
    )
    if detect_language is not None:
        flagged = flagged.withColumn(
            "_lang", detect_language(F.when(F.col("_early").isNull(), F.col("main")))
        )
        other = ~F.col("_lang").eqNullSafe(keep_language)
        flagged = flagged.withColumn(
            "_early", F.coalesce("_early", F.when(other, F.lit("non_english")))
        ).drop("_lang")
    return (
        flagged.withColumn(
            "reason", F.coalesce("_early", F.when(strip(F.col("main")) == "", F.lit("empty")))
        )
        .drop("_early", "_body")
    )


def clean_emails(flagged: DataFrame) -> DataFrame:
    """Clean rows: the email body and its thread, every entry stripped."""
    return (
        flagged.where(F.col("reason").isNull())
        .withColumn("email", strip(F.col("main")))
        .withColumn("thread", F.transform("thread", strip))
        .drop("reason", "main", "text", "payload")
    )


def discarded_emails(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("reason").isNotNull()).drop("main", "thread")


def discard_stats(flagged: DataFrame, *by: str) -> DataFrame:
    """Row counts per reason, ``clean`` for the kept ones."""
    reason = F.coalesce("reason", F.lit("clean")).alias("reason")
    return flagged.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))
