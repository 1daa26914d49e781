"""Mail-shaped rows from a table of conversation turns.

Every turn is a message; it quotes the two turns before it at levels 1 and 2
the way mail programs do. Turns by ``system`` are forwarded messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FORWARD_TAG
from ..operators.ordering import previous_in_group
from .mbox import escape_from_lines

START_SECONDS = 1704067200  # 2024-01-01T00:00:00Z


def quoted(text: Column, mark: str) -> Column:
    return F.concat(F.lit(mark + " "), F.replace(text, F.lit("\n"), F.lit(f"\n{mark} ")))


def mail_view(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as messages.

    Adds email_id, prev and prev2 (the texts before), body, from_addr, subject,
    sent_s (epoch seconds) and date_iso.
    """
    linked = previous_in_group(turns, ["conv_id"], "turn", F.col("text"), ["prev", "prev2"])
    turn = F.col("turn").cast("string")
    reply = F.concat(
        F.lit("\n\nOn turn "), turn, F.lit(" they wrote:\n"), quoted(F.col("prev"), ">")
    )
    older = F.concat(F.lit("\n> Am Tag "), turn, F.lit(" schrieb sie:\n"), quoted(F.col("prev2"), ">>"))
    own = F.when(
        F.col("role") == "system", F.concat(F.lit(FORWARD_TAG + "\n"), F.col("text"))
    ).otherwise(F.col("text"))
    body = F.concat(own, F.coalesce(reply, F.lit("")), F.coalesce(older, F.lit("")))
    sent = F.lit(START_SECONDS) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return linked.select(
        "conv_id",
        "turn",
        F.concat_ws("-", F.col("conv_id").cast("string"), turn).alias("email_id"),
        "role",
        "text",
        "prev",
        "prev2",
        escape_from_lines(body).alias("body"),
        F.concat("role", F.lit("@example.com")).alias("from_addr"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("subject"),
        sent.alias("sent_s"),
        F.date_format(F.timestamp_seconds(sent), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date_iso"),
    )


def as_parts(mails: DataFrame) -> DataFrame:
    """Mail view rows in the shape of decoded message parts."""
    return mails.select(
        "conv_id",
        "turn",
        F.col("email_id").alias("msg_id"),
        F.lit(0).alias("part_no"),
        "from_addr",
        "subject",
        F.col("date_iso").alias("date_raw"),
        "date_iso",
        (F.col("sent_s") * 1_000_000).alias("date_us"),
        F.lit("text/plain").alias("content_type"),
        F.col("body").cast("binary").alias("payload"),
    )


def raw_messages(mails: DataFrame) -> DataFrame:
    """Mail view rows as RFC 822 text: the body, an HTML twin, a base64 attachment.

    Columns conv_id, turn, msg_id, role and raw (TEXT). The Date header has an
    offset of +0200.
    """
    local = F.timestamp_seconds(F.col("sent_s") + 7200)
    head = F.concat(
        F.lit("From: A Person <"),
        F.col("from_addr"),
        F.lit(">\nSubject: "),
        F.col("subject"),
        F.lit("\nDate: "),
        F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(" +0200\nMIME-Version: 1.0\n"),
        F.lit('Content-Type: multipart/mixed; boundary="=_part"\n\n'),
    )
    plain = F.concat(
        F.lit("--=_part\nContent-Type: text/plain; charset=utf-8\n"),
        F.lit("Content-Transfer-Encoding: 8bit\n\n"),
        F.col("body"),
    )
    html = F.concat(
        F.lit("\n--=_part\nContent-Type: text/html; charset=utf-8\n\n<p>"),
        F.col("subject"),
        F.lit("</p>"),
    )
    attached = F.concat(
        F.lit("\n--=_part\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n"),
        F.base64(F.col("text").cast("binary")),
        F.lit("\n--=_part--\n"),
    )
    return mails.select(
        "conv_id",
        "turn",
        F.col("email_id").alias("msg_id"),
        "role",
        F.concat(head, plain, html, attached).alias("raw"),
    )
