"""Mailbox dumps: distributed scan, MIME part walk, part decoding."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from email import message_from_bytes
from email.message import Message
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PARTS
from ..session import cut_lineage

YIELD_BYTES, YIELD_ROWS = 8 << 20, 10_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def read_mbox(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(msg_id, source_file, raw) of every message; large files are read in splits.

    A line starting with ``From `` opens a message, so that is the record
    separator; the envelope line, which is all before the first line end, is
    dropped. Bytes stay as they are.

    An id is the file and a digest of the message (without line ends around it), so it
    stays the same however the files are split and whatever files come later. Equal
    messages of one file are told apart by #1, #2, ... behind it; they are found by one
    pass over the digests alone and made again from one of them, so messages are not shuffled.
    """
    lines = (
        spark.read.option("lineSep", "\nFrom ")
        .text(path)
        .select(F.col("_metadata.file_path").alias("source_file"), F.col("value").cast("binary").alias("_record"))
    )
    cut = F.position(F.lit("\n").cast("binary"), F.col("_record"))
    body = F.when(cut > 0, F.substring(F.col("_record"), cut + 1, F.length("_record")))
    digest = F.md5(F.expr("btrim(raw, X'0A')"))
    found = lines.withColumn("raw", body).drop("_record").where(F.length("raw") > 0).withColumn("_digest", digest)
    key = ["source_file", "_digest"]
    copies = cut_lineage(found.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("_n")).where("_n > 1"))
    single = found.join(copies, key, "left_anti").withColumn("_tie", F.lit(0))
    # Line ends around a message may differ, its first form stands for all.
    several = (
        found.join(copies.select(*key), key, "left_semi")
        .groupBy(*key)
        .agg(F.min("raw").alias("raw"))
        .join(copies, key)
        .withColumn("_tie", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select(*single.columns)
    )
    tie = F.when(F.col("_tie") > 0, F.concat(F.lit("#"), F.col("_tie").cast("string"))).otherwise("")
    msg_id = F.concat("source_file", F.lit(":"), "_digest", tie)
    return single.unionByName(several).select(msg_id.alias("msg_id"), "source_file", "raw")


def _date(header) -> tuple[str | None, int | None]:
    """ISO text with the original offset and UTC microseconds; NULLs if unreadable."""
    try:
        when = parsedate_to_datetime(str(header))
    except (ValueError, TypeError, IndexError, OverflowError):
        return None, None
    aware = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    delta = aware - _EPOCH
    return when.isoformat(), (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def _leaves(message: Message) -> Iterator[Message]:
    return (p for p in message.walk() if not p.is_multipart())


def _text(header) -> str | None:
    return None if header is None else str(header).encode("utf-8", "replace").decode("utf-8")


def explode_parts(raw: DataFrame, senders: tuple[str, ...] | None = None, plain_only: bool = False) -> DataFrame:
    """One row per leaf part of each message, transfer encoding already undone.

    With ``senders`` the parts of messages whose From header has none of these addresses
    get an empty payload, with ``plain_only`` parts that are no plain text: such parts are
    set aside by their headers, so nothing is decoded and sent on for them. Rows leave in
    batches of about YIELD_BYTES of payload.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=PARTS.names)
            out["date_us"] = out["date_us"].astype("Int64")
            return out

        for batch in batches:
            for msg_id, data in zip(batch["msg_id"], batch["raw"]):
                message = message_from_bytes(bytes(data))
                header, sender = message["Date"], _text(message["From"])
                wanted = senders is None or any(s in (sender or "") for s in senders)
                iso, micros = _date(header) if header else (None, None)
                shared = (sender, _text(message["Subject"]), _text(header), iso, micros)
                for no, part in enumerate(_leaves(message)):
                    kind = part.get_content_type()
                    read = wanted and (not plain_only or kind == "text/plain")
                    payload = (part.get_payload(decode=True) or b"") if read else b""
                    rows.append((msg_id, no, *shared, kind, payload))
                    held += len(payload)
                    if held > YIELD_BYTES or len(rows) >= YIELD_ROWS:
                        yield frame()
                        rows, held = [], 0
        yield frame()

    return raw.select("msg_id", "raw").mapInPandas(walk, PARTS)


def part_date(parts: DataFrame) -> DataFrame:
    """Add ``date`` as a TIMESTAMP."""
    return parts.withColumn("date", F.timestamp_micros("date_us"))


def escape_from_lines(text: Column) -> Column:
    """Quote body lines a mailbox reader would take for a new message."""
    return F.regexp_replace(text, "(?dm)^From ", ">From ")


def write_mbox(raw: DataFrame, path: str, sender: Column) -> None:
    """Write RFC 822 messages (TEXT column ``raw``) as mailbox files.

    One part file per task; every record begins with its envelope line.
    """
    record = F.concat(
        F.lit("From "), sender, F.lit(" Mon Jan  1 00:00:00 2024\n"), F.col("raw"), F.lit("\n")
    )
    raw.select(record.alias("value")).write.option("lineSep", "\n").text(path)
