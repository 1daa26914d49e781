"""JSON-lines tables of emails and discarded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_iso
from ..schema import EMAIL

_KEYS = "_keys array<string>"


def email_struct(line: Column, schema=EMAIL) -> Column:
    """Parse one JSON line; a malformed one fails the job. Unknown keys vanish."""
    return F.from_json(line, schema, {"mode": "FAILFAST"})


def read_emails(df: DataFrame, line_col: str = "value") -> DataFrame:
    """Emails of JSON lines, fields missing in old files filled in.

    A missing subject becomes ``""``, a missing thread ``[]``, a missing date
    stays NULL (it sorts first). An explicit JSON null is kept as NULL. Commas
    around a line are tolerated, blank lines skipped. Other columns are kept.
    """
    lines = df.withColumn("_line", F.regexp_replace(line_col, r"\A,+|[,\s]+\z", "")).where(
        F.col("_line") != ""
    )
    parsed = lines.withColumn("_e", email_struct(F.col("_line"))).withColumn(
        "_has", F.json_object_keys("_line")
    )

    def backfill(name: str, default: Column) -> Column:
        value = F.col(f"_e.{name}")
        return F.when(F.array_contains("_has", name), value).otherwise(default).alias(name)

    others = [c for c in df.columns if c != line_col]
    return parsed.select(
        *others,
        F.col("_e.email").alias("email"),
        backfill("subject", F.lit("")),
        backfill("thread", F.array().cast("array<string>")),
        F.col("_e.date").alias("date_iso"),
        parse_iso(F.col("_e.date")).alias("date"),
        F.col("_e.summary").alias("summary"),
    )


def load_emails(spark: SparkSession, path: str) -> DataFrame:
    """Read ``*.jsonl`` files or folders of them."""
    if not path.rstrip("/").endswith(".jsonl"):
        raise ValueError(f"expected a .jsonl path, got {path}")
    return read_emails(spark.read.text(path))


def email_json(date_iso: str = "date_iso") -> Column:
    """The JSON line of an email, its date as ISO text, absent values as null."""
    return F.to_json(
        F.struct("email", "subject", "thread", F.col(date_iso).alias("date"), "summary"),
        {"ignoreNullFields": "false"},
    )


def write_emails(emails: DataFrame, path: str, date_iso: str = "date_iso") -> None:
    """One JSON object per line, written by every task to its own file."""
    if "summary" not in emails.columns:
        emails = emails.withColumn("summary", F.lit(None).cast("string"))
    emails.select(email_json(date_iso).alias("value")).write.text(path)


def write_discarded(discarded: DataFrame, path: str, user: str) -> None:
    """Discarded parts below ``path``, one folder per user and reason.

    Text where there is one; for undecodable parts the raw payload as base64.
    """
    (
        discarded.select(
            "reason",
            F.lit(user).alias("user"),
            "text",
            F.when(F.col("text").isNull(), F.base64("payload")).alias("payload_base64"),
        )
        .write.partitionBy("user", "reason")
        .json(path)
    )


def merge_mailboxes(mailboxes: dict[str, DataFrame]) -> DataFrame:
    """Concatenate mailboxes, duplicates kept, with their name in ``mailbox``."""
    merged = None
    for name, df in mailboxes.items():
        named = df.withColumn("mailbox", F.lit(name))
        merged = named if merged is None else merged.unionByName(named, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no mailboxes")
    return merged
