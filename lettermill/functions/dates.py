"""Date expressions. Naive times count as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds of 0001-01-01T00:00:00Z, the value of a missing date when sorting.
MIN_DATE_US = -62135596800000000


def parse_iso(date_iso: Column) -> Column:
    """ISO-8601 text to TIMESTAMP, NULL if it is no date."""
    has_zone = date_iso.rlike(r"([+-]\d{2}:?\d{2}(:?\d{2})?|Z)\z")
    return F.try_to_timestamp(
        F.when(has_zone, date_iso).otherwise(F.concat(date_iso, F.lit("+00:00")))
    )


def sort_micros(date: Column) -> Column:
    """A BIGINT to order rows by; a missing date sorts first."""
    return F.coalesce(F.unix_micros(date.cast("timestamp")), F.lit(MIN_DATE_US))
