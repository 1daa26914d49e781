"""Mail headers as column expressions: RFC 2822 dates and RFC 2047 encoded words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, and the offsets in minutes of the zones that have names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {
    "ut": 0, "utc": 0, "gmt": 0, "z": 0, "ast": -240, "adt": -180, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

# Day, month, year, hours, minutes, seconds, zone; a weekday before and a comment behind.
DATE = (
    r"(?i)\A\s*(?:[a-z]+,?\s*)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?,?[\s-]+(\d{4}|\d{2}),?\s+"
    r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))?\s*([+-]\d{4}|[a-z]+)?\s*(?:\(.*\))?\s*\z"
)

ENCODED = r"=\?[^?\s]+\?[bBqQ]\?[^?\s]*\?="


def mail_date(header: Column) -> Column:
    """STRUCT(iso, us) of a Date header: ISO text with its own offset, UTC microseconds.

    Both are NULL if the header is missing or no date. Two-digit years below 69 are of this
    century, others of the last. A zone that is unknown, or -0000, says nothing: the time is
    taken as UTC and the text has no offset.
    """

    def part(n: int) -> Column:
        return F.regexp_extract(header, DATE, n)

    def number(n: int) -> Column:
        return F.try_to_number(F.lpad(F.when(part(n) != "", part(n)).otherwise("0"), 4, "0"), F.lit("9999")).cast("int")

    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2))).cast("int")
    short = F.length(part(3)) == 2
    year = number(3) + F.when(short & (number(3) < 69), 2000).when(short, 1900).otherwise(0)
    zone = F.lower(part(7))
    numeric = zone.rlike(r"\A[+-]\d{4}\z") & (zone != "-0000")
    digits = F.when(numeric, F.substring(zone, 2, 4)).otherwise("0000")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.when(numeric, F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes)).otherwise(
        F.try_element_at(named, zone)
    )
    known = F.coalesce(offset, F.lit(0))
    valid = (
        header.rlike(DATE)
        & (month > 0)
        & (number(4) < 24)
        & (number(5) < 60)
        & (number(6) < 60)
        & (F.abs(known) < 1440)
    )
    day = F.try_make_timestamp(
        F.when(valid, year), month, number(1), number(4), number(5), number(6).cast("decimal(8,6)"), F.lit("UTC")
    )
    size = F.abs(known)
    sign = F.when(known < 0, "-").otherwise("+")
    tail = F.concat(sign, F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    # The fields themselves, not a formatted time: the text does not depend on the session's zone.
    fields = [F.lpad(x.cast("string"), n, "0") for x, n in ((year, 4), (month, 2), (number(1), 2), (number(4), 2), (number(5), 2), (number(6), 2))]
    text = F.concat(
        fields[0], F.lit("-"), fields[1], F.lit("-"), fields[2], F.lit("T"), fields[3], F.lit(":"), fields[4], F.lit(":"), fields[5]
    )
    iso = F.when(offset.isNull(), text).otherwise(F.concat(text, tail))
    us = F.unix_micros(day) - known.cast("bigint") * 60_000_000
    return F.struct(F.when(day.isNotNull(), iso).alias("iso"), us.alias("us"))


def _decoded(word: Column) -> Column:
    """The text of one encoded word; a charset the engine cannot decode leaves it as it is."""
    charset = F.lower(F.regexp_extract(word, r"=\?([^?*\s]+)", 1))
    kind = F.lower(F.regexp_extract(word, r"=\?[^?\s]+\?([bBqQ])\?", 1))
    body = F.regexp_extract(word, r"\?[bBqQ]\?([^?\s]*)\?=", 1)
    units = F.regexp_extract_all(F.translate(body, "_", " "), F.lit("=[0-9A-Fa-f]{2}|."), F.lit(0))
    quoted = F.unhex(
        F.array_join(
            F.transform(units, lambda u: F.when(F.length(u) == 3, F.substring(u, 2, 2)).otherwise(F.hex(u))), ""
        )
    )
    raw = F.when(kind == "b", F.try_to_binary(body, F.lit("base64"))).otherwise(quoted)
    latin = charset.isin("iso-8859-1", "latin1", "latin-1", "iso8859-1")
    plain = charset.isin("utf-8", "utf8", "us-ascii", "ascii") & F.is_valid_utf8(raw.cast("string"))
    text = F.when(plain, raw.cast("string")).when(latin, F.decode(raw, "ISO-8859-1"))
    return F.coalesce(text, word)


def decode_words(header: Column) -> Column:
    """A header with its encoded words decoded; white space between two of them is dropped.

    Words in UTF-8, ASCII and Latin-1 are decoded, others stay as they are.
    """
    joined = F.regexp_replace(header, rf"({ENCODED})\s+(?={ENCODED})", "$1")
    pieces = F.regexp_extract_all(joined, F.lit(rf"(?s){ENCODED}|(?:(?!{ENCODED}).)+"), F.lit(0))
    read = F.transform(pieces, lambda p: F.when(p.rlike(rf"\A{ENCODED}\z"), _decoded(p)).otherwise(p))
    return F.when(F.contains(header, F.lit("=?")), F.array_join(read, "")).otherwise(header)
