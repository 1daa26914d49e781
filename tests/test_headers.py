"""Date headers and encoded words against the standard library."""

from datetime import timezone
from email.header import decode_header
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from lettermill.functions.headers import decode_words, mail_date
from lettermill.operators.generation import by_length

DATES = [
    "Mon, 01 Jan 2024 10:00:00 +0200", "1 Feb 2024 23:59:59 -0330", "Tue, 29 Feb 2000 00:00:00 GMT", "5 Mar 99 7:05 EST",
    "Wed, 3 Apr 2024 08:00:01 PDT (summer)", "Sat, 06 Jul 2024 10:11:12 -0000", "Sat, 06 Jul 2024 10:11:12 Z",
    "06 Jul 2024 10:11:12 XYZ", "7 August 2024 01:02:03 +0000", "Sun, 08 Sep 2024 10:11:12", "Thu, 12 Dec 24 12:00 CET",
    "Fri, 31 Dec 1999 23:59:59 +1345", "01 jan 2024 10:00:00 ut",
]
NO_DATES = ["", "soon", "Mon, 32 Jan 2024 10:00:00 +0000", "1 Foo 2024 10:00:00 +0000", "1 Jan 2024", "1 Jan 2024 25:00:00 +0000", "31 Feb 2024 10:00:00 GMT", None]


def test_dates(spark):
    df = spark.createDataFrame([(d,) for d in DATES + NO_DATES], "h string")
    got = {r["h"]: r["d"] for r in df.select("h", mail_date(F.col("h")).alias("d")).collect()}
    for text in DATES:
        when = parsedate_to_datetime(text)
        aware = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        assert (got[text]["iso"], got[text]["us"]) == (when.isoformat(), int(aware.timestamp()) * 1_000_000), text
    assert all(tuple(got[text]) == (None, None) for text in NO_DATES)


SUBJECTS = [
    "plain", "", "=?utf-8?B?R3LDvMOfZQ==?=", "=?utf-8?q?Gr=C3=BC=C3=9Fe_aus?= Wien", "Re: =?ISO-8859-1?Q?caf=E9?=",
    "=?utf-8?q?a?= =?utf-8?q?b?=", "=?utf-8?q?a?=\r\n =?utf-8?b?Yg==?= c", "a =? b ?= c", "x =?us-ascii?Q?y=3Dz?=", "1 + 1 =?",
]


def library_text(header):
    parts = decode_header(header)
    return "".join(p if isinstance(p, str) else p.decode(charset or "ascii") for p, charset in parts)


def test_encoded_words(spark):
    df = spark.createDataFrame([(s,) for s in SUBJECTS], "h string")
    got = {r["h"]: r["d"] for r in df.select("h", decode_words(F.col("h")).alias("d")).collect()}
    for text in SUBJECTS:
        assert got[text] == library_text(text), text


def test_words_that_cannot_be_decoded_stay(spark):
    odd = ["=?utf-8?q?=FF?=", "=?klingon?q?abc?=", "=?utf-8?b?!!!?=", None]
    df = spark.createDataFrame([(s,) for s in odd], "h string")
    assert [r["d"] for r in df.select(decode_words(F.col("h")).alias("d")).collect()] == odd


def test_prompts_of_like_length_go_together():
    import pandas as pd

    prompts = pd.Series(["x" * n for n in [500, 1, 490, 3, 2, 510, 4, 505]], index=[9, 8, 7, 6, 5, 4, 3, 2])
    padded = []

    def model(batch):
        padded.append(len(batch) * batch.str.len().max())
        return batch.str.len().astype(str)

    got = by_length(prompts, model, 4)
    assert got.tolist() == prompts.str.len().astype(str).tolist() and got.index.equals(prompts.index)
    assert sum(padded) == 4 * 4 + 4 * 510  # 8 * 510 as they came
    assert by_length(prompts.iloc[:0], model, 4).tolist() == []
