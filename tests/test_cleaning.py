"""The cleaning rules on hand-written messages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lettermill.fixed_values import FORWARD_TAG, WS_CHARS
from lettermill.functions import text as X
from lettermill.operators import cleaning as C

ME = "me@example.com"
TWELVE = "one two three four five six seven eight nine ten eleven twelve"


def part(body, sender=f"Me <{ME}>", date_raw="x", date_us=0, kind="text/plain"):
    data = body if isinstance(body, (bytes, bytearray)) else body.encode()
    return (sender, date_raw, date_us, kind, bytearray(data))


def flag(spark, *parts, **options):
    rows = [(i, *p) for i, p in enumerate(parts)]
    df = spark.createDataFrame(
        rows,
        "n int, from_addr string, date_raw string, date_us bigint, content_type string, payload binary",
    )
    return C.flag_parts(df, [ME], **options).orderBy("n").collect()


def one(spark, body, **options):
    return flag(spark, part(body), **options)[0]


def test_plain(spark):
    row = one(spark, TWELVE)
    assert (row.reason, row.main, row.thread) == (None, TWELVE, [])


def test_reply_levels_become_a_chronological_thread(spark):
    row = one(spark, f"{TWELVE}\n\nOn Monday X wrote:\n> a\n>> b\n")
    assert (row.main, row.thread) == (TWELVE, ["b", "a"])


def test_quote_first_is_the_main_text(spark):
    row = one(spark, f"> {TWELVE}\nthanks")
    assert (row.main, row.thread) == (TWELVE, ["thanks"])


def test_spaced_quote_marks_count_once(spark):
    row = one(spark, f"{TWELVE}\n> > x")
    assert row.thread == ["> x"]


def test_two_quotes_of_one_level_merge(spark):
    row = one(spark, f"{TWELVE}\n> a\n  indented\n> b")
    assert (row.main, row.thread) == (TWELVE + "\nindented", ["a\nb"])


def test_attribution_cuts_to_the_end(spark):
    row = one(spark, f"{TWELVE}\nOnly she\nwrote it\nand more")
    assert row.main == TWELVE


def test_strict_attribution_removes_one_line(spark):
    body = f"{TWELVE}\nOnly she\nwrote it\nOn Monday X wrote:\nand more"
    row = one(spark, body, strict_attribution=True)
    assert row.main == f"{TWELVE}\nOnly she\nwrote it\n\nand more"


def test_german_attribution(spark):
    assert one(spark, f"{TWELVE}\nAm Montag schrieb X:").main == TWELVE


@pytest.mark.parametrize(
    "case, reason",
    [
        (part(TWELVE, sender="other@example.com"), "other_sender"),
        (part(TWELVE, sender=None), "other_sender"),
        (part(TWELVE, sender="ME@EXAMPLE.COM"), "other_sender"),
        (part(TWELVE, date_raw=None, date_us=None), "missing_date"),
        (part(TWELVE, date_us=None), "bad_date"),
        (part(TWELVE, kind="text/html"), "not_plain_text"),
        (part(TWELVE.encode() + b"\xe9"), "cant_decode_utf8"),
        (part(f"{TWELVE}\n{FORWARD_TAG}"), "forwarded"),
        (part("one two three four five six seven eight nine"), "short"),
        (part("one two three four five six seven eight nine ten"), None),
        (part(""), "short"),
    ],
)
def test_reasons(spark, case, reason):
    assert flag(spark, case)[0].reason == reason


def test_every_part_is_counted_once(spark):
    rows = flag(spark, part(TWELVE), part("x"), part(FORWARD_TAG), part(b"\xff"))
    assert [r.reason for r in rows] == [None, "short", "forwarded", "cant_decode_utf8"]


def test_language_rule_only_sees_survivors(spark):
    def detect(text):
        return F.when(text.isNull(), F.raise_error(F.lit("not asked"))).otherwise(
            F.when(F.contains(text, F.lit("deux")), "fr").otherwise("en")
        )

    french = "un deux trois quatre cinq six sept huit neuf dix onze"
    df = spark.createDataFrame(
        [(0, *part(TWELVE)), (1, *part(french))],
        "n int, from_addr string, date_raw string, date_us bigint, content_type string, payload binary",
    )
    got = C.flag_parts(df, [ME], detect).orderBy("n").collect()
    assert [r.reason for r in got] == [None, "non_english"]


def test_discard_stats_add_up(spark):
    df = spark.createDataFrame(
        [(i, *part(b)) for i, b in enumerate([TWELVE, TWELVE, "x", FORWARD_TAG])],
        "n int, from_addr string, date_raw string, date_us bigint, content_type string, payload binary",
    )
    stats = {r.reason: r.n for r in C.discard_stats(C.flag_parts(df, [ME])).collect()}
    assert stats == {"clean": 2, "short": 1, "forwarded": 1}


def expected_split(body):
    """The rules in plain Python, for random mails."""
    levels = {}
    for line in body.split("\n"):
        marks = len(line) - len(line.lstrip(">"))
        levels.setdefault(marks, []).append(line[marks:].lstrip())
    entries = []
    for lines in levels.values():
        entry = "\n".join(lines).strip()
        starts = [m.start() for m in re.finditer(r"^On|^Am", entry, re.M)]
        for s in starts:
            word = "wrote" if entry.startswith("On", s) else "schrieb"
            if word in entry[s + 2 :]:
                entry = entry[:s].strip()
                break
        entries.append(entry)
    return entries[0], entries[:0:-1]


def test_random_mails_with_odd_whitespace(spark):
    rng = random.Random(7)
    tokens = ["On", "wrote", "Am", "schrieb", ">", ">>", "\n", "\n", " ", "x", "Only", *WS_CHARS]
    bodies = ["".join(rng.choices(tokens, k=rng.randint(1, 30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = C.split_thread(df, "body").orderBy("n").select("main", "thread").collect()
    for body, row in zip(bodies, got):
        assert (row.main, row.thread) == expected_split(body), repr(body)
    counts = df.select(
        "n", X.word_count(F.col("body")), X.words(F.col("body")), X.strip(F.col("body"))
    ).orderBy("n")
    for body, row in zip(bodies, counts.collect()):
        assert (row[1], row[2], row[3]) == (len(body.split()), body.split(), body.strip())


def test_metric_normalisation(spark):
    import string

    bodies = ["Hello, World!", string.punctuation + "a", " É x\x1fy ", "", "don't--stop"]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, b string")
    got = df.select(
        "n", X.normalise_for_metrics(F.col("b")), X.metric_tokens(F.col("b"))
    ).orderBy("n").collect()
    table = str.maketrans("", "", string.punctuation)
    for body, row in zip(bodies, got):
        want = body.translate(table).lower().split()
        assert row[1] == " ".join(want) and row[2] == want


def test_drop_quoted_lines(spark):
    df = spark.createDataFrame([("a\n> b\n c\n>",)], "t string")
    assert df.select(C.drop_quoted_lines(F.col("t"))).first()[0] == "a\n c"


def test_ngrams_two_ways(spark):
    rows = ["a b c d", "a", "", "x x x"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string").withColumn(
        "t", X.words(F.col("s"))
    )
    got = sorted(tuple(r) for r in X.explode_ngrams(df, "t", 3, ["i"]).collect())
    want = sorted(
        (i, n, " ".join(s.split()[j : j + n]))
        for i, s in enumerate(rows)
        for n in (1, 2, 3)
        for j in range(len(s.split()) - n + 1)
    )
    assert got == want
    arrays = df.select("i", X.ngrams(F.col("t"), 2).alias("g")).orderBy("i").collect()
    assert [r.g for r in arrays] == [["a b", "b c", "c d"], [], [], ["x x", "x x"]]
