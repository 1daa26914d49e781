"""Mailbox files, JSON lines, the chunk store and the streams."""

import base64
import json
import mailbox
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lettermill.operators import cleaning
from lettermill.operators.chunking import chunk_fixed, chunk_recursive, split_recursively
from lettermill.operators.embedding import build_index, hashed_terms, python_model
from lettermill.plans.stages import observed
from lettermill.session import cut_lineage, new_work_path, shared_folder, spread
from lettermill.sources import jsonl, mbox, store
from lettermill.streaming import ingest, stats

TWELVE = "one two three four five six seven eight nine ten eleven twelve"


def message(body, *headers, sender="Me <me@example.com>", date="Mon, 01 Jan 2024 10:00:00 +0200"):
    head = [f"From: {sender}", "Subject: =?utf-8?q?raw?="]
    if date is not None:
        head.append(f"Date: {date}")
    data = body if isinstance(body, bytes) else body.encode()
    return "\n".join([*head, *headers]).encode() + b"\n\n" + data


MULTIPART = (
    "--B\nContent-Type: text/plain\n\n" + TWELVE + "\n--B\nContent-Type: text/html\n\n<p>x</p>\n"
    "--B\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n"
    + base64.b64encode(("é " + TWELVE).encode()).decode()
    + "\n--B--\n"
)
MESSAGES = [
    message(TWELVE),
    message("bad \xe9".encode("latin-1"), "Content-Type: text/plain"),
    message(MULTIPART, 'Content-Type: multipart/mixed; boundary="B"'),
    message(TWELVE, date=None),
    message(TWELVE, date="no date at all"),
    message(TWELVE, date="Mon, 01 Jan 2024 10:00:00"),
    message(TWELVE, sender="you@example.com"),
    message(f"{TWELVE}\r\nwith\rreturns\n>From here"),
    message(TWELVE, date="Thu, 01 Jan 0100 00:00:00 +0000"),
]


@pytest.fixture
def mailbox_file(tmp_path):
    path = tmp_path / "Sent.mbox"
    with open(path, "wb") as f:
        for m in MESSAGES:
            f.write(b"From me@example.com Mon Jan  1 00:00:00 2024\n" + m + b"\n\n")
    return path


def test_mbox_scan_finds_every_message_whatever_the_splits(spark, mailbox_file):
    library = [bytes(m) for m in mailbox.mbox(mailbox_file)]
    want = sorted(m.rstrip(b"\n").replace(b"\r\n", b"\n") for m in MESSAGES)
    assert len(library) == len(want)
    for size in ("300b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        raw = mbox.read_mbox(spark, str(mailbox_file))
        rows = raw.collect()
        got = sorted(bytes(r.raw).rstrip(b"\n").replace(b"\r\n", b"\n") for r in rows)
        assert got == want
        assert len({r.msg_id for r in rows}) == len(want)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parts_and_reasons(spark, mailbox_file):
    parts = mbox.part_date(mbox.explode_parts(mbox.read_mbox(spark, str(mailbox_file))))
    rows = cleaning.flag_parts(parts, ["me@example.com"]).collect()
    reasons = sorted(r.reason or "clean" for r in rows)
    assert reasons == sorted(
        ["clean"] * 6
        + ["cant_decode_utf8", "not_plain_text", "missing_date", "bad_date", "other_sender"]
    )
    by_iso = {r.date_iso: r for r in rows if r.reason is None}
    assert by_iso["2024-01-01T10:00:00"].date == datetime(2024, 1, 1, 10)
    assert by_iso["2024-01-01T10:00:00+02:00"].date == datetime(2024, 1, 1, 8)
    assert by_iso["0100-01-01T00:00:00+00:00"].date_us < -(10**15)
    assert any(r.main and r.main.startswith("é") for r in rows)
    assert {r.subject for r in rows} == {"=?utf-8?q?raw?="}
    quoted = [r for r in rows if r.thread == ["From here"]]
    assert len(quoted) == 1 and "\r" in quoted[0].main


def test_written_mailbox_reads_back(spark):
    raw = spark.createDataFrame(
        [(f"From: a@b\n\n{TWELVE} {i}",) for i in range(5)], "raw string"
    )
    path = new_work_path(spark, "mbox")
    mbox.write_mbox(raw, path, F.lit("a@b"))
    got = mbox.explode_parts(mbox.read_mbox(spark, path)).select(F.col("payload").cast("string"))
    assert sorted(r[0].strip() for r in got.collect()) == [f"{TWELVE} {i}" for i in range(5)]


def test_json_round_trip(spark, mini_emails):
    path = new_work_path(spark, "emails") + ".jsonl"
    jsonl.write_emails(mini_emails, path)
    got = jsonl.load_emails(spark, path).orderBy("email").collect()
    want = mini_emails.orderBy("email").collect()
    for g, w in zip(got, want):
        assert (g.email, g.subject, g.thread, g.date_iso, g.summary) == (
            w.email, w.subject, w.thread, w.date_iso, w.summary,
        )


def test_old_rows_are_filled_in(spark):
    lines = [
        '{"email": "x", "extra": 1},',
        '{"email": "y", "subject": null, "thread": ["t"], "date": "2024-01-01T00:00:00+01:00"}',
        "",
    ]
    df = spark.createDataFrame([(l,) for l in lines], "value string")
    x, y = jsonl.read_emails(df).orderBy("email").collect()
    assert (x.subject, x.thread, x.date, x.summary) == ("", [], None, None)
    assert (y.subject, y.thread, y.date) == (None, ["t"], datetime(2023, 12, 31, 23))
    assert "extra" not in x.asDict()


def test_malformed_line_fails(spark):
    df = spark.createDataFrame([("[1, 2",)], "value string")
    with pytest.raises(Exception):
        jsonl.read_emails(df).collect()


def test_only_jsonl_paths(spark):
    with pytest.raises(ValueError):
        jsonl.load_emails(spark, "/tmp/x.json")


def test_discard_sink_keeps_raw_bytes(spark):
    df = spark.createDataFrame(
        [("short", "hi", bytearray(b"hi")), ("cant_decode_utf8", None, bytearray(b"\xff"))],
        "reason string, text string, payload binary",
    )
    path = new_work_path(spark, "discarded")
    jsonl.write_discarded(df, path, "me")
    rows = {r.reason: r for r in spark.read.json(path).collect()}
    assert rows["short"].text == "hi"
    assert base64.b64decode(rows["cant_decode_utf8"].payload_base64) == b"\xff"


def index_rows(emails):
    rows = emails.select(
        "email_id", "email", "subject", "thread", F.col("date_iso").alias("date"), "summary"
    )
    return build_index(rows, "email_id", "mini", hashed_terms(16), 1000, 1000)


def test_index_of_short_emails(spark, mini_emails):
    rows = index_rows(mini_emails).orderBy("doc_id").collect()
    assert [(r.chunk, r.chunk_no, r.email.subject) for r in rows] == [
        (f"email{i}", 0, f"subject{i}") for i in range(3)
    ]


def test_store_missing_create_append(spark, mini_emails):
    path = new_work_path(spark, "store")
    assert store.load_index(spark, path, "mini").count() == 0
    chunks = index_rows(mini_emails)
    store.store_chunks(chunks, path)
    assert store.load_index(spark, path, "mini").count() == 3
    store.store_chunks(chunks, path)
    assert store.load_index(spark, path, "mini").count() == 6
    store.store_chunks(chunks.withColumn("index_name", F.lit("other")), path)
    store.replace_index(chunks.limit(1), path)
    assert store.load_index(spark, path, "mini").count() == 1
    assert store.load_index(spark, path, "other").count() == 3
    assert store.load_index(spark, path, "absent").count() == 0


def test_materialise_reuses_until_forced(spark):
    path = new_work_path(spark, "stage")
    assert store.materialise(spark.range(3), path).count() == 3
    assert store.materialise(spark.range(5), path).count() == 3
    assert store.materialise(spark.range(5), path, force=True).count() == 5


def test_report(spark):
    path = new_work_path(spark, "report")
    scores = spark.createDataFrame([("b", 1.0)], "z string, a double")
    store.write_report(scores, scores.select("a"), path)
    line = spark.read.text(path + "/responses").first()[0]
    assert list(json.loads(line)) == ["a", "z"]


def test_merge_keeps_duplicates(spark):
    a = spark.createDataFrame([("x", 1)], "t string, n int")
    merged = jsonl.merge_mailboxes({"one": a, "two": a.drop("n")}).orderBy("mailbox").collect()
    assert [(r.mailbox, r.t, r.n) for r in merged] == [("one", "x", 1), ("two", "x", None)]


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_folder(spark) == configured.rstrip("/")
    assert cut_lineage(spark.range(7)).count() == 7


def test_spread_leaves_large_scans_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == 4


def test_observed_counts_without_a_job(spark):
    df, watch = observed(spark.range(12), "rows-seen")
    df.collect()
    assert watch.get["rows"] == 12


def test_fixed_windows(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",), ("abc",)], "t string")
    got = chunk_fixed(df, "t", 4, 1).orderBy("t", "chunk_no").collect()
    assert [r.chunk for r in got] == ["abc", "abcd", "defg", "ghij"]
    with pytest.raises(ValueError):
        chunk_fixed(df, "t", 4, 4)


def test_recursive_chunks(spark):
    text = "one two three\n\nfour five six seven\neight\n\nnine"
    assert list(split_recursively(text, 14, 0)) == [
        "one two three", "four five six", "seven", "eight", "nine",
    ]
    assert list(split_recursively("a b c d e", 5, 3)) == ["a b c", "c d", "d e"]
    assert list(split_recursively("abcdefgh", 3, 1)) == ["abc", "cde", "efg", "gh"]
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "i int, t string")
    rows = chunk_recursive(df, "t", 14, 14).collect()
    assert [r.chunk for r in rows if r.i == 2] == ["short"]
    assert all(0 < len(r.chunk) <= 14 for r in rows)
    assert not [r for r in rows if r.i == 3]


def test_every_word_is_in_some_chunk():
    text = " ".join(f"w{i}" for i in range(300)) + "\n\n" + "x" * 50
    for size, overlap in ((30, 0), (30, 10), (30, 30)):
        chunks = list(split_recursively(text, size, overlap))
        assert all(len(c) <= size for c in chunks)
        seen = {w for c in chunks for w in c.split()}
        assert {f"w{i}" for i in range(300)} <= seen


def test_python_model(spark):
    import numpy as np

    model = python_model(lambda: lambda texts: np.array([[len(t), 1] for t in texts]))
    df = spark.createDataFrame([("abc",), ("a",)], "t string")
    got = {r.t: r.v for r in model(df, "t", "v").collect()}
    assert got == {"abc": [3.0, 1.0], "a": [1.0, 1.0]}


def test_hashed_vectors_are_unit_and_equal_for_equal_words(spark):
    df = spark.createDataFrame([("Hello, world",), ("hello world!",), ("",)], "t string")
    a, b, c = (r.v for r in hashed_terms(32)(df, "t", "v").collect())
    assert a == b and sum(x * x for x in a) == pytest.approx(1.0, abs=1e-6)
    assert sum(c) == 0


def parts_table(spark, n):
    rows = [
        (f"m{i}", 0, "me@x", "s", "d", "2024-01-01T00:00:00+00:00", 1_704_067_200_000_000,
         "text/plain", bytearray(f"{TWELVE} {i}".encode() if i % 3 else b"short"))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, mbox.PARTS)


def test_stream_ingest_equals_batch_and_reruns_store_once(spark):
    arrived, out, state = (new_work_path(spark, n) for n in ("in", "out", "state"))
    parts = parts_table(spark, 20)
    parts.repartition(5).write.parquet(arrived)

    def run(checkpoint):
        stream = ingest.read_part_stream(spark, arrived, files_per_batch=2)
        ingest.ingest(
            stream, out, checkpoint, ["me@x"], "mail", 40, 10, hashed_terms(8)
        ).awaitTermination()
        return sorted((r.doc_id, r.chunk_no, r.chunk) for r in ingest.ingested(spark, out).collect())

    first = run(state)
    emails = cleaning.clean_emails(cleaning.flag_parts(parts, ["me@x"])).select(
        F.concat(F.col("msg_id"), F.lit("#0")).alias("email_id"), "email", "subject", "thread",
        F.col("date_iso").alias("date"), F.lit(None).cast("string").alias("summary"),
    )
    batch = build_index(emails, "email_id", "mail", hashed_terms(8), 40, 10)
    assert first == sorted((r.doc_id, r.chunk_no, r.chunk) for r in batch.collect())
    assert ingest.ingested(spark, out).select("batch_id").distinct().count() >= 3
    # A lost checkpoint replays every batch into its own folder.
    assert run(state + "-lost") == first


def test_stream_stats_equal_batch_and_count_late_rows(spark):
    rows = spark.createDataFrame(
        [(f"2024-01-{d:02d} 10:00:00", r) for d in range(1, 9) for r in ("clean", "short", "clean")],
        "t string, reason string",
    ).select(F.to_timestamp("t").alias("date"), "reason")
    arrived, out, state = (new_work_path(spark, n) for n in ("in", "out", "state"))
    rows.repartition(3).write.parquet(arrived)

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
        stats.stream_stats(stream, "date", "reason", out, state).awaitTermination()

    run()
    want = sorted(map(tuple, stats.stats_by_day(rows, "date", "reason").collect()))
    assert sorted(map(tuple, stats.latest_stats(spark, out).collect())) == want
    late = spark.createDataFrame([("2020-01-01 00:00:00", "clean")], "t string, reason string")
    late.select(F.to_timestamp("t").alias("date"), "reason").coalesce(1).write.mode("append").parquet(
        arrived
    )
    run()
    every = sorted(map(tuple, stats.stats_by_day(rows.union(spark.read.parquet(arrived).where("date < '2021-01-01'")), "date", "reason").collect()))
    assert len(every) == len(want) + 1
    assert sorted(map(tuple, stats.latest_stats(spark, out).collect())) == every
    assert stats.late_rows(spark, out) == 0


def test_lateness_counts_what_it_leaves_out(spark):
    arrived, out, state = (new_work_path(spark, n) for n in ("in", "out", "state"))
    days = [(10, 5), (3, 4), (11, 2), (1, 3)]  # (day, rows), one file and batch each
    kind = "date timestamp, reason string"
    for i, (d, n) in enumerate(days):
        rows = spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00",)] * n, "t string")
        rows = rows.select(F.to_timestamp("t").alias("date"), F.lit("clean").alias("reason"))
        rows.coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(arrived)
        stats.stream_stats(stream, "date", "reason", out, state, lateness="5 days").awaitTermination()
    assert stats.late_rows(spark, out) == 4 + 3
    kept = {r["day"].day: r["n"] for r in stats.closed_stats(spark, out).collect()}
    assert kept == {10: 5, 11: 2}
