"""One query per operator on the given tables; see ``oracles`` for their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, headers, templates, text, vectors
from ..operators import (
    chunking,
    cleaning,
    divergence,
    embedding,
    generation,
    language,
    ordering,
    perplexity,
    prompting,
    retrieval,
    scoring,
    splitting,
    threads,
)
from ..schema import KEYED_CHUNKS
from ..session import cut_lineage, new_work_path, spread
from ..sources import jsonl, mail_view, mbox, store
from ..streaming import ingest as stream_ingest
from ..streaming import stats as stream_stats
from . import stages
from .evaluation import evaluate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SENDERS = ["assistant@example.com", "system@example.com"]
MODELS = ("Meta-Llama-3-8B-Instruct", "Mistral-7B-Instruct", "Phi-3-mini-4k-instruct")
TEST_SPLIT = 0.2
K = 5


def query(fn: Query) -> Query:
    """Register under the function's name; times are read in UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan, "doc_id") if name == "documents" else scan


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_view.mail_view(table(spark, sf_dir, "conversations"))


def detector(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    return language.language_detector(docs, language.train_profile(docs, "text", "lang"))


def flagged(spark: SparkSession, sf_dir: str, with_language: bool = False) -> DataFrame:
    detect = detector(spark, sf_dir) if with_language else None
    return cleaning.flag_parts(mail_view.as_parts(mails(spark, sf_dir)), SENDERS, detect)


def joined(thread: Column) -> Column:
    return F.array_join(thread, "\n==\n")


def rounded(value: Column | str, places: int = 6) -> Column:
    return F.round(value, places)


# --- cleaning ------------------------------------------------------------------


@query
def clean_flags(spark, sf_dir):
    """All rules with language detection: one reason per message."""
    reason = F.coalesce("reason", F.lit("clean")).alias("reason")
    return flagged(spark, sf_dir, True).select("conv_id", "turn", reason)


@query
def clean_emails(spark, sf_dir):
    return cleaning.clean_emails(flagged(spark, sf_dir)).select(
        "conv_id",
        "turn",
        "email",
        joined(F.col("thread")).alias("thread"),
        F.size("thread").cast("bigint").alias("n_thread"),
        "subject",
        "date_iso",
    )


@query
def discard_stats(spark, sf_dir):
    return cleaning.discard_stats(flagged(spark, sf_dir, True))


@query
def discard_report(spark, sf_dir):
    """Counts per sender and reason with subtotals."""
    rows = flagged(spark, sf_dir).withColumn("mailbox", text.username(F.col("from_addr")))
    return (
        rows.rollup("mailbox", F.coalesce("reason", F.lit("clean")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.coalesce("mailbox", F.lit("(all)")).alias("mailbox"),
            F.coalesce("reason", F.lit("(all)")).alias("reason"),
            "n",
        )
    )


@query
def quote_levels(spark, sf_dir):
    groups = cleaning.quote_groups(F.col("lines"))
    return (
        mails(spark, sf_dir)
        .select("conv_id", "turn", cleaning.quote_lines(F.col("body")).alias("lines"))
        .select("conv_id", "turn", F.posexplode(groups).alias("place", "g"))
        .select(
            "conv_id",
            "turn",
            F.col("place").cast("bigint").alias("place"),
            F.col("g.level").cast("bigint").alias("level"),
            F.col("g.text").alias("text"),
        )
    )


@query
def strip_attribution(spark, sf_dir):
    kept = cleaning.strip_attribution(F.col("body"))
    return mails(spark, sf_dir).select("conv_id", "turn", kept.alias("kept"))


@query
def drop_quoted_lines(spark, sf_dir):
    kept = cleaning.drop_quoted_lines(F.col("body"))
    return mails(spark, sf_dir).select("conv_id", "turn", kept.alias("kept"))


@query
def forwarded_filter(spark, sf_dir):
    return mails(spark, sf_dir).where(cleaning.is_forwarded(F.col("body"))).select("conv_id", "turn")


@query
def sender_filter(spark, sf_dir):
    return (
        mails(spark, sf_dir)
        .where(cleaning.sent_by(F.col("from_addr"), SENDERS))
        .select("conv_id", "turn", text.username(F.col("from_addr")).alias("username"))
    )


@query
def thread_so_far(spark, sf_dir):
    return threads.thread_so_far(
        table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3
    ).select("conv_id", "turn", "n_before", joined(F.col("thread")).alias("thread"))


@query
def thread_rows(spark, sf_dir):
    """Whole threads: a message's thread are the rows of its conversation before it."""
    turns = table(spark, sf_dir, "conversations")
    return threads.thread_rows(turns, "conv_id", "turn").select("conv_id", "turn", "n_before", "text")


@query
def previous_messages(spark, sf_dir):
    return mails(spark, sf_dir).select("conv_id", "turn", "prev", "prev2")


# --- language and words ----------------------------------------------------------


@query
def lang_id(spark, sf_dir):
    detect = detector(spark, sf_dir)
    return table(spark, sf_dir, "documents").select("doc_id", detect(F.col("text")).alias("lang"))


@query
def lang_filter(spark, sf_dir):
    detect = detector(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    return docs.where(detect(F.col("text")) == "en").select("doc_id", "source")


@query
def lang_profile(spark, sf_dir):
    """Training counts per language and trigram bucket."""
    return language.trigram_counts(table(spark, sf_dir, "documents"), "text", "lang")


@query
def word_counts(spark, sf_dir):
    n = text.word_count(F.col("text")).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words"))


@query
def short_filter(spark, sf_dir):
    short = text.word_count(F.col("text")) < cleaning.MIN_WORDS
    return table(spark, sf_dir, "documents").where(short).select("doc_id", "lang")


@query
def normalised_text(spark, sf_dir):
    value = text.normalise_for_metrics(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("normalised"))


@query
def ngram_counts(spark, sf_dir):
    tokens = text.metric_tokens(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select(tokens.alias("t"))
    return (
        text.explode_ngrams(turns, "t", 3, [])
        .groupBy(F.col("n").cast("bigint").alias("n"), "gram")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


@query
def iso_dates(spark, sf_dir):
    """ISO texts with and without an offset, parsed to UTC microseconds."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.when(F.col("user_id") % 2 == 0, "+02:00").otherwise("")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", F.concat(stamp, zone).alias("date_iso"))
        .select(
            "event_id", "date_iso", F.unix_micros(dates.parse_iso(F.col("date_iso"))).alias("utc_us")
        )
    )


# --- splitting and merging --------------------------------------------------------


def split_documents(spark, sf_dir) -> DataFrame:
    return splitting.split_train_test(table(spark, sf_dir, "documents"), "doc_id", TEST_SPLIT)


@query
def split_random(spark, sf_dir):
    return split_documents(spark, sf_dir).select("doc_id", "split")


@query
def split_chrono(spark, sf_dir):
    return splitting.split_train_test(
        table(spark, sf_dir, "events"),
        "event_id",
        TEST_SPLIT,
        "chronological",
        dates.sort_micros(F.col("ts")),
    ).select("event_id", "split")


@query
def split_zero(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return splitting.split_train_test(docs, "doc_id", 0).select("doc_id", "split")


@query
def sample_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return splitting.sample_exact(docs, "doc_id", 128).select("doc_id", "lang")


@query
def train_test_leak(spark, sf_dir):
    return splitting.leaked_bodies(split_documents(spark, sf_dir), "text")


@query
def merge_mailboxes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("key"), "text", "lang"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        "text",
    )
    merged = jsonl.merge_mailboxes({"documents": docs, "conversations": turns})
    return merged.select("mailbox", "key", "lang", F.md5("text").alias("body_md5"))


# --- sources and sinks ------------------------------------------------------------


def plain_emails(spark, sf_dir) -> DataFrame:
    return mails(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.col("body").alias("email"),
        "subject",
        F.array_compact(F.array("prev2", "prev")).alias("thread"),
        "date_iso",
        F.when(F.col("turn") == 0, F.col("text")).alias("summary"),
    )


@query
def json_roundtrip(spark, sf_dir):
    """Emails written as JSON lines and read back."""
    path = new_work_path(spark, "emails") + ".jsonl"
    jsonl.write_emails(plain_emails(spark, sf_dir), path)
    return jsonl.load_emails(spark, path).select(
        "email",
        "subject",
        joined(F.col("thread")).alias("thread"),
        "date_iso",
        F.unix_micros("date").alias("date_us"),
        "summary",
    )


@query
def serialize_email(spark, sf_dir):
    return plain_emails(spark, sf_dir).select(
        "conv_id", "turn", F.md5(jsonl.email_json()).alias("json_md5")
    )


@query
def backfill_v1(spark, sf_dir):
    """Lines of the oldest format: a body and an unknown key, a stray comma."""
    line = F.concat(
        F.to_json(F.struct(F.col("text").alias("email"), F.col("role").alias("unknown"))), F.lit(",")
    )
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("value"))
    return jsonl.read_emails(lines).select(
        "conv_id",
        "turn",
        "email",
        "subject",
        F.size("thread").cast("bigint").alias("n_thread"),
        F.unix_micros("date").alias("date_us"),
        "summary",
    )


def mime_rows(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.select(
        *keys,
        F.col("part_no").cast("bigint").alias("part_no"),
        "from_addr",
        "subject",
        "date_iso",
        "date_us",
        "content_type",
        text.strip(cleaning.decoded(F.col("payload"))).alias("payload"),
    )


@query
def mime_parts(spark, sf_dir):
    """Part walk and transfer decoding of RFC 822 messages."""
    raw = mail_view.raw_messages(mails(spark, sf_dir)).withColumn("raw", F.col("raw").cast("binary"))
    return mime_rows(mbox.explode_parts(raw), "msg_id")


def mailbox_files(spark, sf_dir) -> str:
    path = new_work_path(spark, "mailbox")
    raw = mail_view.raw_messages(mails(spark, sf_dir))
    mbox.write_mbox(raw, path, F.concat("role", F.lit("@example.com")))
    return path


@query
def mbox_scan(spark, sf_dir):
    """The same messages through mailbox files on shared storage."""
    return mime_rows(mbox.explode_parts(mbox.read_mbox(spark, mailbox_files(spark, sf_dir))))


@query
def mbox_ids(spark, sf_dir):
    """Ids of messages by content: every fourth turn twice, all in files of their conversation."""
    path = new_work_path(spark, "mailbox-ids")
    raw = mail_view.raw_messages(mails(spark, sf_dir))
    twice = raw.where("turn % 4 = 0").union(raw).withColumn("folder", F.col("conv_id") % 3)
    record = F.concat(F.lit("From x Mon Jan  1 00:00:00 2024\n"), "raw", F.lit("\n"))
    by_file = twice.select("folder", record.alias("value")).repartition("folder")
    by_file.write.option("lineSep", "\n").partitionBy("folder").text(path)
    ids = mbox.read_mbox(spark, path).select(F.substring_index("msg_id", ":", -1).alias("id"))
    digest = F.substring_index("id", "#", 1)
    return ids.groupBy(digest.alias("digest")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.max("id").alias("last_id"),
    )


def mails_with_headers(spark, sf_dir) -> DataFrame:
    """Mails whose Date and Subject headers come in many forms; some have no or a bad date."""
    rows = mails(spark, sf_dir)
    zones = [("+0200", 120), ("-0330", -210), ("EST", -300), ("GMT", 0), ("-0000", 0)]
    case = F.col("conv_id") % len(zones)
    name = F.element_at(F.array(*[F.lit(n) for n, _ in zones]), (case + 1).cast("int"))
    minutes = F.element_at(F.array(*[F.lit(m) for _, m in zones]), (case + 1).cast("int"))
    local = F.timestamp_seconds(F.col("sent_s") + minutes * 60)
    date = F.concat_ws(" ", F.date_format(local, "EEE, d MMM yyyy HH:mm:ss"), name)
    bad = F.concat(F.lit("some day in "), F.date_format(local, "yyyy"))
    word = F.concat(F.lit("Grüße "), F.col("conv_id").cast("string"))
    in_q = F.concat(F.lit("=?utf-8?q?Gr=C3=BC=C3=9Fe_"), F.col("conv_id").cast("string"), F.lit("?="))
    in_b = F.concat(F.lit("=?UTF-8?B?"), F.base64(F.encode(word, "UTF-8")), F.lit("?="))
    kind = F.col("turn") % 3
    return rows.withColumns(
        {
            "date_raw": F.when(F.col("turn") % 7 == 3, F.lit(None)).when(F.col("turn") % 7 == 5, bad).otherwise(date),
            "subject": F.when(kind == 0, F.concat(F.lit("Re: "), in_q)).when(kind == 1, in_b).otherwise(F.col("subject")),
        }
    )


@query
def mail_dates(spark, sf_dir):
    """Date headers in five zones, missing and bad ones, and encoded subjects, read in columns."""
    rows = mails_with_headers(spark, sf_dir).withColumn("date", headers.mail_date(F.col("date_raw")))
    parts = rows.select(
        F.col("email_id").alias("msg_id"),
        F.lit(0).alias("part_no"),
        "from_addr",
        "subject",
        "date_raw",
        F.col("date.iso").alias("date_iso"),
        F.col("date.us").alias("date_us"),
        F.lit("text/plain").alias("content_type"),
        F.col("body").cast("binary").alias("payload"),
    )
    flags = cleaning.flag_parts(parts, ["@example.com"])
    by_date = F.col("reason").isin("missing_date", "bad_date")
    return flags.select(
        F.col("msg_id").alias("email_id"),
        "date_iso",
        "date_us",
        headers.decode_words(F.col("subject")).alias("subject"),
        F.when(by_date, F.col("reason")).alias("reason"),
    )


@query
def extract_mailbox(spark, sf_dir):
    """Mailbox files to clean emails: scan, part walk, all rules."""
    settings = stages.Settings(addresses=tuple(SENDERS))
    found = stages.extract(spark, mailbox_files(spark, sf_dir), settings)
    return cleaning.clean_emails(found).select(
        "subject", "date_iso", "email", joined(F.col("thread")).alias("thread")
    )


@query
def undecodable_parts(spark, sf_dir):
    """Payloads with a broken byte are set aside, raw bytes kept."""
    broken = F.when(
        F.col("turn") % 3 == 0, F.concat(F.lit(bytearray(b"\xe9")), F.col("payload"))
    ).otherwise(F.col("payload"))
    parts = mail_view.as_parts(mails(spark, sf_dir)).withColumn("payload", broken)
    rows = cleaning.flag_parts(parts, ["@example.com"]).where(
        F.col("reason") == "cant_decode_utf8"
    )
    return rows.select("conv_id", "turn", F.md5("payload").alias("payload_md5"))


@query
def discard_sink(spark, sf_dir):
    """Discarded parts written per reason and counted from the files."""
    path = new_work_path(spark, "discarded")
    jsonl.write_discarded(cleaning.discarded_emails(flagged(spark, sf_dir)), path, "assistant")
    return (
        spark.read.schema("text string, payload_base64 string, user string, reason string")
        .json(path)
        .groupBy("user", "reason")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))
    )


def fixed_chunk_store(spark, sf_dir, model: embedding.Model | None = None) -> DataFrame:
    """Keyed chunks of documents, which are no emails."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = model or embedding.hashed_terms(64)
    return embedding.index_chunks(docs, "doc_id", "text", "documents", model, 1000, 100, recursive=False)


@query
def document_store(spark, sf_dir):
    """Documents, not emails, put into one index by a batch, a stream and another batch:
    chunks hold keys only, and language and source come from the payloads."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chunks, stored, arrived, state = (
        new_work_path(spark, n) for n in ("doc-chunks", "doc-payloads", "doc-arrived", "doc-state")
    )
    model = embedding.hashed_terms(16)

    def by_batch(rows: DataFrame) -> None:
        store.store_chunks(
            embedding.index_chunks(rows, "doc_id", "text", "docs", model, 700, 0, recursive=False), chunks
        )
        store.store_chunks(embedding.payloads(rows, "doc_id", "docs"), stored)

    third = F.col("doc_id") % 3
    by_batch(docs.where(third == 0))
    docs.where(third == 1).repartition(4, "doc_id").write.parquet(arrived)
    stream_ingest.ingest_documents(
        spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(arrived),
        chunks, stored, state, "doc_id", "text", "docs", 700, 0, model, recursive=False,
    ).awaitTermination()
    by_batch(docs.where(third == 2))
    documents = store.load_index(spark, stored, "docs", store.payload_schema(docs.drop("doc_id").schema))
    per_doc = (
        store.load_index(spark, chunks, "docs", KEYED_CHUNKS)
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))
    )
    return documents.join(per_doc, "doc_id", "left").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("payload.lang").alias("lang"),
        F.col("payload.source").alias("source"),
        F.coalesce("n_chunks", F.lit(0).cast("bigint")).alias("n_chunks"),
        F.coalesce("n_chars", F.lit(0).cast("bigint")).alias("n_chars"),
    )


@query
def store_append(spark, sf_dir):
    """A store that starts missing, then gets the same chunks twice."""
    path = new_work_path(spark, "store")
    before = store.load_index(spark, path, "documents", KEYED_CHUNKS).count()
    chunks = fixed_chunk_store(spark, sf_dir)
    store.store_chunks(chunks, path)
    store.store_chunks(chunks, path)
    return (
        store.load_index(spark, path, "documents", KEYED_CHUNKS)
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))
        .withColumn("before", F.lit(before).cast("bigint"))
    )


@query
def reuse_stage(spark, sf_dir):
    """A second run keeps the first result unless forced."""
    path = new_work_path(spark, "stage")
    docs = table(spark, sf_dir, "documents")
    store.materialise(docs.select("doc_id", F.lit("first").alias("version")), path)
    kept = store.materialise(docs.select("doc_id", F.lit("second").alias("version")), path)
    return kept.select("doc_id", "version")


@query
def report_round_trip(spark, sf_dir):
    """Scores and their means written as a report and read again from its files."""
    path = new_work_path(spark, "report")
    samples, goldens = graded(spark, sf_dir)
    scores = cut_lineage(scoring.bleu(samples, goldens))
    store.write_report(scores, scoring.metric_means(scores, "bleu"), path)
    rows = spark.read.schema("bleu double, bleu1 double, bleu2 double, bleu3 double, bleu4 double, sample_id string")
    means = spark.read.schema("bleu double").json(f"{path}/aggregate_metrics").select(F.col("bleu").alias("mean"), F.lit(1).alias("one"))
    back = rows.json(f"{path}/responses").withColumn("one", F.lit(1)).join(F.broadcast(means), "one")
    return back.select("sample_id", rounded("bleu").alias("bleu"), rounded("mean").alias("mean"))


@query
def stage_counts(spark, sf_dir):
    """Rows of two stages, counted while they are written and not by extra jobs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs, seen = stages.observed(docs, "documents")
    chunks, cut = stages.observed(chunking.chunk_fixed(docs, "text", 500, 100), "chunks")
    written = cut_lineage(chunks.select("doc_id", "chunk_no"))
    return written.agg(
        F.lit(seen.get["rows"]).cast("bigint").alias("n_documents"),
        F.lit(cut.get["rows"]).cast("bigint").alias("n_chunks"),
        F.count(F.lit(1)).alias("n_written"),
    )


# --- chunks and vectors -------------------------------------------------------------


@query
def chunk_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunk_fixed(docs, "text", 500, 100).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk"
    )


@query
def chunk_recursive(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunk_recursive(docs, "text", 500, 100).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk"
    )


@query
def embed_documents(spark, sf_dir):
    """Unit vectors of hashed terms with idf, one row per bucket that a text has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = embedding.hashed_terms(256, embedding.fit_idf(docs, "text", 256))
    weights = model(docs, "text", "vector").select("doc_id", F.posexplode("vector").alias("bucket", "weight"))
    return weights.where("weight > 0").select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"), rounded(F.col("weight").cast("double")).alias("weight")
    )


@query
def build_index(spark, sf_dir):
    """Chunks with vectors by the idf of all chunks' documents; vectors as rounded sums."""
    docs = table(spark, sf_dir, "documents")
    model = embedding.hashed_terms(256, embedding.fit_idf(docs, "text", 256))
    vector = F.transform("vector", lambda x: x.cast("double"))
    return fixed_chunk_store(spark, sf_dir, model).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        "chunk",
        F.size(F.filter(vector, lambda x: x > 0)).cast("bigint").alias("n_buckets"),
        rounded(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)).alias("weight_sum"),
    )


# --- retrieval ------------------------------------------------------------------------


def vectors_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return (
        rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")),
    )


def hit_rows(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "chunk_id",
        rounded("score").alias("score"),
    )


@query
def knn_exact(spark, sf_dir):
    return hit_rows(retrieval.nearest(*vectors_of(spark, sf_dir), K))


@query
def knn_blocks(spark, sf_dir):
    """The same join by cells and blocks, as it runs when nothing fits a broadcast."""
    return hit_rows(
        retrieval.nearest(*vectors_of(spark, sf_dir), K, broadcast_bytes=0, block_rows=512)
    )


@query
def knn_ivf(spark, sf_dir):
    """Approximate: the 4 nearest of 16 cells per query."""
    return hit_rows(retrieval.nearest(*vectors_of(spark, sf_dir), K, cells=16, probes=4))


@query
def knn_recall(spark, sf_dir):
    """Recall of the approximate search: calibrated on the queries with ids divisible by 20 for
    0.95 of their exact hits, measured on these and on as many others."""
    queries, chunks = vectors_of(spark, sf_dir)
    known = F.col("query_id") % 20 == 0
    search = retrieval.recalling(queries.where(known), chunks, K, recall=0.95, cells=32)
    asked = queries.where(F.col("query_id") % 10 == 0)
    found = retrieval.found_of(search(asked, chunks, K), retrieval.nearest(asked, chunks, K))
    both = Window.partitionBy("calibrated")
    return found.withColumn("calibrated", known).select(
        "query_id",
        "calibrated",
        "n_exact",
        "n_found",
        rounded(F.sum("n_found").over(both) / F.sum("n_exact").over(both)).alias("recall"),
    )


@query
def knn_threshold(spark, sf_dir):
    return hit_rows(retrieval.above_threshold(retrieval.nearest(*vectors_of(spark, sf_dir), K)))


@query
def knn_plain(spark, sf_dir):
    hits = retrieval.nearest(*vectors_of(spark, sf_dir), K)
    return hits.select("query_id", "chunk_id")


@query
def knn_none(spark, sf_dir):
    """The retriever without hits: every query keeps an empty list."""
    queries, _ = vectors_of(spark, sf_dir)
    none = retrieval.no_hits(queries)
    counted = none.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.join(counted, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_hits")
    )


@query
def relevance_score(spark, sf_dir):
    """Distance and relevance of neighbouring vector ids, as expressions."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    d2 = vectors.squared_distance(F.col("a"), F.col("b"))
    return a.join(b, "vec_id").select(
        "vec_id", rounded(d2).alias("distance2"), rounded(vectors.relevance(d2)).alias("score")
    )


def documents_with_vectors(spark, sf_dir) -> DataFrame:
    """Every document with a vector: there are fewer vectors, so they repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vecs.count()
    return docs.join(vecs, F.col("doc_id") % n == F.col("vec_id")).drop("vec_id")


def texts_with_vectors(spark, sf_dir) -> DataFrame:
    """(doc_id, text) of ``documents_with_vectors``, as often as a row is there. Texts are dealt by
    doc_id, not by the vector's id, so a join on doc_id does not shuffle them again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vecs = table(spark, sf_dir, "embeddings")
    times = vecs.groupBy("vec_id").agg(F.count(F.lit(1)).alias("times"))
    n = vecs.count()
    found = docs.select("doc_id").distinct().join(times, F.col("doc_id") % n == F.col("vec_id"))
    rows = docs.join(found.select("doc_id", "times"), "doc_id")
    return rows.select("doc_id", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def enriched(spark, sf_dir, drop_contained: bool = True, threshold: float | None = None) -> DataFrame:
    rows = documents_with_vectors(spark, sf_dir)
    chunks = rows.withColumnRenamed("doc_id", "chunk_id")
    hits = retrieval.nearest(rows, chunks, K, query_id="doc_id")
    if threshold is not None:
        hits = retrieval.above_threshold(hits, threshold)
    return retrieval.with_neighbours(
        rows.select("doc_id", "text"),
        hits,
        chunks,
        "doc_id",
        "text",
        "chunk_id",
        "text",
        F.struct("chunk_id", F.col("text").alias("email")),
        drop_contained=drop_contained,
    )


@query
def raft_neighbours(spark, sf_dir):
    """Every document with its nearest others; contained ones dropped after the top k."""
    hits = F.col("relevant_emails")
    ids = F.transform(hits, lambda h: h["serialized_email"]["chunk_id"].cast("string"))
    total = F.aggregate(hits, F.lit(0.0), lambda s, h: s + h["score"])
    return enriched(spark, sf_dir).select(
        "doc_id",
        F.size(hits).cast("bigint").alias("n_hits"),
        F.array_join(ids, ",").alias("hit_ids"),
        rounded(total).alias("score_sum"),
    )


@query
def containment_filter(spark, sf_dir):
    """Pairs of a message and the one before that it does not contain verbatim."""
    pairs = mails(spark, sf_dir).where(F.col("prev").isNotNull())
    kept = pairs.where(retrieval.not_contained(F.col("body"), F.col("prev")))
    return kept.select("conv_id", "turn")


@query
def search_text(spark, sf_dir):
    """Benchmark texts looked up in the document chunks by hashed vectors with idf."""
    model = embedding.hashed_terms(256, embedding.fit_idf(table(spark, sf_dir, "documents"), "text", 256))
    chunks = cut_lineage(
        fixed_chunk_store(spark, sf_dir, model).select(
            F.concat_ws("#", "doc_id", "chunk_no").alias("chunk_id"), "vector"
        )
    )
    queries = model(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "text", "vector")
    return hit_rows(retrieval.nearest(queries, chunks, K))


@query
def raft_refilled(spark, sf_dir):
    """Every document with its K nearest others that it does not contain, however far they are."""
    # The search reads vectors many times, texts are read twice: only the vectors are written.
    vectors = documents_with_vectors(spark, sf_dir).select("doc_id", "vector")
    queries, texts = spread(cut_lineage(vectors), "doc_id"), texts_with_vectors(spark, sf_dir)
    chunks, chunk_texts = (df.withColumnRenamed("doc_id", "chunk_id") for df in (queries, texts))
    hits = retrieval.nearest_kept(
        queries, chunks, K, "text", "text", query_id="doc_id", query_texts=texts, chunk_texts=chunk_texts
    )
    return hits.select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", rounded("score").alias("score")
    )


# --- prompts and pairs ---------------------------------------------------------------------


def prompt_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        F.md5("prompt").alias("prompt_md5"),
        F.length("prompt").cast("bigint").alias("prompt_chars"),
    )


@query
def rag_prompt(spark, sf_dir):
    """Neighbours above the threshold in the prompt; the frame stays without hits."""
    bodies = F.transform("relevant_emails", lambda h: h["serialized_email"]["email"])
    prompt = prompting.email_prompt(
        F.col("text"), user_preamble=" Sent from the office. \n", hits=bodies
    )
    rows = enriched(spark, sf_dir, threshold=0.2).withColumn("prompt", prompt)
    return prompt_rows(rows, "doc_id")


@query
def legacy_prompt(spark, sf_dir):
    bodies = F.transform("relevant_emails", lambda h: h["chunk"])
    prompt = prompting.legacy_email_prompt(F.col("text"), hits=bodies)
    rows = enriched(spark, sf_dir, threshold=0.2).withColumn("prompt", prompt)
    return prompt_rows(rows, "doc_id")


@query
def thread_prompt(spark, sf_dir):
    prompt = prompting.email_prompt(
        F.col("main"), system_preamble="", thread=F.col("thread"), thread_emails=1
    )
    rows = cleaning.split_thread(mails(spark, sf_dir), "body")
    return rows.select("conv_id", "turn", prompt.alias("prompt"))


@query
def summary_prompt(spark, sf_dir):
    prompt = prompting.summary_prompt(F.col("text"))
    return prompt_rows(table(spark, sf_dir, "documents").withColumn("prompt", prompt), "doc_id")


def replies(spark, sf_dir) -> DataFrame:
    return mails(spark, sf_dir).where((F.col("role") == "assistant") & F.col("prev").isNotNull())


def pairs(spark, sf_dir) -> DataFrame:
    prompt = prompting.email_prompt(F.col("prev"), user_preamble="I am Pat.")
    family = F.col("conv_id") % len(MODELS)
    model = F.when(family == 0, MODELS[0]).when(family == 1, MODELS[1]).otherwise(MODELS[2])
    return replies(spark, sf_dir).select(
        "conv_id",
        "turn",
        prompting.pair_prompt(prompt, model).alias("prompt"),
        prompting.pair_response(F.col("text"), model).alias("response"),
    )


@query
def chat_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query
def pair_length_cap(spark, sf_dir):
    fits = prompting.within_length(F.col("prompt"), F.col("response"), 200)
    return pairs(spark, sf_dir).select("conv_id", "turn", fits.alias("fits"))


@query
def chat_messages(spark, sf_dir):
    chat = prompting.conversation(F.col("prev"), F.col("text"))
    return (
        replies(spark, sf_dir)
        .select("conv_id", "turn", F.posexplode(chat).alias("place", "m"))
        .select(
            "conv_id", "turn", F.col("place").cast("bigint").alias("place"), "m.role", "m.content"
        )
    )


@query
def template_fill(spark, sf_dir):
    """Braces inside an inserted text are left alone."""
    value = F.concat(F.lit("{b} "), F.col("text"))
    filled = templates.fill("<{a}|{b}>", a=value, b=F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", filled.alias("filled"))


@query
def instruction_extract(spark, sf_dir):
    summary = F.concat(F.col("role"), F.lit("\n\nInstruction: a\n\nInstruction: "), F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prompting.instruction_of(summary).alias("instruction")
    )


@query
def instruction_valid(spark, sf_dir):
    """Replies with the keyword none, once or twice: only once is kept."""
    reply = F.concat(F.repeat(F.lit("Instruction: "), (F.col("turn") % 3).cast("int")), F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return rows.where(prompting.has_one_instruction(F.col("reply"))).select(
        "conv_id", "turn", prompting.instruction_behind_key(F.col("reply")).alias("instruction")
    )


@query
def strip_boilerplate(spark, sf_dir):
    reply = F.concat(
        F.lit("Here is the email:\nSUBJECT: x\nSubject: y\nE-MAIL CONTENT: z\n"),
        F.col("text"),
        F.lit("\nIt had no Subject: line\nbye"),
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prompting.strip_boilerplate(reply).alias("reply")
    )


@query
def generated_extract(spark, sf_dir):
    full = F.concat(
        F.lit("[INST] q [/INST] r [/INST]\n "), F.col("text"), F.lit(" \n</s> junk </s>")
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prompting.generated_text(full, MODELS[1]).alias("reply")
    )


@query
def generate_echo(spark, sf_dir):
    """Two samples per prompt through the Python generator, keys kept."""
    asked = table(spark, sf_dir, "conversations").withColumn(
        "prompt", prompting.email_prompt(F.col("text"), system_preamble="")
    )
    return generation.generate(asked, "prompt", generation.echo, samples=2).select(
        "conv_id", "turn", F.col("sample_no").cast("bigint").alias("sample_no"), "response"
    )


@query
def generate_extractive(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").withColumn(
        "prompt", prompting.summary_prompt(F.col("text"))
    )
    answered = generation.generate(asked, "prompt", generation.extractive)
    return answered.select("doc_id", F.col("sample_no").cast("bigint").alias("sample_no"), "response")


# --- evaluation ------------------------------------------------------------------------------


@query
def golden_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.concat_ws("/", "role", F.col("turn").cast("string")).alias("thread")
    )
    grouped = scoring.golden_groups(rows, "conv_id", "turn", "text", "thread", slice_rows=3)
    return grouped.select(
        "conv_id",
        F.col("slice_no").cast("bigint").alias("slice_no"),
        joined(F.col("goldens")).alias("goldens"),
        "thread",
        "first_seq",
        "n_goldens",
    )


def graded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as replies; the one or two messages before as goldens."""
    rows = cut_lineage(replies(spark, sf_dir).select("email_id", "text", "prev", "prev2"))
    key = F.col("email_id")
    samples = rows.select(
        key.alias("sample_id"), key.alias("prompt_id"), F.col("text").alias("response")
    )
    goldens = rows.select(
        key.alias("prompt_id"), F.posexplode(F.array("prev", "prev2")).alias("golden_no", "golden")
    )
    return samples, goldens.where(F.col("golden").isNotNull())


@query
def bleu(spark, sf_dir):
    scores = scoring.bleu(*graded(spark, sf_dir))
    return scores.select("sample_id", *[rounded(c).alias(c) for c in scores.columns[1:]])


@query
def rouge_n(spark, sf_dir):
    scores = scoring.rouge(*graded(spark, sf_dir), longest=False)
    return scores.select("sample_id", *[rounded(c).alias(c) for c in scores.columns[1:]])


@query
def rouge_l(spark, sf_dir):
    scores = scoring.rouge(*graded(spark, sf_dir))
    longest = [c for c in scores.columns if c.startswith("rougeL")]
    return scores.select("sample_id", *[rounded(c).alias(c) for c in longest])


@query
def rouge_all_goldens(spark, sf_dir):
    """Replies against every earlier turn of their conversation, BLEU and all of ROUGE."""
    turns = mails(spark, sf_dir).select("conv_id", "turn", "role", "text", "prev")
    asked = turns.where((F.col("role") == "assistant") & F.col("prev").isNotNull())
    samples = asked.select(
        F.concat_ws("-", "conv_id", "turn").alias("sample_id"),
        F.concat_ws("-", "conv_id", "turn").alias("prompt_id"),
        F.col("text").alias("response"),
    )
    before = turns.select("conv_id", F.col("turn").alias("golden_no"), F.col("text").alias("golden"))
    goldens = (
        asked.select("conv_id", "turn")
        .join(before, "conv_id")
        .where("golden_no < turn")
        .select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), "golden_no", "golden")
    )
    samples, goldens = cut_lineage(samples), cut_lineage(goldens)
    both = scoring.bleu(samples, goldens).join(scoring.rouge(samples, goldens), "sample_id")
    kept = ["bleu", "rouge1_fmeasure", "rouge2_fmeasure", "rougeL_fmeasure"]
    return both.select("sample_id", *[rounded(c).alias(c) for c in kept])


@query
def metric_means(spark, sf_dir):
    samples, goldens = graded(spark, sf_dir)
    rouge = scoring.rouge(samples, goldens, longest=False)
    both = scoring.bleu(samples, goldens).join(rouge, "sample_id")
    means = scoring.metric_means(both, "bleu", *rouge.columns[1:])
    return means.select(*[rounded(c).alias(c) for c in means.columns])


@query
def mauve_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    result = divergence.mauve(rows, "label", F.col("vec_id") % 2 == 0)
    return result.select(rounded("mauve").alias("mauve"), "n_p", "n_q")


@query
def bigram_perplexity(spark, sf_dir):
    rows = split_documents(spark, sf_dir).select("doc_id", "text", "split")
    scored = perplexity.row_perplexity(
        rows.where("split = 'train'"), rows.where("split = 'test'"), "doc_id", "text"
    )
    return scored.select("doc_id", "n_bigrams", rounded("perplexity", 4).alias("perplexity"))


@query
def corpus_perplexity(spark, sf_dir):
    rows = split_documents(spark, sf_dir).select("doc_id", "text", "split")
    scored = perplexity.row_perplexity(
        rows.where("split = 'train'"), rows.where("split = 'test'"), "doc_id", "text"
    )
    total = perplexity.corpus_perplexity(scored)
    return total.select(
        "n_rows",
        "n_bigrams",
        rounded("cross_entropy").alias("cross_entropy"),
        rounded("perplexity", 4).alias("perplexity"),
    )


def test_table(spark, sf_dir) -> DataFrame:
    """Replies with the message they answer as instruction."""
    return cut_lineage(
        replies(spark, sf_dir).select(
            F.col("prev").alias("summary"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
            F.col("text").alias("email"),
            F.array_compact(F.array("prev2")).alias("thread"),
        )
    )


def echo_evaluation(spark, sf_dir):
    return evaluate(
        test_table(spark, sf_dir),
        generation.echo,
        use_thread=True,
        thread_emails=1,
        cells=8,
        model=embedding.hashed_terms(64),
    )


@query
def evaluate_replies(spark, sf_dir):
    """Bulk answering and scoring; one row of aggregate metrics."""
    return echo_evaluation(spark, sf_dir).metrics


@query
def evaluate_scores(spark, sf_dir):
    """The means of the same run that plain SQL can state."""
    scores = echo_evaluation(spark, sf_dir).scores
    names = ["bleu", *[k for k in scoring.ROUGE_KEYS if k.startswith(("rouge1", "rouge2"))]]
    means = scoring.metric_means(scores, *names)
    return means.select(*[rounded(c).alias(c) for c in names])


# --- stages together ----------------------------------------------------------------------------


@query
def training_pairs(spark, sf_dir):
    """Mail to training pairs: clean, instruct, split, index, neighbours, prompts."""
    settings = stages.Settings(
        addresses=tuple(SENDERS), test_split=0.1, neighbours=3, rag_emails=2, thread_emails=1
    )
    emails = cleaning.clean_emails(flagged(spark, sf_dir, True)).withColumn(
        "email_id", F.col("msg_id")
    )
    emails = mbox.part_date(emails)
    instructed, _ = stages.instruct(emails, generation.extractive)
    ready = cut_lineage(stages.split(instructed, settings))
    train = ready.where("split = 'train'")
    chunks = cut_lineage(stages.index(train, settings))
    found = stages.enrich(train, chunks, settings)
    return stages.training_pairs(found, settings)


# --- statistics and streams ---------------------------------------------------------------------


@query
def stats_by_day(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    daily = stream_stats.stats_by_day(events, "ts", "event_type")
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "reason", "n")


@query
def stream_stats_by_day(spark, sf_dir):
    """The same counts from a file stream whose days arrive in any order."""
    events = table(spark, sf_dir, "events")
    arrived = new_work_path(spark, "events")
    shuffled = events.select("ts", "event_type").withColumn("h", F.xxhash64("ts", "event_type"))
    shuffled.repartition(6, "h").drop("h").write.parquet(arrived)
    rows = (
        spark.readStream.schema("ts timestamp_ntz, event_type string")
        .option("maxFilesPerTrigger", 1)
        .parquet(arrived)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    out, checkpoint = new_work_path(spark, "daily"), new_work_path(spark, "daily-state")
    stream_stats.stream_stats(rows, "ts", "event_type", out, checkpoint).awaitTermination()
    return stream_stats.latest_stats(spark, out).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "reason", "n"
    )


@query
def stream_ingested(spark, sf_dir):
    """Messages arriving as files, three per batch, cleaned and chunked into a store."""
    arrived, out, state = (new_work_path(spark, n) for n in ("arrived", "store", "store-state"))
    parts = mail_view.as_parts(mails(spark, sf_dir)).drop("conv_id", "turn")
    parts.repartition(8, "msg_id").write.parquet(arrived)
    stream_ingest.ingest(
        stream_ingest.read_part_stream(spark, arrived, files_per_batch=3),
        out,
        state,
        SENDERS,
        "mail",
        500,
        100,
        embedding.hashed_terms(64),
        recursive=False,
    ).awaitTermination()
    return stream_ingest.ingested(spark, out).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk"
    )
