"""Keyed chunks, payloads of any type, hashed terms with idf, refilled hits."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.operators import embedding, retrieval
from lettermill.plans import stages
from lettermill.schema import KEYED_CHUNKS
from lettermill.session import cut_lineage, new_work_path
from lettermill.sources import store
from lettermill.streaming import ingest

TEXTS = ["the cat sat", "The dog, sat!", "a cat and the dog", "", None, "the the the bird"]


def bucket(token, n):
    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % n


def tokens(text):
    return "".join(c for c in (text or "") if c not in "!,").lower().split()


def test_idf_and_vectors(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    table = embedding.fit_idf(docs, "text", 32)
    seen = Counter(b for t in TEXTS for b in {bucket(w, 32) for w in tokens(t)})
    want = {b: (seen[b], len(TEXTS), math.log((len(TEXTS) + 1) / (seen[b] + 1))) for b in range(32)}
    got = {r["bucket"]: (r["n_with"], r["n_docs"], r["idf"]) for r in table.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[b], want[b]) for b in want)
    model = embedding.hashed_terms(32, table)
    for row in model(docs, "text", "v").collect():
        v = np.zeros(32)
        for w in tokens(row["text"]):
            v[bucket(w, 32)] += want[bucket(w, 32)][2]
        assert np.allclose(row["v"], v / (np.linalg.norm(v) or 1), atol=1e-6)
    with pytest.raises(ValueError, match="32 buckets for 16"):
        embedding.hashed_terms(16, table)


def test_idf_of_nothing(spark):
    table = embedding.fit_idf(spark.createDataFrame([], "text string"), "text", 8)
    assert [tuple(r) for r in table.select("n_with", "n_docs", "idf").distinct().collect()] == [(0, 0, 0.0)]


def notes(spark, rows):
    return spark.createDataFrame(rows, "key long, note string, stars int, tags array<string>")


def test_documents_of_any_type_in_one_index(spark):
    path, kept, arrived, state = (new_work_path(spark, n) for n in ("c", "p", "a", "s"))
    model = embedding.hashed_terms(8)
    rows = [(i, f"note number {i} " * 9, i % 5, [f"t{i}"]) for i in range(12)]

    def batch(df):
        store.store_chunks(embedding.index_chunks(df, "key", "note", "n", model, 40, 0, recursive=False), path)
        store.store_chunks(embedding.payloads(df, "key", "n"), kept)

    batch(notes(spark, rows[:4]))
    notes(spark, rows[4:9]).repartition(3).write.parquet(arrived)
    stream = spark.readStream.schema(notes(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest_documents(stream, path, kept, state, "key", "note", "n", 40, 0, model, recursive=False).awaitTermination()
    batch(notes(spark, rows[9:]))
    chunks = store.load_index(spark, path, "n", KEYED_CHUNKS)
    assert set(chunks.columns) == {"doc_id", "chunk_no", "chunk", "vector", "index_name"}
    joined = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: c["chunk"]), "").alias("note"))
    schema = store.payload_schema(notes(spark, []).drop("key").schema)
    whole = store.load_index(spark, kept, "n", schema).join(joined, "doc_id")
    got = [(int(r["doc_id"]), r["note"], r["payload"]["stars"], r["payload"]["tags"]) for r in whole.collect()]
    assert sorted(got) == rows
    assert store.load_index(spark, kept, "absent", schema).count() == 0


def brute_refill(rows, k):
    out = set()
    for i, (text, v) in rows.items():
        free = sorted((float(((np.float32(v) - np.float32(w)).astype(float) ** 2).sum()), j) for j, (t, w) in rows.items() if t not in text)
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(free[:k])}
    return out


@pytest.mark.parametrize("k", [1, 4, 100])
def test_refilled_hits(spark, k):
    rng = np.random.default_rng(4)
    rows = {i: ("ab" * rng.integers(1, 5) + "c" * (i % 3), rng.normal(size=3).tolist()) for i in range(60)}
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in rows.items()], "query_id long, text string, vector array<float>")
    chunks = df.select(F.col("query_id").alias("chunk_id"), F.col("text").alias("chunk"), "vector")
    got = retrieval.nearest_kept(df, chunks, k, "text", "chunk", widen=2)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got.collect()} == brute_refill(rows, k)
    own = F.col("query_id") == F.col("chunk_id")
    others = retrieval.nearest_kept(df, chunks, k, "text", "chunk", exclude_self=own)
    assert others.where(own).count() == 0


def test_nothing_to_refill(spark):
    df = spark.createDataFrame([(1, "abc", [1.0])], "query_id long, text string, vector array<float>")
    chunks = df.select(F.col("query_id").alias("chunk_id"), F.col("text").alias("chunk"), "vector")
    assert retrieval.nearest_kept(df, chunks, 3, "text", "chunk").count() == 0
    assert retrieval.nearest_kept(df, chunks.limit(0), 3, "text", "chunk").count() == 0


def test_emails_come_from_their_payloads(spark):
    bodies = ["alpha beta gamma delta", "alpha beta gamma", "alpha beta epsilon zeta", "omega psi chi"]
    train = spark.createDataFrame(
        [(f"m{i}", b, f"s{i}", [], "2024-01-01", None) for i, b in enumerate(bodies)],
        "email_id string, email string, subject string, thread array<string>, date_iso string, summary string",
    )
    settings = stages.Settings(addresses=("a",), neighbours=2, chunk_size=100, chunk_overlap=0)
    model = embedding.hashed_terms(64)
    chunks = cut_lineage(stages.index(train, settings, model))
    stored = cut_lineage(stages.payloads(train, settings))
    plain = stages.enrich(train, chunks, settings, model, stored=stored, exclude_self=False)
    full = stages.enrich(train, chunks, settings, model, exclude_self=False, refill=True)
    hits = {r["email_id"]: [h["serialized_email"]["subject"] for h in r["relevant_emails"]] for r in plain.collect()}
    assert hits["m0"] == [] and "s0" in hits["m1"]  # it contains both of its nearest
    more = {r["email_id"]: [h["serialized_email"]["email"] for h in r["relevant_emails"]] for r in full.collect()}
    assert more["m0"] == ["alpha beta epsilon zeta", "omega psi chi"] and all(len(h) == 2 for h in more.values())


def test_a_word_is_digested_once(monkeypatch):
    import pyarrow as pa

    asked = []
    plain = embedding.bucket
    monkeypatch.setattr(embedding, "bucket", lambda w, n: asked.append(w) or plain(w, n))
    texts = [["the", "cat", "the"], None, [], ["é", "cat"]] * 300
    known = {}
    counts = np.concatenate(list(embedding.bucket_counts(pa.array(texts, pa.list_(pa.string())), 16, known)))
    assert sorted(asked) == sorted({w.encode() for w in ("the", "cat", "é")})
    for row, text in zip(counts, texts):
        want = Counter(bucket(w, 16) for w in text or [])
        assert row.tolist() == [want[b] for b in range(16)]


def test_an_embedding_is_evaluated_once(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = embedding.hashed_terms(8)(docs, "text", "v").select("doc_id", F.posexplode("v")).where("col > 0")
    assert rows._jdf.queryExecution().executedPlan().toString().count("vectors(") == 1
