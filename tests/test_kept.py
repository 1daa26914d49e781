"""Hits that a row does not contain: found by marks, not by texts that travel with every hit."""

from collections import Counter
from contextlib import nullcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.operators import retrieval
from lettermill.operators.retrieval import HITS_AT_ONCE, _Windows, holds, text_marks
from lettermill.plans import registry
from lettermill.session import cut_lineage, shuffles_freed

LONG = "".join(chr(97 + i * i % 23) for i in range(300))
THUE = ["ab"[bin(i).count("1") % 2] for i in range(4096)]
PIECES = [
    "", "a", "é", "\u0000", LONG, LONG[40:], LONG[:-1], LONG[5:200], LONG[:150] + "#" + LONG[151:], LONG + LONG,
    "a" * 500, "a" * 499 + "b", "xy" * 400, "x" + "yx" * 40, "日本語" * 30, "本語日" * 20, "=" * 16, "=" * 17,
    # Different texts of one print.
    "".join(THUE[:2048]), "".join(THUE[2048:]),
]


def test_marks_find_what_a_search_finds():
    windows, raw = _Windows(), [p.encode() for p in PIECES]
    marks = [text_marks(_Windows(), p) for p in raw]
    for text in [*raw, b"".join(raw), raw[4][::-1]]:
        assert holds(windows, text, marks) == [p in text for p in raw]
    assert marks[-1][2] == marks[-2][2] and marks[-1][3] != marks[-2][3]


def test_random_texts():
    rng, windows = np.random.default_rng(5), _Windows()
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 60)).astype(np.uint8)) * int(rng.integers(1, 3)) for _ in range(120)]
    texts += [t[a : a + n] for t in texts for a, n in rng.integers(0, 50, (2, 2))]
    marks = [text_marks(windows, t) for t in texts]
    for text in texts:
        assert holds(windows, text, marks) == [t in text for t in texts]


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "query_id long, text string, vector array<float>")
    return df, df.select(F.col("query_id").alias("chunk_id"), F.col("text").alias("chunk"), "vector")


@pytest.mark.parametrize("k", [2, HITS_AT_ONCE + 10])
def test_texts_in_tables_of_their_own(spark, k):
    """Also: rows and chunks without text, row ids that come twice, more hits than meet a text at once."""
    rng = np.random.default_rng(1)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(["ab", "c"], rng.integers(0, 12)))
    rows = [(i, text(), rng.normal(size=3).tolist()) for i in range(100)]
    df, chunks = rows_of(spark, rows)
    df = df.withColumn("query_id", F.col("query_id") % 90)
    got = retrieval.nearest_kept(
        df.drop("text"), chunks.drop("chunk"), k, "text", "chunk", widen=2, query_texts=df.drop("vector"), chunk_texts=chunks.drop("vector")
    )
    assert got.columns == ["query_id", "chunk_id", "rank", "distance2", "score"]
    have = {}
    for r in got.collect():
        have.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    for i, own, v in rows[10:90]:  # ids that come once, so that their hits have one order
        gap = lambda w, v=v: float(((np.float32(v) - np.float32(w)).astype(float) ** 2).sum())
        free = sorted((gap(w), j) for j, t, w in rows if own is not None and t is not None and t not in own)
        assert have.get(i, {}) == {rank: j for rank, (_, j) in enumerate(free[:k], 1)}


def on_disk(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.length())) if f.getName().startswith("shuffle"))


def test_texts_are_not_shuffled_per_hit(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.bytes(15_000).hex(), rng.normal(size=3).tolist()) for i in range(120)]
    df, chunks = (cut_lineage(x) for x in rows_of(spark, rows))
    before, there = on_disk(spark), []
    monkeypatch.setattr(retrieval, "shuffles_freed", lambda session: nullcontext(), raising=False)
    monkeypatch.setattr(retrieval, "cut_lineage", lambda x: (cut_lineage(x), there.append(on_disk(spark)))[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the texts were a large table
    try:
        hits = retrieval.nearest_kept(df, chunks, 10, "text", "chunk")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(there) - before < 2 * 120 * 30_000  # there are 20 hits a row
    assert hits.count() == 1200


def test_shuffles_end_with_their_action(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    df = spark.range(200_000).select(F.rand(1).alias("a"), "id").repartition(4, "a")
    before = on_disk(spark)
    with shuffles_freed(spark):
        assert df.count() == 200_000
        with shuffles_freed(spark):
            cut = cut_lineage(df)
        assert spark.conf.get(key) == "true"
        assert on_disk(spark) <= before and cut.count() == 200_000
    assert spark.conf.get(key, None) == was
    cut_lineage(df)
    assert on_disk(spark) > before


def test_blocks_are_searched_in_rounds(spark, monkeypatch):
    """Also with equal vectors and with chunk ids that come twice."""
    rng, k = np.random.default_rng(3), 4
    vectors = [rng.normal(size=2).tolist() for _ in range(60)] * 3
    queries = spark.createDataFrame(list(enumerate(vectors[:90])), "query_id long, vector array<float>")
    chunks = spark.createDataFrame([(i % 150, v) for i, v in enumerate(vectors)], "chunk_id long, vector array<float>")
    written = []
    monkeypatch.setattr(retrieval, "cut_lineage", lambda x: (cut_lineage(x), written.append(x.columns))[0])

    def found(rows):
        written.clear()
        monkeypatch.setattr(retrieval, "FOUND_ROWS", rows, raising=False)
        hits = retrieval.nearest(queries, chunks, k, broadcast_bytes=0, block_rows=8)
        return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance2"], 5)) for r in hits.collect())

    def brute():
        out = []
        for i, v in enumerate(vectors[:90]):
            gap = lambda w, v=v: float(((np.float32(v) - np.float32(w)).astype(float) ** 2).sum())
            near = sorted((gap(w), j % 150) for j, w in enumerate(vectors))[:k]
            out += [(i, rank, j, round(d, 5)) for rank, (d, j) in enumerate(near, 1)]
        return out

    once = found(1 << 24)
    rounds = written.count(["qid", "rep", "no", "d2"])
    assert once == brute() and rounds == 1
    assert found(100) == once and written.count(["qid", "rep", "no", "d2"]) > 3


def test_texts_are_those_of_the_rows_with_vectors(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(9)] + [(3, "text 3"), (3, "other"), (5, None), (None, "no id")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, [1.0]) for i in (0, 1, 2, 2, None, 7)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = registry.documents_with_vectors(spark, str(tmp_path)).select("doc_id", "text")
    got = registry.texts_with_vectors(spark, str(tmp_path))
    assert got.columns == want.columns and want.count() > 6
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
