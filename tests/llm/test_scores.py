"""Quality, toxicity and language: held-out accuracy, exact neighbours, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import language_codes, quality_neighbours, toxicity
from lettermill.llm.common import documents, fold, labels

LARGER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "12 ### 34"), (None, "the and of with"), (5, "the and of"), (5, "the and of"),
       (6, "word " * 60_000), (7, "é"), (8, "a")]


def odd_rows(spark, rows=ODD):
    return spark.createDataFrame([(d, t, "en", 1.0, "q") for d, t in rows],
        "doc_id bigint, text string, lang string, score double, label string")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, LARGER)


@pytest.fixture(scope="module")
def marks(spark):
    return labels(spark, LARGER)


def test_fold(spark):
    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def accuracy(scored, marks, label):
    rows = scored.where("held_out").join(marks, "doc_id").select("score", "predicted", F.col(label).alias("y")).toPandas()
    rank = rows["score"].rank()
    pos, neg = (rows["y"] == 1).sum(), (rows["y"] == 0).sum()
    area = (rank[rows["y"] == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    return area, (rows["predicted"] == rows["y"]).mean()


def test_quality(spark, docs, marks):
    space = quality_neighbours.fit(docs, marks)
    area, right = accuracy(quality_neighbours.score(docs, space), marks, "quality")
    assert area > 0.85 and right > 0.9
    odd = quality_neighbours.score(odd_rows(spark), space).toPandas()
    assert len(odd) == len(ODD) and odd["score"].between(0, 1).all()
    assert odd.loc[odd.doc_id.isin([1, 2, 8]), "score"].eq(round(space.prior, 4)).all()
    assert odd[odd.doc_id == 5]["score"].nunique() == 1


def test_quality_votes_are_exact():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.05, (80, quality_neighbours.FEATURES))
    y = (counts[:, :40].sum(axis=1) > 2).astype(int)
    space = quality_neighbours.latent_space(counts, y, np.arange(80), 16)
    got = space.scores(counts[:30], k=7)
    placed = space.place(counts[:30])
    for i in range(30):
        cosine = space.vectors @ placed[i]
        near = np.argsort(-cosine)[:7]
        w = np.maximum(cosine[near], 1e-3) ** quality_neighbours.POWER
        assert got[i] == pytest.approx((w * y[near]).sum() / w.sum(), abs=1e-4)


def test_toxicity(spark, docs, marks):
    index = toxicity.fit(docs, marks)
    area, right = accuracy(toxicity.score(docs, index), marks, "toxic")
    assert area > 0.8 and right > 0.93  # six held-out toxic texts here
    odd = toxicity.score(odd_rows(spark), index).toPandas()
    assert len(odd) == len(ODD) and odd["score"].between(0, 1).all()
    assert odd.loc[odd.doc_id.isin([1, 2, 3]), "score"].eq(index.empty_score).all()
    kept = toxicity.keep_mild(docs, index)
    assert kept.columns == docs.columns
    rejected = {r["doc_id"] for r in toxicity.score(docs, index).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
    frame = odd_rows(spark)
    assert toxicity.keep_mild(frame, index).columns == frame.columns


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    n, vocabulary = 700, 60
    rows = [(e, t, 1 + rng.integers(4)) for e in range(n) for t in rng.choice(vocabulary, rng.integers(1, 8), replace=False)]
    example, term, tf = (np.array(x) for x in zip(*rows))
    index = toxicity.build_index(np.arange(n), rng.integers(0, 2, n), example, term, tf.astype(float))
    dense = np.zeros((n, len(index.terms)))
    w = (1 + np.log(tf)) * index.idf[np.searchsorted(index.terms, term)]
    dense[example, np.searchsorted(index.terms, term)] = w
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for _ in range(40):
        q = np.sort(rng.choice(len(index.terms), rng.integers(1, 6), replace=False))
        v = toxicity.query_vector(index, q, np.ones(len(q)))
        at, cosine = index.nearest(q, v, 15)
        want = dense[:, q] @ v
        order = np.lexsort((np.arange(n), -np.round(want, 6)))[:15]
        order = order[want[order] > 0]
        assert at.tolist() == order.tolist() and np.allclose(cosine, want[order])


def test_language(spark, docs):
    book = language_codes.fit(docs)
    found = language_codes.identify(docs, book)
    held = found.where("held_out").join(docs, "doc_id")
    assert held.where("lang_pred = lang").count() / held.count() > 0.97
    odd = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_codes.identify(odd_rows(spark), book).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)} <= odd
    assert all(lang != "und" for d, lang, _ in odd if d not in (1, 2, 3, 4))


def test_every_language_is_learnt(spark, monkeypatch):
    """140 languages of own words, the last ones rarer; more than are allowed is an error."""
    monkeypatch.setattr(language_codes, "DECODED", 1 << 16)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(140):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        rows += [(1000 * k + i, " ".join(rng.permutation(words)), f"l{k:03}") for i in range(9 if k < 130 else 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    book = language_codes.fit(df)
    assert book.languages == sorted({lang for _, _, lang in rows})
    found = {r["doc_id"]: r["lang_pred"] for r in language_codes.identify(df, book).collect()}
    assert found == {d: lang for d, _, lang in rows}
    with pytest.raises(ValueError, match="more languages"):
        language_codes.fit(df, max_languages=139)


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords(n):
    code = language_codes.codewords(n)
    gap = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
    assert gap.min() >= 1 and (np.abs(code.sum(axis=0)) < n).all()
    if n <= 7:
        assert gap.min() == 2 ** (n - 2)  # every pair of languages differs in half the splits


def test_decoding_corrects_a_wrong_bit():
    book = language_codes.Codebook(list("abcd"), language_codes.codewords(4), np.zeros((7, 1)))
    margins = 5 * book.code[2:3].copy()
    margins[0, 3] *= -1
    best, score, close = book.decode(margins)
    assert best[0] == 2 and score[0] > 0.9 and not close[0]
    assert book.decode(np.zeros((1, 7)))[2][0]


def test_nothing_to_learn_from(spark):
    empty = odd_rows(spark, [])
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = odd_rows(spark)
    assert toxicity.fit(rows, no_labels) is None and quality_neighbours.fit(rows, no_labels) is None
    assert {r["score"] for r in toxicity.score(rows, None).collect()} == {0.0}
    assert {r["score"] for r in quality_neighbours.score(rows, None).collect()} == {0.5}
    book = language_codes.fit(empty)
    assert {r["lang_pred"] for r in language_codes.identify(rows, book).collect()} == {"und"}
    for df in (toxicity.score(empty, None), quality_neighbours.score(empty, None), language_codes.identify(empty, book)):
        assert df.count() == 0
    null_labels = spark.createDataFrame([(5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(rows, null_labels) is None
    one_language = language_codes.fit(rows)
    assert {r["lang_pred"] for r in language_codes.identify(rows, one_language).collect()} == {"und", "en"}
