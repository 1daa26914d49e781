import random
import re

import numpy as np
import pytest

from lettermill.llm import ngram_join
from lettermill.llm.common import documents
from lettermill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """{row number: (class, links)} by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return sorted(((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()), key=repr)


def near_copies(seed, base_words, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(base_words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def test_against_all_pairs(spark):
    texts = [None, "", " \t\n", "one two", "one  two", "one two three four five", "same copy text of five plus words"]
    texts += ["same copy text of five plus words"] * 7
    texts += list(near_copies(1, 60, 40, 3)) + list(near_copies(2, 200, 30, 8)) + list(near_copies(3, 30, 25, 2))
    texts += ["long " + " ".join(f"v{i}" for i in range(30_000)), "long " + " ".join(f"v{i}" for i in range(29_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, "alone without id and with words"), (5, texts[5])]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id bigint, text string, unit int, label string")
    result = ngram_join.ngram_join(df)
    assert got(result) == brute(rows)
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    classes = {c for d, c, _ in brute(rows)}
    assert {r["doc_id"] for r in kept.collect()} == classes


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = list(enumerate(near_copies(5, 80, 150, 4)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.ngram_join(df)) == brute(rows)


def test_different_texts_with_one_id(spark):
    """Ids 1 and 2 stand for two texts each, all with near copies of their own; rows repeat."""
    a, b, c, d = (list(near_copies(seed, 200, 3, 1)) for seed in (11, 12, 13, 14))
    rows = [(1, a[0]), (1, b[0]), (2, c[0]), (2, d[0]), (3, a[1]), (4, b[1]), (5, c[1]), (6, d[1]), (7, "alone with words of its own")]
    rows += [(1, a[0]), (1, a[0]), (None, d[2]), (None, "no id here but two rows"), (None, "no id here but two rows"), (8, ""), (8, "")]
    df = spark.createDataFrame([(x, t, i) for i, (x, t) in enumerate(rows)], "doc_id bigint, text string, n int")
    assert got(ngram_join.ngram_join(df)) == brute(rows)
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    least = [(1, a[0]), (1, b[0]), (2, c[0]), (2, d[0]), (7, rows[8][1]), (None, rows[12][1]), (8, ""), (8, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(least, key=repr)
    assert ngram_join.ngram_join(df).where("stays").count() == len(least)


def test_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(ngram_join.ngram_join(docs)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.ngram_join(df).count() == 0 and ngram_join.keep_one_of_each(df).count() == 0


def test_pruning_bound():
    need = ngram_join.enough_matches(0.8, 1e-6)
    draws = np.random.default_rng(0).random((200_000, ngram_join.COMPARED)) < 0.8
    matches = draws.cumsum(axis=1)[:, ngram_join.STEP - 1 :: ngram_join.STEP]
    assert (matches < need).any(axis=1).mean() < 1e-4
    assert need[-1] > 70


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 5000, 5000, 700)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert ngram_join.common_counts(sets).tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("text", ["a b c d e f a b c d e", "é x\x0by"])
def test_shingle_sets(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    found = list(ngram_join.shingles_in(raw, np.array([0, len(raw)])))
    assert len(found) == 1 and len(found[0]) == len(shingles(text))
