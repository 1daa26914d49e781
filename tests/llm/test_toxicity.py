"""Learning and scoring against a plain statement of the method over dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lettermill.llm import toxicity
from lettermill.llm.common import documents, labels


def terms(text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower())
    return Counter(words) + Counter((n, w[:n]) for w in words for n in (4, 5) if len(w) > n)


class Brute:
    def __init__(self, texts, marks):
        """``texts`` and ``marks`` by id: all labelled examples."""
        self.ids = sorted(marks)
        self.y = np.array([marks[i] for i in self.ids], dtype=float)
        tf = [terms(texts[i]) for i in self.ids]
        n, n_pos = len(self.ids), int(self.y.sum())
        df, pos = Counter(), Counter()
        for t, y in zip(tf, self.y):
            df.update(t.keys())
            pos.update({k: int(y) for k in t})
        self.scale = {}
        for k in df:
            a, b = pos[k], df[k] - pos[k]
            gap = max(abs(a * (n - n_pos) - b * n_pos) - n / 2, 0)
            chi = n * gap * gap / (df[k] * max(n - df[k], 1) * max(n_pos, 1) * max(n - n_pos, 1))
            self.scale[k] = (math.log((1 + n) / (1 + df[k])) + 1) * (0.005 + 0.995 * chi / (chi + 20))
        self.strange = (math.log(1 + n) + 1) * 0.005
        self.vectors = [self.vector(t) for t in tf]

    def vector(self, tf):
        w = {k: (1 + math.log(c)) * self.scale.get(k, self.strange) for k, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {k: x / norm for k, x in w.items()}

    def vote(self, v, skip=None):
        cosines = [(-round(c, 6), i, c) for i, u in enumerate(self.vectors) if i != skip and (c := sum(x * u[k] for k, x in v.items() if k in u)) > 0]
        near = sorted(cosines)[:15]
        w = [1 / (1.05 - min(c, 1)) for _, _, c in near]
        return (sum(a * self.y[i] for a, (_, i, _) in zip(w, near)) / sum(w), [self.ids[i] for _, i, _ in near]) if near else None


@pytest.mark.parametrize("frequent", [2, 16, 10**9])
def test_fit_and_score(spark, sf_dir, monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    monkeypatch.setattr(toxicity, "COMMON", 3)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    docs = documents(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels(spark, sf_dir).collect()}
    learnt = {i: y for i, y in marks.items() if zlib.crc32(str(i).encode()) % 5 and i in texts}
    if not sum(learnt.values()):
        pytest.skip("no toxic examples")
    brute = Brute(texts, learnt)
    index = toxicity.fit(docs, labels(spark, sf_dir))
    assert index.ids.tolist() == brute.ids and len(index.terms) == len(brute.scale)
    left_out = [(brute.vote(v, skip=i), brute.y[i]) for i, v in enumerate(brute.vectors)]
    votes, y = zip(*[(v[0], t) for v, t in left_out if v])
    slope, offset = toxicity.fit_logistic(np.array(votes), np.array(y), np.ones(len(y)))
    assert (index.slope, index.offset) == pytest.approx((slope, offset), rel=1e-3)
    for r in toxicity.score(docs, index).collect():
        found = brute.vote(brute.vector(terms(texts[r["doc_id"]])))
        if found is None:
            assert r["score"] == index.empty_score and r["evidence"] == []
        else:
            assert r["score"] == pytest.approx(index.calibrated(found[0]), abs=1e-5), r["doc_id"]
            assert len(set(r["evidence"]) & set(found[1])) >= len(found[1]) - 1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in toxicity.score(docs, index).collect())


def test_bounded_sample_is_balanced(spark):
    docs = spark.createDataFrame([(i, f"w{i % 50} " + ("bad" if i % 10 == 0 else "good")) for i in range(800)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "int(doc_id % 10 = 0) as toxic")
    index = toxicity.fit(docs, marks, max_examples=60)
    assert len(index.ids) == 60 and index.labels.sum() == 30
    assert index.empty_score == pytest.approx(0.1, abs=0.03)  # the true share, not the sample's
    again = toxicity.fit(docs.repartition(3), marks, max_examples=60)
    assert again.ids.tolist() == index.ids.tolist()


def test_string_ids(spark):
    docs = spark.createDataFrame([(f"k{i}", "awful thing" if i % 4 == 0 else "nice thing") for i in range(60)], "doc_id string, text string")
    marks = docs.selectExpr("doc_id", "int(text LIKE 'awful%') as toxic")
    rows = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert all((r["score"] >= 0.5) == (int(r["doc_id"][1:]) % 4 == 0) and r["evidence"][0].startswith("k") for r in rows)
