import random
import re
from collections import Counter, defaultdict

import pytest

from lettermill.llm import source_divergence as sd

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = [t.translate(UPPER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def prices(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: prices(counts[lang, s]) for s in sources}, prices(whole)
        for s in sources:
            found = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(found))}
            found = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(found)[:top])}
    return out


def random_rows(seed, n, sources=6):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ab", "cé", "ß", "日本", "z") for b in ("x", "Y", "zz", "ñ", "q")]
    rows = []
    for i in range(n):
        few = vocabulary[: rng.randint(3, len(vocabulary))]
        words = [rng.choice(few) for _ in range(rng.choice([0, 1, 5, 60]))]
        text = rng.choice([" ", "-", "1", "\n"]).join(words)
        rows.append((rng.choice([text, text, text, None]) if i % 9 else "", rng.choice(["en", "fr", None]), rng.choice([None, *"uvwxyä"[:sources]])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = random_rows(seed, 150)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sd.audit(docs.repartition(3), min_docs=8, top=7).collect()
    assert {tuple(r) for r in got} == brute(rows, 8, 7) and len(got) == len(set(map(tuple, got)))


def test_many_blocks_give_the_same(spark, monkeypatch):
    rows = random_rows(3, 120)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for name, value in {"BLOCK_ENTRIES": 7, "GROUP_BLOCK": 2, "TERMS": 2, "COLUMNS": 3, "HELD_TERMS": 5}.items():
        monkeypatch.setattr(sd, name, value)
    assert {tuple(r) for r in sd.audit(docs, min_docs=5).collect()} == brute(rows, 5, 50)


def test_defined_cases(spark):
    rows = [("Aa aa", "x", None), (None, "x", "s"), ("aa", "x", ""), ("bb", None, "only"), ("", "y", "a"), ("", "y", "b")]
    docs = spark.createDataFrame([(1, *r, "c") for r in rows], "doc_id int, text string, lang string, source string, term string")
    got = {tuple(r) for r in sd.audit(docs, min_docs=2).collect()}
    assert got == brute(rows, 2, 50)
    assert ("y", "a", "pair", "b", 0, 1) in got  # no kept terms
    assert sd.audit(docs.limit(0)).count() == 0


def test_counts_beyond_long_arithmetic(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(sd.price(F.lit(7 * 10**12), F.lit(9 * 10**15), F.lit(10**7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (7 * 10**12 + 5) // (9 * 10**15 + 5 * 10**7)
