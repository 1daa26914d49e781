import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import spelling_variants as sv

UPPER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


@pytest.mark.parametrize("pairs", [0, 1, 3, 1024])
def test_variants_against_brute_force(spark, pairs):
    base = ["abcdefg", "abcdefgh", "bbcdefg", "aabcdefg", "abcdefgg", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "ébcdefg", "abçdefg"]
    more = [f"abcdef{c}{d}" for c in "abcd" for d in "xyz"] + [f"{c}{d}mnopqr" for c in "mno" for d in "mnp"]
    words = {w: 1 + 7 ** (i % 5) for i, w in enumerate(dict.fromkeys(base + more))}
    got = sv.variants(spark.createDataFrame(list(words.items()), "word string, n long"), pairs=pairs)
    assert {tuple(r) for r in got.collect()} == brute_variants(words)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=7, max_size=10), min_size=1, max_size=25, unique=True), st.data())
def test_any_words(spark, words, data):
    counts = {w: data.draw(st.sampled_from([2, 5, 30, 400])) for w in words}
    got = sv.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), pairs=4)
    assert {tuple(r) for r in got.collect()} == brute_variants(counts)


def test_documents_and_defined_cases(spark):
    text = "Painting paintings PAINTING painitng Straße-Übungen ÜBUNGEN übungen naïveté naivete x1abcdefg "
    rows = [(i, text * (1 + i % 3), 0) for i in range(40)] + [(None, text, 1), (None, None, 2), (5, "", 3), (5, text, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = sv.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute_variants(brute_words([r[:2] for r in rows]))
    assert sv.spelling_variants(docs.limit(0)).count() == 0


def test_chains_and_long_words(spark):
    long = "q" * 5000
    words = {"letters": 3, "lettars": 40, "lettarz": 500, "lattarz": 6000, long: 2, long + "x": 90, "z" + long: 2}
    got = {r["word"]: r["root"] for r in sv.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["letters"] == got["lettars"] == "lattarz" and got[long] == long + "x" and got["z" + long] == "z" + long


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["word"]: r["n"] for r in sv.spelling_variants(docs).collect()}
    assert got == brute_words(rows)
