"""Metrics against plain-Python statements of their definitions."""

import math
import random
from collections import Counter
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lettermill.operators import divergence, language, perplexity, scoring
from lettermill.operators import generation
from lettermill.operators.embedding import build_index, hashed_terms
from lettermill.plans.evaluation import evaluate
from lettermill.session import cut_lineage

WORDS = ["the", "a", "cat", "dog", "sat", "on", "mat", "The", "cat.", "é"]


def texts(rng, low=0, high=12):
    return " ".join(rng.choices(WORDS, k=rng.randint(low, high)))


def normal(text):
    import string

    return text.translate(str.maketrans("", "", string.punctuation)).lower().split()


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def plain_bleu(candidate, goldens):
    c, gs = normal(candidate), [normal(g) for g in goldens]
    closest = min(gs, key=lambda g: abs(len(c) - len(g)))
    scores = []
    for n in range(1, 5):
        product = 1.0
        for i in range(1, n + 1):
            most = Counter()
            for g in gs:
                most |= grams(g, i)
            mine = grams(c, i)
            hits, total = sum((mine & most).values()), sum(mine.values())
            product *= hits / total if total else 0.0
        brevity = 1.0 if len(c) > len(closest) else math.exp(1 - len(closest) / len(c)) if c else 0
        scores.append(brevity * product ** (1 / n) if product else 0.0)
    return sum(scores) / 4


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def plain_rouge(candidate, goldens):
    import re

    def tokens(t):
        return re.sub("[^a-z0-9]+", " ", " ".join(normal(t))).split()

    def prf(h, c, g):
        p, r = (h / c if c else 0.0), (h / g if g else 0.0)
        return p, r, (2 * p * r / (p + r) if p + r else 0.0)

    c = tokens(candidate)
    best, best_f1 = None, Fraction(0)
    for golden in goldens:
        g = tokens(golden)
        scores = {}
        for name, n in (("rouge1", 1), ("rouge2", 2)):
            hits = sum((grams(c, n) & grams(g, n)).values())
            scores[name] = prf(hits, max(len(c) - n + 1, 0), max(len(g) - n + 1, 0))
        scores["rougeL"] = scores["rougeLsum"] = prf(lcs(c, g), len(c), len(g))
        # F of whole counts, so that equal scores tie exactly and the first one stays.
        hits = sum((grams(c, 1) & grams(g, 1)).values())
        f1 = Fraction(2 * hits, len(c) + len(g)) if c or g else Fraction(0)
        if best is None or f1 > best_f1:
            best, best_f1 = scores, f1
    return best


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(11)
    prompts = {}
    for p in range(40):
        # One prompt owns a third of all goldens.
        prompts[p] = ([texts(rng) for _ in range(2)], [texts(rng) for _ in range(60 if p == 0 else 3)])
    samples = [(f"{p}#{i}", p, s) for p, (ss, _) in prompts.items() for i, s in enumerate(ss)]
    goldens = [(p, i, g) for p, (_, gs) in prompts.items() for i, g in enumerate(gs)]
    return (
        prompts,
        spark.createDataFrame(samples, "sample_id string, prompt_id int, response string"),
        spark.createDataFrame(goldens, "prompt_id int, golden_no int, golden string"),
    )


def test_bleu(graded):
    prompts, samples, goldens = graded
    got = {r.sample_id: r.bleu for r in scoring.bleu(samples, goldens).collect()}
    assert len(got) == 80
    for key, score in got.items():
        p, i = map(int, key.split("#"))
        assert score == pytest.approx(plain_bleu(prompts[p][0][i], prompts[p][1])), key


def test_rouge(graded):
    prompts, samples, goldens = graded
    rows = scoring.rouge(samples, goldens).collect()
    assert len(rows) == 80
    for r in rows:
        p, i = map(int, r.sample_id.split("#"))
        want = plain_rouge(prompts[p][0][i], prompts[p][1])
        for kind, parts in want.items():
            got = (r[f"{kind}_precision"], r[f"{kind}_recall"], r[f"{kind}_fmeasure"])
            assert got == pytest.approx(parts), (r.sample_id, kind)


def test_identity_and_missing_goldens(spark):
    samples = spark.createDataFrame(
        [("a", 1, "one two three four five"), ("b", 2, "x")],
        "sample_id string, prompt_id int, response string",
    )
    goldens = spark.createDataFrame(
        [(1, 0, "One, two three four five!")], "prompt_id int, golden_no int, golden string"
    )
    got = {r.sample_id: r for r in scoring.bleu(samples, goldens).collect()}
    assert got["a"].bleu == pytest.approx(1.0) and got["b"].bleu is None
    got = {r.sample_id: r for r in scoring.rouge(samples, goldens).collect()}
    assert got["a"].rougeL_fmeasure == pytest.approx(1.0) and got["b"].rouge1_fmeasure is None


def test_lcs_helper():
    rng = random.Random(2)
    for _ in range(300):
        a, b = rng.choices("abc", k=rng.randint(0, 90)), rng.choices("abcd", k=rng.randint(0, 90))
        assert scoring.lcs_length(a, b) == lcs(a, b)


def test_golden_groups_slice_large_prompts(spark):
    rows = [(i % 3 and "rare" or "hot", i, None if i == 4 else f"g{i}", [f"t{i}"]) for i in range(90)]
    rows.append(("bare", 1000, None, ["t"]))
    df = spark.createDataFrame(rows, "prompt string, seq bigint, email string, thread array<string>")
    got = scoring.golden_groups(df, "prompt", "seq", "email", "thread", slice_rows=7).collect()
    for prompt in ("rare", "hot"):
        mine = sorted((r for r in got if r.prompt == prompt), key=lambda r: r.slice_no)
        whole = [g for r in mine for g in r.goldens]
        assert whole == [e for p, _, e, _ in rows if p == prompt and e]
        assert all(len(r.goldens) <= 7 and r.n_goldens == len(whole) for r in mine)
        last = max(s for p, s, _, _ in rows if p == prompt)
        assert {r.thread[0] for r in mine} == {f"t{last}"}
    (bare,) = [r for r in got if r.prompt == "bare"]
    assert (bare.goldens, bare.n_goldens, bare.first_seq) == ([], 0, 1000)


def plain_mauve(p, q):
    cells = sorted(set(p) | set(q))
    a, b = [p.count(c) / len(p) for c in cells], [q.count(c) / len(q) for c in cells]

    def kl(x, y):
        return sum(i * math.log(i / j) for i, j in zip(x, y) if i)

    points = [(1.0, 0.0)]
    for i in range(25):
        w = 1e-6 + (1 - 2e-6) * i / 24
        r = [w * x + (1 - w) * y for x, y in zip(a, b)]
        points.append((math.exp(-5 * kl(b, r)), math.exp(-5 * kl(a, r))))
    points.append((0.0, 1.0))

    def area(pts):
        pts = sorted(pts)
        return sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:]))

    return (area(points) + area([(y, x) for x, y in points])) / 2


@pytest.mark.parametrize(
    "p, q", [([1, 2, 3], [1, 2, 3]), ([1, 1, 2], [2, 3, 3, 3]), ([1, 1], [2, 2]), ([5] * 9 + [6], [5, 6])]
)
def test_mauve(spark, p, q):
    rows = [(c, True) for c in p] + [(c, False) for c in q]
    df = spark.createDataFrame(rows, "cell int, first boolean")
    (row,) = divergence.mauve(df, "cell", F.col("first")).collect()
    assert row.mauve == pytest.approx(plain_mauve(p, q))
    assert (row.n_p, row.n_q) == (len(p), len(q))
    if sorted(p) == sorted(q):
        assert row.mauve == pytest.approx(1.0)


def test_perplexity(spark):
    train = ["a b a b c", "b c a", "lonely"]
    test = ["a b c", "a a z", "single"]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id bigint, t string")
    counts, firsts, vocabulary = Counter(), Counter(), set()
    for t in map(str.split, train):
        for x, y in zip(t, t[1:]):
            counts[x, y] += 1
            firsts[x] += 1
            vocabulary |= {x, y}
    got = {r.id: r for r in perplexity.row_perplexity(frame(train), frame(test), "id", "t").collect()}
    assert set(got) == {0, 1}
    total, n = 0.0, 0
    for i in got:
        t = test[i].split()
        logs = [
            math.log((counts[x, y] + 1) / (firsts[x] + len(vocabulary))) for x, y in zip(t, t[1:])
        ]
        assert got[i].perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)))
        total, n = total + sum(logs), n + len(logs)
    scored = perplexity.row_perplexity(frame(train), frame(test), "id", "t")
    (row,) = perplexity.corpus_perplexity(scored).collect()
    assert (row.n_rows, row.n_bigrams) == (2, n)
    assert row.perplexity == pytest.approx(math.exp(-total / n))


def test_language_detection(spark):
    rows = [
        ("en", "the quick brown fox jumps over the lazy dog and then the other one"),
        ("de", "der schnelle braune Fuchs springt über den faulen Hund und dann noch einmal"),
        ("fr", "le renard brun et rapide saute par dessus le chien paresseux et puis encore"),
    ]
    df = spark.createDataFrame(rows, "lang string, text string")
    profile = language.train_profile(df, "text", "lang")
    assert profile[0] == ["de", "en", "fr"]
    detect = language.language_detector(df, profile)
    asked = [("the dog and the fox", "en"), ("über den Hund", "de"), ("le chien et le renard", "fr"),
             ("12345 !?", None), ("", None), (None, None)]
    got = spark.createDataFrame(asked, "text string, want string").select(
        "want", detect(F.col("text")).alias("got")
    )
    assert all(r.want == r.got for r in got.collect())


def test_evaluation_end_to_end(spark):
    rows = [
        ("say hi", 0, "hi there my friend", ["t0"]),
        ("say hi", 1, "hello friend of mine", ["t1"]),
        ("say bye", 2, "Received: Instruction: say bye", []),
    ]
    df = spark.createDataFrame(rows, "summary string, seq bigint, email string, thread array<string>")
    result = evaluate(
        df, generation.echo, samples=2, cells=2, model=hashed_terms(16), system_preamble=""
    )
    responses = result.responses.collect()
    assert len(responses) == 4 and {r.prompt for r in responses} == {"say hi", "say bye"}
    assert all(r.full_prompt == f"Instruction: {r.prompt}" for r in responses)
    ids = {r.prompt: r.prompt_id for r in responses}
    scores = {r.sample_id: r for r in result.scores.collect()}
    assert scores[ids["say bye"] + "#0"].bleu == pytest.approx(1.0)
    assert scores[ids["say bye"] + "#1"].rougeL_fmeasure == pytest.approx(1.0)
    assert {r.prompt: r.first_seq for r in responses} == {"say hi": 0, "say bye": 2}
    (metrics,) = result.metrics.collect()
    assert metrics.bleu == pytest.approx(sum(r.bleu for r in scores.values()) / 4)
    assert 0 <= metrics.mauve <= 1


def test_evaluation_with_retrieval_and_threads(spark):
    rows = [("write about cats", 0, "cats", ["old"]), ("write about cats", 1, "more cats", ["new"])]
    df = spark.createDataFrame(rows, "summary string, seq bigint, email string, thread array<string>")
    emails = spark.createDataFrame(
        [("e1", "about cats we write", "s", [], "d", None), ("e2", "zebra", "s", [], "d", None)],
        "id string, email string, subject string, thread array<string>, date string, summary string",
    )
    model = hashed_terms(64)
    result = evaluate(
        df, generation.echo, use_thread=True, thread_emails=1, rag_emails=2, threshold=0.2, cells=2,
        chunks=build_index(emails, "id", "mail", model, 100, 0), model=model, system_preamble="",
        goldens_for_divergence="first",
    )
    (row,) = result.responses.collect()
    assert "E-MAIL CONTENT:\nabout cats we write\n\n---" in row.full_prompt
    assert "zebra" not in row.full_prompt and "new\n\n---" in row.full_prompt
    assert result.goldens.count() == 2 and result.metrics.count() == 1


@pytest.mark.parametrize("score", [scoring.bleu, scoring.rouge])
def test_ngrams_are_not_rows(graded, score):
    """Texts are shuffled to their goldens; a row per n-gram was ten times as much."""
    _, samples, goldens = graded
    plan = score(samples, goldens)._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan.replace("program", "")


def test_goldens_of_many_slices(spark):
    """Clipped by the largest count in any golden, however the goldens fall into slices."""
    samples = spark.createDataFrame([("s", 1, "a b a b a c d e")], "sample_id string, prompt_id int, response string")
    texts = ["a b x", "a b a b x", "c d e", "a y a", "b a b a"] * 1000
    goldens = spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(texts)], "prompt_id int, golden_no int, golden string"
    )
    got = scoring.bleu(samples, goldens).first()["bleu"]
    assert got == pytest.approx(plain_bleu("a b a b a c d e", texts))
    best = scoring.rouge(samples, goldens, longest=False).first()
    assert best["rouge1_fmeasure"] == pytest.approx(plain_rouge("a b a b a c d e", texts)["rouge1"][2])


def test_trigrams_of_few_texts_at_once(spark, monkeypatch):
    """A batch of long texts is looked at in parts: memory is bounded in characters, not in rows."""
    texts = [None, "", "das und die " * 30, "the and of " * 30, "der " * 400, "the", None] * 20
    runs = list(language.slices(texts, 1000))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(texts)))
    assert all(sum(len(t or "") for t in texts[a : b - 1]) < 1000 for a, b in runs)
    df = spark.createDataFrame([(i, t, "de" if "d" in (t or "") else "en") for i, t in enumerate(texts)], "i int, t string, l string")
    whole = sorted(map(tuple, language.trigram_counts(df, "t", "l").collect()))
    profile = language.train_profile(df, "t", "l")
    told = [tuple(r) for r in df.select("i", language.language_detector(df, profile)(F.col("t"))).orderBy("i").collect()]
    monkeypatch.setattr(language.slices, "__defaults__", (50,))
    assert sorted(map(tuple, language.trigram_counts(df, "t", "l").collect())) == whole
    again = df.select("i", language.language_detector(df, profile)(F.col("t"))).orderBy("i")
    assert [tuple(r) for r in again.collect()] == told


def test_bigrams_are_shuffled_once_per_pair(spark, monkeypatch):
    """No shuffle by (id, w1, w2), and tokens are found once per text: no filter asks for them."""
    train = spark.createDataFrame([(1, "a b a b"), (2, "one")], "id long, t string")
    test = spark.createDataFrame([(3, "a b c"), (3, "a b"), (4, ""), (5, None), (6, "x")], "id long, t string")
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(perplexity, "cut_lineage", keep)
    got = perplexity.row_perplexity(train, test, "id", "t").collect()
    # (a b) twice of two a's, (b c) never of one b; two words.
    logs = 2 * math.log(3 / 4) + math.log(1 / 3)
    assert [(r.id, r.n_bigrams) for r in got] == [(3, 3)]
    assert got[0].log_prob == pytest.approx(logs)
    assert "hashpartitioning(id" not in "".join(plans) and "Filter" not in plans[0]


def test_longest_subsequence_reads_joined_words():
    """Words travel as one string; as characters, "ab cd" and "ab ce" would share four."""
    pairs = iter([(pd.Series(["ab cd", "", None, "a"]), pd.Series(["ab ce", "a", "a", "a"]))])
    assert [list(s) for s in scoring._lcs.func(pairs)] == [[1, 0, 0, 1]]
