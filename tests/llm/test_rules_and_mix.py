import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lettermill.llm import bpe_codec, exact_dedup, ngram_join, quality_rules, source_mix, toxicity
from lettermill.llm.common import documents, labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
        len(w) < 20 or 100 * len(inside) > 30 * len(w),
    )


def test_rules_on_odd_texts(spark):
    loop = "one two three four five six seven eight nine ten "
    texts = [None, "", " \n ", "a b c", loop * 2, loop * 40, "tail " + loop + "gap " * 3 + loop, "x " * 5000, "é" * 30_000,
             "l1 a\nl1 a\n\n\nl2\r\nl2\r\n", "p\x0bq\x0cr", "the same " * 7, "a | b | c\n" + " ".join(f"w{i}" for i in range(40))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, loop), (3, "a b c")]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id bigint, text string, words int, lines string")
    got = quality_rules.apply_rules(df)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(((d, *base_rules(t)) for d, t in rows), key=repr)
    last = got.where("doc_id = 12").first()
    assert last["kept"] and last["n_bad_lines"] == 1 and "|" not in last["clean_text"]
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line, bad",
    [
        ("A sentence like any other, with a few words.", False),
        ("word### other*** more$$$ and%%% so&&& on", True),
        ("HELLO!! THIS!! IS!! LOUD!!", True),
        ("Home | About | Contact | Login", True),
        ("home about contact us", True),
        ("We use cookies to improve the site.", True),
        ("so so so so so word word word word word", True),
        ("A price of $5 & more is fine in a sentence of this length.", False),
    ],
)
def test_line_rules(spark, line, bad):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(quality_rules.line_fails(df["line"]).alias("b")).first()["b"] is bad


def test_native_plan(spark, sf_dir):
    plan = quality_rules.apply_rules(documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_targets():
    assert source_mix.targets([100, 100, 100], [1, 2, 3], 300) == pytest.approx([50, 100, 150])
    got = source_mix.targets([10, 1000, 0, 40], [1, 2, 3, 1], 1050)
    assert got[2] == 0 and sum(got) == pytest.approx(1050) and got[0] == 30 and got[3] == 120 and got[1] == 900


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(2)
    p, size = rng.random(500), rng.integers(0, 4000, 500).astype(float)
    x = np.column_stack([size, np.ones(500)])
    q = source_mix.flight(p, x, np.random.default_rng(1))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q @ x == pytest.approx(p @ x)
    landed = source_mix.landing(q, x)
    assert set(landed) <= {0.0, 1.0} and abs((landed - p).sum()) <= 2
    runs = np.mean([source_mix.flight(np.full(30, 0.3), x[:30], np.random.default_rng(s)) for s in range(800)], axis=0)
    assert np.abs(runs - 0.3).max() < 0.1  # inclusion probabilities hold


def mix_rows(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "z", 0.5) for d, t, s in rows],
        "doc_id bigint, text string, source string, size int, place string, p double")


def test_mix(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = source_mix.mix(docs).toPandas()
    assert sorted(got["doc_id"]) == sorted(r["doc_id"] for r in docs.collect())
    words = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert (got["size"] == got["doc_id"].map(words)).all()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    names = sorted(got["source"].unique())
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    per = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), top=("size", "max"))
    want = source_mix.targets(per["size"].tolist(), [weight[s] for s in per.index], per["size"].sum())
    assert per["target"].tolist() == pytest.approx(want)
    assert ((per["taken"] - per["target"]).abs() <= per["top"]).all()
    again = source_mix.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))


def test_mix_in_levels(spark):
    rows = [(i, "w " * (1 + i % 50), "hot" if i % 3 else "cold") for i in range(3000)]
    units = source_mix.mix(mix_rows(spark, rows)).toPandas()
    small_chunks = mix_rows(spark, rows).selectExpr("doc_id", "0L as row_key", "size(split(text, ' ')) - 1L as size", "int(doc_id % 3 = 0) as place", "0.4D as p")
    done = source_mix.balanced_sample(small_chunks, chunk=40).toPandas()
    assert len(done) == 3000 and set(done["p"]) <= {0.0, 1.0}
    for _, part in done.groupby("place"):
        assert abs(part["p"].sum() - 0.4 * len(part)) <= 2
        assert abs((part["p"] * part["size"]).sum() - 0.4 * part["size"].sum()) <= 100
    assert len(units) == 3000


def test_mix_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "one two", None), (3, "x y", "b"), (3, "x y", "b"), (4, "w " * 50_000, "c"), (5, "w", "")]
    df = mix_rows(spark, rows)
    got = source_mix.mix(df).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    mixed = source_mix.mixed_documents(df)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(
        {d: n for d, n in ((None if np.isnan(d) else int(d), int(c)) for d, c in zip(got["doc_id"].fillna(np.nan), got["copies"])) if n}
    ) or sum(got["copies"]) == mixed.count()
    assert source_mix.mix(df.limit(0)).count() == 0 and source_mix.mixed_documents(df.limit(0)).count() == 0


def test_mix_keeps_large_ids_beside_null_ones(spark):
    rows = [((1 << 60) + i if i % 7 else None, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(200)]
    df = mix_rows(spark, rows)
    got = source_mix.mix(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _, _ in rows)
    mixed = Counter(r["doc_id"] for r in source_mix.mixed_documents(df).collect())
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    assert sum(mixed.values()) > 100 and set(mixed) <= set(copies)
    named = df.withColumn("doc_id", F.concat(F.lit("id-"), F.coalesce("doc_id", F.lit(0)).cast("string")))
    assert source_mix.mix(named).where("doc_id LIKE 'id-%'").count() == 200


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_targets_of_many_sources(spark, monkeypatch, broadcast_rows):
    """Order, stops and levels of the source table against the plain statement."""
    from lettermill.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(6)
    names = [None, "", "Z", "a", "é", "z", "日", "\U0001F600", "\uffff"] + [f"s{i}" for i in range(60)]
    size = {s: int(rng.choice([0, 1, 3, 50, 4000])) for s in names}
    rows = [(i, "w " * (size[s] // 2 + (size[s] % 2) * k), s) for i, s in enumerate(names) for k in (0, 1)]
    got = source_mix.mix(mix_rows(spark, rows)).toPandas()
    order = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(len(t.split()) for _, t, x in rows if x == s) for s in order]
    want = dict(zip(order, source_mix.targets(totals, [[1, 2, 3][i % 3] for i in range(len(order))], sum(totals))))
    found = {None if r["source"] is None or r["source"] != r["source"] else r["source"]: r for _, r in got.iterrows()}
    assert found.keys() == want.keys()
    assert all(found[s]["target"] == pytest.approx(want[s]) and found[s]["source_size"] == t for s, t in zip(order, totals))


def test_pipeline(spark):
    """Each stage against what it promises on the rows the one before kept."""
    sf_dir = "/root/testdata/sf0.001"
    docs = documents(spark, sf_dir)
    columns = docs.columns
    index = toxicity.fit(docs, labels(spark, sf_dir))
    (_, mild), (_, single), (_, apart), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    a = mild(spark, docs, sf_dir)
    bad = {r["doc_id"] for r in toxicity.score(docs, index).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    b = single(spark, a, sf_dir)
    first = {}
    for r in sorted(a.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(first.values())
    c = apart(spark, b, sf_dir)
    classes = {r["class_id"] for r in ngram_join.ngram_join(b).collect()}
    assert {r["doc_id"] for r in c.collect()} == classes
    d = mixed(spark, c, sf_dir)
    copies = {r["doc_id"]: r["copies"] for r in source_mix.mix(c, row_key=None).collect()}
    assert set(r["doc_id"] for r in d.collect()) <= set(copies)
    assert [x.columns for x in (a, b, c, d)] == [columns] * 4
    e = encoded(spark, d, sf_dir)
    assert e.count() == d.count()
    taken = sum(len(WORD.findall(r["text"])) for r in d.collect())
    total = sum(len(WORD.findall(r["text"])) for r in c.collect())
    assert abs(taken - total) < 0.2 * total
    assert defaultdict(int, {r["doc_id"]: 1 for r in e.collect()}).keys() == {r["doc_id"] for r in d.collect()}
    assert exact_dedup and bpe_codec
