"""The whole pipeline over a small table, against plain statements of what each stage promises."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lettermill.llm import source_mix, toxicity
from lettermill.llm.common import documents, labels
from lettermill.session import new_work_path

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one_of_equal(rows):
    kept = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        kept.setdefault(SPACES.sub(" ", r["text"] or ""), r)
    return list(kept.values())


def near_classes(rows):
    """Classes of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for r in rows:
        w = WORD.findall(r["text"] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    owner = list(range(len(rows)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                owner[find(i)] = find(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(r["doc_id"])
    return list(classes.values())


def test_run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.collect()
    bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir))).where("predicted = 1").collect()}
    single = one_of_equal([r for r in rows if r["doc_id"] not in bad])
    classes = near_classes([r for r in single if WORD.search(r["text"] or "")])
    wordless = {r["doc_id"] for r in single if not WORD.search(r["text"] or "")}

    out = corpus_pipeline.run(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    taken = Counter(r["doc_id"] for r in out)
    # Of a class only one document can have been mixed in, of a rejected one none.
    assert all(sum(i in taken for i in c) <= 1 for c in classes)
    assert set(taken) <= {i for c in classes for i in c} | wordless
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in out:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()

    # Words per source near the targets of what the join has kept: min(class) or any other of it,
    # so sizes are taken from the stages themselves.
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "exact_dedup", "ngram_jaccard_join"):
        path = new_work_path(spark, name)
        stages[name](spark, kept, sf_dir).write.parquet(path)
        kept = spark.read.parquet(path)
    left = kept.collect()
    assert sorted(min(c) in {r["doc_id"] for r in left} or any(i in {r["doc_id"] for r in left} for i in c) for c in classes) == [True] * len(classes)
    size = defaultdict(int)
    most = defaultdict(int)
    for r in left:
        n = len(WORD.findall(r["text"] or ""))
        size[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = source_mix.targets([size[s] for s in order], [[1, 2, 3][i % 3] for i in range(len(order))], sum(size.values()))
    source = {r["doc_id"]: r["source"] for r in left}
    got = Counter()
    for i, n in taken.items():
        assert n <= 3
        got[source[i]] += n * len(WORD.findall(text[i]))
    for s, target in zip(order, want):
        assert abs(got[s] - target) <= most[s]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_and_odd_tables(spark, tmp_path, stage):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    fn = dict(corpus_pipeline.STAGES)[stage]
    sf_dir = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    assert fn(spark, spark.createDataFrame([], schema), sf_dir).count() == 0
    rows = [(1, None, None, None, 0), (None, "a b c d e f", "en", "s", 11), (2, "", "en", None, 0), (3, "w " * 40_000, "en", "s", 80_000), (3, "w " * 40_000, "en", "s", 80_000)]
    out = fn(spark, spark.createDataFrame(rows, schema), sf_dir)
    if stage != "bpe_codec":
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.count() >= 3 or stage == "source_mix"
