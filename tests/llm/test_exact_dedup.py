import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from lettermill.llm import exact_dedup

SPACES = re.compile(r"[\x20\x09-\x0D]+")

ROWS = [
    (1, "a  b"), (2, "a b"), (3, "a\tb"), (4, "A b"), (5, None), (6, ""), (None, "a b"), (None, "only null"),
    (7, " "), (8, "long " * 40_000), (9, "long  " * 40_000), (10, " "), (11, " a b"), (2, "a b"), (12, "q"), (12, "r"),
]


def table(spark, rows):
    # Columns with the names that results and helpers use.
    return spark.createDataFrame([(d, t, "x", 1, True) for d, t in rows],
        "doc_id bigint, text string, digest string, keep_id int, kept boolean")


def brute(rows, bits=256):
    groups = defaultdict(list)
    for d, t in rows:
        groups[SPACES.sub(" ", t or "")].append(d)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()[: bits // 4]
        kept_yet = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            stays = i == keep and not kept_yet
            kept_yet = kept_yet or stays
            out.append((i, keep, len(ids), stays, digest))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_against_brute_force(spark, batches):
    assert result(exact_dedup.exact_dedup(table(spark, ROWS), batches=batches)) == brute(ROWS)


def test_colliding_digests_are_told_apart(spark):
    rows = ROWS + [(100 + i, f"text {i % 40}") for i in range(120)]
    got = exact_dedup.exact_dedup(table(spark, rows), digest_bits=4)
    assert result(got) == brute(rows, 4)


def test_keep_exact(spark):
    df = table(spark, ROWS)
    kept = exact_dedup.keep_exact(df)
    assert kept.columns == df.columns
    plain = [(r["doc_id"], SPACES.sub(" ", r["text"] or "")) for r in kept.collect()]
    got = sorted(((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in plain), key=repr)
    assert got == sorted({(b[1], b[4]) for b in brute(ROWS)}, key=repr)


def test_empty_table(spark):
    df = table(spark, [])
    assert exact_dedup.exact_dedup(df).count() == 0
    assert exact_dedup.keep_exact(df).columns == df.columns


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 30_000])
def test_filter_has_no_false_negative(n):
    keys = exact_dedup.mix64(np.arange(n, dtype=np.uint64))
    built = exact_dedup.build_filter(np.concatenate([keys, keys[:1]]))
    assert exact_dedup.maybe_in(keys, *built).all()
    others = exact_dedup.mix64(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))
    assert exact_dedup.maybe_in(others, *built).mean() < 0.02
    if n >= 10_000:
        assert len(built[3]) < 1.3 * n


def test_positives_only_join(spark):
    """The filters of a snapshot pass all its digests and few others."""
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(4000)]
    old = spark.createDataFrame([(d,) for d in digests[:3000]], "digest string")
    new = spark.createDataFrame([(d,) for d in digests[2500:]], "digest string")
    hits = {r["digest"] for r in exact_dedup.screen(new, exact_dedup.snapshot_filters(old, 4), 4).collect()}
    assert set(digests[2500:3000]) <= hits and len(hits) < 500 + 40
