import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from test_tokens import HARD

from lettermill.llm import id_store
from lettermill.session import new_work_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
library = Tokenizer.from_file(WORDS)


def as_bytes(ids):
    return np.asarray(ids, dtype="<u4").tobytes()


def library_ids(text):
    return [*library.encode(text or "", add_special_tokens=False).ids, id_store.END_ID]


def crc(ids):
    return zlib.crc32(as_bytes(ids))


@pytest.fixture(scope="module")
def words():
    with open(WORDS, encoding="utf-8") as file:
        return id_store.Words(file.read())


@pytest.mark.parametrize("text", HARD)
def test_tokens_are_the_librarys(words, text):
    assert words.encode(text) == as_bytes(library_ids(text)[:-1])


def test_many_texts_at_once_are_the_librarys(words):
    rng = np.random.default_rng(4)
    bits = ["'s", "'", "''", "'ll", "'RE", "a", "B", "1", "\u0663", "-", " ", "\n", "\u3000", "e\u0301", "\u03a3", "\u0130", "the "]
    for i in range(40):
        pool = [b for b in bits if i % 2 or max(map(ord, b)) < 256]
        texts = [*("".join(rng.choice(pool, rng.integers(0, 12))) for _ in range(5)), *HARD[i % 3 :: 3]]
        want = [library_ids(t) for t in texts]
        ids, sizes = words.encode_all(texts)
        assert ids.tolist() == [i for d in want for i in d] and sizes.tolist() == list(map(len, want))
        if i % 7 == 0:
            words._forget()


class Counted:
    def __init__(self, library):
        self.library, self.calls = library, 0

    def encode_batch_fast(self, texts, **options):
        self.calls += 1
        return self.library.encode_batch_fast(texts, **options)


def test_new_words_reach_the_library_together_and_once(words):
    texts = [" ".join(f"zq{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(k, k + 9)) for k in range(500)]
    with open(WORDS, encoding="utf-8") as file:
        vocabulary = {"content": file.read()}
    for task, calls in enumerate((1, 0)):  # a further task of the same worker has what the first one made
        held = id_store.held_words(vocabulary, id_store.END_ID)
        held.bare = Counted(held.bare)
        held.encode_all(texts)
        assert held.bare.calls == calls
    held._forget()  # what has come of late stays
    held.encode_all(texts[:3])
    assert held.bare.calls == 0 and held.encode(texts[9]) == as_bytes(library_ids(texts[9])[:-1])


def test_runs_of_texts():
    texts = ["a" * id_store.TEXT_AT_ONCE, "b", "", "c" * (id_store.TEXT_AT_ONCE + 9), "", "d"]
    for kind in (pa.string(), pa.large_string()):
        assert list(id_store.runs(pa.array(texts, kind))) == [(0, 1), (1, 3), (3, 4), (4, 6)]
    assert list(id_store.runs(pa.array([], pa.string()))) == []


def documents_of(rng, kind):
    if kind == "few":
        return [as_bytes(rng.integers(0, 5, rng.integers(0, 40))) for _ in range(30)]
    if kind == "many":
        return [as_bytes(rng.integers(0, 49408, 3000)) for _ in range(4)]
    if kind == "repeats":
        return [as_bytes(np.tile(rng.integers(0, 900, 17), 300)), as_bytes([7] * 5000)]
    return [as_bytes(np.minimum(rng.zipf(1.3, 4000), 268_435_455))]


@pytest.mark.parametrize("kind", ["few", "many", "repeats", "skewed"])
def test_round_trip(kind):
    docs = documents_of(np.random.default_rng(5), kind)
    assert [d.tobytes() for d in id_store.unpack(id_store.pack(docs))] == docs


@pytest.mark.parametrize("kind, sum_", [("few", 2651130412), ("many", 4153821405), ("repeats", 2662030101), ("skewed", 3044373212)])
def test_payloads_are_those_of_version_1(kind, sum_):
    payload = id_store.pack(documents_of(np.random.default_rng(5), kind))
    n_words = struct.unpack_from(id_store.HEAD, payload)[-1]
    assert zlib.crc32(payload[-2 * n_words :]) == sum_


@pytest.mark.parametrize("n, size", [(8191, 2), (8193, 4)])
def test_tables_take_two_bytes_an_entry_where_these_hold_all_ids(n, size):
    ids = np.random.default_rng(6).permutation(np.arange(1, n + 1, dtype=np.uint32))
    assert id_store.Mix(3, np.append(0, np.sort(ids))).entries.itemsize == size
    assert np.array_equal(np.concatenate(id_store.unpack(id_store.pack([ids.tobytes()]))), ids)


def test_predictable_ids_become_small():
    docs = documents_of(np.random.default_rng(1), "repeats")
    n = sum(map(len, docs)) // 4
    assert 8 * len(id_store.pack(docs)) < 5 * n  # hundreds of different ids, tables included


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70), max_size=60), max_size=5))
def test_any_documents(docs):
    docs = [as_bytes(d) for d in docs]
    assert [d.tobytes() for d in id_store.unpack(id_store.pack(docs))] == docs


def test_blocks_do_not_depend_on_each_other(monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 300, 5 * 128).astype(np.int64)
    tables = id_store.order_zero(ids)
    whole = id_store.encode_blocks(ids, 128, *tables)
    for i, words in enumerate(whole):
        alone = id_store.encode_blocks(ids[i * 128 : (i + 1) * 128], 128, *tables)
        assert alone[0].tolist() == words.tolist()


def test_changes_are_found():
    docs = documents_of(np.random.default_rng(3), "many")
    payload = bytearray(id_store.pack(docs))
    for at in (0, 5, 60, len(payload) // 2, len(payload) - 40):
        changed = bytearray(payload)
        changed[at] ^= 0x55
        with pytest.raises(id_store.Damaged):
            id_store.unpack(bytes(changed))
    with pytest.raises(id_store.Damaged):
        id_store.unpack(bytes(payload[:-2]))
    with pytest.raises(id_store.Damaged):
        id_store.unpack(b"")


def expected_rows(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) in ascending order; equal ids as a set."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    start, out = 0, []
    for doc_id, text in ordered:
        ids = library_ids(text)
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out, start


def test_query_rows_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = id_store.store_and_read(docs, WORDS, segment_ids=5000)
    want, _ = expected_rows(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_defined_cases(spark):
    rows = [(3, "b b", 1), (None, "x", 2), (1, None, 3), (3, "b b", 4), (3, "longer text here", 5), (2, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_crc32 int").withColumnRenamed("ids_crc32", "part")
    path = new_work_path(spark, "ids")
    got = sorted(map(tuple, id_store.store_and_read(docs, WORDS, path, segment_ids=3).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 3]
    assert [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got])[:-1]).tolist()
    assert sorted(r[2:] for r in got) == sorted((len(library_ids(t)), crc(library_ids(t))) for _, t, _ in rows)
    ids = id_store.read_ids(spark, path)
    assert {(r["doc_id"], bytes(r["ids"])) for r in ids.collect()} == {(i, as_bytes(library_ids(t))) for i, t, _ in rows}
    empty = id_store.store_and_read(docs.limit(0), WORDS)
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and empty.count() == 0


def test_one_very_long_text_and_one_hot_id(spark):
    long = "lorem ipsum dolor " * 60_000
    docs = spark.createDataFrame([(7, long), *[(7, f"w{i % 3}") for i in range(300)], (8, "z")], "doc_id int, text string")
    got = id_store.store_and_read(docs, WORDS, segment_ids=1000).collect()
    want, total = expected_rows([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((a, c, d) for a, _, c, d in want)
    spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert spans[0][0] == 0 and spans[-1][1] == total and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
