import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lettermill.llm import bpe_codec, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")

HARD = [
    "", " ", "\n\n  x", "It's THE'LL don't we've I'm he'd", "a" * 700, "ab" * 1500, "x  y\t\tz \r\n w ",
    "<|endoftext|>", "a<|endoftext|><|startoftext|> b <|endoftext|>", "<|endoftext", "ΟΔΥΣΣΕΥΣ Σ ΑΣ.",
    "İstanbul ǅ ﬁ ẞ", "été Å", "日本語テキスト、混在 text", "😀👍🏽 👨‍👩‍👧", " x\u0085y z　",
    "\x1c\x1d\x1e\x1f a\x1cb", "\x00\x01", "١٢٣ ²³ Ⅷ ½", "aʰ नमस्ते ไทย", "12345 3.14 $$$ ###*** a_b", "﻿x​y",
]


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(bpe_codec.load_vocabulary(BYTES))


@pytest.fixture(scope="module")
def counter():
    vocabulary = bpe_codec.load_vocabulary(WORDS)
    return token_counts.Counter(vocabulary, token_counts.whole_tokens(vocabulary))


byte_library, word_library = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def check_bytes(codec, text):
    ids = byte_library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert codec.decode(got) == byte_library.decode(ids, skip_special_tokens=False) == text


def check_words(counter, text):
    assert counter.count(text) == len(word_library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(codec, counter, text):
    check_bytes(codec, text)
    check_words(counter, text)


pieces = st.lists(
    st.one_of(
        st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=12),
        st.sampled_from([" ", "\n", "'s", "<|endoftext|>", "the ", "Straße ", "###", "  "]),
    ),
    max_size=8,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_any_text(codec, counter, text):
    check_bytes(codec, text)
    check_words(counter, text)


def test_long_words_merge_in_the_same_order(codec):
    rng = np.random.default_rng(3)
    pairs, first = codec.known.pairs, codec.known.first
    for n in (5, 60, 199):
        word = bytes(rng.choice(list(b"etaoinshr"), n).tolist())
        parts = [first[b] for b in word]
        assert bpe_codec.merge_word(list(parts), pairs) == bpe_codec._merge_long(list(parts), pairs)


def test_shortcut_is_proved(counter):
    proved = counter.known.proved
    assert len(proved) > 30_000
    for word in sorted(proved)[::997]:
        if word_library.encode(word, add_special_tokens=False).tokens == [word + "</w>"]:
            assert counter.known[word] == 1


def rows(spark, items):
    return spark.createDataFrame(items, "doc_id bigint, text string, n_tokens int, ids string")


CASES = [(1, None, 1, "x"), (2, "", 1, "x"), (None, "the cat", None, None), (4, "the cat", 2, "y"), (4, "the cat", 2, "y"),
         (5, "word " * 3000, 0, "z"), (6, "q" * 50_000, 0, "z")]


def test_tables(spark):
    docs = rows(spark, CASES)
    counted = token_counts.count_tokens(docs, WORDS).collect()
    assert len(counted) == len(CASES)
    by = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in counted}
    assert by[(1, 0)] == by[(2, 0)] == (0, False)
    assert by[(5, 15000)] == (3000, True)
    tripped = bpe_codec.round_trip(docs, BYTES).collect()
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in CASES}
    assert len(tripped) == len(CASES) and {r["decoded_sha256"] for r in tripped} == texts
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(docs, BYTES), BYTES).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t, _, _ in CASES)
    assert token_counts.count_tokens(rows(spark, []), WORDS).count() == 0
    assert bpe_codec.round_trip(rows(spark, []), BYTES).count() == 0


@pytest.mark.parametrize(
    "change",
    [
        lambda c: c["model"].update(byte_fallback=True),
        lambda c: c["model"].update(unk_token="?"),
        lambda c: c["model"]["vocab"].update({"far": 1 << bpe_codec.ID_BITS}),
        lambda c: c.update(normalizer={"type": "NFKC"}),
        lambda c: c["added_tokens"][0].update(lstrip=True),
        lambda c: c["pre_tokenizer"].update(type="Whitespace"),
    ],
)
def test_other_settings_are_refused(tmp_path, change):
    with open(BYTES, encoding="utf-8") as file:
        content = json.load(file)
    change(content)
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(content), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        bpe_codec.load_vocabulary(str(path))
