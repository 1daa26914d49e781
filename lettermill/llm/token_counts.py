"""Token counts with a whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary entries. Which entries really come out
of the merges as one token is proved once per vocabulary on the driver, by encoding every
entry; a pre-token in that set counts 1 without any merging. Only the rest are merged,
each distinct one once per task.

The rules are those of a lower-casing vocabulary whose words carry an end mark: NFC, white
space dropped, lower case character by character; special strings are found in the raw
text and count 1.

Defined cases: null text is the empty text with 0 tokens; repeated rows and null ids are
rows like any other; other columns are not looked at; a table without rows gives none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import (
    CACHE_WORDS,
    FILE_WORD_PATTERN,
    LONG_WORD,
    Splitter,
    Vocabulary,
    byte_symbols,
    load_vocabulary,
    merge_word,
)
from .common import share, shared

WORD_PATTERN = FILE_WORD_PATTERN


def first_parts(word: bytes, vocabulary: Vocabulary) -> list[int]:
    parts = [vocabulary.first[b] for b in word]
    parts[-1] = vocabulary.last[word[-1]]
    return parts


def whole_tokens(vocabulary: Vocabulary) -> set[str]:
    """Texts of the entries that, as pre-tokens, encode as exactly themselves."""
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    proved = set()
    for symbol, i in vocabulary.symbols.items():
        if not symbol.endswith(vocabulary.suffix) or len(symbol) == len(vocabulary.suffix):
            continue
        word = bytes([byte_of[c] for c in symbol[: len(symbol) - len(vocabulary.suffix)]])
        try:
            text = word.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if merge_word(first_parts(word, vocabulary), vocabulary.pairs) == [i]:
            proved.add(text)
    return proved


class Rest(dict):
    """Pre-token -> its number of tokens; starts with the proved ones, merges the others."""

    def __init__(self, vocabulary: Vocabulary, proved: set[str]):
        self.vocabulary, self.proved = vocabulary, proved
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.proved, 1))

    def __missing__(self, word: str) -> int:
        n = len(merge_word(first_parts(word.encode("utf-8"), self.vocabulary), self.vocabulary.pairs))
        if len(self) >= CACHE_WORDS:
            self._begin()
        if len(word) <= LONG_WORD:
            self[word] = n
        return n


def lowered(text: str) -> str:
    """NFC and lower case; white space is dropped by the pattern anyway."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # Character by character: no final form of sigma.
    return text.replace("Σ", "σ").lower()


class Counter:
    def __init__(self, vocabulary: Vocabulary, proved: set[str], pattern: str = WORD_PATTERN):
        self.splitter = Splitter(pattern, vocabulary.special)
        self.known = Rest(vocabulary, proved)

    def count(self, text: str) -> int:
        n = 0
        for i, segment in enumerate(self.splitter.segments(text)):
            n += 1 if i % 2 else sum(map(self.known.__getitem__, self.splitter.words(lowered(segment))))
        return n


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    vocabulary = load_vocabulary(vocabulary_path)
    model = share(docs.sparkSession, (vocabulary, whole_tokens(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared(model))
        for batch in batches:
            n = [counter.count(value.as_py() or "") for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
