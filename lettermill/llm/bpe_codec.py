"""Byte-level BPE encoding and decoding of whole texts.

A text is cut at special strings, then into pre-tokens by the vocabulary's pattern. A
pre-token is encoded on a contiguous rank array: ``parts`` holds the ids between the
current boundaries and ``ranks`` the rank of every adjacent pair. The smallest rank is
searched by a scan, its boundary deleted, and the two neighbouring ranks refreshed.
Scans are quadratic, so words of more than LONG_WORD bytes use a heap with the same
order of merges (rank, then place). Equal pre-tokens of a task are encoded once.

Defined cases: null text is the empty text and has no ids; ids decode back to the text
(bytes that are not UTF-8 become U+FFFD, which whole texts never need); repeated rows
and null ids are rows like any other; other columns are not looked at; a table without
rows gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share, shared, tidied

LONG_WORD = 200
CACHE_WORDS = 400_000
NO_RANK = 1 << 62
ID_BITS = 24
LATIN_END = 0x250  # below it, character classes are spelled out for the fast matcher

# The pattern of the byte-level pre-tokeniser, and that of lower-casing files.
FILE_WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 stands for itself, every other byte for U+0100 onwards in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def latin_pattern(pattern: str) -> str:
    """``pattern`` for texts below LATIN_END, its classes as plain character sets.

    The standard matcher has no Unicode classes but is about twice as fast.
    """
    kinds = {"L": "", "N": "", "s": ""}
    for code in range(LATIN_END):
        ch = chr(code)
        kind = unicodedata.category(ch)[0]
        if kind in "LN":
            kinds[kind] += re.escape(ch)
        elif regex.match(r"\s", ch):
            kinds["s"] += re.escape(ch)
    out = pattern.replace(r"[\p{L}]", f"[{kinds['L']}]").replace(r"[\p{N}]", f"[{kinds['N']}]")
    out = out.replace(r"[^\s\p{L}\p{N}]", f"[^{kinds['s']}{kinds['L']}{kinds['N']}]")
    out = out.replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]")
    return out.replace(r"\S", f"[^{kinds['s']}]").replace(r"\s", f"[{kinds['s']}]")


class Splitter:
    """Cuts a text into special strings and pre-tokens."""

    def __init__(self, pattern: str, special: dict[str, int]):
        self.pattern, self.special = pattern, special
        self._start()

    def _start(self) -> None:
        self.any = regex.compile(self.pattern).findall
        self.latin = re.compile(latin_pattern(self.pattern)).findall
        self.beyond = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]").search
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None

    def __reduce__(self):
        return Splitter, (self.pattern, self.special)

    def segments(self, text: str) -> list[str]:
        """Plain text at even places, special strings at odd ones."""
        return self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]

    def words(self, segment: str) -> list[str]:
        return (self.any if self.beyond(segment) else self.latin)(segment)


@dataclass
class Vocabulary:
    """What encoding needs: pair key -> (rank, merged id) in one integer, first ids, bytes."""

    pairs: dict[int, int]
    first: list[int]  # id of a single byte
    last: list[int]  # id of a byte that ends a word
    symbols: dict[str, int]
    special: dict[str, int]
    suffix: str


def refuse_other_settings(content: dict) -> None:
    """Raise for a file whose settings are not the ones that are built in here."""
    model, special = content["model"], content.get("added_tokens") or []
    other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    other += [f"{t['content']}: {k}" for t in special for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    cut = content["pre_tokenizer"] or {}
    steps = cut.get("pretokenizers", [cut])
    patterns = [s["pattern"].get("Regex") for s in steps if s.get("type") == "Split"]
    last = steps[-1]
    if model.get("type", "BPE") != "BPE" or last.get("type") != "ByteLevel" or last.get("add_prefix_space"):
        other.append("pre-tokeniser")
    if patterns != ([] if last.get("use_regex", True) else [FILE_WORD_PATTERN]):
        other.append("pattern")
    norm = content.get("normalizer") or {}
    kinds = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
    if kinds != (["NFC", "Replace", "Lowercase"] if patterns else []):
        other.append("normaliser")
    if max([*model["vocab"].values(), *(t["id"] for t in special)], default=0) >> ID_BITS:
        other.append(f"ids of more than {ID_BITS} bits")
    if other:
        raise ValueError(f"vocabulary with settings that are not supported: {', '.join(other)}")


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    refuse_other_settings(content)
    model = content["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        key = vocab[left] << ID_BITS | vocab[right]
        pairs.setdefault(key, rank << ID_BITS | vocab[left + right])
    letters = byte_symbols()
    return Vocabulary(
        pairs,
        [vocab[c] for c in letters],
        [vocab[c + suffix] for c in letters],
        vocab,
        {t["content"]: t["id"] for t in content["added_tokens"]},
        suffix,
    )


def merge_word(parts: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids after all merges; ``parts`` is used up."""
    if len(parts) > LONG_WORD:
        return _merge_long(parts, pairs)
    get, low = pairs.get, (1 << ID_BITS) - 1
    ranks = [get(a << ID_BITS | b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while ranks:
        best = min(ranks)
        if best == NO_RANK:
            break
        i = ranks.index(best)
        parts[i] = best & low
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] << ID_BITS | parts[i], NO_RANK)
        if i < len(ranks):
            ranks[i] = get(parts[i] << ID_BITS | parts[i + 1], NO_RANK)
    return parts


def _merge_long(parts: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges in the same order with a heap and linked neighbours."""
    get, low, n = pairs.get, (1 << ID_BITS) - 1, len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        found = get(parts[i] << ID_BITS | parts[i + 1])
        if found is not None:
            heap.append((found, i))
    heapq.heapify(heap)
    while heap:
        found, i = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or get(parts[i] << ID_BITS | parts[j]) != found:
            continue  # a neighbour has changed since
        parts[i], alive[j] = found & low, False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            more = get(parts[i] << ID_BITS | parts[k])
            if more is not None:
                heapq.heappush(heap, (more, i))
        if (h := before[i]) >= 0:
            more = get(parts[h] << ID_BITS | parts[i])
            if more is not None:
                heapq.heappush(heap, (more, h))
    return [p for p, there in zip(parts, alive) if there]


class Encoded(dict):
    """Pre-token -> its ids as little-endian 32-bit integers; bounded, filled on demand."""

    def __init__(self, vocabulary: Vocabulary):
        self.pairs, self.first = vocabulary.pairs, vocabulary.first

    def __missing__(self, word: str) -> bytes:
        first = self.first
        ids = merge_word([first[b] for b in word.encode("utf-8")], self.pairs)
        out = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= LONG_WORD:
            self[word] = out
        return out


def token_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes each id stands for."""
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    table = [b""] * (1 + max([*vocabulary.symbols.values(), *vocabulary.special.values()]))
    for symbol, i in vocabulary.symbols.items():
        table[i] = bytes([byte_of[c] for c in symbol])
    for text, i in vocabulary.special.items():
        table[i] = text.encode("utf-8")
    return table


class Codec:
    def __init__(self, vocabulary: Vocabulary, pattern: str = BYTE_LEVEL_PATTERN):
        self.splitter = Splitter(pattern, vocabulary.special)
        self.known = Encoded(vocabulary)
        self.table = token_bytes(vocabulary)
        self.special = vocabulary.special

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for i, segment in enumerate(self.splitter.segments(text)):
            if i % 2:
                out.append(self.special[segment].to_bytes(4, "little"))
            else:
                out.extend(map(self.known.__getitem__, self.splitter.words(segment)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        whole = memoryview(ids).cast("I").tolist()
        return b"".join(map(self.table.__getitem__, whole)).decode("utf-8", "replace")


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): ids as little-endian 32-bit integers in a binary column."""
    vocabulary = share(docs.sparkSession, load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared(vocabulary))
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    vocabulary = share(encoded.sparkSession, load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared(vocabulary))
        for batch in batches:
            texts = [codec.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(tidied(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes within one task, so ids never travel.
    """
    vocabulary = share(docs.sparkSession, load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared(vocabulary))
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        tidied(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
