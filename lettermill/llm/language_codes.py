"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit a binary naive Bayes classifier
over hashed byte trigrams tells the languages with +1 from those with -1: its weights are
log ratios of smoothed trigram shares, averaged over the languages of either side, so no
language counts more for having more text. A text's margins are decoded by logistic loss:
the language whose codeword loses least wins, its share of exp(-loss) is the score, and a
text whose two best codewords are nearly as good is flagged ambiguous.

Up to seven languages get the exhaustive code (all ways to split them in two); more get
random columns from a fixed seed, those with the largest smallest distance.

Every language with labelled texts is learnt. What is broadcast are (bits x TRIGRAMS) weights,
with 10 * log2 of the languages as bits, and the codewords; the driver takes in the counts of
one language after another. Codewords are compared in pairs, so that more than MAX_LANGUAGES
languages are an error; none is left out.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null
languages and null ids are not learnt from; with nothing learnt all texts are ``und``; with
one language all others are that one; rows that repeat are scored alike; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_table, fold, pieces, share, shared, small, text_or_empty, written
from .quality_neighbours import trigram_slots

TRIGRAM_BITS = 15
TRIGRAMS = 1 << TRIGRAM_BITS
MAX_LANGUAGES = 4096
SAMPLE_DOCS = 1000  # labelled texts per language
EVIDENCE = 12.0  # trigrams after which more text makes no surer
AMBIGUOUS = 0.8
HELD_TABLES = 256  # languages a task counts before it passes its counts on
DECODED = 1 << 22  # losses (texts x languages x bits) worked out at once
FOLDS, HELD_OUT = 4, 2

_LETTERS = byte_table(lambda b: b >= 0x80 or chr(b).isalpha())
#: Letters in lower case, everything else one blank.
PLAIN = np.where(_LETTERS, LOWER, 0x20).astype(np.uint8)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1/-1: distinct rows, no constant and no repeated column."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        # The first language has +1 everywhere: a column and its opposite are the same split.
        splits = np.arange(2 ** (n - 1) - 1)
        bits = [(splits >> (n - 2 - i)) & 1 for i in range(n - 1)]
        return np.vstack([np.ones(len(splits)), *[2.0 * b - 1 for b in bits]])
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        code = np.where(rng.random((n, width)) < 0.5, -1.0, 1.0)
        code[0] = np.where((code == code[0]).all(axis=0), -code[0], code[0])
        gap = (width - code @ code.T) / 2
        np.fill_diagonal(gap, width)
        if gap.min() > far:
            best, far = code, gap.min()
    return best


@dataclass
class Codebook:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (bits, TRIGRAMS)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and whether the runner-up is close, per row of margins."""
        if len(self.languages) == 1:
            n = len(margins)
            return np.zeros(n, dtype=int), np.ones(n), np.zeros(n, dtype=bool)
        loss = np.empty((len(margins), len(self.code)))
        rows = max(1, DECODED // self.code.size)
        for i in range(0, len(margins), rows):
            loss[i : i + rows] = np.logaddexp(0.0, -margins[i : i + rows, None, :] * self.code[None]).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = order[:, 0]
        score = share[np.arange(len(loss)), best]
        return best, score, score < AMBIGUOUS

    def margins(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, bits): mean log ratio of a text's trigrams times its evidence."""
        n, bits = len(starts) - 1, len(self.weights)
        out = np.zeros((n, bits))
        length = np.maximum(np.diff(starts) - 2, 0)
        if bits and len(raw) >= 3:
            slots = trigram_slots(PLAIN[raw], TRIGRAM_BITS)
            first = np.minimum(starts[:-1], len(slots))
            end = np.maximum(np.minimum(starts[1:] - 2, len(slots)), first)
            total = np.empty(len(slots) + 1)
            total[0] = 0.0
            for bit in range(bits):
                np.cumsum(self.weights[bit][slots], dtype=np.float64, out=total[1:])
                out[:, bit] = total[end] - total[first]
        surety = np.minimum(length, EVIDENCE) / np.maximum(length, 1)
        return out * surety[:, None]


def train(languages: list[str], tables: Iterable[np.ndarray]) -> Codebook:
    """Codebook from the TRIGRAMS counts of each language, in the order of ``languages``."""
    code = codewords(len(languages))
    plus, minus = np.zeros((2, code.shape[1], TRIGRAMS))
    for word, counts in zip(code, tables, strict=True):
        share = (counts + 0.1) / (counts + 0.1).sum()
        plus[word > 0] += share
        minus[word < 0] += share
    ahead = (code > 0).sum(axis=0)[:, None]
    weights = np.log(plus / ahead) - np.log(minus / (len(languages) - ahead))
    return Codebook(languages, code, weights.astype(np.float32))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    max_languages: int = MAX_LANGUAGES,
) -> Codebook:
    """Learn from rows with a language outside the held-out fold: at most ``sample_docs``
    texts for each language, by smallest hash. More than ``max_languages`` are an error."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    usable = rows.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if usable.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError("more languages than max_languages")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked, _ = written(
        usable.select("doc_id", "lang")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= sample_docs)
        .select("doc_id", "lang")
        .distinct(),
        "lang-sample",
    )

    def counted(seen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, table in seen.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(table[used])],
                ["lang", "slot", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, end, raw, starts in pieces(batch):
                for i in range(end - first):
                    text = PLAIN[raw[starts[i] : starts[i + 1]]]
                    if len(text) >= 3:
                        if len(seen) >= HELD_TABLES and langs[first + i] not in seen:
                            yield from counted(seen)
                            seen = {}
                        table = seen.setdefault(langs[first + i], np.zeros(TRIGRAMS, dtype=np.int64))
                        table += np.bincount(trigram_slots(text, TRIGRAM_BITS), minlength=TRIGRAMS)
        yield from counted(seen)

    sampled = usable.join(small(picked, picked.count()), ["doc_id", "lang"]).select("text", "lang")
    found, _ = written(
        sampled.mapInArrow(run, "lang string, slot int, n bigint")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts")),
        "lang-counts",
    )
    languages = sorted(r["lang"] for r in found.select("lang").collect())

    def tables() -> Iterator[np.ndarray]:
        for r in found.orderBy("lang").toLocalIterator():
            table = np.zeros(TRIGRAMS)
            table[r["slots"]] = r["counts"]
            yield table

    return train(languages, tables())


def identify(docs: DataFrame, book: Codebook, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    model = share(docs.sparkSession, book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared(model)
        names = np.array([*book.languages, "und"], dtype=object)
        for batch in batches:
            n = batch.num_rows
            lang, score, close = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n, dtype=bool)
            letters = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            for first, end, raw, starts in pieces(batch):
                if book.languages:
                    lang[first:end], score[first:end], close[first:end] = book.decode(book.margins(raw, starts))
            lang[~letters], score[~letters], close[~letters] = len(names) - 1, 0.0, False
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(close)],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    text = text_or_empty(text_col)
    rows = docs.select(text.alias("text"), F.col(id_col).alias("doc_id"), text.rlike(r"\p{L}").alias("letters"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
