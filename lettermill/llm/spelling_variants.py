"""Grouping of spelling variants: words one edit apart, by asymmetric chunks and grams.

Words are letter runs of whole texts, A-Z lower-cased, of MIN_LENGTH code points or more (the
contract deletes one code point of some occurrences first), counted over all documents; words
that occur once are left out. Two words are near if one inserted, deleted or replaced code
point makes them equal.

The shorter word ``s`` of a near pair is cut into two disjoint chunks, s[:q] and s[q:]. One edit
leaves one of them whole. The longer word ``t`` (or the other one of equal length) gives the
positional grams that such a chunk can have become: a chunk at the front keeps its place, a
chunk at the end moves by the difference of the lengths, so by one at most. Chunks and grams with
equal (length, place, letters) are joined and every hit is verified by edit distance.

A gram of three letters can be common. Where the chunks times the grams of one key exceed
PAIRS, the rows of that key are cut again: the edit lies in what the chunk left open, which is
halved, so that each row has one more whole chunk. Half after half the open window shrinks to
one code point, where a key has as many rows as there are letters. So no key is ever large,
and no pair is lost: every cut keeps the edit in one of its halves.

A word's form is its near word with the most occurrences (ties: first in code point order) if
it has FACTOR times the word's or more; forms are followed to the last one, the root. Each step
multiplies the count by FACTOR, so chains are short.

Defined cases: null text has no words; a null doc_id counts as an empty one; rows that repeat
are documents of their own; other columns are not looked at; a table without words gives no
rows; very long runs are words like any other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
FACTOR = 10
THINNING = 31
PAIRS = 1024  # chunks times grams of one key that are compared without another cut
HELD_WORDS = 300_000


def thinned(run: str, prefix_crc: int) -> str:
    """``run`` without one code point if its hash says so."""
    h = zlib.crc32(run.encode("utf-8"), prefix_crc)
    if h % THINNING:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of whole texts: partial counts, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{MIN_LENGTH},}}").findall
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                # CRCs continue: the id is hashed once per document. bytes.lower() changes A-Z only.
                prefix = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for word, n in Counter(runs((text.as_py() or b"").lower().decode())).items():
                    word = thinned(word, prefix)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows()
        yield rows()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string").cast("binary"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _part(text: str, begin: Column, length: Column | None = None) -> Column:
    """Code points of ``text`` from ``begin`` (from 0) on."""
    rest = F.length(text) if length is None else length
    return F.substring(F.col(text), begin + 1, rest)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, shift, low, high) with ``size`` of the shorter word and ``key``.

    ``low`` to ``high`` is the open window in the shorter word; in the longer one it is
    ``shift`` wider. What stands before and after it must be equal.
    """
    size = F.length("word") - F.col("shift")
    before = _part("word", F.lit(0), F.col("low"))
    after = _part("word", F.col("high") + F.col("shift"))
    return rows.withColumn("key", F.xxhash64(size, "low", "high", before, after))


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice, with either half of its open window."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")),
        F.struct(middle.alias("low"), F.col("high").alias("high")),
    )
    cut = rows.withColumn("half", F.explode(halves)).drop("low", "high", "key")
    return keyed(cut.select("*", "half.low", "half.high").drop("half"))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(word, near, near_n), both directions of every near pair, of distinct (word, n)."""
    longest = F.length("word")
    roles = F.array(
        # chunk side, grams of words of equal length, grams of words one longer
        *[
            F.struct(F.lit(chunk).alias("chunk"), F.lit(shift).alias("shift"), (longest - shift).alias("high"))
            for chunk, shift in ((True, 0), (False, 0), (False, 1))
        ]
    )
    whole = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*", F.lit(0).alias("low"))
    rows, _ = written(halved(whole), "variant-chunks")
    found = []
    while True:
        sizes = rows.groupBy("key").agg(
            F.count_if("chunk").alias("chunks"),
            F.count_if(~F.col("chunk")).alias("grams"),
            F.max(F.col("high") - F.col("low")).alias("open"),
        )
        # Keys of one side only can go; the others are compared now or cut again.
        sizes, _ = written(
            sizes.where("chunks > 0 AND grams > 0").select(
                "key", ((F.col("chunks") * F.col("grams") > pairs) & (F.col("open") > 1)).alias("large")
            ),
            "variant-keys",
        )
        sized = rows.join(sizes, "key")
        now = sized.where(~F.col("large"))
        s = now.where("chunk").select("key", F.col("word").alias("s"), F.col("n").alias("s_n"))
        t = now.where(~F.col("chunk")).select("key", "shift", F.col("word").alias("t"), F.col("n").alias("t_n"))
        hits = s.join(t, "key").where((F.col("s") != F.col("t")) & (F.levenshtein("s", "t", 1) == 1))
        found.append(written(hits.select("s", "s_n", "t", "t_n", "shift"), "variant-hits")[0])
        if sizes.where("large").isEmpty():
            break
        rows, _ = written(halved(sized.where("large").drop("large")), "variant-chunks")
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    # Equal lengths are found from either side; a pair that is found by two chunks is one pair.
    there = hits.select(F.col("s").alias("word"), F.col("t").alias("near"), F.col("t_n").alias("near_n"))
    back = hits.where("shift = 1").select(F.col("t").alias("word"), F.col("s").alias("near"), F.col("s_n").alias("near_n"))
    return there.union(back).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by following forms until none changes."""
    at, _ = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        # Doubling: what is reached after one more step of what has been reached so far.
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved, _ = written(at.join(step, "root", "left"), "variant-roots")
        if moved.where("next IS NOT NULL").isEmpty():
            return at
        at = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, factor: int = FACTOR, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct (word, n)."""
    near = near_pairs(words, pairs)
    # The smallest (-n, word) is the largest n and, among equals, the first word.
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    large = -F.col("best.minus") >= factor * F.col("n")
    table, _ = written(
        words.join(best, "word", "left").select(
            "word",
            F.when(large, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(large, -F.col("best.minus")).alias("form_n"),
        ),
        "variant-forms",
    )
    last = roots(table.where("form IS NOT NULL"))
    return table.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per word of all documents: word, form, root, n, n_near, form_n."""
    words, _ = written(word_counts(docs, id_col, text_col).where(F.col("n") >= MIN_COUNT), "variant-words")
    return variants(words, **options)
