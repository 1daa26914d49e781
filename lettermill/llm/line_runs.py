"""Deletion of repeated line runs by a distributed suffix order, in DataFrame functions only.

The corpus is read as sequences of line ids, documents in the order of their ids. Suffixes
are ranked by prefix doubling: rank 0 orders the lines that occur twice or more (a line that
occurs once ends every repeated run); a suffix with rank ``r`` at ``i`` and ``s`` at
``i + 2**k`` gets its next rank from the order of the pairs (r, s). Pairs are counted
before they are sorted, the sort is by ranges, and ranks are the increasing ids of sorted
rows, so no rank, no line and no group of equal runs is ever one task.

The suffixes of one rank at level k are the LCP interval of depth 2**k: all places of one run of
2**k lines, the smallest of which is the copy that stays. A round only has the suffixes whose
run still recurs.

Every later copy of a maximal repeated run of MIN_WORDS words or more is deleted, whatever its
length in lines. Two kinds of windows stand for all such runs: the shortest one with MIN_WORDS
words from each first line, and the shortest one up to each last line. In a later copy [p, q) a
line with MIN_WORDS words from p up to itself lies in the window that ends there, any other line
in the window that begins at p; both lie within the copy, and every window that stood earlier is
itself part of a run with enough words. A window of m lines is named by m and the ranks of its
first and its last 2**floor(log2 m) lines, so only levels up to the longest window are made.

Defined cases: null text is the empty text with one empty line; lines are what stands between
line feeds, compared whole; rows that repeat id and text are one document, each such row is
cleaned alike; rows with doc_id NULL come after all others, ordered by a hash of the text; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, text_or_empty, written

MIN_WORDS = 25
LAST = (1 << 63) - 1  # stands for a missing id in the order of documents


def _places() -> Column:
    return F.struct("d", "row", "i")


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("d"),
        F.md5(text).alias("row"),
        text.alias("text"),
    )


def line_rows(keyed: DataFrame) -> DataFrame:
    """(d, row, i, line, words): line is the 128-bit digest of a line."""
    exploded = keyed.select("d", "row", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return exploded.select(
        "d", "row", "i", F.unhex(F.md5("line")).alias("line"), F.regexp_count("line", F.lit(WORD)).alias("words")
    )


def ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` (distinct keys) with ``rank``: increasing in the order of the keys."""
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn("rank", F.monotonically_increasing_id()), "line-ranks")[0]


def intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with two or more places, their first place, ranked."""
    return ranked(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(_places()).alias("first")).where("n > 1").drop("n"),
        keys,
    )


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Level 0: (d, row, i, rank, words, later) of the lines that recur."""
    first = lines.join(intervals(lines, ["line"]), "line").select(
        "d", "row", "i", "rank", "words", (_places() > F.col("first")).alias("later")
    )
    # Rows that repeat a whole document bring every place twice.
    return written(first.dropDuplicates(["d", "row", "i"]), "line-level")[0]


def suffix_levels(level: DataFrame, longest: int | None = None) -> list[DataFrame]:
    """For k = 0, 1, ...: (d, row, i, rank, words, later) of the suffixes whose 2**k lines recur,
    from level 0 and while 2**k is at most ``longest``."""
    levels, step = [level], 1
    while longest is None or 2 * step <= longest:
        ahead = Window.partitionBy("d", "row").orderBy("i").rangeBetween(step, step)
        pairs = level.select(
            "d",
            "row",
            "i",
            F.col("rank").alias("r"),
            F.max("rank").over(ahead).alias("s"),
            F.col("words").alias("w"),
            F.max("words").over(ahead).alias("v"),
        ).where("s IS NOT NULL")
        pairs, _ = written(pairs, "line-pairs")
        if pairs.isEmpty():
            return levels
        found = pairs.join(intervals(pairs, ["r", "s"]), ["r", "s"])
        level, _ = written(
            found.select(
                "d", "row", "i", "rank", (F.col("w") + F.col("v")).alias("words"), (_places() > F.col("first")).alias("later")
            ),
            "line-level",
        )
        levels.append(level)
        step *= 2
    return levels


def shortest_windows(level: DataFrame, min_words: int) -> DataFrame:
    """(d, row, i, m): the shortest windows of ``min_words`` words from each line and up to each
    line, within stretches of neighbouring lines of level 0."""
    within = Window.partitionBy("d", "row").orderBy("i")
    stretch = ["d", "row", "stretch"]
    upto = Window.partitionBy(*stretch).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = (
        level.select("d", "row", "i", "words", (F.col("i") - F.row_number().over(within)).alias("stretch"))
        .withColumn("end", F.sum(F.col("words").cast("bigint")).over(upto))
        .withColumn("begin", F.col("end") - F.col("words"))
    )

    def asked(known: str, ask: Column, best: Callable[[str], Column], order: list[Column]) -> DataFrame:
        """Of each line i, ``far``: the best line with its ``known`` on the right side of ``ask``."""
        rows = lines.select(*stretch, F.explode(F.array(
            F.struct(F.col(known).alias("at"), F.lit(0).alias("kind"), F.col("i").alias("stop"), F.lit(None).cast("int").alias("i")),
            F.struct(ask.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("stop"), F.col("i").alias("i")),
        )).alias("x")).select(*stretch, "x.*")
        seen = Window.partitionBy(*stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("d", "row", "i", best("stop").over(seen).alias("far")).where("i IS NOT NULL AND far IS NOT NULL")

    ahead = asked("end", F.col("begin") + min_words, F.min, [F.desc("at"), F.asc("kind")])
    back = asked("begin", F.col("end") - min_words, F.max, [F.asc("at"), F.asc("kind")])
    # Without a least number of words the nearest line can be on the wrong side.
    both = ahead.select("d", "row", "i", F.greatest("i", "far").alias("last")).union(
        back.select("d", "row", F.least("i", "far").alias("i"), F.col("i").alias("last"))
    )
    return both.select("d", "row", "i", (F.col("last") - F.col("i") + 1).alias("m")).distinct()


def maximal_hits(level: DataFrame, min_words: int) -> DataFrame:
    """(d, row, i, lines): windows of ``min_words`` words or more that stood earlier."""
    windows, _ = written(shortest_windows(level, min_words).withColumn("k", F.length(F.bin("m")) - 1), "line-windows")
    longest = windows.agg(F.max("m")).first()[0] or 1
    names = reduce(
        DataFrame.union,
        [x.select("d", "row", "i", F.lit(k).alias("k"), "rank") for k, x in enumerate(suffix_levels(level, longest))],
    )
    place = ["d", "row", "k"]
    named = (
        windows.join(names.withColumnRenamed("rank", "r"), [*place, "i"])
        .withColumn("tail", F.expr("CAST(i + m - shiftleft(1, k) AS INT)"))
        .join(names.select(*place, F.col("i").alias("tail"), F.col("rank").alias("s")), [*place, "tail"])
        .select("d", "row", "i", "m", "r", "s")
    )
    named, _ = written(named, "line-window-names")
    runs = (
        named.groupBy("m", "r", "s")
        .agg(F.count(F.lit(1)).alias("n"), F.min(_places()).alias("first"))
        .where("n > 1")
        .drop("n")
    )
    return named.join(runs, ["m", "r", "s"]).where(_places() > F.col("first")).select("d", "row", "i", F.col("m").alias("lines"))


def deleted_lines(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, row, gone, gone_words): the line numbers each document loses."""
    level = repeated_lines(written(line_rows(keyed), "lines")[0])
    longest = maximal_hits(level, min_words).groupBy("d", "row", "i").agg(F.max("lines").alias("lines"))
    # Every line of a later copy has an earlier copy itself, so it is a row of level 0.
    before = Window.partitionBy("d", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    covered = (
        level.join(longest, ["d", "row", "i"], "left")
        .withColumn("until", F.max(F.col("i") + F.col("lines")).over(before))
        .where(F.col("until") > F.col("i"))
    )
    return written(
        covered.groupBy("d", "row").agg(
            F.array_sort(F.collect_list("i")).alias("gone"), F.sum("words").cast("bigint").alias("gone_words")
        ),
        "line-gone",
    )[0]


def without_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_deleted, deleted_words, clean_text."""
    keyed = keyed_documents(docs, id_col, text_col)
    gone = deleted_lines(keyed, min_words)
    n_bytes = gone.agg(F.sum(F.size("gone") * 4 + 80)).first()[0] or 0
    gone = F.broadcast(gone) if n_bytes <= BROADCAST_BYTES else gone
    lines = F.split("text", "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.transform(numbers, lambda i: F.get("lines", i))
    return (
        keyed.join(gone, ["d", "row"], "left")
        .withColumn("lines", lines)
        .select(
            "doc_id",
            F.size("lines").cast("bigint").alias("n_lines"),
            F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_deleted"),
            F.coalesce("gone_words", F.lit(0)).cast("bigint").alias("deleted_words"),
            F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        )
    )
