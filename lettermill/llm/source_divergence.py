"""Divergence audit of sources: how differently the sources of a language use its terms.

Terms are runs of letters (everything but ASCII that is not a letter), A-Z lower-cased. A
language keeps the V terms that stand in MIN_DOCS of its documents. Every (lang, source)
group, and every language, gives a kept term with ``count`` occurrences the price
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), N the group's occurrences of kept terms.

*Pairs.* The distance of two sources of a language is the sum of |p - q| over all kept terms.
Prices depend on (group, count) only, so each count of a group is a *level*, and what is
needed of two groups is the joint table of their levels: how many terms have level a here and
level b there. Indicator columns, one per (group, level), make a 0/1 matrix with a row per
term; its product with its transpose holds all joint tables of a block of groups at once.
Level 0 has no column. With p0, q0 the prices of level 0 and n the joint table

    sum |p - q|  =  V |p0 - q0|
                    + sum over levels a of the one: terms(a) * (|p_a - q0| - |p0 - q0|)
                    + the same of the other
                    + sum over a, b: n(a, b) * (|p_a - q_b| - |p_a - q0| - |p0 - q_b| + |p0 - q0|)

so terms that a group does not have are never rows. Products run in tasks keyed by a block
of terms (terms of like frequency together, hence few levels) and two blocks of groups.
Counts in a product are at most TERMS, exact in single precision; prices and sums are integers.

*Terms.* The kept terms a group uses more than its language does, by p - q, the first TOP.

Defined cases: null text, lang or source are empty strings; a group without terms, and a
language without kept terms (V = 0), still gives its pairs, the latter with value 0; a group
of a single source has no pairs; ties rank by item in UTF-8 order; repeated rows are documents of
their own; doc_id is not looked at, nor are other columns; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_or_empty, written

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTH = 5
HELD_TERMS = 300_000  # counts a task holds before it sends them on
BLOCK_ENTRIES = 100_000  # entries of a block of terms
GROUP_BLOCK = 64  # sources in a block of groups
TERMS, COLUMNS = 8192, 768  # rows and, where levels are many, columns of one product


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of whole texts, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = re.compile(TERM).findall
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                found = list(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        pa.array([source] * len(found), pa.string()),
                        pa.array([t.decode() for t in found], pa.string()),
                        pa.array(list(n.values()), pa.int64()),
                        pa.array([seen[t] for t in found], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            for text, lang, source in zip(*batch.columns):
                n, seen = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                # bytes.lower() changes A-Z only.
                found, before = terms(text.as_py().lower()), len(n)
                n.update(found)
                seen.update(set(found))
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from rows()
                    size = 0
        yield from rows()

    rows = docs.select(text_or_empty(text_col).cast("binary"), text_or_empty(lang_col), text_or_empty(source_col))
    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def price(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)) in whole numbers of any size needed."""
    count, total, kept = (F.col(c) if isinstance(c, str) else c for c in (count, total, kept))
    over = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    under = (total + SMOOTH * kept).cast("decimal(20,0)")
    rest = over - over % under
    return F.when(under > 0, F.lit(1) + (rest / under).cast("bigint"))


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x[:, None] - y[None, :])


def joint_price(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Sums of n(a, b) * price(a, b) by (group of ``left``, group of ``right``).

    Both are entries (row, group, level, p, p0) of some terms; rows are numbered from 0.
    """
    height = 1 + max(left["row"].max(), right["row"].max())

    def indicators(entries: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        code, column = np.unique(
            entries["group"].to_numpy() * (1 + entries["level"].max()) + entries["level"].to_numpy(), return_inverse=True
        )
        x = np.zeros((height, len(code)), dtype=np.float32)
        x[entries["row"].to_numpy(), column] = 1
        first = np.empty(len(code), dtype=np.int64)
        first[column[::-1]] = np.arange(len(column))[::-1]
        return x, entries.iloc[first]

    x, a = indicators(left)
    y, b = (x, a) if right is left else indicators(right)
    joint = (x.T @ y).astype(np.int64)
    p, p0, q, q0 = (c.to_numpy() for c in (a["p"], a["p0"], b["p"], b["p0"]))
    cost = joint * (_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0))
    rows = np.flatnonzero(np.append(True, np.diff(a["group"].to_numpy()) != 0))
    cols = np.flatnonzero(np.append(True, np.diff(b["group"].to_numpy()) != 0))
    return np.add.reduceat(np.add.reduceat(cost, rows, axis=0), cols, axis=1)


def _product(key: tuple, entries: pd.DataFrame) -> pd.DataFrame:
    """Level products of one block of terms for two blocks of groups."""
    lang, first, second = key[0], key[-2], key[-1]
    names, group = np.unique(entries["source"].to_numpy(), return_inverse=True)
    entries = entries.assign(group=group, level=entries["n"])
    entries = entries.sort_values(["total", "term", "group"], kind="stable").reset_index(drop=True)
    new = (entries["term"] != entries["term"].shift()).to_numpy()
    entries["row"] = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), len(entries))
    n_terms = len(starts) - 1
    sums = np.zeros((len(names), len(names)), dtype=np.int64)
    at = 0
    while at < n_terms:
        # Rare terms have few levels; frequent ones are taken a few at a time.
        levels = len(names) * int(entries["total"].iat[starts[at]])
        take = TERMS if levels <= COLUMNS else max(1, COLUMNS * (n_terms - at) // max(1, len(entries) - starts[at]))
        end = min(n_terms, at + take)
        part = entries.iloc[starts[at] : starts[end]]
        part = part.assign(row=part["row"] - at)
        left = part[part["block"] == first]
        right = left if second == first else part[part["block"] == second]
        if len(left) and len(right):
            sums[np.ix_(np.unique(left["group"]), np.unique(right["group"]))] += joint_price(left, right)
        at = end
    a, b = np.nonzero(sums)
    value = sums[a, b]
    if first != second:  # the other direction is in no other task
        a, b, value = np.append(a, b), np.append(b, a), np.append(value, value)
    keep = a != b
    return pd.DataFrame({"lang": lang, "source": names[a[keep]], "item": names[b[keep]], "value": value[keep]})


def _single(key: tuple, others: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
    """What the levels of one group give against level 0 of each other group, both ways."""
    lang, source = key
    if not len(others):
        return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})
    p0, q0 = others["p0"].to_numpy(dtype=np.int64), others["q0"].to_numpy(dtype=np.int64)
    levels = levels.sort_values("p", kind="stable")
    p, m = levels["p"].to_numpy(dtype=np.int64), levels["terms"].to_numpy(dtype=np.int64)
    upto, weighted = np.append(0, np.cumsum(m)), np.append(0, np.cumsum(m * p))
    k = np.searchsorted(p, q0)
    value = q0 * upto[k] - weighted[k] + (weighted[-1] - weighted[k]) - q0 * (upto[-1] - upto[k])
    value = value - upto[-1] * np.abs(p0 - q0)
    item = others["item"].to_numpy()
    half = others["kept"].to_numpy(dtype=np.int64) * np.abs(p0 - q0)  # of V |p0 - q0|, counted in one direction
    own = np.full(len(item), source, dtype=object)
    return pd.DataFrame(
        {
            "lang": lang,
            "source": np.append(own, item),
            "item": np.append(item, own),
            "value": np.append(value + half, value),
        }
    )


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    each = Window.partitionBy("lang", "term")
    # One exchange: all counts of a term of a language meet, a few rows per task and source.
    counted = (
        term_counts(docs, text_col, lang_col, source_col)
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    kept, _ = written(
        counted.withColumn("all_docs", F.sum("docs").over(each))
        .withColumn("total", F.sum("n").over(each))
        .where(F.col("all_docs") >= min_docs)
        .select("lang", "source", "term", "n", "total"),
        "divergence-kept",
    )
    named = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    whole = kept.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(
        F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("kept")
    )
    sizes = named.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"))
    groups = named.distinct().join(sums, ["lang", "source"], "left").join(whole, "lang", "left").join(sizes, "lang")
    groups, _ = written(
        groups.na.fill(0, ["group_n", "lang_n", "kept"])
        .withColumn("blocks", F.ceil(F.col("n_sources") / GROUP_BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        .withColumn("p0", F.coalesce(price(F.lit(0), "group_n", "kept"), F.lit(0).cast("bigint"))),
        "divergence-groups",
    )
    n_groups = groups.count()

    priced, _ = written(
        kept.join(small(groups, n_groups), ["lang", "source"]).select(
            "lang",
            "source",
            "term",
            "n",
            "total",
            "block",
            "blocks",
            "p0",
            price("n", "group_n", "kept").alias("p"),
            price("total", "lang_n", "kept").alias("q"),
            F.floor(F.log2(F.col("total").cast("double")) * 4).cast("int").alias("band"),
        ),
        "divergence-priced",
    )

    # Blocks of terms: a band of frequencies, cut by hash so that entries stay bounded.
    bands = priced.groupBy("lang", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ENTRIES).cast("int").alias("parts"))
    bands, _ = written(bands, "divergence-bands")
    dealt = (
        priced.join(small(bands, bands.count()), ["lang", "band"])
        .withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .select("lang", "source", "term", "n", "total", "p", "p0", "block", "band", "part", "first", "second")
    )
    line = "lang string, source string, item string, value bigint"
    products = dealt.groupBy("lang", "band", "part", "first", "second").applyInPandas(_product, line)

    levels = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "p0", "kept").join(other, "lang").where("source <> item")
    by = ["lang", "source"]
    singles = pairs.groupBy(*by).cogroup(levels.groupBy(*by)).applyInPandas(_single, line)

    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    order = ["lang", "source", "part", "item", "value", "rank"]
    ranked_pairs = (
        singles.unionByName(products)
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(falling))
        .withColumn("part", F.lit("pair"))
    )
    ranked_terms = (
        priced.where("p > q")
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(falling))
        .where(F.col("rank") <= top)
        .withColumn("part", F.lit("term"))
    )
    return ranked_pairs.select(*order).unionByName(ranked_terms.select(*order))
