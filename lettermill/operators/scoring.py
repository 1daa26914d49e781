"""BLEU and ROUGE of generated replies against any number of goldens.

Inputs are long: ``samples(sample_id, prompt_id, response)`` and
``goldens(prompt_id, golden_no, golden)``. A reply meets slices of at most
2**GOLDEN_SLICE_BITS goldens of its prompt, and n-grams are counted where they meet: texts are
shuffled, n-grams never. All goldens of a prompt never meet in one row or task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import metric_tokens, normalise_for_metrics, rouge_tokens
from ..session import cut_lineage
from .ordering import rank_in_group, same_keys_join

ORDERS = (1, 2, 3, 4)
GOLDEN_SLICE_BITS = 4
SLICES_AT_ONCE_BITS = 8
ROUGE_KEYS = tuple(
    f"{kind}_{part}"
    for kind in ("rouge1", "rouge2", "rougeL", "rougeLsum")
    for part in ("precision", "recall", "fmeasure")
)


def golden_groups(
    df: DataFrame, prompt: str, seq: str, email: str, thread: str, slice_rows: int = 1000
) -> DataFrame:
    """Goldens per prompt in file order, the last thread, the first-seen position.

    A prompt with more than ``slice_rows`` goldens has several rows, numbered by
    ``slice_no``, each with the next goldens in order: nothing is dropped and no
    array grows without bound. Prompts without goldens keep an empty array.
    """
    facts = df.groupBy(prompt).agg(
        F.max_by(thread, seq).alias("thread"),
        F.min(seq).alias("first_seq"),
        F.count(email).alias("n_goldens"),
    )
    given = rank_in_group(df.where(F.col(email).isNotNull()), [prompt], seq, "golden_no")
    sliced = given.groupBy(
        prompt, F.floor(F.col("golden_no") / slice_rows).cast("int").alias("slice_no")
    ).agg(F.sort_array(F.collect_list(F.struct("golden_no", email))).alias("_goldens"))
    joined = facts.join(sliced, prompt, "left")
    return joined.select(
        prompt,
        F.coalesce("slice_no", F.lit(0)).alias("slice_no"),
        F.coalesce(
            F.transform("_goldens", lambda g: g[email]), F.array().cast("array<string>")
        ).alias("goldens"),
        "thread",
        "first_seq",
        "n_goldens",
    )


def golden_slices(gold: DataFrame) -> DataFrame:
    """(prompt_id, part, gs) of (prompt_id, golden_no, t): goldens whose numbers share all but the
    last GOLDEN_SLICE_BITS bits, as ``{golden_no, words, size}``; the words joined by spaces."""
    part = F.shiftright(F.col("golden_no").cast("bigint"), GOLDEN_SLICE_BITS)
    words = F.array_join("t", " ").alias("words")
    return cut_lineage(
        gold.groupBy("prompt_id", part.alias("part")).agg(
            F.collect_list(F.struct("golden_no", words, F.size("t").alias("size"))).alias("gs")
        )
    )


def _with_slices(
    cand: DataFrame,
    keys: list[str],
    slices: DataFrame,
    compare: Callable[[list, list, list, list, int], object],
    out: str,
    kind: str,
) -> DataFrame:
    """(keys..., part, out) for every slice of goldens that a candidate's prompt has.

    ``compare`` gets the candidate's texts, the golden numbers, words and sizes of the slice,
    and how many slices the prompt has.
    """
    texts = cand.groupBy(*keys).agg(F.collect_list(F.array_join("t", " ")).alias("ts"))
    parts = slices.groupBy("prompt_id").agg(F.collect_list(F.struct("part")).alias("parts"))
    placed = texts.join(parts, "prompt_id").select(
        *keys, "ts", F.size("parts").alias("n_parts"), F.explode("parts").alias("p")
    )
    met = same_keys_join(
        placed.select(*keys, "ts", "n_parts", "p.part"), slices, ["prompt_id", "part"]
    ).select(
        *keys,
        "part",
        "ts",
        "n_parts",
        F.col("gs.golden_no").alias("nos"),
        F.col("gs.words").alias("words"),
        F.col("gs.size").alias("sizes"),
    )
    schema = T.StructType([*[met.schema[k] for k in [*keys, "part"]], T.StructField(out, T._parse_datatype_string(kind))])
    arrow = to_arrow_type(schema[out].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ts", "nos", "words", "sizes", "n_parts")]
            found = pa.array([compare(*row) for row in zip(*columns)], arrow)
            kept = [batch.column(k) for k in [*keys, "part"]]
            yield pa.RecordBatch.from_arrays([*kept, found], names=[*keys, "part", out])

    return met.mapInArrow(run, schema)


def split_words(text: str) -> list[str]:
    """The words of a text that joins them by one space."""
    return text.split(" ") if text else []


def gram_counts(texts: list[str], orders: tuple[int, ...]) -> list[Counter]:
    """The n-grams of texts whose words are joined by one space, counted per order."""
    counts = [Counter() for _ in orders]
    for text in texts:
        words = split_words(text)
        for n, seen in zip(orders, counts):
            seen.update(words if n == 1 else zip(*[words[i:] for i in range(n)]))
    return counts


def _by_golden(nos: list, words: list, sizes: list | None = None) -> dict:
    """Texts per golden (number and size, if given); rows that share them count together."""
    together: dict = {}
    for i, (no, text) in enumerate(zip(nos, words)):
        if text is not None:
            together.setdefault(no if sizes is None else (no, sizes[i]), []).append(text)
    return together


def clipped(texts: list, nos: list, words: list, sizes: list, n_parts: int) -> list[list[int]]:
    """Per order, the candidate's n-gram counts clipped by the largest count in any golden.

    The only slice of a prompt gives their sums: nothing is left to be compared.
    """
    mine = gram_counts(texts, ORDERS)
    most = [dict.fromkeys(seen, 0) for seen in mine]
    for own in _by_golden(nos, words).values():
        for best, theirs in zip(most, gram_counts(own, ORDERS)):
            for gram in best.keys() & theirs.keys():
                best[gram] = max(best[gram], theirs[gram])
    hits = [[min(c, best[g]) for g, c in seen.items()] for seen, best in zip(mine, most)]
    return hits if n_parts > 1 else [[sum(h)] for h in hits]


def best_golden(texts: list, nos: list, words: list, sizes: list, n_parts: int) -> dict | None:
    """The golden of a slice with the highest unigram F, the first one on ties; None without overlap."""
    mine = gram_counts(texts, (1, 2))
    clen = texts[0].count(" ") + 1 if texts and texts[0] else 0
    best = None
    for (no, glen), own in _by_golden(nos, words, sizes).items():
        theirs = gram_counts(own, (1, 2))
        h1, h2 = (sum(min(a[g], b[g]) for g in a.keys() & b.keys()) for a, b in zip(mine, theirs))
        if h1:
            found = (-(2 * h1 / (clen + glen)), no is not None, no or 0, clen, glen, h1, h2, no)
            best = found if best is None else min(best, found)
    if best is None:
        return None
    return dict(zip(("worse", "golden_no", "clen", "glen", "h1", "h2"), (best[0], best[7], *best[3:7])))


def bleu(samples: DataFrame, goldens: DataFrame) -> DataFrame:
    """Mean of BLEU-1..4 per sample: (sample_id, bleu1..bleu4, bleu).

    Counts are clipped by the largest count in any golden; the brevity penalty
    uses the closest golden length, the first one on ties; an order without a
    match gives 0. Samples without goldens score NULL.
    """
    cand = samples.select(
        "sample_id", "prompt_id", metric_tokens(F.col("response")).alias("t")
    )
    gold = goldens.select(
        "prompt_id", "golden_no", metric_tokens(F.col("golden")).alias("t")
    )
    slices = golden_slices(gold)
    met = _with_slices(cand, ["sample_id", "prompt_id"], slices, clipped, "hits", "array<array<int>>")

    def most(rows: DataFrame, *keys: Column | str) -> DataFrame:
        # Slices of a prompt list the candidate's n-grams in one order.
        def larger(a: Column, b: Column) -> Column:
            return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda m, n: F.greatest(m, n)))

        all_hits = rows.groupBy(*keys).agg(F.collect_list("hits").alias("_all"))
        first, others = F.get("_all", F.lit(0)), F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0)))
        return all_hits.withColumn("hits", F.aggregate(others, first, larger)).drop("_all")

    some = F.shiftright("part", SLICES_AT_ONCE_BITS).alias("some")
    hits = most(most(met, "sample_id", "prompt_id", some), "sample_id", "prompt_id")
    matched = hits.groupBy("sample_id").agg(
        *[
            F.sum(F.aggregate(F.get("hits", F.lit(n - 1)), F.lit(0), lambda a, x: a + x)).alias(f"m{n}")
            for n in ORDERS
        ]
    )
    # Distinct lengths per prompt: few, however many goldens share a prompt.
    lengths = (
        slices.select("prompt_id", F.explode("gs").alias("g"))
        .groupBy("prompt_id", F.col("g.size").alias("glen"))
        .agg(F.min("g.golden_no").alias("first_no"))
    )
    sized = cand.select("sample_id", "prompt_id", F.size("t").alias("clen"))
    closest = (
        sized.join(lengths, "prompt_id", "left")
        .groupBy("sample_id", "clen")
        .agg(
            F.min_by(
                "glen", F.struct(F.abs(F.col("clen") - F.col("glen")), F.col("first_no"))
            ).alias("glen")
        )
    )
    def precision(n: int) -> Column:
        m = F.coalesce(F.col(f"m{n}"), F.lit(0))
        return F.when(m > 0, m / (F.col("clen") - (n - 1))).otherwise(F.lit(0.0))

    brevity = F.when(F.col("clen") > F.col("glen"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("glen") / F.nullif(F.col("clen"), F.lit(0)))
    )
    measured = closest.join(matched, "sample_id", "left").select(
        "sample_id",
        F.col("glen").isNotNull().alias("has"),
        brevity.alias("bp"),
        *[precision(n).alias(f"p{n}") for n in ORDERS],
    )

    def score(n: int) -> Column:
        used = [F.col(f"p{i}") for i in range(1, n + 1)]
        worst = F.least(*used) if n > 1 else used[0]
        product = reduce(lambda x, y: x * y, used)
        value = F.when(worst > 0, F.col("bp") * F.pow(product, F.lit(1.0 / n))).otherwise(0.0)
        return F.when(F.col("has"), value)

    scored = measured.select("sample_id", *[score(n).alias(f"bleu{n}") for n in ORDERS])
    mean = sum((F.col(f"bleu{n}") for n in ORDERS), F.lit(0.0)) / len(ORDERS)
    return scored.select("*", mean.alias("bleu"))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, 64+ positions per machine step."""
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = full
    for token in b:
        hit = rows & where.get(token, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of texts whose words are joined by one space: as arrays they would shuffle three times the bytes."""
    for left, right in pairs:
        yield pd.Series([lcs_length(split_words(a), split_words(b)) for a, b in zip(left, right)], dtype="int32")


def rouge(samples: DataFrame, goldens: DataFrame, longest: bool = True) -> DataFrame:
    """ROUGE-1, 2, L and Lsum (precision, recall, F) against the best golden.

    The best golden has the highest ROUGE-1 F, the first one on ties. Texts have
    no line breaks after normalisation, so Lsum equals L. ``longest=False``
    leaves both out. Samples without goldens score NULL.

    Samples and goldens meet per prompt and slice of goldens, so a prompt with very many
    goldens is many join keys; a sample's text is repeated per slice of its prompt.
    """
    cand = samples.select(
        "sample_id",
        "prompt_id",
        rouge_tokens(normalise_for_metrics(F.col("response"))).alias("t"),
    )
    gold = goldens.select(
        "prompt_id",
        "golden_no",
        rouge_tokens(normalise_for_metrics(F.col("golden"))).alias("t"),
    )
    number = dict(gold.dtypes)["golden_no"]
    # Of each slice of goldens one row is left before they meet: the smallest of -F and number.
    by_part = _with_slices(
        cand.withColumn("clen", F.size("t")),
        ["sample_id", "prompt_id", "clen"],
        golden_slices(gold),
        best_golden,
        "b",
        f"struct<worse: double, golden_no: {number}, clen: int, glen: int, h1: bigint, h2: bigint>",
    )
    best = by_part.where(F.col("b").isNotNull()).groupBy("sample_id", "prompt_id").agg(F.min("b").alias("b"))
    picked = best.select("sample_id", "prompt_id", "b.*").drop("worse")
    if longest:
        with_text = picked.join(
            gold.select("prompt_id", "golden_no", F.array_join("t", " ").alias("gt")),
            ["prompt_id", "golden_no"],
        ).join(cand.select("sample_id", F.array_join("t", " ").alias("ct")), "sample_id")
        picked = with_text.withColumn("hl", _lcs("ct", "gt")).drop("ct", "gt")
    # A prompt with goldens but no overlap scores 0; without goldens NULL.
    has_golden = goldens.select("prompt_id").distinct().withColumn("_has", F.lit(True))
    scored = (
        samples.select("sample_id", "prompt_id")
        .join(picked.drop("prompt_id"), "sample_id", "left")
        .join(has_golden, "prompt_id", "left")
    )
    columns = []
    kinds = [("rouge1", "h1", 0), ("rouge2", "h2", 1)]
    if longest:
        kinds += [("rougeL", "hl", 0), ("rougeLsum", "hl", 0)]
    for kind, hits, less in kinds:
        h = F.coalesce(F.col(hits), F.lit(0))
        p = h / F.nullif(F.col("clen") - less, F.lit(0))
        r = h / F.nullif(F.col("glen") - less, F.lit(0))
        f = 2 * p * r / F.nullif(p + r, F.lit(0.0))
        for part, value in (("precision", p), ("recall", r), ("fmeasure", f)):
            columns.append(
                F.when(F.col("_has"), F.coalesce(value, F.lit(0.0))).alias(f"{kind}_{part}")
            )
    return scored.select("sample_id", *columns)


def metric_means(scores: DataFrame, *metrics: str) -> DataFrame:
    """One row with the mean of every metric over all samples."""
    return scores.agg(*[F.avg(m).alias(m) for m in metrics])
