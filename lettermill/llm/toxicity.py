"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words of letters and digits and the four- and five-byte beginnings
of longer words (inflected insults share them). All terms of the examples are indexed. A
weight is (1 + ln tf) * idf * relevance; relevance runs from FLOOR to 1 with the chi-square
(Yates-corrected) of the term's presence against the label, so a word that tells the labels
apart counts more than the topic of a text, and no term counts nothing. Vectors have unit
length over all their terms; terms of a query that no example has count in its length.

The examples are held in a block-max inverted index. Terms of COMMON examples or more keep,
per block of BLOCK examples, their postings and their largest weight; rarer terms are few
postings and are added up first, and terms of more than one in FREQUENT examples stand as
rows of a matrix that many texts are multiplied with at once. The sum of a query's weights
times the maxima, plus the best that rare and frequent terms give in a block, bounds every
cosine there; blocks are visited by falling bound and the search ends when no unvisited
block can beat the k-th best, so the k nearest are exact. Among equal cosines the example
that comes first in the index wins.

A vote weighs each neighbour's label by its closeness; a logistic curve fitted on
leave-one-out votes of the examples turns votes into calibrated scores. The examples are a
sample of equally many of either label where there are enough, so the curve weighs them by
the labels' true shares. Texts without any indexed term get the share of toxic labels.
``evidence`` lists the neighbours.

What is learnt from is bounded: MAX_EXAMPLES labelled texts, by smallest hash of the id. Their
terms are counted in the tasks that read them, one row per example; the index is built in
one task and travels as one value.

Defined cases: null and empty texts have no terms; unlabelled or null labels and null ids
are not learnt from; without any usable label every score is 0; rows that repeat are
scored alike, of examples that repeat an id one text is learnt; other columns are carried
through or ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, fold, mix64, pieces, share, shared, text_or_empty, tidied, words_in, written

MAX_EXAMPLES = 3_000
HALF_CHI = 20.0  # chi-square at which a term has half of the full relevance
FLOOR = 0.005  # relevance of a term that says nothing about the label
BLOCK = 64
COMMON = 16
FREQUENT = 16
TEXTS_AT_ONCE = 64
NEIGHBOURS = 15
PREFIXES = (4, 5)
FOLDS, HELD_OUT = 5, 0


def terms_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of several texts and the text each belongs to."""
    raw = LOWER[raw]
    hashes, heads, length, first = words_in(raw, starts, ALNUM)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    found, owners = [hashes], [owner]
    for n in PREFIXES:
        longer = np.flatnonzero(length > n)
        packed = np.full(len(longer), n, dtype=np.uint64)
        for i in range(n):
            packed = (packed << np.uint64(8)) | raw[heads[longer] + i].astype(np.uint64)
        found.append(mix64(packed))
        owners.append(owner[longer])
    return np.concatenate(found), np.concatenate(owners)


def counted_terms(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) of several texts, in this order, with their counts."""
    hashes, owner = terms_of(raw, starts)
    order = np.argsort(hashes)
    # A stable sort of 16-bit numbers is a radix sort.
    order = order[np.argsort(owner[order].astype(np.uint16 if len(starts) < 1 << 16 else np.int64), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at].view(np.int64), np.diff(np.append(at, len(hashes)))


def term_rows(docs: DataFrame) -> DataFrame:
    """(example, label, terms, tf) of (example, label, text): a row per text, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, starts in pieces(batch):
                owner, terms, tf = counted_terms(raw, starts)
                edges = np.searchsorted(owner, np.arange(end - first + 1))
                spans = list(zip(edges, edges[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(first, end - first),
                        batch.column(2).slice(first, end - first),
                        pa.array([terms[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([tf[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                    ],
                    ["example", "label", "terms", "tf"],
                )

    rows = docs.select("text", "example", "label")
    kind = rows.schema["example"].dataType.simpleString()
    return rows.mapInArrow(run, f"example {kind}, label int, terms binary, tf binary")


@dataclass
class Index:
    """Block-max inverted index of unit vectors, and what turns votes into scores."""

    terms: np.ndarray  # sorted term hashes
    idf: np.ndarray  # with relevance
    unseen: float  # idf of a term that no example has
    starts: np.ndarray  # (terms + 1): postings of a term
    examples: np.ndarray  # of the postings, ascending within a term
    weights: np.ndarray
    common: np.ndarray  # by term: its row in the block tables, or -1
    block_max: np.ndarray  # (common terms, blocks)
    places: np.ndarray  # (common terms, blocks + 1): where a block's postings begin
    frequent: np.ndarray  # by term: its row in the matrix, or -1
    ids: np.ndarray  # by example
    labels: np.ndarray
    slope: float = 0.0
    offset: float = -np.inf
    empty_score: float = 0.0

    @cached_property
    def matrix(self) -> np.ndarray:
        """(frequent terms, examples): weights, 0 where an example does not have a term."""
        often = np.flatnonzero(self.frequent >= 0)
        out = np.zeros((len(often), self.block_max.shape[1] * BLOCK))
        for row, k in enumerate(often):
            span = slice(self.starts[k], self.starts[k + 1])
            out[row, self.examples[span]] = self.weights[span]
        return out

    def by_frequent(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """(n texts, examples): what frequent terms give to the cosines."""
        row = self.frequent[terms]
        some = row >= 0
        texts = np.zeros((n, len(self.matrix)))
        texts[owner[some], row[some]] = weights[some]
        return texts @ self.matrix

    def nearest(
        self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, base: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples (fewer if fewer share a term) and their cosines.

        ``base`` is the text's row of ``by_frequent``, if that is known.
        """
        n_blocks = self.block_max.shape[1]
        if base is None:
            base = self.by_frequent(np.zeros(len(terms), np.int64), terms, weights, 1)[0]
        row = self.common[terms]
        rare = (row < 0) & (self.frequent[terms] < 0)
        begin, end = self.starts[terms[rare]], self.starts[terms[rare] + 1]
        found = _ranges(begin, end)
        value = self.weights[found] * np.repeat(weights[rare], end - begin)
        base = base + np.bincount(self.examples[found], value, len(base))
        row, weights = row[row >= 0], weights[row >= 0]
        bound = weights @ self.block_max[row] + base.reshape(n_blocks, BLOCK).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, score = np.empty(0, np.int64), np.empty(0)
        # The most promising blocks first, then ever more of those that can still matter.
        first, count = 0, 8
        while first < len(order):
            blocks = order[first : first + count]
            if len(score) >= k:
                blocks = blocks[bound[blocks] >= score[-1] - 1e-6]
                if not len(blocks):
                    break
            hit, value = self._scored(row, weights, blocks, base)
            at, score = np.concatenate([at, hit[hit != skip]]), np.concatenate([score, value[hit != skip]])
            best = np.lexsort((at, -np.round(score, 6)))[:k]
            at, score = at[best], score[best]
            first, count = first + count, count * 8
        return at, score

    def _scored(self, row: np.ndarray, weights: np.ndarray, blocks: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of the examples in ``blocks`` that share a term with the query."""
        table = self.places[row]
        begin, end = table[:, blocks].ravel(), table[:, blocks + 1].ravel()
        found = _ranges(begin, end)
        value = self.weights[found] * np.repeat(np.repeat(weights, len(blocks)), end - begin)
        total = np.bincount(self.examples[found], weights=value, minlength=len(base))
        some = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        total = total[some] + base[some]
        return some[total > 0], total[total > 0]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Mean label of the neighbours, each weighted by 1 / (1.05 - cosine)."""
        w = 1.0 / (1.05 - np.minimum(cosine, 1.0))
        return float((w * self.labels[at]).sum() / w.sum()) if len(at) else 0.0

    def calibrated(self, vote: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * vote + self.offset, -30, 30))))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one range after the other."""
    length = end - begin
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def relevance(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """FLOOR to 1 by the chi-square of a term's presence in ``pos`` and ``neg`` examples."""
    n, df = n_pos + n_neg, pos + neg
    gap = np.maximum(np.abs(pos * n_neg - neg * n_pos) - n / 2, 0.0)
    chi = n * gap * gap / (df * np.maximum(n - df, 1) * max(n_pos, 1) * max(n_neg, 1))
    return FLOOR + (1 - FLOOR) * chi / (chi + HALF_CHI)


def build_index(ids: np.ndarray, labels: np.ndarray, example: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Index:
    """Index of examples 0..n-1; the other arrays are the postings (term hashes)."""
    terms, t = np.unique(term, return_inverse=True)
    n, n_blocks = len(ids), max(1, -(-len(ids) // BLOCK))
    df = np.bincount(t, minlength=len(terms))
    pos = np.bincount(t, weights=labels[example], minlength=len(terms))
    n_pos = int(labels.sum())
    idf = (np.log((1 + n) / (1 + df)) + 1.0) * relevance(pos, df - pos, n_pos, n - n_pos)
    w = (1 + np.log(tf)) * idf[t]
    norm = np.sqrt(np.bincount(example, weights=w * w, minlength=n))
    w = w / norm[example] if len(w) else w
    order = np.lexsort((example, t))
    t, example, w = t[order], example[order], w[order]
    starts = np.append(0, np.cumsum(df))
    long = df * FREQUENT > n
    often = np.flatnonzero((df >= COMMON) & ~long)
    frequent = np.full(len(terms), -1, dtype=np.int32)
    frequent[long] = np.arange(long.sum())
    common = np.full(len(terms), -1, dtype=np.int64)
    common[often] = np.arange(len(often))
    block_max = np.zeros((len(often), n_blocks))
    places = np.empty((len(often), n_blocks + 1), dtype=np.int32)
    for i, k in enumerate(often):
        a, b = starts[k], starts[k + 1]
        np.maximum.at(block_max[i], example[a:b] // BLOCK, w[a:b])
        places[i] = a + np.searchsorted(example[a:b], np.arange(n_blocks + 1) * BLOCK)
    unseen = (np.log(1 + n) + 1.0) * FLOOR
    example = example.astype(np.uint16 if n < 1 << 16 else np.int32)
    return Index(terms, idf, unseen, starts, example, w, common, block_max, places, frequent, ids, labels.astype(float))


def fit_logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps with a weak ridge; ``share`` weighs the rows."""
    a = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (share * (y - p)) - 1e-2 * beta
        hess = (a * (share * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def query_vector(index: Index, known: np.ndarray, tf: np.ndarray, unseen: float = 0.0) -> np.ndarray:
    """Weights of the known terms; ``unseen`` is what other terms add to the squared length."""
    w = (1 + np.log(tf)) * index.idf[known]
    return w / np.sqrt((w * w).sum() + unseen)


def _postings(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """ids, labels, example, term, tf of ``term_rows``, examples numbered by id."""
    rows = rows.sort_values("example", kind="stable").reset_index(drop=True)
    terms = [np.frombuffer(t, dtype=np.int64) for t in rows["terms"]]
    tf = [np.frombuffer(t, dtype=np.int32) for t in rows["tf"]]
    example = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
    return rows["example"].to_numpy(), rows["label"].to_numpy(), example, np.concatenate(terms), np.concatenate(tf).astype(float)


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The index as rows (name, data), one per array."""
    found = vars(build_index(*_postings(rows)))
    return pd.DataFrame({"name": list(found), "data": [pickle.dumps(v) for v in found.values()]})


def leave_one_out(index: Index, rows: DataFrame, k: int) -> pd.DataFrame:
    """(label, vote) of every example that shares a term with others, its vote without itself."""
    model = share(rows.sparkSession, index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared(model)
        for batch in batches:
            votes = []
            for example, terms, tf in zip(batch["example"], batch["terms"], batch["tf"]):
                known = np.searchsorted(index.terms, np.frombuffer(terms, dtype=np.int64))
                weights = query_vector(index, known, np.frombuffer(tf, dtype=np.int32))
                at, cosine = index.nearest(known, weights, k, skip=int(np.searchsorted(index.ids, example)))
                votes.append(index.vote(at, cosine) if len(at) else np.nan)
            yield pd.DataFrame({"label": batch["label"], "vote": votes})

    some = rows.where(F.octet_length("terms") > 0)
    return some.mapInPandas(run, "label int, vote double").where(~F.isnan("vote")).toPandas()


def fit(
    docs: DataFrame,
    marks: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_examples: int = MAX_EXAMPLES,
    k: int = NEIGHBOURS,
) -> Index | None:
    """Learn from the labelled rows outside the held-out fold.

    At most ``max_examples`` of them, half of each label where there are as many, by
    smallest hash of the id: a bounded sample.
    """
    usable = (
        marks.where((fold(id_col, FOLDS) != HELD_OUT) & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("example"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("example"), text_or_empty(text_col).alias("text"))
    usable, _ = written(usable.join(texts.select("example"), "example", "left_semi"), "tox-labels")
    totals = dict(usable.groupBy("label").count().collect())
    if not totals.get(1):
        return None
    take = {1: min(totals[1], max(max_examples // 2, max_examples - totals.get(0, 0)))}
    take[0] = min(totals.get(0, 0), max_examples - take[1])
    by_hash = [F.xxhash64("example"), F.col("example")]
    sides = [usable.where(F.col("label") == mark).orderBy(*by_hash).limit(n) for mark, n in take.items()]
    picked, _ = written(sides[0].union(sides[1]), "tox-examples")
    rows = term_rows(texts.join(F.broadcast(picked), "example"))
    one = F.max(F.struct("terms", "tf", "label")).alias("x")
    rows, _ = written(rows.groupBy("example").agg(one).select("example", "x.label", "x.terms", "x.tf"), "tox-terms")
    # At most ``max_examples`` rows: one task.
    built, _ = written(rows.groupBy().applyInPandas(_built, "name string, data binary"), "tox-index")
    index = Index(**{r["name"]: pickle.loads(r["data"]) for r in built.toLocalIterator()})
    votes = leave_one_out(index, rows, k)
    index.empty_score = float(totals[1] / sum(totals.values()))
    if len(votes):
        mark = votes["label"].to_numpy()
        true_share = np.array([totals.get(c, 0) / max(take[c], 1) for c in (0, 1)])
        index.slope, index.offset = fit_logistic(votes["vote"].to_numpy(), mark, true_share[mark])
    return index


class Scorer:
    def __init__(self, index: Index, k: int = NEIGHBOURS):
        self.index, self.k = index, k
        self.seen: dict[bytes, tuple[float, list[int]]] = {}

    def scores(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Scores of several texts and their nearest examples' ids."""
        index, n = self.index, len(starts) - 1
        out, evidence = np.full(n, index.empty_score), [[] for _ in range(n)]
        if not len(index.terms):
            return out, evidence
        owner, hashes, tf = counted_terms(raw, starts)
        known = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
        match = index.terms[known] == hashes
        strange = ((1 + np.log(tf[~match])) * index.unseen) ** 2
        unseen = np.bincount(owner[~match], weights=strange, minlength=n)
        owner, known, tf = owner[match], known[match], tf[match]
        order = np.lexsort((known, owner))
        owner, known, tf = owner[order], known[order], tf[order]
        rows, at = np.unique(owner, return_index=True)
        spans = list(zip(rows, at, np.append(at[1:], len(owner))))
        # Copies of a text are common.
        keys = [hashlib.md5(known[a:b].tobytes() + tf[a:b].tobytes() + unseen[r].tobytes()).digest() for r, a, b in spans]
        new = {key: span for key, span in zip(keys, spans) if key not in self.seen}
        if len(self.seen) > 100_000:
            self.seen.clear()
            new = dict(zip(keys, spans))
        asked = list(new.items())
        for first in range(0, len(asked), TEXTS_AT_ONCE):
            some = asked[first : first + TEXTS_AT_ONCE]
            weights = [query_vector(index, known[a:b], tf[a:b], unseen[r]) for _, (r, a, b) in some]
            place = np.repeat(np.arange(len(some)), [len(w) for w in weights])
            terms = np.concatenate([known[a:b] for _, (_, a, b) in some])
            base = index.by_frequent(place, terms, np.concatenate(weights), len(some))
            for i, (key, (_, a, b)) in enumerate(some):
                near, cosine = index.nearest(known[a:b], weights[i], self.k, base=base[i])
                self.seen[key] = index.calibrated(index.vote(near, cosine)), index.ids[near].tolist()
        for key, (row, _, _) in zip(keys, spans):
            out[row], evidence[row] = self.seen[key]
        return out, evidence


def score(docs: DataFrame, index: Index | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence."""
    model = share(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared(model)
        scorer = Scorer(index) if index is not None else None
        for batch in batches:
            values, near = [np.empty(0)], []
            for first, end, raw, starts in pieces(batch):
                if scorer is None:
                    values.append(np.zeros(end - first))
                    near.extend([[] for _ in range(end - first)])
                else:
                    got, evidence = scorer.scores(raw, starts)
                    values.append(got)
                    near.extend(evidence)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.concatenate(values)), pa.array(near, pa.list_(batch.column(1).type))],
                ["doc_id", "score", "evidence"],
            )

    rows = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(tidied(run), f"doc_id {kind}, score double, evidence array<{kind}>")
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def keep_mild(docs: DataFrame, index: Index | None, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored at ``limit`` or more; all columns as they came.

    Rows pass through the scoring task whole, so nothing is joined back.
    """
    if index is None:
        return docs
    model = share(docs.sparkSession, index)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared(model))
        for batch in batches:
            for first, end, raw, starts in pieces(batch, place):
                yield batch.slice(first, end - first).filter(pa.array(scorer.scores(raw, starts)[0] < limit))

    return docs.mapInArrow(tidied(run), docs.schema)
