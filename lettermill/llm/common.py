"""Shared pieces: text forms, folds, written tables, byte-level NumPy helpers.

Conventions of every operator in this subpackage:

* a null text counts as the empty text; texts are always processed whole;
* only the columns an operator needs are read, internal columns get names that
  the input does not use, so further input columns may be called anything;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import copy
import ctypes
import gc
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, new_work_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20  # text handled at once inside a task
BROADCAST_BYTES = 64 << 20  # counted bytes a table may have to be broadcast
BROADCAST_ROWS = 1_000_000  # narrow rows a counted table may have to be broadcast

__all__ = [
    "SPACE", "WORD", "cut_lineage", "new_work_path", "documents", "labels", "fresh", "fold", "text_or_empty",
    "small", "pieces", "mix64", "words_in", "share", "shared", "tidied", "release",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id is in no fold (NULL)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string")), F.lit(n))


def text_or_empty(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string"), F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted number of narrow rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def pieces(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch by its text column into runs of rows of about PIECE_BYTES.

    Yields (first row, end row, bytes of these rows, row starts within them); the
    starts have one entry more than there are rows. A longer text is its own run.
    """
    texts = batch.column(column)
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(ends, ends[first] + PIECE_BYTES, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[ends[first] : ends[end]], ends[first : end + 1] - ends[first]
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_in(
    raw: np.ndarray, starts: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of several texts: hashes, first bytes, lengths, first word per text.

    ``raw`` are the bytes of all texts, ``starts`` the text borders, ``is_word`` a
    table of 256 booleans. A word is a maximal run of word bytes within one text. Its
    hash scrambles every eight bytes with their place before it adds them up, so it is
    linear in nothing and words of eight bytes or fewer never collide before that.
    """
    inside = is_word[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    borders = starts[1:-1]
    borders = borders[borders < len(raw)]
    begin[borders] = inside[borders]
    heads = np.flatnonzero(begin)
    if not len(heads):
        return np.empty(0, np.uint64), heads, heads, np.zeros(len(starts), np.int64)
    kept = np.flatnonzero(inside)
    first_kept = np.searchsorted(kept, heads)
    length = np.diff(np.append(first_kept, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first_kept, length)
    # Eight bytes to an integer, one scramble each, one sum per word.
    eights = np.flatnonzero((place & 7) == 0)
    packed = np.add.reduceat(raw[kept].astype(np.uint64) << ((place & 7) << 3).astype(np.uint64), eights)
    packed ^= mix64(((place[eights] >> 3) + 1).astype(np.uint64))
    sums = np.add.reduceat(mix64(packed), np.searchsorted(eights, first_kept))
    return mix64(sums ^ (length.astype(np.uint64) << np.uint64(40))), heads, length, np.searchsorted(heads, starts)


def byte_table(allowed) -> np.ndarray:
    return np.array([allowed(b) for b in range(256)], dtype=bool)


#: Bytes of words between ASCII white space, and of letters and digits only.
NOT_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class Packed:
    """Pickled values that unpickle as what they hold, so a worker that reads them keeps no second copy."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return pickle.loads, (self.data,)


def share(spark: SparkSession, value) -> Broadcast:
    """``value`` broadcast by value, classes of this package included: executors need no copy of it."""
    return spark.sparkContext.broadcast(Packed(cloudpickle.dumps(value)))


def shared(broadcast: Broadcast):
    """What ``share`` was given, for reading; call it once per task.

    The worker's tasks share its parts; what a task caches on it ends with the task.
    """
    return copy.copy(broadcast.value)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow whose worker returns, as a task ends, the memory that the task has freed.

    Workers outlive their tasks, and allocators keep freed memory for the next one, which may
    be another stage's.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return task


def release(spark: SparkSession, path: str) -> None:
    """Delete a work table that is no longer read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written below the shared folder and read again, with its path."""
    path = new_work_path(df.sparkSession, f"{label}-{uuid.uuid4().hex[:6]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
