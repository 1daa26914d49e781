"""What a Python worker keeps while and after it runs a task."""

import ctypes
import pickle
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lettermill.llm import toxicity
from lettermill.llm.common import PIECE_BYTES, share, shared, tidied


def test_worker_reads_the_value_itself(spark):
    value = {"a": np.arange(1000)}
    model = share(spark, value)
    # What the worker's copy of the broadcast holds: not bytes beside the value made of them.
    kept = pickle.loads(pickle.dumps(model.value))
    assert isinstance(kept, dict) and np.array_equal(kept["a"], value["a"])
    again = shared(SimpleNamespace(value=kept))
    again["cached"] = 1  # ends with the task
    assert "cached" not in kept and again["a"] is kept["a"]


def test_mild_texts_leave_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "shared", lambda model: None)
    monkeypatch.setattr(toxicity, "share", lambda session, value: None)
    monkeypatch.setattr(
        toxicity, "Scorer", lambda index: SimpleNamespace(scores=lambda raw, starts: (np.array([float(raw[s] == 33) for s in starts[:-1]]), []))
    )
    text = "word " * 20_000
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": [("!" if i % 3 == 0 else "a") + text for i in range(60)]})
    got = []
    docs = SimpleNamespace(
        sparkSession=None, columns=["doc_id", "text"], schema=None, mapInArrow=lambda run, schema: got.extend(run(iter([rows, rows.slice(0, 0)])))
    )
    toxicity.keep_mild(docs, object())
    assert [i for b in got for i in b.column(0).to_pylist()] == [i for i in range(60) if i % 3]
    assert max(sum(map(len, b.column(1).to_pylist())) for b in got) <= PIECE_BYTES


def test_freed_memory_goes_back_as_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(ctypes, "CDLL", lambda name: SimpleNamespace(malloc_trim=calls.append))
    run = tidied(lambda batches: (b for b in batches))
    out = run(iter([1, 2]))
    assert next(out) == 1 and not calls
    assert list(out) == [2] and calls == [0]
