"""What language identification holds of a batch at once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loamgrid.llm import language_id
from tests.llm.conftest import prose


def test_a_batch_is_worked_in_small_slices():
    """4 MB of text in one batch, eight languages: numpy holds a few tens of MB at once, and each row comes out once."""
    texts = [prose(seed, 1500) for seed in range(20)]
    texts = (texts * (1 + (4 << 20) // sum(map(len, texts))))[:600]
    buckets, names = 1 << 12, [f"l{i}" for i in range(8)]
    logs = np.log(np.random.default_rng(1).random((buckets, 8)) + 0.1).astype(np.float32)
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "held_out": [False] * len(texts), "lang": [names[i % 8] for i in range(len(texts))]})
    tracemalloc.start()
    try:
        counted = list(language_id._count(buckets)(iter([rows.select(["text", "lang"])])))
        of_counts = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        found = pa.Table.from_batches(language_id._predict(names, logs, 2.0, 1e-3, ())(iter([rows])))
        of_predictions = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found["doc_id"].to_pylist() == list(range(len(texts)))
    assert sum(pc.sum(x["n"]).as_py() for x in counted) == sum(sum(map(str.isalpha, x)) for x in texts)
    assert of_counts < 40e6 and of_predictions < 40e6
