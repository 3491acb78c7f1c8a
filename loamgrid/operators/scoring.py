"""Scores from a user's model, batch by batch, with a record of how often it was loaded."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker's models by name: a worker serves many tasks, and a model is loaded for the first of them.
_LOADED: dict[str, Any] = {}


def _model(model_id: str, load: Callable[[], Any]) -> tuple[Any, bool]:
    """The worker's model, and whether it was loaded just now. Named in the module, so that every task of a worker finds the same dict."""
    fresh = model_id not in _LOADED
    if fresh:
        _LOADED[model_id] = load()
    return _LOADED[model_id], fresh


def score(pixels: DataFrame, model_id: str, load: Callable[[], Any], features: list[str], classes: int, keep: list[str], rows: int = 4096) -> DataFrame:
    """``keep``, model_id, probs (array of ``classes``) of every row, and worker and loaded of the batch that it was in.

    ``load`` gives a callable from a float matrix (rows, features) to one of (rows, classes); it runs once in each Python worker and must come from an
    importable module or be picklable. Null features are NaN. A model that gives another shape fails the query. ``worker``
    names the process; ``loaded`` is true in the rows of the batch for which the model was loaded.
    """
    schema = pixels.select(*keep).schema
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import socket

        worker = f"{socket.gethostname()}:{os.getpid()}"
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                model, fresh = _model(model_id, load)
                table = np.stack([part.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], axis=1)
                probs = np.asarray(model(table), dtype=float)
                if probs.shape != (len(table), classes):
                    raise ValueError(f"{model_id} gave {probs.shape} instead of {(len(table), classes)}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * classes), pa.array(probs.reshape(-1)))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([model_id] * n), lists, pa.array([worker] * n), pa.array([fresh] * n)], names=[*keep, "model_id", "probs", "worker", "loaded"])

    return pixels.select(*dict.fromkeys([*keep, *features])).mapInArrow(run, ", ".join([*names, "model_id string", "probs array<double>", "worker string", "loaded boolean"]))


def loads(scores: DataFrame) -> DataFrame:
    """model_id, workers, loads (workers that loaded it), cached (rows served from memory) of a saved table of scores."""
    each = scores.groupBy("model_id", "worker").agg(F.bool_or("loaded").alias("loaded"), F.count_if(~F.col("loaded")).alias("cached"))
    return each.groupBy("model_id").agg(F.count("*").alias("workers"), F.count_if("loaded").alias("loads"), F.sum("cached").alias("cached"))
