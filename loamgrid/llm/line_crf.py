"""Op 7: document quality from a linear-chain conditional random field over lines.

Every line with a word gets features of its own and of its two neighbour
lines.  The field has two states, bad and good.  A document's score is the mean of its lines'
forward-backward marginals of good, weighted by their lengths.

Only documents are labelled; the states of their lines are latent.  Training alternates (posterior
regularisation): the field's own posterior is tilted, document by document, as little as it takes for the
length-weighted mean marginal to reach ``target`` on the label's side; the weights then follow the gradient from
the field's expectations to the tilted ones (Adam, L2).  So a bad document may hold good lines and the
chain learns when lines change from one to the other.

Training uses labelled documents in the order of a hash of their ids, whole, until ``train_docs`` documents or ``train_lines``
lines are reached; this bound is what reaches the driver, beside the last document taken.
Scoring takes all lines of all documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.llm.shared import held_out, saved, table
from loamgrid.llm.words import SPACE, Words, mix, slices

_U64 = np.uint64
_CELLS = 1 << 20


def _kinds() -> np.ndarray:
    """Byte classes: letter, digit, symbol, sentence punctuation, upper case."""
    kinds = np.zeros((5, 256), np.float32)
    for row, chars in enumerate((b"", b"0123456789", b"#*$%&|<>{}[]=_\\/~^@", b".,;:!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        kinds[row, list(chars)] = 1
    kinds[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return kinds


_KINDS = _kinds()
N_OWN = 15


class Lines:
    """Lines with a word, of the rows of a text column: features, weights, row bounds."""

    def __init__(self, column: pa.Array) -> None:
        texts = [[x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")] for t in column.to_pylist()]
        self.edge = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        words = Words(pa.array([x for t in texts for x in t], pa.large_string()))
        self.weight = np.diff(words.off).astype(np.float64)
        own = self._own(words)
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        begins, ends = self.edge[:-1][np.diff(self.edge) > 0], self.edge[1:][np.diff(self.edge) > 0] - 1
        before[begins] = 0
        after[ends] = 0
        rim = np.zeros((len(own), 3), np.float32)
        rim[:, 0] = 1
        rim[begins, 1] = 1
        rim[ends, 2] = 1
        self.features = np.hstack([own, before, after, rim])

    def _own(self, words: Words) -> np.ndarray:
        n = len(words.off) - 1
        out = np.zeros((n, N_OWN), np.float32)
        if not n:
            return out
        size, count = np.diff(words.off), np.diff(words.first)
        sums = lambda a: np.diff(np.concatenate([[0], np.cumsum(a, dtype=np.float64)])[words.off])
        per_word = lambda a: np.diff(np.concatenate([[0], np.cumsum(a, dtype=np.float64)])[words.first]) / count
        for i, kind in enumerate(_KINDS):
            out[:, i] = sums(kind[words.data]) / size
        hashes, length = words.hashes(), words.end - words.start
        out[:, 5] = np.log1p(count)
        out[:, 6] = per_word(length) / 10
        out[:, 7] = per_word(length <= 3)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
        out[:, 8] = per_word(again)
        keyed = mix(hashes + mix(words.row.astype(_U64) + _U64(1)))
        _, first = np.unique(keyed, return_index=True)
        fresh = np.zeros(len(hashes), bool)
        fresh[first] = True
        out[:, 9] = per_word(fresh)
        out[:, 10] = per_word(_KINDS[2][words.data[words.end - 1]])
        last, begin = words.data[words.end[words.first[1:] - 1] - 1], words.data[words.start[words.first[:-1]]]
        out[:, 11] = np.isin(last, np.frombuffer(b".!?", np.uint8))
        out[:, 12] = _KINDS[4][begin]
        doc = np.repeat(np.arange(len(self.edge) - 1), np.diff(self.edge)).astype(_U64)
        line = mix(np.add.reduceat(mix(hashes + (np.arange(len(hashes)) - words.first[:-1][words.row]).astype(_U64)), words.first[:-1]) + mix(doc + _U64(1)))
        _, back, copies = np.unique(line, return_inverse=True, return_counts=True)
        out[:, 13] = copies[back] > 1
        out[:, 14] = sums(SPACE[words.data]) / size
        return out


class Field(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    step: np.ndarray
    prior: float


def _chains(edge: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of documents of like length, as line numbers padded with -1 to one width."""
    size = np.diff(edge)
    order = np.flatnonzero(size)[np.argsort(size[size > 0], kind="stable")]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and size[order[j]] * (j + 1 - i) <= _CELLS and size[order[j]] <= 2 * size[order[i]] + 8:
            j += 1
        place = np.arange(size[order[j - 1]])[None, :]
        yield np.where(place < size[order[i:j]][:, None], edge[order[i:j]][:, None] + place, -1)
        i = j


def forward_backward(unary: np.ndarray, step: np.ndarray, edge: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good for every line, expected transitions (2 x 2) and the sum of log partitions."""
    good, moves, logs = np.zeros(len(unary)), np.zeros((2, 2)), 0.0
    go = np.exp(step)
    for lines in _chains(edge):
        n, width = lines.shape
        here = lines >= 0
        odds = np.where(here, np.exp(np.clip(unary[lines], -30, 30)), 1.0)
        shape = np.stack([np.ones_like(odds), odds], 2)
        ahead = np.empty((n, width, 2))
        for t in range(width):
            now = shape[:, t] if not t else (ahead[:, t - 1] @ go) * shape[:, t]
            total = now.sum(1)
            ahead[:, t] = np.where(here[:, t, None], now / total[:, None], ahead[:, t - 1] if t else now)
            logs += np.log(total[here[:, t]]).sum()
        back = np.ones((n, 2))
        for t in range(width - 1, -1, -1):
            both = ahead[:, t] * back
            both /= both.sum(1, keepdims=True)
            good[lines[here[:, t], t]] = both[here[:, t], 1]
            if t:
                now = (shape[:, t] * back) @ go.T
                if pairs:
                    joint = ahead[:, t - 1, :, None] * go[None] * (shape[:, t] * back)[:, None, :]
                    moves += (joint / joint.sum((1, 2), keepdims=True))[here[:, t]].sum(0)
                back = np.where(here[:, t, None], now / now.sum(1, keepdims=True), back)
    return good, moves, logs


def train(features: np.ndarray, edge: np.ndarray, weight: np.ndarray, label: np.ndarray, rounds: int, l2: float, target: float) -> Field:
    """Weights for documents (bounded by ``edge``) whose length-weighted mean of good is on the side of ``label``."""
    mean, scale = features.mean(0), features.std(0) + 1e-6
    mean[-3], scale[-3] = 0.0, 1.0
    x = (features - mean) / scale
    size = np.diff(edge)
    share = weight / np.repeat(np.maximum(np.add.reduceat(weight, edge[:-1]), 1e-9), size)
    pull = share * np.repeat(size, size)
    wanted, sign = np.where(label == 1, target, 1 - target), np.where(label == 1, 1.0, -1.0)
    tilt = 0.5 * sign
    at, slow, fast = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for i in range(1, rounds + 1):
        unary, step = x @ at[:-4], at[-4:].reshape(2, 2)
        good, moves, _ = forward_backward(unary, step, edge, pairs=True)
        held, held_moves, _ = forward_backward(unary + np.repeat(tilt, size) * pull, step, edge, pairs=True)
        short = wanted - np.add.reduceat(held * share, edge[:-1])
        tilt = sign * np.clip(sign * (tilt + 2.0 * short), 0.0, 20.0)
        slope = np.concatenate([x.T @ (held - good), (held_moves - moves).ravel()]) / max(1, len(label)) - l2 * at
        slow, fast = 0.9 * slow + 0.1 * slope, 0.99 * fast + 0.01 * slope**2
        at += 0.1 * (slow / (1 - 0.9**i)) / (np.sqrt(fast / (1 - 0.99**i)) + 1e-8)
    return Field(mean, scale, at[:-4], at[-4:].reshape(2, 2), float(label.mean()))


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [sum(1 for x in (t.as_py() or "").split("\n") if x.strip(" \t\n\v\f\r")) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n"])


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            lines = Lines(part.column("text"))
            keep = np.flatnonzero(np.diff(lines.edge))
            of = [slice(lines.edge[i], lines.edge[i + 1]) for i in keep]
            made = [pa.array([lines.features[s].ravel() for s in of], pa.list_(pa.float32())), pa.array([lines.weight[s] for s in of], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(keep)), part.column("label").take(pa.array(keep)), *made], names=["doc_id", "label", "features", "weight"])


def _score(field: Field | None):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = np.full(part.num_rows, field.prior if field else 0.5)
                lines = Lines(part.column("text"))
                full = np.flatnonzero(np.diff(lines.edge))
                if field and len(full):
                    unary = ((lines.features - field.mean) / field.scale) @ field.weight
                    good, _, _ = forward_backward(unary, field.step, lines.edge)
                    begin = lines.edge[:-1][full]
                    score[full] = np.add.reduceat(good * lines.weight, begin) / np.add.reduceat(lines.weight, begin)
                score = np.clip(score, 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=schema)

    return run


def classify_quality(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_lines: int = 60_000, rounds: int = 120, l2: float = 1e-3, target: float = 0.9) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality (0 or 1; where an id has both, 1 counts);
    other columns are ignored.  Only rows outside the held-out fold teach; of rows that share an id the first text in
    order does.  Texts without a word, null among them, score the share of good training documents;
    without any label everything scores 0.5.  Repeated rows stay.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = saved(docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")  # at most train_docs ids
    counts = rows.select("doc_id", "text").mapInArrow(_count_lines, "doc_id long, n long")
    before = F.coalesce(F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = counts.select("doc_id", before.alias("before")).where(F.col("before") < train_lines)
    sample = rows.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "label").mapInArrow(_collect, "doc_id long, label int, features array<float>, weight array<double>").toPandas()
    field = None
    if len(sample):
        sample = sample.sort_values("doc_id")  # the order of rows must not matter to sums
        size = sample["weight"].map(len).to_numpy()
        features = np.concatenate(sample["features"].to_list()).reshape(size.sum(), -1).astype(np.float64)
        field = train(features, np.concatenate([[0], np.cumsum(size)]), np.concatenate(sample["weight"].to_list()), sample["label"].to_numpy(), rounds, l2, target)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_score(field), "doc_id long, held_out boolean, score double, predicted int")


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
