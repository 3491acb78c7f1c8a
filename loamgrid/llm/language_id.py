"""Op 2: language identification by multilingual mixture inference.

Training counts hashed byte trigrams of lower-cased words for each language
over all labelled documents of the training folds.  A document is then
taken as a mixture: each word comes from one language, with the likelihood of its
trigrams.  Expectation-maximisation, run until no proportion moves by more than a tolerance, estimates the languages'
proportions; the language set is the one, among the top-k sets by proportion of every size k, with the
best likelihood less ``penalty * k * log(words)``.  No set has a better likelihood than all languages together, so sets
whose penalty outweighs even that gain are not worked out.  The proportions of the
chosen set are the result, its largest the prediction.

The model is bounded by ``buckets`` times the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.shared import held_out, table
from loamgrid.llm.words import slices, text_bytes

_LETTER = np.zeros(256, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = np.arange(1, 27)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_LETTER[0x80:] = np.arange(27, 155)
#: Bytes of text at once; its trigrams under all languages take some fifty times that.
SLICE_BYTES = 1 << 19
_COUNTED = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
_MADE = ("doc_id", "held_out", "lang_pred", "score", "languages")


def _trigrams(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, the first letter of each word, and the word's row.

    Letters are a-z, A-Z as a-z, and all bytes of non-ASCII characters;
    everything else parts words, as does the end of a row.
    """
    data, off = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(data) + len(off) + 1, np.uint32)
    shift = np.repeat(np.arange(len(off) - 1), np.diff(off)) + 1
    code[np.arange(len(data)) + shift] = _LETTER[data]
    at = np.flatnonzero(code)
    gram = (code[at - 1] * np.uint32(155) + code[at]) * np.uint32(155) + code[at + 1]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(7)) & np.uint32(buckets - 1)
    head = np.flatnonzero(code[at - 1] == 0)
    row = np.searchsorted(off + np.arange(len(off)) + 1, at[head], "right") - 1
    return bucket.astype(np.int64), head, row


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs], np.int64)
                bucket, head, row = _trigrams(part.column("text"), buckets)
                each = np.repeat(number[row], np.diff(np.append(head, len(bucket))))
                found = np.bincount(each * buckets + bucket, minlength=buckets * len(names)).reshape(len(names), buckets)
                for name, n in zip(names, found, strict=True):
                    counts[name] = counts.get(name, 0) + n
        for name, n in counts.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen])], schema=_COUNTED)

    return run


def _segment_sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of rows between the edges (which bound non-empty segments)."""
    return np.add.reduceat(values, edge[:-1], axis=0)


def mixture(like: np.ndarray, edge: np.ndarray, allowed: np.ndarray, tolerance: float = 1e-4, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: proportions and log likelihood of each segment.

    ``like``: likelihoods of the words (rows) under the languages; ``edge``: bounds
    of the segments; ``allowed``: languages that each segment may use.  A segment is done when none of its
    proportions moves by more than ``tolerance`` in a round, after ``rounds`` at the latest.
    """
    n = np.diff(edge)
    share = allowed / allowed.sum(1, keepdims=True)
    open_, part, bounds = np.arange(len(n)), like, edge
    for i in range(rounds):
        weighted = part * np.repeat(share[open_], n[open_], axis=0)
        weighted /= np.maximum(weighted.sum(1), 1e-300)[:, None]
        new = _segment_sums(weighted, bounds) / n[open_, None]
        moving = np.abs(new - share[open_]).max(1) > tolerance
        share[open_] = new
        if not moving.any():
            break
        if moving.mean() < 0.7:
            part = part[np.repeat(moving, n[open_])]
            open_ = open_[moving]
            bounds = np.concatenate([[0], np.cumsum(n[open_])])
    total = (like * np.repeat(share, n, axis=0)).sum(1)
    return share, _segment_sums(np.log(np.maximum(total, 1e-300)), edge)


def choose(logs: np.ndarray, edge: np.ndarray, penalty: float, tolerance: float = 1e-4) -> np.ndarray:
    """Proportions of the languages in each segment under the set with the best penalised likelihood."""
    like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60.0))
    n, languages = np.diff(edge), logs.shape[1]
    full, most = mixture(like, edge, np.ones((len(n), languages)), tolerance)
    place = np.empty_like(full, dtype=np.int64)
    np.put_along_axis(place, np.argsort(-full, axis=1, kind="stable"), np.arange(languages)[None, :], axis=1)
    best = (place == 0).astype(float)
    cost = penalty * np.log(n + 1.0)
    value = _segment_sums(np.log(np.maximum((like * np.repeat(best, n, axis=0)).sum(1), 1e-300)), edge) - cost
    # what rounds after the last could still add to the likelihood of all languages is of the order of the tolerance
    most = most + tolerance * n
    for k in range(2, languages + 1):
        now = np.flatnonzero(most - k * cost > value)
        if not len(now):
            break
        words = np.flatnonzero(np.repeat(np.isin(np.arange(len(n)), now), n))
        own = np.concatenate([[0], np.cumsum(n[now])])
        share, total = mixture(like[words], own, (place[now] < k).astype(float), tolerance)
        better = total - k * cost[now] > value[now]
        best[now[better]] = share[better]
        value[now[better]] = (total - k * cost[now])[better]
    return best


def _predict(names: list[str], logs: np.ndarray, penalty: float, tolerance: float, extra: tuple[str, ...]):
    buckets = logs.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                n = part.num_rows
                pred, score, mixed = ["und"] * n, np.zeros(n), [""] * n
                bucket, head, row = _trigrams(part.column("text"), buckets)
                lettered = [any(map(str.isalpha, x or "")) for x in part.column("text").to_pylist()]
                if len(head) and names:
                    words = np.add.reduceat(logs[bucket], head, axis=0)
                    rows, begin = np.unique(row, return_index=True)
                    share = choose(words, np.append(begin, len(row)), penalty, tolerance)
                    for i, p in zip(rows.tolist(), share, strict=True):
                        order = np.argsort(-p, kind="stable")
                        if lettered[i]:
                            pred[i], score[i] = names[order[0]], min(1.0, float(p[order[0]]))
                            mixed[i] = " ".join(f"{names[j]}:{p[j]:.3f}" for j in order if p[j] > 0)
                elif names:
                    pred = [names[0] if x else "und" for x in lettered]
                made = [part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.string())]
                yield pa.RecordBatch.from_arrays([*made, *(part.column(c) for c in extra)], names=[*_MADE, *extra])

    return run


def identify_languages(docs: DataFrame, buckets: int = 1 << 15, smoothing: float = 0.5, penalty: float = 2.0, tolerance: float = 1e-3, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the languages' proportions of every row, then its ``extra`` columns.

    ``docs`` needs doc_id, text and lang; other columns than those in ``extra`` are ignored.  The model learns from
    the rows outside the held-out fold with non-null doc_id and lang; a prediction
    uses the text alone.  Null texts and texts without a letter are
    ``und`` with score 0, as is everything if nothing could be learned.  Repeated rows
    stay.  Ties go to the language first in alphabetical order.
    """
    other = [c for c in extra if c != "text"]
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), held_out(F.col("doc_id")).alias("held_out"), *other)
    train = docs.where("doc_id is not null and lang is not null and text is not null and not held_out").select("text", "lang")
    counts = train.mapInArrow(_count(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(counts["lang"]))
    table_ = np.full((buckets, len(names)), smoothing)
    table_[counts["bucket"].to_numpy(int), [names.index(x) for x in counts["lang"]]] += counts["n"]
    logs = (np.log(table_) - np.log(table_.sum(0, keepdims=True))).astype(np.float32)
    kinds = dict(docs.dtypes)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, languages string" + "".join(f", `{c}` {kinds[c]}" for c in extra)
    return docs.select("doc_id", "text", "held_out", *other).mapInArrow(_predict(names, logs, penalty, tolerance, tuple(extra)), schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
