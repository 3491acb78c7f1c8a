"""Op 1: quality rules by a hashed n-gram log-likelihood ratio.

Word n-grams are hashed into a fixed number of buckets.  Two multinomials over
the buckets are counted: the raw corpus and its trusted part.  A document's score is its mean log ratio of the two over its
n-grams, so its length doesn't matter.  Every document whose score lies under
a threshold is rejected.  The threshold lies as far below the ``quantile`` of the
trusted documents' own scores as that lies below their median; both come from an
exact histogram, so that the same corpus always gives the same verdicts.  Log ratios are fixed-point integers: sums
don't depend on the order of rows.

Both counts and the threshold cover all documents.  Raw counts need no shuffle of texts; the trusted ones are
taken in a second pass over the documents that meet a trusted id, in a merge join that shuffles
the texts once, at every size alike.  The
counts tables are bounded by ``buckets`` rows and the histogram by the range of
the scores; only these reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.llm.shared import saved, table
from loamgrid.llm.words import SPACE, Words, slices, windows

_U64 = np.uint64
#: Fixed-point scale of a log ratio; bins of a score in the histogram.
_SCALE = 1 << 20
_BINS = 1000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_REPEAT = 8
_COUNTED = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
_SCORED = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "log_ratio")])


def _grams(words: Words, orders: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket and the row of every n-gram that stays within its row."""
    hashes, ends, out = words.hashes(), words.ends(), []
    for n in orders:
        found = windows(hashes, n, n)
        inside = np.arange(len(found)) + n <= ends[: len(found)]
        out.append(((found[inside] % _U64(buckets)).astype(np.int64), words.row[: len(found)][inside]))
    return out


def _count(orders: tuple[int, ...], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for bucket, _ in _grams(Words(part.column("text")), orders, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], schema=_COUNTED)

    return run


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])


def _repeated(words: Words) -> np.ndarray:
    """Words of each row that lie in a window of eight words found twice or more in the row."""
    hashes = windows(words.hashes(), _REPEAT)
    at = np.flatnonzero(np.arange(len(hashes)) + _REPEAT <= words.ends()[: len(hashes)])
    key = hashes[at] + words.row[at].astype(_U64) * _U64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at), bool)
    equal = key[order[1:]] == key[order[:-1]]
    same[order[1:]] |= equal
    same[order[:-1]] |= equal
    edge = np.zeros(len(words.start) + 1, np.int64)
    edge[at[same]] += 1
    edge[at[same] + _REPEAT] -= 1
    return _per_row(np.cumsum(edge[:-1]) > 0, words.first)


def _dup_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _score(orders: tuple[int, ...], ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, n = Words(part.column("text")), part.num_rows
                first_byte = (words.data & 0xC0) != 0x80
                total, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for bucket, row in _grams(words, orders, len(ratio)):
                    sums = np.concatenate([[0], np.cumsum(ratio[bucket])])
                    edge = np.searchsorted(row, np.arange(n + 1))
                    total += sums[edge[1:]] - sums[edge[:-1]]
                    count += np.diff(edge)
                columns = [
                    np.diff(words.first),
                    _per_row(first_byte & ~SPACE[words.data], words.off),
                    _per_row(_SYMBOL[words.data], words.off),
                    np.array([_dup_lines(x) for x in part.column("text").to_pylist()], np.int64),
                    _repeated(words),
                    count,
                    total,
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], schema=_SCORED)

    return run


def _threshold(scores: DataFrame, quantile: float) -> float | None:
    """Twice the ``quantile`` less the median of the scores, by histogram bins; None without scores."""
    bins = scores.groupBy(F.floor(F.col("llr") * _BINS).alias("bin")).count()
    below = F.coalesce(F.sum("count").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = bins.select("bin", below.alias("below"), F.sum("count").over(W.partitionBy()).alias("all"))
    upto = lambda q: F.max(F.when(F.col("below") <= q * F.col("all"), F.col("bin")))
    low, middle = ranked.agg(upto(quantile), upto(0.5)).first()
    return None if low is None else (2 * low - middle) / _BINS


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    orders: tuple[int, ...] = (1, 2),
    buckets: int = 1 << 16,
    smoothing: float = 1.0,
    quantile: float = 0.002,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Counts, base rules, log-likelihood ratio and verdict of every row of ``docs``.

    ``docs`` needs doc_id and text, ``trusted`` the doc_id of trusted documents;
    other columns are ignored, as are repeated and null ids in ``trusted``.  Repeated
    rows of ``docs`` stay and count each time.  Null texts have no words.  A
    document without words scores 0.  Without any trusted document that passes
    the base rules there is no threshold and the base rules decide alone.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    trusted = trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()

    def counts(texts: DataFrame) -> np.ndarray:
        found = texts.select("text").mapInArrow(_count(orders, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(buckets, smoothing)
        total[found["bucket"]] += found["n"]
        return total

    raw, good = counts(docs), counts(docs.join(trusted.hint("merge"), "doc_id", "left_semi"))
    ratio = np.rint((np.log(good / good.sum()) - np.log(raw / raw.sum())) * _SCALE).astype(np.int64)
    scored = saved(docs.mapInArrow(_score(orders, ratio), ", ".join(f"{n} long" for n in _SCORED.names)), "scores")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    llr = F.when(F.col("n_grams") > 0, F.col("log_ratio") / F.col("n_grams") / _SCALE).otherwise(0.0)
    scored = scored.withColumn("base_failed", failed).withColumn("llr", llr)
    edge = _threshold(scored.where("not base_failed").join(trusted, "doc_id", "left_semi"), quantile)
    verdict = F.lit(True) if edge is None else F.col("llr") >= edge
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "llr")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), good)
