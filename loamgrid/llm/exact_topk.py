"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, as matrix products of packed blocks: one block of queries by one of candidates.  The scores
are never kept.  Instead each pass returns a histogram of every query's scores over an interval that holds its kth
best, summed over all blocks; the bin in which the count from above reaches k is the next interval, until it is one value
wide or holds hardly more scores than k.  The last pass returns only scores above the interval's lower end and, of those equal to it, the k
smallest ids of each block, which a ranking cuts to k rows.  A task drops the bins below the one in which its own count reaches k: the kth best
of all can't lie there.

What grows with the table is dealt in blocks, and nothing of it passes the driver: candidates are packed where they are read and dealt evenly
to groups, a task each, of which there are a few times as many as cores and so many that a group's blocks stay few.  A task holds its group's
blocks while a copy of every block of queries goes by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamgrid.llm.shared import discard, saved, table
from loamgrid.llm.vectors import integers, matrix, usable

K = 5
#: Rows of a block of queries and of candidates; a pair of blocks makes their product of scores.
QUERIES, CANDIDATES = 512, 4096
#: Bins of a histogram.
BINS = 1024
#: Blocks of candidates that a task holds at most, if they are dealt evenly.
HELD = 32
#: An interval with so many times k scores at most, those above it included, is not refined.
FEW = 4
_NONE = np.int64(-(1 << 63))
_PACKED = "block long, task int, nth int, n int, width int, row array<long>, vec_id array<long>, m binary, top double, most long"


def _lists(rows: list[np.ndarray] | list[list]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int64()))


def _pack(size: int):
    """Rows (row, vec_id, v) as blocks of ``size``; block: its first row; it is the ``nth`` of its task. ``top`` and ``most``: the largest norm and component in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task, nth = TaskContext.get().partitionId(), 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, nth
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            whole = rows[0] if rows else held[0].slice(0, 0)
            stop = whole.num_rows if last else whole.num_rows // size * size
            for a in range(0, stop, size):
                part = whole.slice(a, min(size, stop - a))
                m = matrix(part.column("v"))
                norm = float(np.sqrt((m.astype(float) ** 2).sum(axis=1)).max(initial=0))
                row = part.column("row").to_pylist()
                columns = [pa.array([row[0]]), *(pa.array([x], pa.int32()) for x in (task, nth, len(row))), pa.array([m.shape[1]], pa.int32()), _lists([row]), _lists([part.column("vec_id").to_pylist()])]
                columns += [pa.array([m.astype("<i4").tobytes()], pa.binary()), pa.array([norm]), pa.array([int(np.abs(m).max(initial=0))])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "task", "nth", "n", "width", "row", "vec_id", "m", "top", "most"])
                nth += 1
            held = [whole.slice(stop)] if stop < whole.num_rows else []

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield from blocks(False)
        yield from blocks(True)

    return run


class Block:
    """A packed block; as one of candidates its rows ascend by id, null last."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        whole = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
        n, width, self.most = (batch.column(c)[i].as_py() for c in ("n", "width", "most"))
        self.m = np.frombuffer(batch.column("m")[i].as_buffer(), "<i4").reshape(n, width)
        self.row = whole("row")
        if batch.column("low")[i].is_valid:
            self.low, self.span = whole("low"), whole("span")
            return
        ids = batch.column("vec_id")[i].values
        self.id, self.none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((self.id, self.none))
        self.m, self.row, self.id, self.none = self.m[order], self.row[order], self.id[order], self.none[order]  # copies, so that the batch goes


def scores(q: Block, c: Block) -> np.ndarray:
    """Exact scores of a pair of blocks, below all others where a query meets its own row. Missing components count as zeros."""
    width = min(q.m.shape[1], c.m.shape[1])
    most = q.most * c.most * width
    kind = next((k for k in (np.float32, np.float64) if most < _WHOLE[k]), np.int64)  # floats hold all sums exactly
    out = q.m[:, :width].astype(kind) @ c.m[:, :width].astype(kind).T
    if len(q.row) and len(c.row) and q.row.max() >= c.row.min() and c.row.max() >= q.row.min():
        order = np.argsort(c.row)
        at = np.minimum(np.searchsorted(c.row[order], q.row), len(order) - 1)
        own = np.flatnonzero(c.row[order][at] == q.row)
        out[own, order[at[own]]] = _NONE if kind is np.int64 else -np.inf
    return out


#: Up to here all whole numbers are exact.
_WHOLE = {np.float32: 1 << 24, np.float64: 1 << 53}


def _as(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Bounds, a row each, in the type of ``found``: they part its scores as before, and leave out a query's own row."""
    limit = _WHOLE.get(found.dtype.type)
    return (np.clip(x, -limit, limit).astype(found.dtype) if limit else np.maximum(x, _NONE + 1))[:, None]


def step_of(span, bins: int):
    """Values in a bin."""
    return -(-span // bins)


def _listed(found: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the scores that are ``inside``, row by row."""
    at = np.flatnonzero(inside)
    return *np.divmod(at, max(1, found.shape[1])), found.reshape(-1)[at].astype(np.int64)


def tally(count: np.ndarray, floor: np.ndarray, found: np.ndarray, low: np.ndarray, span: np.ndarray, k: int) -> None:
    """Add the scores in [floor, low + span) to ``count`` (a row a query, a column a bin) and raise ``floor`` to the bin in which its count from above reaches k."""
    bins = count.shape[1]
    step = np.maximum(step_of(span, bins), 1)
    inside = found >= _as(floor, found)
    if np.count_nonzero(inside) > 8 * k * len(found):
        # the block's own kth best: what lies in bins below its own is not looked at one by one
        kth = np.partition(found, -k, axis=1)[:, -k]
        at = np.flatnonzero(kth >= _as(floor, found)[:, 0])
        floor[at] = low[at] + (kth[at].astype(np.int64) - low[at]) // step[at] * step[at]
        inside = found >= _as(floor, found)
    q, _, score = _listed(found, inside)
    below = score < (low + span)[q]
    q, score = q[below], score[below]
    np.add.at(count, (q, (score - low[q]) // step[q]), 1)
    seen = np.unique(q)
    reached = np.cumsum(count[seen, ::-1], axis=1) >= k
    there = reached[:, -1]
    at = seen[there]
    floor[at] = np.maximum(floor[at], low[at] + (bins - 1 - reached[there].argmax(axis=1)) * step[at])


def binned(count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, bin and count, without bins below the one in which the count from above reaches k."""
    above = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] - count
    q, b = np.nonzero((count > 0) & (above < k))
    return q, b, count[q, b]


def histogram(found: np.ndarray, low: np.ndarray, span: np.ndarray, bins: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, bin and count of the scores in [low, low + span), without bins below the one in which the count from above reaches k."""
    count = np.zeros((len(found), bins), np.int64)
    tally(count, low.astype(np.int64), found, low, span, k)
    return binned(count, k)


def _met(of: Callable[[Block, list[Block]], Iterator[pa.RecordBatch]]):
    """``of`` each block of queries and all candidates of its group; rows come by group, candidates (without ``low``) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                grp, block = batch.column("grp")[i].as_py(), Block(batch, i)
                if grp != at:
                    at, held = grp, []
                if batch.column("low")[i].is_valid:
                    yield from of(block, held)
                else:
                    held.append(block)

    return run


def _counted(bins: int, k: int):
    def of(q: Block, held: list[Block]) -> Iterator[pa.RecordBatch]:
        asks = q.span > 0
        q.m, q.row, q.low, q.span = (x[asks] for x in (q.m, q.row, q.low, q.span))
        count, floor = np.zeros((len(q.row), bins), np.int64), q.low.copy()
        for c in held:
            tally(count, floor, scores(q, c), q.low, q.span, k)
        at, b, n = binned(count, k)
        yield pa.RecordBatch.from_arrays([pa.array(q.row[at]), pa.array(b), pa.array(n)], names=["query", "bin", "n"])

    return _met(of)


def _taken(k: int):
    """query, vec_id, score: all scores above the interval's lower end, and of those equal to it the smallest ids."""

    def of(q: Block, held: list[Block]) -> Iterator[pa.RecordBatch]:
        for c in held:
            found = scores(q, c)
            i, j, score = _listed(found, found >= _as(q.low, found))
            equal = score == q.low[i]
            so_far = np.concatenate([[0], np.cumsum(equal)])
            keep = ~equal | (so_far[1:] - so_far[np.searchsorted(i, i)] <= k)
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q.row[i]), pa.array(c.id[j], mask=c.none[j]), pa.array(score[keep])], names=["query", "vec_id", "score"])

    return _met(of)


def search(vectors: DataFrame, is_query, k: int = K, scale: int = 256, queries: int = QUERIES, candidates: int = CANDIDATES, bins: int = BINS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows of every row for which ``is_query`` holds.

    ``vectors`` needs vec_id and embedding; other columns are ignored.  The score is the inner product of floor(``scale`` * x),
    components held to ``LIMIT`` of ``vectors``; of vectors of different lengths the shorter ends in zeros.  Equal scores go to the smaller
    vec_id, null last.  Vectors null or with a null or non-finite component take no part.  A repeated row is a query
    each time, and its copies are candidates like any others.  Fewer candidates than ``k`` are all returned.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    kept = saved(kept.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")
    packed = saved(kept.select("row", "vec_id", "v").mapInArrow(_pack(candidates), _PACKED), "candidates")
    asked = saved(kept.where("asks").select("row", "vec_id", "v").mapInArrow(_pack(queries), _PACKED), "queries")
    dealt = packed.groupBy("task").agg(F.count("*").alias("n"), F.max("top").alias("top")).collect()  # a row a task
    blocks, top = sum(r.n for r in dealt), max((r.top for r in dealt), default=0.0)
    groups = max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism), -(-blocks // HELD))
    first = dict(zip((r.task for r in dealt), np.cumsum([0, *(r.n for r in dealt)]).tolist(), strict=False))
    number = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col("task")) + F.col("nth") if first else F.lit(0)
    there = packed.select(F.pmod(number, F.lit(groups)).cast("int").alias("grp"), "n", "width", "row", "vec_id", "m", "most")

    # No join may broadcast: Spark sizes packed and repeated rows far too small, and the state grows with the queries.
    def met(state: DataFrame, of, result: str) -> DataFrame:
        """``of`` all pairs of blocks, each query with its interval, which is empty if it is closed."""
        each = F.struct("at", "low", F.when(F.col("open"), F.col("span")).otherwise(0).alias("span"))
        per = state.groupBy("block").agg(F.array_sort(F.collect_list(each)).alias("s"))  # one block's queries
        here = asked.join(per.hint("merge"), "block").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "n", "width", "row", "m", "most", F.col("s.low").alias("low"), F.col("s.span").alias("span"))
        both = here.unionByName(there, allowMissingColumns=True).repartitionById(groups, "grp")
        return both.sortWithinPartitions("grp", F.col("low").isNotNull()).mapInArrow(of, result)

    # a score is at most the product of the norms
    most = F.ceil(F.col("top") * F.lit(top or 0.0) * 1.000001 + 1)
    state = saved(asked.select("block", F.posexplode("row").alias("at", "query"), (-most).alias("low"), (2 * most + 1).alias("span"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open")), "state")
    while state.where("open").limit(1).count():
        live = state.join(state.where("open").select("block").distinct().hint("merge"), "block", "left_semi")
        found = met(live, _counted(bins, k), "query long, bin long, n long")
        seen = found.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1))
        hit = seen.withColumn("above", F.coalesce(above, F.lit(0))).join(state.where("open").select("query", "need").hint("merge"), "query")
        hit = hit.where("above < need and above + n >= need").select("query", "bin", "above", "n")
        step = F.expr(f"(span + {bins - 1}) div {bins}")  # as step_of
        # the bin becomes the interval; a query with fewer candidates than k takes all of them
        low = F.when(F.col("bin").isNull(), F.lit(int(_NONE))).otherwise(F.col("low") + F.col("bin") * step)
        many = F.lit(k) - F.col("need") + F.col("above") + F.col("n") > FEW * k
        found_ = {
            "low": F.when(F.col("open"), low).otherwise(F.col("low")),
            "need": F.col("need") - F.coalesce("above", F.lit(0)),
            "open": F.col("open") & F.col("bin").isNotNull() & (step > 1) & many,
            "span": F.when(F.col("open") & F.col("bin").isNotNull(), F.least(step, F.col("span") - F.col("bin") * step)).otherwise(F.col("span")),
        }
        after = state.join(hit.hint("merge"), "query", "left").withColumns(found_)
        old, state = state, saved(after.select(*state.columns), "state")
        discard(old)
    best = met(state, _taken(k), "query long, vec_id long, score long")
    by = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    named = kept.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(named.hint("merge"), "query").select("query_id", "rank", "vec_id", "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best for every vector whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH vecs AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score FROM vecs AS q JOIN vecs AS c ON c.r <> q.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) AS s WHERE rank <= 5"""
