"""Exact centroid clustering with a LAESA pivot table.

Every vector's distances to a few fixed pivots are measured once and saved beside it.  In each round a centroid's distances to the
same pivots are known too, and by the triangle inequality no vector is nearer to a centroid than the largest difference
of their pivot distances.  A vector is first measured against the centroid with the smallest such bound; of the others only those
whose bound does not exceed that distance are measured.  All distances are squared integers, so nothing is rounded;
bounds are doubles and give way by more than their rounding error, so they never rule out a nearest centroid or a tie.

Centroids and pivots are the only state on the driver: ``k`` and ``pivots`` vectors.  A round is one pass over the saved
table, which returns one row of sums for each centroid and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.shared import saved, table
from loamgrid.llm.vectors import integers, matrix, usable

CLUSTERS, ROUNDS, PIVOTS = 16, 3, 8
#: Bounds give way by this share, far more than the rounding of a square root.
_SLACK = 1e-9
#: Rows measured at a time.
_ROWS = 4096
_LONG = (1 << 63) - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two tables of one width, exactly."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, or fewer, that lie far apart: the first, then each time the one farthest from those taken."""
    if not len(vectors):
        return vectors
    taken, near = [0], squared(vectors, vectors[:1])
    while len(taken) < n and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, squared(vectors, vectors[taken[-1:]]))
    return vectors[taken]


def nearest(rows: np.ndarray, pivot: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the first of equal ones), its squared distance, and how many centroids were measured.

    ``pivot``: the rows' squared distances to the pivots.
    """
    n, k = len(rows), len(centroids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.sqrt(np.stack([squared(centroids, p[None, :]) for p in pivots], axis=1).astype(float))
    far = np.sqrt(pivot.astype(float))
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(far[:, p, None] - own[None, :, p]) - _SLACK * (far[:, p, None] + own[None, :, p]), out=bound)
    first = bound.argmin(axis=1)
    dist = np.full((n, k), _LONG, np.int64)
    at = np.arange(n)
    dist[at, first] = squared(rows, centroids[first])
    limit = np.sqrt(dist[at, first].astype(float)) * (1 + _SLACK) + _SLACK
    alive = bound <= limit[:, None]
    alive[at, first] = False
    for c in range(k):
        left = np.flatnonzero(alive[:, c])
        dist[left, c] = squared(rows[left], centroids[c][None, :])
    best = dist.argmin(axis=1)
    return best, dist[at, best], alive.sum(axis=1) + 1


def _measured(pivots: np.ndarray):
    """``pivot``: squared distances of each vector to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"), pivots.shape[1])
            each = np.stack([squared(rows, p[None, :]) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(pivots)), pa.array(each.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "pivot"])

    return run


def _pieces(batch: pa.RecordBatch, width: int, pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for a in range(0, batch.num_rows, _ROWS):
        part = batch.slice(a, _ROWS)
        yield part, matrix(part.column("v"), width), matrix(part.column("pivot"), pivots)


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """cluster, n, s0, s1, ...: this task's vectors by nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, rows, pivot in _pieces(batch, centroids.shape[1], len(pivots)):
                best, _, _ = nearest(rows, pivot, centroids, pivots)
                n += np.bincount(best, minlength=len(n))
                np.add.at(total, best, rows)
        names = ["cluster", "n", *[f"s{i}" for i in range(centroids.shape[1])]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), *[pa.array(c) for c in np.ascontiguousarray(total.T)]], names=names)

    return run


def _assigned(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, pivot in _pieces(batch, centroids.shape[1], len(pivots)):
                best, dist, tested = nearest(rows, pivot, centroids, pivots)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(dist), pa.array(tested.astype(np.int32))], names=["vec_id", "cluster", "distance", "tested"])

    return run


def cluster_vectors(vectors: DataFrame, width: int, scale: int = 64, k: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """Each vector's cluster after some rounds of k-means on integers, with exact distances and sums.

    ``vectors`` needs vec_id and embedding; other columns are ignored.  Vectors of exactly ``width`` components, none null or non-finite,
    take part, components as floor(``scale`` * x), held to ``LIMIT`` of ``vectors``.  The first centroids are the ``k`` vectors
    with the smallest sha256 of ``1:`` and the id (fewer if there are fewer; rows that share an id by their components; no id last).  A
    centroid becomes the floor of its vectors' mean; without vectors it stays.  Repeated rows count and come back each.

    Returns vec_id, cluster, distance (squared), tested (centroids measured for it at the end), cluster_inertia, inertia and
    centroid_sha256.  Inertias beyond a long are given as its largest value.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == width)).select(F.col("vec_id").cast("long"), integers(F.col("embedding"), scale).alias("v"))
    kept = saved(kept, "vectors")
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    state = np.array([r.v for r in first], np.int64).reshape(len(first), width)
    fixed = spread(state, pivots)
    if len(state):
        kept = saved(kept.mapInArrow(_measured(fixed), "vec_id long, v array<int>, pivot array<long>"), "pivot_distances")
    names = [f"s{i}" for i in range(width)]
    for _ in range(rounds if len(state) else 0):
        each = kept.mapInArrow(_sums(state, fixed), "cluster long, n long, " + ", ".join(f"{s} long" for s in names))
        sums = each.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names])
        state = state.copy()
        for r in sums.where("n > 0").collect():  # k rows
            state[r.cluster] = [int(r[s]) // r.n for s in names]
    schema = "vec_id long, cluster int, distance long, tested int"
    if not len(state):
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    out = saved(kept.mapInArrow(_assigned(state, fixed), schema), "assigned")
    own = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    whole = min(sum(own.values()), _LONG)
    rows = [(c, min(s, _LONG), whole, sha256(",".join(map(str, state[c].tolist())).encode()).hexdigest()) for c, s in own.items()]
    kind = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    return out.join(F.broadcast(spark.createDataFrame(rows, kind)), "cluster").select("vec_id", "cluster", "distance", "tested", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters after three rounds."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"), 64).drop("tested")


def _sql(rounds: int) -> str:
    steps = ["""
vecs AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vecs ORDER BY h NULLS LAST, v LIMIT 16) AS s)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT vecs.r, vecs.vec_id, vecs.v, c, list_sum(list_transform(list_zip(vecs.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM vecs, c{i}) AS x
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(q ORDER BY p) AS v FROM (
  SELECT c, p, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS q FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) AS u GROUP BY c, p) AS w GROUP BY c) AS m USING (c))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


OP12_SQL = _sql(ROUNDS)
