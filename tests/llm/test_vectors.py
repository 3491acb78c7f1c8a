"""Clustering and search over vectors against plain loops."""

from __future__ import annotations

import math
import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import centroids, exact_topk
from tests.compare import differences

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, rank string, row string, v string, query string, low string"


def table(spark, rows, schema=SCHEMA):
    """Rows (vec_id, embedding) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, 0, "c", "c", "c", "c", "c", "c") for i, v in rows], schema)


def vectors(n, width=64, seed=1, groups=0):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [[float(np.float32(r.gauss(0, 0.1) + (middle[i % groups][k] if groups else 0))) for k in range(width)] for i in range(n)]


def odd_rows(width=64):
    """Null and broken vectors, null ids, repeated rows and ids, ties, other lengths, huge numbers."""
    base = vectors(40, width, 7)
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100, None), (150, []), (200, base[0][:-1] + [None]), (250, base[0][:-1] + [math.nan]), (300, base[0][:-1] + [math.inf]), (350, base[1][:-1]), (400, base[1] + [1.0])]
    rows += [(0, base[0]), (0, base[0]), (50, base[3]), (50, base[4]), (None, base[5]), (None, base[0]), (450, [0.0] * width), (500, [3e38] * width), (-50, [-3e38] * width)]
    return rows + [(1000 + i, base[2]) for i in range(30)]


def whole(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def floors(v, scale):
    limit = 1 << 25
    return [math.floor(max(-limit, min(limit, scale * x))) for x in v]


# ---- clustering ----


def brute_clusters(rows, width=64, k=16, rounds=3):
    kept = [(i, floors(v, 64)) for i, v in whole(rows) if len(v) == width]
    name = lambda i: (i is None, sha256(f"1:{i}".encode()).hexdigest())
    state = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in state]
            out.append((i, far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(state)):
            own = [v for (_, v), (_, at, _) in zip(kept, found, strict=True) if at == c]
            if own:
                state[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found, most = assign(), (1 << 63) - 1
    own = {c: sum(d for _, at, d in found if at == c) for c in range(len(state))}
    return sorted([(i, c, d, min(own[c], most), min(sum(own.values()), most), sha256(",".join(map(str, state[c])).encode()).hexdigest()) for i, c, d in found], key=str)


def clusters(df, **kind):
    out = centroids.cluster_vectors(df, 64, **kind).drop("tested")
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rows = list(enumerate(vectors(300)))
    assert clusters(table(spark, rows).repartition(5)) == brute_clusters(rows)


def test_clusters_of_odd_rows(spark):
    rows = odd_rows()
    assert clusters(table(spark, rows)) == brute_clusters(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(i, v) for i, v in enumerate(vectors(5))]
    assert clusters(table(spark, rows)) == brute_clusters(rows)
    assert clusters(table(spark, [])) == []
    assert clusters(table(spark, [(1, None), (2, [1.0])])) == []


def test_pivots_spare_distances(spark):
    """Vectors in groups: most centroids are ruled out by the pivots' table, and the result is that of measuring all."""
    rows = list(enumerate(vectors(400, groups=16)))
    out = centroids.cluster_vectors(table(spark, rows), 64)
    assert out.agg(F.avg("tested")).first()[0] < 8
    assert clusters(table(spark, rows)) == brute_clusters(rows)


@pytest.mark.parametrize("seed", range(5))
def test_bounds_never_lose_a_tie(seed):
    """Small grids have many equal distances; huge ones strain the doubles."""
    r = np.random.default_rng(seed)
    for top in (2, 1 << 25):
        rows, c, p = (r.integers(-top, top + 1, (n, 3)) for n in (200, 9, 4))
        pivot = np.stack([centroids.squared(rows, x[None, :]) for x in p], axis=1)
        best, dist, tested = centroids.nearest(rows, pivot, c, p)
        far = ((rows[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (best == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all() and (tested <= 9).all()


# ---- search ----


def brute_search(rows, every=50, k=5):
    kept = [(i, floors(v, 256)) for i, v in whole(rows)]
    out = []
    for n, (i, v) in enumerate(kept):
        if i is None or i % every:
            continue
        found = sorted([(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, m) for m, (j, w) in enumerate(kept) if m != n])
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j, _) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def searched(df, every=50, **kind):
    out = exact_topk.search(df, F.col("vec_id") % every == 0, **kind)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("kind", [{}, {"queries": 3, "candidates": 16, "bins": 7}, {"k": 40, "bins": 2}, {"k": 1}])
def test_search_equals_brute_force(spark, kind):
    rows = list(enumerate(vectors(240)))
    assert searched(table(spark, rows).repartition(3), 20, **kind) == brute_search(rows, 20, kind.get("k", 5))


@pytest.mark.parametrize("candidates", [8, 4096])
def test_search_of_odd_rows(spark, candidates):
    rows = odd_rows()
    assert searched(table(spark, rows), candidates=candidates) == brute_search(rows)


def test_search_among_copies(spark):
    """A third of all rows are one vector: ties go to the smallest ids, in blocks that are full of them."""
    base = vectors(60)
    rows = [(i, base[0] if i % 3 == 0 else base[i % 60]) for i in range(600)]
    random.Random(3).shuffle(rows)
    assert searched(table(spark, rows), candidates=32) == brute_search(rows)


def test_few_candidates_and_none(spark):
    for n in (0, 1, 3):
        rows = [(50 * i, v) for i, v in enumerate(vectors(n, 4))]
        assert searched(table(spark, rows)) == brute_search(rows)


def test_histograms_drop_only_what_cannot_hold_the_kth():
    r = np.random.default_rng(2)
    found = r.integers(-50, 50, (6, 80))
    low, span = np.full(6, -50), np.full(6, 101)
    q, b, n = exact_topk.histogram(found, low, span, 10, 5)
    for i in range(6):
        full = np.bincount((found[i] + 50) // 11, minlength=10)
        kth = (np.sort(found[i])[-5] + 50) // 11
        assert dict(zip(b[q == i].tolist(), n[q == i].tolist(), strict=True)) == {x: full[x] for x in range(kth, 10) if full[x]}


def test_sql_reads_the_same_rows(spark, tmp_path):
    """The registered queries' SQL over odd rows too, but for numbers beyond the limit."""
    import duckdb

    from loamgrid.llm.queries import ORACLE_SQL, QUERIES

    rows = [r for r in odd_rows() if r[1] is None or all(x is None or not abs(x) > 1e30 or math.isinf(x) for x in r[1])]
    table(spark, rows).select("vec_id", "embedding", "label").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("op12_centroid_clustering", "op13_exact_topk"):
        assert not differences(QUERIES[name], ORACLE_SQL[name], spark, str(tmp_path), db), name
