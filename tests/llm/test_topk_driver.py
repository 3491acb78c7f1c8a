"""What exact top-k search asks of the driver and of a task, and that its scores are exact in every type."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import exact_topk
from loamgrid.sources.scratch import saved
from tests.llm.test_vectors import brute_search, table, vectors


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_is_broadcast_however_small(spark, monkeypatch):
    """Blocks of queries behind explode looked small to Spark, and their copies for all groups went through the driver."""
    seen = []

    def noted(df, name, *more):
        seen.append((name, _plan(df)))
        return saved(df, name, *more)

    monkeypatch.setattr(exact_topk, "saved", noted)
    rows = list(enumerate(vectors(240)))
    found = exact_topk.search(table(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, queries=3, candidates=16)
    seen.append(("result", _plan(found)))
    assert sum(name == "state" for name, _ in seen) > 1
    assert [name for name, plan in seen if "Broadcast" in plan or "CartesianProduct" in plan or "NestedLoop" in plan] == []
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_search(rows, 20)


def test_groups_are_even_and_bounded(spark, monkeypatch):
    """A task holds few blocks of candidates, whatever their number, and each group meets all queries."""
    taken = exact_topk._taken

    def watched(k):
        of = taken(k)

        def run(batches):
            batches, per = list(batches), {}
            for batch in batches:
                for grp, low, row in zip(*(batch.column(c).to_pylist() for c in ("grp", "low", "row")), strict=True):
                    per.setdefault(grp, [0, 0])[low is not None] += 1 if low is None else len(row)
            assert all(2 <= n <= 3 and asks == 32 for n, asks in per.values()), per
            yield from of(iter(batches))

        return run

    monkeypatch.setattr(exact_topk, "HELD", 3)
    monkeypatch.setattr(exact_topk, "_taken", watched)
    rows = list(enumerate(vectors(640, 4)))
    found = exact_topk.search(table(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, queries=5, candidates=8)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_search(rows, 20)


@pytest.mark.parametrize(("top", "kind"), [(500, np.float32), (600, np.float64), (1 << 25, np.int64)])
def test_scores_are_exact(top, kind):
    r = np.random.default_rng(4)

    def block(n, row, asks):
        m = r.integers(-top, top + 1, (n, 64))
        fields = {"n": [n], "width": [64], "most": [top], "m": [m.astype("<i4").tobytes()], "row": [list(range(row, row + n))], "vec_id": [list(range(n))[::-1]]}
        fields |= {"low": pa.array([[0] * n if asks else None], pa.list_(pa.int64())), "span": pa.array([[1] * n if asks else None], pa.list_(pa.int64()))}
        return exact_topk.Block(pa.RecordBatch.from_pydict(fields), 0), m

    (q, mq), (c, mc) = block(5, 7, True), block(9, 0, False)
    found, want = exact_topk.scores(q, c), mq @ mc[::-1].T  # candidates ascend by id
    own = np.array([[a == b for b in c.row] for a in q.row])
    assert found.dtype == kind and own.sum() == 2
    assert (found[~own].astype(np.int64) == want[~own]).all() and (found[own] < want.min()).all()
    # a bound parts the scores as whole numbers do
    for low in (want[0, 0], want[0, 0] + 1, -(1 << 62), -(1 << 63)):
        inside = found >= exact_topk._as(np.full(5, low), found)
        assert (inside == ((want >= low) & ~own)).all()


@pytest.mark.parametrize("kind", [np.float32, np.int64])
def test_blocks_one_by_one_count_as_together(kind):
    """Bins from the kth's on hold all scores, in whatever order the blocks come."""
    r = np.random.default_rng(5)
    found, low, span = r.integers(-500, 500, (6, 900)), np.full(6, -500), np.full(6, 1001)
    count, floor = np.zeros((6, 40), np.int64), low.copy()
    for part in np.split(found, 9, axis=1):
        exact_topk.tally(count, floor, part.astype(kind), low, span, 5)
    q, b, n = exact_topk.binned(count, 5)
    for i in range(6):
        full, kth = np.bincount((found[i] + 500) // 26, minlength=40), (np.sort(found[i])[-5] + 500) // 26
        assert dict(zip(b[q == i].tolist(), n[q == i].tolist(), strict=True)) == {x: full[x] for x in range(kth, 40) if full[x]}
        assert floor[i] == kth * 26 - 500
