"""Coverage of boxes against counting cells."""

from __future__ import annotations

import random

import pytest

from loamgrid.operators.coverage import areas, coverage


def cells(box):
    return [(x, y) for x in range(box[0], box[2]) for y in range(box[1], box[3])]


@pytest.mark.parametrize(("seed", "block"), [(1, 4), (2, 7), (3, 256)])
def test_areas_equal_cells(spark, seed, block):
    """Large and small boxes, empty and repeated ones, negative corners, a range of several parts that overlap."""
    r = random.Random(seed)
    boxes = [(x := r.randrange(-12, 40), y := r.randrange(-12, 30), x + r.choice([0, 1, 3, 20]), y + r.choice([1, 2, 9])) for _ in range(40)] + [(0, 0, 5, 5)] * 3 + [(9, 9, 3, 12)]
    wanted = [(-5, -5, 30, 20), (20, 10, 44, 26), (-5, -5, 2, 2)]
    count = {}
    for b in boxes:
        for c in cells(b):
            count[c] = count.get(c, 0) + 1
    inside = {c for b in wanted for c in cells(b)}
    df = lambda v: spark.createDataFrame(v, "x0 long, y0 long, x1 long, y1 long")
    want = (len(inside - count.keys()), sum(n - 1 for c, n in count.items() if c in inside), len(count.keys() - inside))
    assert tuple(coverage(df(boxes), df(wanted), block).first()) == want


def test_a_crowded_block_is_as_small_as_any(spark):
    many = spark.range(200_000).selectExpr("id % 50 as x0", "id % 40 as y0", "id % 50 + 1 + id % 60 as x1", "id % 40 + 1 + id % 70 as y1")
    plane = spark.createDataFrame([(0, 0, 200, 200)], "x0 long, y0 long, x1 long, y1 long")
    row = coverage(many, plane).first()
    area = many.selectExpr("sum((x1 - x0) * (y1 - y0))").first()[0]
    assert row.overlap == area - (40_000 - row.gap) and row.outside == 0


def test_no_boxes(spark):
    none, plane = (spark.createDataFrame(v, "x0 long, y0 long, x1 long, y1 long") for v in ([], [(0, 0, 300, 2)]))
    assert tuple(coverage(none, plane).first()) == (600, 0, 0)
    assert tuple(coverage(plane, none).first()) == (0, 0, 600)
    assert tuple(coverage(none, none).first()) == (0, 0, 0)
    assert areas(none, plane).count() == 2
