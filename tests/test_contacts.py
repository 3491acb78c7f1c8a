"""Contacts from runs against looking at every pixel's neighbours."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from loamgrid.operators import contacts


def drawn(seed, wide=30, high=12, holes=0.1, classes=3):
    r = random.Random(seed)
    return {(x, y): (r.randrange(4), r.randrange(classes)) for x in range(-3, wide) for y in range(2, high) if r.random() >= holes}


def table(spark, cells):
    return spark.createDataFrame([(x, y, i, k, y % 3) for (x, y), (i, k) in cells.items()], "x long, y long, component_id long, class_index long, part long")


@pytest.mark.parametrize(("seed", "holes"), [(1, 0.0), (2, 0.15), (3, 0.6)])
def test_sums_equal_pixels(spark, seed, holes):
    cells = {c: (k, k) for c, (_, k) in drawn(seed, holes=holes).items()}
    want, open_ = Counter(), Counter()
    for (x, y), (i, _) in cells.items():
        for a, b, metres in ((1, 0, 0.5), (-1, 0, 0.5), (0, 1, 2.0), (0, -1, 2.0)):
            d = cells.get((x + a, y + b))
            open_[i] += d is None
            if d and d[0] != i:
                want[i, d[0]] += 1
                want[i, d[0], "m"] += metres
    df = table(spark, cells)
    got = {(r.component_id, r.other_component_id): (r.contact, r.contact_m, r.closed) for r in contacts.adjacency(df, 2.0, 0.5).collect()}
    assert got == {k: (n, want[*k, "m"], open_[k[0]] == 0) for k, n in want.items() if len(k) == 2}
    assert {r.component_id: r.open for r in contacts.component_open_sides(df).collect()} == {i: open_[i] for i, _ in cells.values()}
    edge = {c for c, (i, _) in cells.items() for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (d := cells.get((c[0] + a, c[1] + b))) and d[0] != i}
    assert {(r.x, r.y) for r in contacts.boundary_cells(df).collect()} == edge
    sides = Counter(c[1] % 3 for c, (i, _) in cells.items() for d in ((c[0] + 1, c[1]), (c[0], c[1] + 1)) if d in cells and cells[d][0] != i)
    assert {r.part: r.segments for r in contacts.segments(df, "part").collect()} == sides


@pytest.mark.parametrize("only", [None, [0, 2]])
def test_rings_equal_pixels(spark, only):
    """Long runs over several stretches, holes, components that surround one another."""
    cells = drawn(5, wide=150, high=8) | {(x, 9): (9, 1) for x in range(-3, 150)}
    cells = {c: (i, i % 3) for c, (i, _) in cells.items()}
    near = {(cells[c][0], d) for c in cells for d in ((c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if d in cells and cells[d][0] != cells[c][0]}
    want = Counter((i, cells[d][0]) for i, d in near if only is None or i in only)
    df = table(spark, cells)
    sources = None if only is None else df.where(f"component_id in ({', '.join(map(str, only))})")
    assert {(r.component_id, r.other_component_id): r.contact for r in contacts.ring(df, sources).collect()} == want


def test_no_pixels(spark):
    df = table(spark, {})
    assert contacts.adjacency(df).count() == contacts.boundary_lengths(df).count() == contacts.ring(df).count() == contacts.boundary_cells(df).count() == 0
