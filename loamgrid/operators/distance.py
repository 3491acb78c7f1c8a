"""Exact distance to the nearest of many cells: first among those around, then by descent through blocks.

Cells meet the others of their tile and of a margin around it; a distance that reaches no farther than the margin is
the least there is.  Only cells that are not sure yet go on: they and all others are seen as blocks with the bounding box of what they hold, from
one block for all down to blocks of ``block`` cells.  At each level a block of queries keeps the blocks that can still hold a nearest cell: those no
farther off than the farthest corner of the one that is surely near.  Their children are all that the next level looks at, so that the
work follows the cells, not the area between them or a radius.

Within a tile or a block's lot, a cell looks at columns only, nearest first on either side, and in each at the next cell above and
below; it stops at a column that is farther off than what it has found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.sources.scratch import discard, saved

#: Children of a block along each axis; a tile's side in blocks.
_FACTOR = 4
#: Squared distances are compared with this slack.
_EPS = 1e-9
#: Rows that pass Python at once, if a lot is not larger.
_ROWS = 1 << 18


def _blocks(cells: DataFrame, side: int, prefix: str) -> DataFrame:
    """The blocks of cells (u, v): number along both axes and the box of their cells."""
    at = [F.floor(F.col(c) / side).alias(f"{prefix}{c}") for c in ("u", "v")]
    box = [f(c).alias(f"{prefix}{c}{n}") for c in ("u", "v") for f, n in ((F.min, 0), (F.max, 1))]
    return cells.groupBy(*at).agg(*box)


def _parents(blocks: DataFrame, times: int, prefix: str) -> DataFrame:
    """Blocks ``times`` as wide, from the blocks within them."""
    at = [F.floor(F.col(f"{prefix}{c}") / times).alias(f"{prefix}{c}") for c in ("u", "v")]
    box = [f(f"{prefix}{c}{n}").alias(f"{prefix}{c}{n}") for c in ("u", "v") for f, n in ((F.min, 0), (F.max, 1))]
    return blocks.groupBy(*at).agg(*box)


def _axis(c: str, size: float, far: bool):
    """Least or largest distance of two boxes along an axis."""
    a, b = F.col(f"q{c}0") - F.col(f"s{c}1"), F.col(f"s{c}0") - F.col(f"q{c}1")
    gap = F.greatest(F.abs(F.col(f"q{c}1") - F.col(f"s{c}0")), F.abs(F.col(f"s{c}1") - F.col(f"q{c}0"))) if far else F.greatest(a, b, F.lit(0))
    return gap * F.lit(float(size))


def _steps(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _least(lot: np.ndarray, u: np.ndarray, v: np.ndarray, site: np.ndarray, width_m: float, height_m: float) -> np.ndarray:
    """Distance of every row that is no site to the nearest site of its lot, infinite without one; rows are sorted by lot and u."""
    column = np.cumsum(_steps(lot, u)) - 1
    count = np.bincount(column[site], minlength=column[-1] + 1) > 0
    rank = np.cumsum(count) - count
    _, level = np.unique(v, return_inverse=True)
    span = level.max() + 1
    at = np.flatnonzero(site)
    key = rank[column[at]] * span + level[at]
    order = np.argsort(key)
    key, height = key[order], v[at][order]
    first = at[_steps(column[at])]
    place, owner = u[first], lot[first]
    ask = np.flatnonzero(~site)
    best = np.full(len(ask), np.inf)
    for step in (1, -1):
        now = np.arange(len(ask))
        col = rank[column[ask]] - (step < 0)
        while len(now):
            # out of the lot's columns, or too far
            inside = (col >= 0) & (col < len(place))
            now, col = now[inside], col[inside]
            q = ask[now]
            gap = ((place[col] - u[q]) * width_m) ** 2
            near = (owner[col] == lot[q]) & (gap < best[now])
            now, col, q, gap = now[near], col[near], q[near], gap[near]
            wanted = col * span + level[q]
            above = np.searchsorted(key, wanted)
            for i in (np.minimum(above, len(key) - 1), np.maximum(above - 1, 0)):
                found = gap + ((height[i] - v[q]) * height_m) ** 2
                best[now] = np.where(key[i] // span == col, np.minimum(best[now], found), best[now])
            col = col + step
    return np.sqrt(best)


def _lots(width_m: float, height_m: float):
    """Batches of bu, bv, u, v, site, sorted, to u, v, distance of the cells asked; a lot (bu, bv) is held whole."""

    def answer(rows: list[np.ndarray]) -> pa.RecordBatch:
        bu, bv, u, v, site = rows
        distance = _least(np.cumsum(_steps(bu, bv)), u, v, site, width_m, height_m)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (bu[~site], bv[~site], u[~site], v[~site], distance)], names=["bu", "bv", "u", "v", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
            if size >= _ROWS:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.flatnonzero(_steps(rows[0], rows[1]))[-1])
                if cut:
                    yield answer([c[:cut] for c in rows])
                held, size = [[c[cut:] for c in rows]], len(rows[0]) - cut
        if size:
            yield answer([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _met(asked: DataFrame, sites: DataFrame, width_m: float, height_m: float) -> DataFrame:
    """bu, bv, u, v, distance of the cells asked to the nearest site with their bu, bv."""
    both = asked.select("bu", "bv", "u", "v", F.lit(False).alias("site")).unionByName(sites.select("bu", "bv", "u", "v", F.lit(True).alias("site")))
    return both.repartition("bu", "bv").sortWithinPartitions("bu", "bv", "u").mapInArrow(_lots(width_m, height_m), "bu long, bv long, u long, v long, distance double")


def nearest(cells: DataFrame, others: DataFrame, width_m: float = 1.0, height_m: float = 1.0, block: int = 32) -> DataFrame:
    """x, y, distance of every different cell to the nearest of ``others``, between centres of pixels of that width and height; null without others.

    A lot that Python holds is a tile of ``block * 4`` cells a side with a margin of half a block, or a block of queries with the cells of the blocks
    that it has kept.
    """
    asked, sites = (df.where("x is not null and y is not null").select(F.col("x").cast("long").alias("u"), F.col("y").cast("long").alias("v")).distinct() for df in (cells, others))
    sites = saved(sites, "sites")
    if not sites.head(1):
        return asked.select(F.col("u").alias("x"), F.col("v").alias("y"), F.lit(None).cast("double").alias("distance"))
    tile, margin = block * _FACTOR, max(1, block // 2)
    floor = lambda c, shift=0: F.floor((F.col(c) + shift) / tile)
    around = sites
    for c in ("u", "v"):
        around = around.withColumn("b" + c, F.explode(F.sequence(floor(c, -margin), floor(c, margin))))
    first = _met(asked.withColumns({"bu": floor("u"), "bv": floor("v")}), around, width_m, height_m)
    # steps to the nearest cell outside tile and margin, along each axis
    reach = lambda c: F.least(F.col(c) - F.col("b" + c) * tile, (F.col("b" + c) + 1) * tile - 1 - F.col(c)) + margin + 1
    first = saved(first.withColumn("sure", F.col("distance") <= F.least(reach("u") * F.lit(float(width_m)), reach("v") * F.lit(float(height_m)))), "near")
    out = first.where("sure").select("u", "v", "distance")
    left = first.where("not sure").select("u", "v")
    if left.head(1):
        out = out.unionByName(_descent(left, sites, width_m, height_m, block))
    return out.select(F.col("u").alias("x"), F.col("v").alias("y"), "distance")


def _descent(asked: DataFrame, sites: DataFrame, width_m: float, height_m: float, block: int) -> DataFrame:
    """u, v, distance of the cells asked to the nearest of all sites."""
    q0, s0 = saved(_blocks(asked, block, "q"), "asked"), saved(_blocks(sites, block, "s"), "blocks")
    box = lambda df, p: df.select(*[F.col(f"{p}{c}").alias(c) for c in ("u0", "v0", "u1", "v1")])
    frame = box(q0, "q").unionByName(box(s0, "s")).agg(F.min("u0"), F.min("v0"), F.max("u1"), F.max("v1")).first()
    # blocks are counted from the one with the least cells
    base = {c: frame[i] // block for i, c in enumerate("uv")}
    q0, s0 = (df.withColumns({p + c: F.col(p + c) - base[c] for c in "uv"}) for df, p in ((q0, "q"), (s0, "s")))
    extent, times = max(frame[2] // block - base["u"], frame[3] // block - base["v"]) + 1, [1]
    while times[-1] < extent:
        times.append(times[-1] * _FACTOR)
    pairs = None
    for wide in reversed(times):
        q, s = _parents(q0, wide, "q"), _parents(s0, wide, "s")
        if pairs is None:
            met = q.join(s, (F.col("qu") == F.col("su")) & (F.col("qv") == F.col("sv")))  # one block each
        else:
            up = lambda c: F.floor(F.col(c) / _FACTOR).alias("p" + c)
            met = pairs.join(q.select("*", up("qu"), up("qv")), ["pqu", "pqv"]).join(s.select("*", up("su"), up("sv")), ["psu", "psv"])
        low = _axis("u", width_m, False) ** 2 + _axis("v", height_m, False) ** 2
        high = _axis("u", width_m, True) ** 2 + _axis("v", height_m, True) ** 2
        met = met.select("qu", "qv", "su", "sv", low.alias("low"), F.min(high).over(W.partitionBy("qu", "qv")).alias("most"))
        before, pairs = pairs, saved(met.where(F.col("low") <= F.col("most") * (1 + _EPS)).select(*[F.col(c).alias("p" + c) for c in ("qu", "qv", "su", "sv")]), "blocks")
        if before is not None:
            discard(before)
    at = lambda df, u, v: df.withColumns({u: F.floor(F.col("u") / block) - base["u"], v: F.floor(F.col("v") / block) - base["v"]})
    near = at(sites, "psu", "psv").join(pairs, ["psu", "psv"]).select(F.col("pqu").alias("bu"), F.col("pqv").alias("bv"), "u", "v")
    return _met(at(asked, "bu", "bv"), near, width_m, height_m).select("u", "v", "distance")
