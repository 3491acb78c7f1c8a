"""Areas that boxes leave open, claim twice or claim outside a range, without listing cells.

Boxes are half-open and have integer corners.  Each is cut at the edges of square blocks; of a cut box only its four corners
go on, as steps up and down that are summed where they coincide.  So a block holds at most as many corners as points, however
many boxes lie in it, and two running sums along its axes give the number of claims everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a block.
_BLOCK = 256


def _corners(boxes: DataFrame, block: int, name: str) -> DataFrame:
    """bx, by, x, y (within the block, up to its far edge) and the step ``name``."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(b) - 1) / block)))
    parts = boxes.where("x1 > x0 and y1 > y0").select("x0", "y0", "x1", "y1", cut("x0", "x1").alias("bx")).select("*", cut("y0", "y1").alias("by"))
    low = lambda c, b: F.greatest(F.col(c) - F.col(b) * block, F.lit(0))
    high = lambda c, b: F.least(F.col(c) - F.col(b) * block, F.lit(block))
    ends = {"x": (low("x0", "bx"), high("x1", "bx")), "y": (low("y0", "by"), high("y1", "by"))}
    step = F.array(*[F.struct(x.alias("x"), y.alias("y"), F.lit(1 if i == j else -1).alias(name)) for i, x in enumerate(ends["x"]) for j, y in enumerate(ends["y"])])
    return parts.select("bx", "by", F.explode(step).alias("c")).groupBy("bx", "by", "c.x", "c.y").agg(F.sum(f"c.{name}").alias(name))


def areas(claims: DataFrame, wanted: DataFrame, block: int = _BLOCK) -> DataFrame:
    """gap, overlap, outside of every block (bx, by): wanted and not claimed, claimed again within the range, claimed (once or more) beyond it.

    Both tables hold boxes x0, y0, x1, y1; those without area count for nothing. Boxes of ``wanted`` may overlap. A group is a block.
    """
    import numpy as np
    import pyarrow as pa

    both = _corners(claims, block, "claim").withColumn("want", F.lit(0).cast("long")).unionByName(_corners(wanted, block, "want").withColumn("claim", F.lit(0).cast("long")))

    def swept(rows: pa.Table) -> pa.Table:
        x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
        count = {}
        for name in ("claim", "want"):
            at = np.zeros((block + 1, block + 1), np.int64)
            np.add.at(at, (x, y), rows.column(name).to_numpy())
            count[name] = at.cumsum(0).cumsum(1)
        claim, want = count["claim"], count["want"] > 0
        found = {"gap": (want & (claim == 0)).sum(), "overlap": (claim - 1)[want & (claim > 1)].sum(), "outside": (~want & (claim > 0)).sum()}
        return pa.table({c: rows.column(c)[:1] for c in ("bx", "by")} | {k: pa.array([int(v)]) for k, v in found.items()})

    return both.groupBy("bx", "by").applyInArrow(swept, "bx long, by long, gap long, overlap long, outside long")


def coverage(claims: DataFrame, wanted: DataFrame, block: int = _BLOCK) -> DataFrame:
    """One row: gap, overlap and outside over the whole plane."""
    return areas(claims, wanted, block).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gap", "overlap", "outside")])
