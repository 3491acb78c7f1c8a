"""Contacts between the areas of a raster, from runs instead of pixels.

A run is a stretch of equal pixels in a row.  Runs of one row meet end to end; those of two rows meet in a sweep along the
line between them: run starts of both rows in order of x, each carrying the last run of either side, so that no pixel is
copied and nothing is joined.  A pixel is shuffled once, to its row; after that the data is as large as the runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of the stretches in which dilated runs meet others.
_BIN = 64


def runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """y, x0, x1 (inclusive) and ``keys`` of every run of pixels with equal keys."""
    row = W.partitionBy("y").orderBy("x")
    same = reduce(lambda a, b: a & b, [F.lag(k).over(row).eqNullSafe(F.col(k)) for k in keys], F.lag("x").over(row).eqNullSafe(F.col("x") - 1))
    numbered = pixels.select("x", "y", *keys).withColumn("__run", F.sum(F.when(same, 0).otherwise(1)).over(row))
    return numbered.groupBy("y", "__run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), *[F.first(k).alias(k) for k in keys]).drop("__run")


def touching(found: DataFrame, keys: list[str]) -> DataFrame:
    """x, y, n, upright, a, b of every stretch of ``n`` sides in which two runs touch.

    ``a`` and ``b`` hold the keys of the left and the right run (upright, one side, x and y of the left pixel) or of the upper and the
    lower one (x and y of the first upper pixel).
    """
    own = F.struct("x0", "x1", *keys)
    row = W.partitionBy("y").orderBy("x0")
    key = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in keys])
    beside = found.select("y", own.alias("a"), F.lead(own).over(row).alias("b")).where("b.x0 = a.x1 + 1")
    beside = beside.select(F.col("a.x1").alias("x"), "y", F.lit(1).cast("long").alias("n"), F.lit(True).alias("upright"), key("a").alias("a"), key("b").alias("b"))
    lines = found.select("y", "x0", F.lit(0).alias("side"), own.alias("run")).unionByName(found.select((F.col("y") - 1).alias("y"), "x0", F.lit(1).alias("side"), own.alias("run")))
    line = W.partitionBy("y").orderBy("x0", "side")
    last = lambda s: F.last(F.when(F.col("side") == s, F.col("run")), ignorenulls=True).over(line)
    swept = lines.select("y", "x0", last(0).alias("a"), last(1).alias("b"), F.lead("x0").over(line).alias("next"))
    end = F.least("a.x1", "b.x1", F.col("next") - 1)
    swept = swept.where("a is not null and b is not null").withColumn("n", end - F.col("x0") + 1).where("n > 0")
    return beside.unionByName(swept.select(F.col("x0").alias("x"), "y", F.col("n").cast("long").alias("n"), F.lit(False).alias("upright"), key("a").alias("a"), key("b").alias("b")))


def _metres(upright: Column | str, level: Column | str, width_m: float, height_m: float) -> Column:
    """An upright side is as long as a pixel is high."""
    return (F.col(upright) if isinstance(upright, str) else upright) * height_m + (F.col(level) if isinstance(level, str) else level) * width_m


def sums(pixels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both ways between areas: a, b, upright, level sides (an area's sides to itself twice); and every area's own runs and pixels."""
    found = runs(pixels, keys)
    met = touching(found, keys)
    count = [F.sum(F.when(F.col("upright"), F.col("n")).otherwise(0)).alias("upright"), F.sum(F.when(F.col("upright"), 0).otherwise(F.col("n"))).alias("level")]
    once = met.groupBy("a", "b").agg(*count)
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "upright", "level")).groupBy("a", "b").agg(F.sum("upright").alias("upright"), F.sum("level").alias("level"))
    areas = found.groupBy(F.struct(*keys).alias("a")).agg(F.count("*").alias("runs"), F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))
    return both, areas


def open_sides(both: DataFrame, areas: DataFrame) -> DataFrame:
    """a, open_upright, open_level: sides of each area to no pixel. It has two upright ones a run and two level ones a pixel."""
    met = both.groupBy("a").agg(F.sum("upright").alias("u"), F.sum("level").alias("l"))
    rows = areas.join(met, "a", "left").fillna(0, ["u", "l"])
    return rows.select("a", (2 * F.col("runs") - F.col("u")).alias("open_upright"), (2 * F.col("pixels") - F.col("l")).alias("open_level"))


def adjacency(pixels: DataFrame, width_m: float = 1.0, height_m: float = 1.0) -> DataFrame:
    """component_id, other_component_id, their classes, contact (sides), contact_m (their length in metres), and closed: no side of the component is to no pixel."""
    from loamgrid.sources.scratch import saved

    both, areas = sums(pixels, ["component_id", "class_index"])
    both = saved(both, "contacts")
    free = open_sides(both, areas).select("a", (F.col("open_upright") + F.col("open_level") == 0).alias("closed"))
    names = [F.col("a.component_id").alias("component_id"), F.col("a.class_index").alias("class_index"), F.col("b.component_id").alias("other_component_id"), F.col("b.class_index").alias("other_class_index")]
    met = both.where("a.component_id <> b.component_id").join(free, "a")
    return met.select(*names, (F.col("upright") + F.col("level")).alias("contact"), _metres("upright", "level", width_m, height_m).alias("contact_m"), "closed")


def component_open_sides(pixels: DataFrame) -> DataFrame:
    """component_id, open: sides of a component to no pixel."""
    both, areas = sums(pixels, ["component_id"])
    return open_sides(both, areas).select("a.component_id", (F.col("open_upright") + F.col("open_level")).alias("open"))


def boundary_lengths(labels: DataFrame, width_m: float = 1.0, height_m: float = 1.0) -> DataFrame:
    """For each class the sides to another class, and to no pixel, and their lengths in metres of pixels of that width and height."""
    both, areas = sums(labels, ["class_index"])
    inner = both.where("a.class_index <> b.class_index").groupBy("a").agg(F.sum("upright").alias("iu"), F.sum("level").alias("il"))
    rows = open_sides(both, areas).join(inner, "a", "left").fillna(0, ["iu", "il"])
    return rows.select("a.class_index", (F.col("iu") + F.col("il")).alias("internal"), (F.col("open_upright") + F.col("open_level")).alias("outer"), _metres("iu", "il", width_m, height_m).alias("internal_m"), _metres("open_upright", "open_level", width_m, height_m).alias("outer_m"))


def segments(labels: DataFrame, by: str) -> DataFrame:
    """``by``, segments: sides between classes, counted for the left or the upper pixel."""
    keys = ["class_index", by]
    met = touching(runs(labels, keys), keys).where("a.class_index <> b.class_index")
    return met.groupBy(F.col(f"a.{by}").alias(by)).agg(F.sum("n").alias("segments"))


def boundary_cells(labels: DataFrame) -> DataFrame:
    """x, y of pixels with a 4-neighbour of another class."""
    met = touching(runs(labels, ["class_index"]), ["class_index"]).where("a.class_index <> b.class_index")
    pair = F.when(F.col("upright"), F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y"))))
    along = F.sequence("x", F.col("x") + F.col("n") - 1)
    row = lambda d: F.transform(along, lambda x: F.struct(x.alias("x"), (F.col("y") + d).alias("y")))
    rows = F.concat(row(0), row(1))
    return met.select(F.explode(F.coalesce(pair, rows)).alias("c")).select("c.x", "c.y").distinct()


def ring(pixels: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """component_id, class_index, other_component_id, other_class_index, contact: distinct pixels of the other component at a side or corner.

    With ``sources`` (component_id) only for these components. Their runs widen by a pixel all around, overlapping ones of a
    component and row become one, and meet the runs of others in stretches of the row.
    """
    keys = ["component_id", "class_index"]
    found = runs(pixels, keys)
    own = found if sources is None else found.join(sources.select("component_id").distinct(), "component_id", "left_semi")
    wide = own.select(*keys, F.explode(F.array(*[F.col("y") + d for d in (-1, 0, 1)])).alias("y"), (F.col("x0") - 1).alias("lo"), (F.col("x1") + 1).alias("hi"))
    at = W.partitionBy("component_id", "y").orderBy("lo", "hi")
    reach = F.max("hi").over(at.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("lo") <= reach + 1, 0).otherwise(1)).over(at)
    wide = wide.withColumn("reach", reach).withColumn("island", island).groupBy(*keys, "y", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cut = lambda df, a, b: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / _BIN), F.floor(F.col(b) / _BIN))))
    other = cut(found.select("y", "x0", "x1", *[F.col(k).alias(f"other_{k}") for k in keys]), "x0", "x1")
    first = F.greatest("lo", "x0")
    met = cut(wide, "lo", "hi").join(other, ["y", "bin"]).where((F.least("hi", "x1") >= first) & (F.floor(first / _BIN) == F.col("bin")) & (F.col("component_id") != F.col("other_component_id")))
    return met.groupBy(*keys, "other_component_id", "other_class_index").agg(F.sum(F.least("hi", "x1") - first + 1).alias("contact"))
