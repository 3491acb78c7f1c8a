"""Label rasters as pixel tables: runs, components, contacts, areas, comparisons.

Pixels are x, y, class_index; nodata pixels have no row.  ``WIDE`` must exceed every x.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.operators.graph import connected_components
from loamgrid.sources.scratch import saved

WIDE = 1 << 31
_STEPS_4 = ((1, 0), (-1, 0), (0, 1), (0, -1))
_STEPS_8 = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)


def cell(x: Column | str = "x", y: Column | str = "y") -> Column:
    """One number for a pixel; smallest for the topmost, then leftmost pixel."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return y.cast("long") * WIDE + x


def with_runs(labels: DataFrame) -> DataFrame:
    """Adds run_id: the first cell of the pixel's run of equal classes in its row."""
    at = W.partitionBy("y", "class_index").orderBy("x")
    island = labels.withColumn("__island", F.col("x") - F.row_number().over(at))
    first = F.min("x").over(W.partitionBy("y", "class_index", "__island"))
    return island.withColumn("run_id", cell(first, F.col("y"))).drop("__island")


def row_runs(labels: DataFrame) -> DataFrame:
    """y, class_index, x0, x1 (inclusive), pixels, run_id of every run."""
    runs = with_runs(labels).groupBy("y", "class_index", "run_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("pixels"))
    return runs.select("y", "class_index", "x0", "x1", "pixels", "run_id")


def run_components(labels: DataFrame, diagonal: bool = False) -> DataFrame:
    """run_id, component_id (smallest cell) of every run; a component is connected and of one class.

    Runs of neighbouring rows meet by equality of row and class; only their overlap is compared, so
    that edges are as many as runs, not pixels.
    """
    runs = row_runs(labels)
    a, b = runs.alias("a"), runs.withColumn("y", F.col("y") - 1).alias("b")
    reach = 1 if diagonal else 0
    touch = (F.col("a.y") == F.col("b.y")) & (F.col("a.class_index") == F.col("b.class_index")) & (F.col("a.x0") <= F.col("b.x1") + reach) & (F.col("b.x0") <= F.col("a.x1") + reach)
    edges = a.join(b, touch).select(F.col("a.run_id").alias("u"), F.col("b.run_id").alias("v"))
    alone = runs.select(F.col("run_id").alias("u"), F.col("run_id").alias("v"))
    return connected_components(edges.union(alone)).select(F.col("id").alias("run_id"), F.col("component").alias("component_id"))


#: Side of the tiles within which components are labelled first.
TILE = 256


def _label_tile(diagonal: bool):
    """Pixels of one tile with local_id: the smallest cell of each component within the tile."""
    import numpy as np

    ahead = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])

    def run(rows):
        x, y, kind = (rows[c].to_numpy() for c in ("x", "y", "class_index"))
        at = y.astype(np.int64) * WIDE + x
        order = np.argsort(at)
        at, kind, x = at[order], kind[order], x[order]
        u, v = [], []
        for dy, dx in ahead:
            to = np.minimum(np.searchsorted(at, at + dy * WIDE + dx), len(at) - 1)
            met = np.flatnonzero((at[to] == at + dy * WIDE + dx) & (kind[to] == kind))
            u.append(met)
            v.append(to[met])
        u, v = np.concatenate(u), np.concatenate(v)
        root = np.arange(len(at))
        while (root[u] != root[v]).any():
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while (root[root] != root).any():
                root = root[root]
        ids = np.empty(len(at), np.int64)
        ids[order] = at[root]
        return rows.assign(local_id=ids)

    return run


def with_components(labels: DataFrame, diagonal: bool = False, side: int = TILE) -> DataFrame:
    """Adds component_id (the component's smallest cell) to every pixel.

    Components are labelled within tiles of ``side`` pixels, one group a tile; then only contacts across the tiles' edges are
    joined, so that the graph has as many edges as the seams have contacts, not as the raster has pixels.
    """
    tiles = labels.withColumns({"__tx": F.floor(F.col("x") / side), "__ty": F.floor(F.col("y") / side)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema.fields) + ", local_id long"
    local = saved(tiles.groupBy("__tx", "__ty").applyInPandas(_label_tile(diagonal), schema).drop("__tx", "__ty"), "local")
    rim = F.least(F.col("x") % side, F.col("y") % side, side - 1 - F.col("x") % side, side - 1 - F.col("y") % side) == 0
    met = neighbours(local.where(rim).select("x", "y", "class_index", "local_id"), ["class_index", "local_id"], diagonal)
    links = met.where("class_index = other_class_index and local_id > other_local_id").select(F.col("local_id").alias("u"), F.col("other_local_id").alias("v")).distinct()
    joined = connected_components(links).select(F.col("id").alias("local_id"), F.col("component").alias("component_id"))
    return local.join(joined, "local_id", "left").withColumn("component_id", F.coalesce("component_id", "local_id")).drop("local_id")


def components(pixels: DataFrame) -> DataFrame:
    """component_id, class_index, pixel_count, bounding box and border contact of pixels with components."""
    edge = pixels.agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    shape = pixels.groupBy("component_id", "class_index").agg(F.count("*").alias("pixel_count"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    border = (F.col("x0") == F.col("left")) | (F.col("x1") == F.col("right")) | (F.col("y0") == F.col("top")) | (F.col("y1") == F.col("bottom"))
    return shape.join(F.broadcast(edge)).withColumn("touches_border", border).drop("left", "right", "top", "bottom")


def neighbours(pixels: DataFrame, keep: list[str], diagonal: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Each pixel with each neighbour in ``among`` (else itself): own columns, and ``keep`` of the neighbour as other_*.

    Every pixel is copied for each direction: for few pixels; ``contacts`` is for whole rasters.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in (_STEPS_8 if diagonal else _STEPS_4)])
    asked = pixels.withColumn("__s", F.explode(steps)).withColumn("__x", F.col("x") + F.col("__s.dx")).withColumn("__y", F.col("y") + F.col("__s.dy")).drop("__s")
    other = (pixels if among is None else among).select(F.col("x").alias("__x"), F.col("y").alias("__y"), *[F.col(c).alias(f"other_{c}") for c in keep])
    return asked.join(other, ["__x", "__y"]).drop("__x", "__y")


def confusion(reference: DataFrame, prediction: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ref, pred, pixels over the pixels that both have."""
    by = by or []
    both = reference.select("x", "y", *by, F.col("class_index").alias("ref")).join(prediction.select("x", "y", F.col("class_index").alias("pred")), ["x", "y"])
    return both.groupBy(*by, "ref", "pred").agg(F.count("*").alias("pixels"))


def segmentation_metrics(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """valid_pixels, accuracy, miou of a confusion matrix; classes that neither side has don't count."""
    by = by or []
    hit = F.sum(F.when(F.col("ref") == F.col("pred"), F.col("pixels")).otherwise(0))
    sides = matrix.select(*by, F.explode(F.array(F.struct(F.col("ref").alias("c"), F.lit(1).alias("is_ref")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("is_ref")))).alias("s"), "ref", "pred", "pixels")
    per = sides.groupBy(*by, "s.c").agg(F.sum("pixels").alias("both"), F.sum(F.when((F.col("ref") == F.col("pred")) & (F.col("s.is_ref") == 1), F.col("pixels")).otherwise(0)).alias("tp"))
    iou = per.groupBy(*by).agg(F.avg(F.col("tp") / (F.col("both") - F.col("tp"))).alias("miou"))
    whole = matrix.groupBy(*by).agg(F.sum("pixels").alias("valid_pixels"), (hit / F.sum("pixels")).alias("accuracy"))
    return whole.join(iou, by) if by else whole.join(F.broadcast(iou))


def seam_band(x: Column, y: Column, side: int, reach: int) -> Column:
    """Within ``reach`` pixels of an inner line between partitions."""
    near = lambda c: ((c % side) >= side - reach) | (((c % side) < reach) & (c >= side))
    return near(x) | near(y)


def seam_transitions(labels: DataFrame, side: int) -> DataFrame:
    """orientation, pixel (first of the far side), rate of label changes across each line between partitions."""
    across = lambda axis, o: labels.where(F.col(axis) % side == 0).select(F.lit(o).alias("orientation"), F.col(axis).alias("pixel"), "x", "y", "class_index")
    far = across("x", "vertical").withColumn("x", F.col("x") - 1).unionByName(across("y", "horizontal").withColumn("y", F.col("y") - 1))
    near = labels.select("x", "y", F.col("class_index").alias("before"))
    met = far.join(near, ["x", "y"])
    return met.groupBy("orientation", "pixel").agg(F.avg((F.col("class_index") != F.col("before")).cast("double")).alias("rate"))


def raster_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each partition: pixels, differences, pixels of one side only, and whether all are equal."""
    both = a.select("x", "y", "partition_id", F.col("class_index").alias("a")).join(b.select("x", "y", F.col("partition_id").alias("part_b"), F.col("class_index").alias("b")), ["x", "y"], "full")
    both = both.withColumn("partition_id", F.coalesce("partition_id", "part_b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy("partition_id").agg(F.count("*").alias("pixels"), F.count_if(F.col("a") != F.col("b")).alias("differing"), F.count_if(F.col("b").isNull()).alias("gap"), F.count_if(F.col("a").isNull()).alias("outside"), F.bool_and(same).alias("identical"))


def partition_halo(labels: DataFrame, side: int, reach: int) -> DataFrame:
    """Each partition's pixels and those within ``reach`` around it, as column halo_x, halo_y (the partition's column and row).

    Only pixels near an edge are copied.
    """
    last = labels.agg(F.floor(F.max("x") / side).alias("last_x"), F.floor(F.max("y") / side).alias("last_y"))
    parts = lambda c, last_: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - reach) / side)), F.least(F.col(last_), F.floor((F.col(c) + reach) / side)))
    rows = labels.join(F.broadcast(last))
    return rows.withColumn("halo_x", F.explode(parts("x", "last_x"))).withColumn("halo_y", F.explode(parts("y", "last_y"))).drop("last_x", "last_y")


def fragments(table: DataFrame, limits: list[int]) -> DataFrame:
    """class_index (null: all classes), pixel limit, components below it; a rollup over exploded limits."""
    rows = table.withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    return rows.withColumn("__class", F.col("class_index")).groupBy("limit", F.col("__class")).agg(F.count_if(F.col("pixel_count") < F.col("limit")).alias("n")).rollup("limit", "__class").agg(F.sum("n").alias("fragments")).where("limit is not null").select(F.col("__class").alias("class_index"), "limit", "fragments")


def cell_mixture(labels: DataFrame, side: int, protected: Column | None = None) -> DataFrame:
    """cell_x, cell_y, pixels, classes, entropy of the class mixture, coverage and the share of ``protected`` classes in square cells."""
    counts = labels.groupBy(F.floor(F.col("x") / side).alias("cell_x"), F.floor(F.col("y") / side).alias("cell_y"), "class_index").agg(F.count("*").alias("n"))
    whole = W.partitionBy("cell_x", "cell_y")
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(whole))
    extra = [] if protected is None else [F.sum(F.when(protected, F.col("p")).otherwise(0.0)).alias("protected_share")]
    return share.groupBy("cell_x", "cell_y").agg(F.sum("n").alias("pixels"), F.count("*").alias("classes"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), (F.sum("n") / side**2).alias("coverage"), *extra)


def sample_cells(cells: DataFrame, run: str, size: int, apart: int) -> DataFrame:
    """Cells of each run: for each of three rankings its first cell that is ``apart`` cells or more from those taken, then by entropy.

    ``cells``: run, cell_x, cell_y, classes, pixels, entropy. A cell rules out (2 * apart - 1)**2 cells, itself included, so the
    first ``size`` times as many of each ranking hold all that a walk over the whole run could take; only these meet in a group.
    """
    import pandas as pd

    order = {"entropy": F.desc("entropy"), "classes": F.desc("classes"), "pixels": F.asc("pixels")}
    enough, names, short = size * (2 * apart - 1) ** 2, list(order), None
    for name, by in order.items():
        place = F.row_number().over(W.partitionBy(run).orderBy(by, "cell_y", "cell_x"))
        first = cells.withColumn("place", place).where(F.col("place") <= enough).select(run, "cell_x", "cell_y", F.lit(name).alias("ranking"), "place")
        short = first if short is None else short.unionByName(first)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []

        def walk(name: str, most: int) -> None:
            for r in rows[rows["ranking"] == name].sort_values("place").itertuples():
                if most and len(taken) < size and all(max(abs(r.cell_x - x), abs(r.cell_y - y)) >= apart for x, y in taken):
                    taken.append((int(r.cell_x), int(r.cell_y)))
                    most -= 1

        for name in names:
            walk(name, 1)
        walk("entropy", size)
        return pd.DataFrame({run: [rows[run].iloc[0]] * len(taken), "place": range(1, len(taken) + 1), "cell_x": [x for x, _ in taken], "cell_y": [y for _, y in taken]})

    return short.groupBy(run).applyInPandas(pick, f"{run} long, place int, cell_x long, cell_y long")


def semantic_safety(before: DataFrame, after: DataFrame, truth: DataFrame, protected: Column, percent: float, drop: float) -> DataFrame:
    """class_index, before, after (pixels), area_changed, protected_changed, accuracy_dropped for every class of either raster."""
    count = lambda df, name: df.groupBy("class_index").agg(F.count("*").alias(name))
    rows = count(before, "before").join(count(after, "after"), "class_index", "full").fillna(0, ["before", "after"])
    right = truth.select("x", "y", "class_index")
    for name, df in (("was", before), ("now", after)):
        right = right.join(df.select("x", "y", F.col("class_index").alias(name)), ["x", "y"], "left")
    hit = lambda c: F.avg(F.when(F.col(c) == F.col("class_index"), 1.0).otherwise(0.0))
    accuracy = right.groupBy("class_index").agg((hit("was") - hit("now")).alias("lost"))
    rows = rows.join(accuracy, "class_index", "left")
    return rows.select(
        "class_index", "before", "after", (F.abs(F.col("after") - F.col("before")) * 100 > percent * F.col("before")).alias("area_changed"), (protected & (F.col("before") != F.col("after"))).alias("protected_changed"),
        F.coalesce(F.round("lost", 6) > drop, F.lit(False)).alias("accuracy_dropped"),
    )


def boundary_signatures(pixels: DataFrame, side: int) -> DataFrame:
    """partition_id, component_id, class_index, edge (west, east, north, south), fixed, lo, hi: where an object lies along the edges of its partition's window.

    ``fixed`` is the edge's line, lo and hi (exclusive) the stretch along it. A pixel in a corner counts for both edges. ``pixels``: x, y,
    class_index, component_id, partition_id, with windows of ``side`` pixels.
    """
    edge = lambda name, c, along, last: F.when(F.col(c) % side == (side - 1 if last else 0), F.struct(F.lit(name).alias("edge"), (F.col(c) + int(last)).alias("fixed"), F.col(along).alias("at")))
    sides = F.array_compact(F.array(edge("west", "x", "y", False), edge("east", "x", "y", True), edge("north", "y", "x", False), edge("south", "y", "x", True)))
    keys = ["partition_id", "component_id", "class_index", "edge", "fixed"]
    rows = pixels.select("partition_id", "component_id", "class_index", F.explode(sides).alias("s")).select("partition_id", "component_id", "class_index", "s.*")
    island = F.col("at") - F.row_number().over(W.partitionBy(*keys).orderBy("at"))
    return rows.withColumn("island", island).groupBy(*keys, "island").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi")).drop("island")


def class_iou(matrix: DataFrame) -> DataFrame:
    """class_index, reference, predicted, hits (pixels) and iou of every class that either side has, from a confusion matrix."""
    side = lambda c, name: matrix.groupBy(F.col(c).alias("class_index")).agg(F.sum("pixels").alias(name))
    hits = matrix.where("ref = pred").select(F.col("ref").alias("class_index"), F.col("pixels").alias("hits"))
    rows = side("ref", "reference").join(side("pred", "predicted"), "class_index", "full").join(hits, "class_index", "left").fillna(0, ["reference", "predicted", "hits"])
    return rows.withColumn("iou", F.col("hits") / (F.col("reference") + F.col("predicted") - F.col("hits")))


def finalize(labels: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pixels of a run whose streams all hold every planned partition once, and what is wrong if they don't.

    ``labels``: stream_id, partition_id, x, y and what is carried; ``plan``: stream_id, partition_id. The second table has stream_id,
    partition_id, problem: missing, unplanned, or repeated (a pixel more than once). With any row in it the run is refused: no pixels.
    """
    held = labels.groupBy("stream_id", "partition_id", "x", "y").agg(F.count("*").alias("n")).groupBy("stream_id", "partition_id").agg(F.max("n").alias("n"))
    both = plan.select("stream_id", "partition_id", F.lit(True).alias("planned")).distinct().join(held, ["stream_id", "partition_id"], "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("planned").isNull(), "unplanned").when(F.col("n") > 1, "repeated")
    wrong = saved(both.select("stream_id", "partition_id", problem.alias("problem")).where("problem is not null"), "problems")
    return (labels.limit(0) if wrong.head(1) else labels), wrong
