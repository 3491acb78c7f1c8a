"""Fusion of models and blending of tiles; input rows carry the class axis as an array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import arrays as A

CLASSES = 14


def class_sums(probs: Column, weight: Column | None = None) -> list[Column]:
    """One sum for each class instead of a row for each class: a pixel shuffles once, pre-aggregated."""
    return [F.sum(F.get(probs, i) * weight if weight is not None else F.get(probs, i)).alias(f"s{i}") for i in range(CLASSES)]


def as_array(columns: Sequence[str] = tuple(f"s{i}" for i in range(CLASSES))) -> Column:
    return F.array(*columns)


def fuse_equal(scores: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """Mean of the models' probabilities for each pixel."""
    sums = scores.groupBy(*pixel).agg(*class_sums(F.col("probs")), F.count("*").alias("models"))
    return sums.select(*pixel, F.transform(as_array(), lambda s: s / F.col("models")).alias("probs"))


def fuse_weighted(scores: DataFrame, pixel: Sequence[str], weights: DataFrame) -> DataFrame:
    """Softmax of the weighted sum of calibrated log probabilities.

    ``weights``: a row for each model with temperature and its weights by class
    (equal ones give global weights); it is as small as the number of models.
    """
    rows = scores.join(F.broadcast(weights), "model_id")
    logs = A.calibrated_log(F.col("probs"), F.col("temperature"))
    gated = rows.select(*pixel, F.zip_with(logs, "weights", lambda a, w: a * w).alias("probs"))
    return gated.groupBy(*pixel).agg(*class_sums(F.col("probs"))).select(*pixel, as_array().alias("scores")).withColumn("probs", A.softmax(F.col("scores")))


def fuse_linear(scores: DataFrame, pixel: Sequence[str], weights: DataFrame, head: DataFrame) -> DataFrame:
    """Softmax of a linear head over the models' gated log probabilities.

    ``head``: model_id, matrix (output classes by input classes): as small as models times classes squared.
    """
    rows = scores.join(F.broadcast(weights), "model_id").join(F.broadcast(head), "model_id")
    gated = F.zip_with(A.calibrated_log(F.col("probs"), F.col("temperature")), "weights", lambda a, w: a * w)
    part = F.transform("matrix", lambda row: F.aggregate(F.zip_with(row, "gated", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("gated", gated).select(*pixel, part.alias("probs"))
    return rows.groupBy(*pixel).agg(*class_sums(F.col("probs"))).select(*pixel, as_array().alias("scores")).withColumn("probs", A.softmax(F.col("scores")))


def partial_sums(scores: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """State of an incremental equal fusion: sums and the models already in them."""
    once = scores.dropDuplicates([*pixel, "model_id"])
    return once.groupBy(*pixel).agg(*class_sums(F.col("probs")), F.collect_set("model_id").alias("models"))


def merge_partial(state: DataFrame, scores: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """State after more models; a model that the state already holds is ignored."""
    known = state.select(*pixel, F.explode("models").alias("model_id"))
    fresh = partial_sums(scores.join(known, [*pixel, "model_id"], "left_anti"), pixel)
    both = state.unionByName(fresh)
    return both.groupBy(*pixel).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(CLASSES)], F.array_distinct(F.flatten(F.collect_list("models"))).alias("models"))


def finalize_partial(state: DataFrame, pixel: Sequence[str], models: int) -> DataFrame:
    """Fused probabilities of the pixels whose models are complete."""
    return state.where(F.size("models") == models).select(*pixel, F.transform(as_array(), lambda s: s / models).alias("probs"))


def decide(fused: DataFrame) -> DataFrame:
    """Adds class_index (lowest index on ties) and confidence."""
    return fused.withColumn("class_index", A.argmax(F.col("probs"))).withColumn("confidence", F.array_max("probs"))


def to_tiles(scores: DataFrame, size: int = 8, overlap: int = 2) -> DataFrame:
    """Each pixel once for every overlapping tile that covers it: tile_x, tile_y, px, py."""
    stride = size - overlap
    tiles = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - size) / stride) + 1), F.floor(F.col(c) / stride))
    out = scores.withColumn("tile_x", F.explode(tiles("x"))).withColumn("tile_y", F.explode(tiles("y")))
    return out.withColumn("px", F.col("x") - F.col("tile_x") * stride).withColumn("py", F.col("y") - F.col("tile_y") * stride)


def blend_tiles(tiles: DataFrame, keys: Sequence[str], size: int = 8, overlap: int = 2) -> DataFrame:
    """Cosine-weighted mean of overlapping tiles at each global pixel, renormalised over the classes."""
    stride = size - overlap
    weight = A.cosine_weight(F.col("px"), size, overlap) * A.cosine_weight(F.col("py"), size, overlap)
    rows = tiles.select(*keys, (F.col("tile_x") * stride + F.col("px")).alias("x"), (F.col("tile_y") * stride + F.col("py")).alias("y"), "probs", weight.alias("w"))
    sums = rows.groupBy(*keys, "x", "y").agg(*class_sums(F.col("probs"), F.col("w")), F.count("*").alias("covering"))
    return sums.select(*keys, "x", "y", "covering", A.normalized(as_array()).alias("probs"))


def blend_windows(tiles: DataFrame, windows: DataFrame, size: int = 8, overlap: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Blend of only the tiles that meet each window (unit_id, x0, y0, x1, y1), cropped to it, for each value of ``keys``.

    Tiles and windows meet on a coarse grid of tile steps: an equality join instead of a range join.
    """
    stride = size - overlap
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - size) / stride), F.floor((F.col(b) - 1) / stride)))
    wanted = windows.withColumn("tile_x", cells("x0", "x1")).withColumn("tile_y", cells("y0", "y1"))
    met = tiles.drop("x", "y").join(wanted, ["tile_x", "tile_y"])
    blended = blend_tiles(met, [*keys, "unit_id", "x0", "y0", "x1", "y1"], size, overlap)
    return blended.where("x >= x0 and x < x1 and y >= y0 and y < y1").select(*keys, "unit_id", "x", "y", "covering", "probs")


def one_hot(labels: DataFrame) -> DataFrame:
    """Probabilities of accepted pixels: one for the class, zero else."""
    return labels.withColumn("probs", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda i: F.when(i == F.col("class_index"), 1.0).otherwise(0.0)))
