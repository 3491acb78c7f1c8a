"""Queries over class probabilities: contracts, fusion, blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import arrays as A
from loamgrid.operators import probabilities as P
from loamgrid.operators import scoring
from loamgrid.plans.fixtures import Tables, oracle
from loamgrid.registry import query

PIXEL = ("x", "y")
R = 6


def long(df: DataFrame, *keys: str, value: str = "probs", name: str = "p") -> DataFrame:
    """A row for each class, rounded, as the SQL gives them."""
    return df.select(*keys, F.posexplode(value).alias("class_index", "v")).select(*keys, "class_index", F.round("v", R).alias(name))


def _weights(spark: SparkSession) -> DataFrame:
    """Temperature 1 + m / 4 and weight (1 + (c + m) % 3) / 4 of model m for class c."""
    rows = spark.range(3).select(F.col("id").cast("int").alias("model_id"), (1 + F.col("id") / 4).alias("temperature"))
    return rows.withColumn("weights", F.transform(F.sequence(F.lit(0), F.lit(13)), lambda c: (1 + (c + F.col("model_id")) % 3) / 4))


_LOG = "ln(least(greatest(p, 1e-7), 1.0)) / (1 + model_id / 4) * (1 + (class_index + model_id) % 3) / 4"
_SOFT = "exp(s - max(s) OVER (PARTITION BY x, y))"


@query("prob_violations", oracle("scores", """
SELECT model_id, reason, count(*) AS pixels FROM (
  SELECT vec_id, model_id, CASE WHEN bool_or(CASE WHEN vec_id % 13 = 0 AND class_index = 0 THEN -p ELSE p END < 0) THEN 'negative'
    WHEN abs(sum(CASE WHEN vec_id % 7 = 0 THEN p * 1.01 ELSE p END) - 1) > 0.005 THEN 'sum' END AS reason
  FROM scores GROUP BY vec_id, model_id) AS v
WHERE reason IS NOT NULL GROUP BY model_id, reason"""))
def prob_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the probability contract by reason, over scores of which some were damaged."""
    bad = F.transform("probs", lambda p, i: F.when((F.col("vec_id") % 13 == 0) & (i == 0), -p).when(F.col("vec_id") % 7 == 0, p * 1.01).otherwise(p))
    rows = Tables(spark, sf_dir).scores.select("model_id", A.violation(bad, P.CLASSES).alias("reason"))
    return rows.where("reason is not null").groupBy("model_id", "reason").agg(F.count("*").alias("pixels"))


@query("softmax", oracle("", f"""
WITH raw AS (SELECT vec_id, c - 1 AS class_index, CAST(embedding[c] AS DOUBLE) * 20 AS s FROM embeddings, range(1, 15) AS t(c))
SELECT vec_id, class_index, round(exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w), {R}) AS p FROM raw WINDOW w AS (PARTITION BY vec_id)"""))
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).embeddings.select("vec_id", A.softmax(F.transform(F.slice("embedding", 1, 14), lambda e: e.cast("double") * 20)).alias("probs"))
    return long(rows, "vec_id").withColumn("class_index", F.col("class_index").cast("long"))


@query("calibrated_logits", oracle("scores", f"SELECT vec_id, model_id, class_index, round(ln(least(greatest(p, 1e-7), 1.0)) / (1 + model_id / 4), {R}) AS logit FROM scores"))
def calibrated_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).scores.withColumn("logs", A.calibrated_log(F.col("probs"), 1 + F.col("model_id") / 4))
    return long(rows, "vec_id", "model_id", value="logs", name="logit")


@query("argmax_confidence", oracle("scores", f"SELECT vec_id, model_id, arg_min(class_index, (-p, class_index)) AS class_index, round(max(p), {R}) AS confidence FROM scores GROUP BY vec_id, model_id"))
def argmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.decide(Tables(spark, sf_dir).scores).select("vec_id", "model_id", "class_index", F.round("confidence", R).alias("confidence"))


@query("near_tie_audit", oracle("scores", """
SELECT model_id, count(*) AS pixels, count(*) FILTER (m = 0) AS ties, count(*) FILTER (m < 0.01) AS near_ties
FROM (SELECT vec_id, model_id, max(p) - max(p) FILTER (n = 2) AS m FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, model_id ORDER BY p DESC) AS n FROM scores) AS r GROUP BY vec_id, model_id) AS t
GROUP BY model_id"""))
def near_tie_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).scores.select("model_id", A.margin(F.col("probs")).alias("m"))
    return rows.groupBy("model_id").agg(F.count("*").alias("pixels"), F.count_if(F.col("m") == 0).alias("ties"), F.count_if(F.col("m") < 0.01).alias("near_ties"))


@query("quantize_probs", oracle("scores", f"SELECT vec_id, model_id, class_index, CAST(round_even(p * 65535, 0) AS INT) AS level, round(CAST(round_even(p * 65535, 0) AS INT) / 65535, {R}) AS p FROM scores"))
def quantize_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).scores.select("vec_id", "model_id", A.quantized(F.col("probs")).alias("q"))
    rows = rows.select("vec_id", "model_id", F.posexplode(F.arrays_zip("q", A.dequantized(F.col("q")).alias("p"))).alias("class_index", "v"))
    return rows.select("vec_id", "model_id", "class_index", F.col("v.q").alias("level"), F.round("v.p", R).alias("p"))


@query("fuse_equal", oracle("scores", f"SELECT x, y, class_index, round(avg(p), {R}) AS p FROM scores GROUP BY x, y, class_index"))
def fuse_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(P.fuse_equal(Tables(spark, sf_dir).scores, PIXEL), *PIXEL)


@query("fuse_weighted", oracle("scores", f"""
WITH s AS (SELECT x, y, class_index, sum({_LOG}) AS s FROM scores GROUP BY x, y, class_index), e AS (SELECT *, {_SOFT} AS e FROM s)
SELECT x, y, class_index, round(e / sum(e) OVER (PARTITION BY x, y), {R}) AS p FROM e"""))
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(P.fuse_weighted(Tables(spark, sf_dir).scores, PIXEL, _weights(spark)), *PIXEL)


@query("fuse_linear", oracle("scores", f"""
WITH g AS (SELECT x, y, model_id, class_index AS i, {_LOG} AS g FROM scores),
s AS (SELECT x, y, CAST(o AS INT) AS class_index, sum(g * ((o * 3 + i * 5 + model_id) % 7) / 10) AS s FROM g, range(14) AS t(o) GROUP BY x, y, o), e AS (SELECT *, {_SOFT} AS e FROM s)
SELECT x, y, class_index, round(e / sum(e) OVER (PARTITION BY x, y), {R}) AS p FROM e"""))
def fuse_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.sequence(F.lit(0), F.lit(13))
    head = spark.range(3).select(F.col("id").cast("int").alias("model_id")).withColumn("matrix", F.transform(axis, lambda o: F.transform(axis, lambda i: (o * 3 + i * 5 + F.col("model_id")) % 7 / 10)))
    return long(P.fuse_linear(Tables(spark, sf_dir).scores, PIXEL, _weights(spark), head), *PIXEL)


@query("fuse_incremental", oracle("scores", f"SELECT x, y, class_index, round(avg(p), {R}) AS p FROM scores GROUP BY x, y, class_index"))
def fuse_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model by model, the second one twice: as the one-shot fusion."""
    scores = Tables(spark, sf_dir).scores
    state = P.partial_sums(scores.where("model_id = 0"), PIXEL)
    for more in ("model_id = 1", "model_id in (1, 2)"):
        state = P.merge_partial(state, scores.where(more), PIXEL)
    return long(P.finalize_partial(state, PIXEL, 3), *PIXEL)


_RAMP = "CASE WHEN {0} < 2 THEN pow(sin(0.5 * pi() * ({0} + 0.5) / 2), 2) ELSE 1.0 END"
_AXIS = f"least({_RAMP.format('{0}')}, {_RAMP.format('(7 - {0})')})"


@query("cosine_weights", oracle("", f"SELECT vec_id % 8 AS px, vec_id % 5 AS py, count(*) AS n, round(min({_AXIS.format('(vec_id % 8)')} * {_AXIS.format('(vec_id % 5)')}), {R}) AS w FROM embeddings GROUP BY 1, 2"))
def cosine_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).embeddings.select((F.col("vec_id") % 8).alias("px"), (F.col("vec_id") % 5).alias("py"))
    weight = A.cosine_weight(F.col("px"), 8, 2) * A.cosine_weight(F.col("py"), 8, 2)
    return rows.groupBy("px", "py").agg(F.count("*").alias("n"), F.round(F.min(weight), R).alias("w"))


_TILES = """tiles_of AS (
  SELECT s.*, tx, ty, x - tx * 6 AS px, y - ty * 6 AS py FROM scores AS s, LATERAL (SELECT unnest(range(greatest(0, CAST(floor((x - 8) / 6) AS BIGINT) + 1), CAST(floor(x / 6) AS BIGINT) + 1)) AS tx) AS a,
    LATERAL (SELECT unnest(range(greatest(0, CAST(floor((y - 8) / 6) AS BIGINT) + 1), CAST(floor(y / 6) AS BIGINT) + 1)) AS ty) AS b),
mixed AS (SELECT model_id, x, y, class_index, sum(p * (1 + (tx + ty) % 2 * 0.1) * w) AS s, count(*) AS covering FROM (SELECT *, """ + f"{_AXIS.format('px')} * {_AXIS.format('py')}" + """ AS w FROM tiles_of) AS t GROUP BY 1, 2, 3, 4)"""


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles whose scores differ where they overlap."""
    tiles = P.to_tiles(Tables(spark, sf_dir).scores)
    return tiles.withColumn("probs", F.transform("probs", lambda p: p * (1 + (F.col("tile_x") + F.col("tile_y")) % 2 * 0.1)))


@query("mosaic_blend", oracle("scores", f"WITH {_TILES} SELECT model_id, x, y, covering, class_index, round(s / sum(s) OVER (PARTITION BY model_id, x, y), {R}) AS p FROM mixed"))
def mosaic_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(P.blend_tiles(_tiled(spark, sf_dir), ["model_id"]), "model_id", "x", "y", "covering")


@query("partition_blend", oracle("scores", f"""
WITH {_TILES}
SELECT model_id, CAST(floor(y / 10) AS BIGINT) * 3 + CAST(floor(x / 10) AS BIGINT) AS unit_id, x, y, covering, class_index, round(s / sum(s) OVER (PARTITION BY model_id, x, y), {R}) AS p FROM mixed"""))
def partition_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend window by window, from the tiles that meet each window: equal to the whole blend."""
    tiles = _tiled(spark, sf_dir)
    at = lambda c: F.floor(F.col(c) / 10) * 10
    windows = Tables(spark, sf_dir).embeddings.select((F.col("vec_id") % 25).alias("x"), F.floor(F.col("vec_id") / 25).alias("y")).select(at("x").alias("x0"), at("y").alias("y0")).distinct()
    windows = windows.select((F.col("y0") / 10 * 3 + F.col("x0") / 10).cast("long").alias("unit_id"), "x0", "y0", (F.col("x0") + 10).alias("x1"), (F.col("y0") + 10).alias("y1"))
    return long(P.blend_windows(tiles, windows, keys=("model_id",)), "model_id", "unit_id", "x", "y", "covering")


@query("accepted_onehot", oracle("labels_a", "SELECT class_index AS accepted, CAST(c AS INT) AS class_index, CAST(sum(CASE WHEN c = class_index THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS p, count(*) AS pixels FROM labels_a, range(14) AS t(c) GROUP BY 1, 2"))
def accepted_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.one_hot(Tables(spark, sf_dir).labels_a).select(F.col("class_index").alias("accepted"), F.posexplode("probs").alias("class_index", "p"))
    return rows.groupBy("accepted", "class_index").agg(F.sum("p").alias("p"), F.count("*").alias("pixels"))


@query("class_area", oracle("scores classes", f"""
WITH fused AS (SELECT x, y, class_index, avg(p) AS p FROM scores GROUP BY x, y, class_index),
decided AS (SELECT x, y, arg_min(class_index, (-round(p, 12), class_index)) AS class_index, max(p) AS confidence FROM fused GROUP BY x, y)
SELECT class_code, count(*) AS pixels, CAST(count(*) AS DOUBLE) * 0.0625 AS area_m2, round(count(*) / sum(count(*)) OVER (), {R}) AS share, round(avg(confidence), {R}) AS confidence
FROM decided JOIN classes USING (class_index) GROUP BY class_code"""))
def class_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuse three models, decide each pixel, and sum up the classes' areas."""
    tables = Tables(spark, sf_dir)
    fused = P.fuse_equal(tables.scores, PIXEL).withColumn("probs", F.transform("probs", lambda p: F.round(p, 12)))
    rows = P.decide(fused).join(F.broadcast(tables.classes), "class_index").groupBy("class_code").agg(F.count("*").alias("pixels"), F.avg("confidence").alias("c"))
    from pyspark.sql import Window as W

    return rows.select("class_code", "pixels", (F.col("pixels") * 0.0625).alias("area_m2"), F.round(F.col("pixels") / F.sum("pixels").over(W.partitionBy()), R).alias("share"), F.round("c", R).alias("confidence"))


@query("stream_completeness", oracle("scores", """
SELECT model_id, count(DISTINCT vec_id) AS pixels, (SELECT count(DISTINCT vec_id) FROM scores) - count(DISTINCT vec_id) AS missing
FROM scores WHERE vec_id % 10 <> model_id GROUP BY model_id"""))
def stream_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that a model misses of those that any model has."""
    scores = Tables(spark, sf_dir).scores.where("vec_id % 10 <> model_id").select("vec_id", "model_id").distinct()
    every = scores.select("vec_id").distinct().agg(F.count("*").alias("all"))
    rows = scores.groupBy("model_id").agg(F.count("*").alias("pixels"))
    return rows.join(F.broadcast(every)).select("model_id", "pixels", (F.col("all") - F.col("pixels")).alias("missing"))


@query("pixel_area", oracle("", f"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN round(0.25, {R}) WHEN 1 THEN round(0.25 * pow(cos(atan(sinh(c_acctbal * 500 / 6378137.0))), 2), {R})
  ELSE round(0.001 * pi() / 180 * 6378137.0 * cos(radians(c_acctbal / 200)) * 0.001 * (111132.954 - 559.822 * cos(2 * radians(c_acctbal / 200)) + 1.175 * cos(4 * radians(c_acctbal / 200))), 3) END AS area_m2
FROM customer"""))
def pixel_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).customer
    kind = F.col("c_custkey") % 3
    size = F.when(kind == 2, 0.001).otherwise(0.5)
    family = F.when(kind == 0, "metre").when(kind == 1, "mercator").otherwise("degree")
    area = A.pixel_area_m2(family, size, size, F.when(kind == 1, F.col("c_acctbal") * 500).otherwise(F.col("c_acctbal") / 200))
    return rows.select("c_custkey", F.when(kind == 2, F.round(area, 3)).otherwise(F.round(area, R)).alias("area_m2"))


class Prototypes:
    """A plain model: softmax of minus the squared distances to a row of fixed points on a circle."""

    def __init__(self, classes: int) -> None:
        import numpy as np

        turn = 2 * np.pi * np.arange(classes) / classes
        self.points = np.stack([np.cos(turn), np.sin(turn)], axis=1)

    def __call__(self, rows):
        import numpy as np

        far = ((rows[:, None, :] - self.points[None, :, :]) ** 2).sum(axis=2)
        e = np.exp(far.min(axis=1, keepdims=True) - far)
        return e / e.sum(axis=1, keepdims=True)


def _load() -> Prototypes:
    return Prototypes(14)


@query("score_pixels", oracle("", """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), e AS (SELECT vec_id, c, exp(-(pow(a - cos(2 * pi() * c / 14), 2) + pow(b - sin(2 * pi() * c / 14), 2))) AS e FROM p, range(14) AS t(c))
SELECT vec_id, CAST(c AS INT) AS class_index, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e"""))
def score_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of scores as a user's model gives it, from two features."""
    rows = Tables(spark, sf_dir).embeddings.select("vec_id", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))
    scores = scoring.score(rows, "prototypes", _load, ["a", "b"], 14, ["vec_id"])
    return scores.select("vec_id", F.posexplode("probs").alias("class_index", "p")).withColumn("p", F.round("p", 6))
