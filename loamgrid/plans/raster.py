"""Queries over label rasters: components, contacts, areas, comparisons."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.operators import contacts
from loamgrid.operators import proposals as O
from loamgrid.operators import rasters as R
from loamgrid.operators.coverage import coverage
from loamgrid.plans.fixtures import SIDE, Tables, oracle
from loamgrid.registry import query

WIDE = R.WIDE
_RUNS = f"""
runs AS (SELECT y, class_index, min(x) AS x0, max(x) AS x1, count(*) AS pixels, y * {WIDE} + min(x) AS run_id FROM (SELECT *, x - row_number() OVER (PARTITION BY y, class_index ORDER BY x) AS island FROM {{0}}) AS i GROUP BY y, class_index, island)"""


def components_sql(reach: int, labels: str = "labels_a", prefix: str = "") -> str:
    """CTEs runs, px (pixels with component_id), each with ``prefix``: reachable runs by recursion."""
    text = f"""{_RUNS.format(labels)},
edges AS (SELECT a.run_id AS a, b.run_id AS b FROM runs AS a JOIN runs AS b ON b.y IN (a.y - 1, a.y + 1) AND a.class_index = b.class_index AND a.x0 <= b.x1 + {reach} AND b.x0 <= a.x1 + {reach}),
reached AS (SELECT run_id AS a, run_id AS b FROM runs UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a),
roots AS (SELECT a AS run_id, min(b) AS component_id FROM reached GROUP BY a),
px AS (SELECT l.*, component_id FROM {labels} AS l JOIN runs AS r ON l.y = r.y AND l.class_index = r.class_index AND l.x BETWEEN r.x0 AND r.x1 JOIN roots USING (run_id))"""
    return re.sub(r"\b(runs|edges|reached|roots|px)\b", prefix + r"\1", text) if prefix else text


C4, C8 = f"WITH RECURSIVE {components_sql(0)}", f"WITH RECURSIVE {components_sql(1)}"
_SHAPE = """
shape AS (SELECT component_id, class_index, count(*) AS pixel_count, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY component_id, class_index)"""
#: Pixels below which a component is a fragment, by class.
LIMIT = "CASE WHEN class_index % 3 = 0 THEN 4 ELSE 8 END"


@query("row_runs", oracle("labels_a", f"WITH {_RUNS.format('labels_a')} SELECT * FROM runs"))
def row_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_runs(Tables(spark, sf_dir).labels_a)


@query("components_4", oracle("labels_a", f"{C4} SELECT x, y, class_index, component_id FROM px"))
def components_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_components(Tables(spark, sf_dir).labels_a).select("x", "y", "class_index", "component_id")


@query("components_8", oracle("labels_a", f"{C8} SELECT x, y, class_index, component_id FROM px"))
def components_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_components(Tables(spark, sf_dir).labels_a, diagonal=True).select("x", "y", "class_index", "component_id")


@query("global_components", oracle("labels_a", f"{C4} SELECT component_id, class_index, count(*) AS pixels, count(DISTINCT partition_id) AS partitions FROM px GROUP BY component_id, class_index"))
def global_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over all partitions, from components within each partition joined at the seams."""
    pixels = R.with_components(Tables(spark, sf_dir).labels_a, side=SIDE)
    return pixels.groupBy("component_id", "class_index").agg(F.count("*").alias("pixels"), F.countDistinct("partition_id").alias("partitions"))


@query("component_audit", oracle("labels_a", f"{C4}, {_SHAPE} SELECT class_index, count(*) AS components, CAST(sum(pixel_count) AS BIGINT) AS pixels, count(*) FILTER (pixel_count < {LIMIT}) AS fragments FROM shape GROUP BY class_index"))
def component_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.components(R.with_components(Tables(spark, sf_dir).labels_a))
    return parts.groupBy("class_index").agg(F.count("*").alias("components"), F.sum("pixel_count").alias("pixels"), F.count_if(F.expr(f"pixel_count < {LIMIT}")).alias("fragments"))


@query("component_shape", oracle("labels_a", f"""{C8}, {_SHAPE}
SELECT component_id, pixel_count, x0, x1, y0, y1, round(greatest(x1 - x0 + 1, y1 - y0 + 1) / least(x1 - x0 + 1, y1 - y0 + 1), 6) AS aspect, round(pixel_count / greatest(x1 - x0 + 1, y1 - y0 + 1), 6) AS mean_width,
  x0 = (SELECT min(x) FROM px) OR x1 = (SELECT max(x) FROM px) OR y0 = (SELECT min(y) FROM px) OR y1 = (SELECT max(y) FROM px) AS touches_border FROM shape"""))
def component_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.components(R.with_components(Tables(spark, sf_dir).labels_a, diagonal=True))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return parts.select("component_id", "pixel_count", "x0", "x1", "y0", "y1", F.round(F.greatest(w, h) / F.least(w, h), 6).alias("aspect"), F.round(F.col("pixel_count") / F.greatest(w, h), 6).alias("mean_width"), "touches_border")


_STEP4 = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)"


@query("component_adjacency", oracle("labels_a", f"""{C4}
, met AS (SELECT a.component_id, a.class_index, b.component_id AS other_component_id, b.class_index AS other_class_index, dx FROM px AS a, {_STEP4}, px AS b WHERE b.x = a.x + dx AND b.y = a.y + dy),
whole AS (SELECT component_id, 4 * count(*) = (SELECT count(*) FROM met WHERE met.component_id = px.component_id) AS closed FROM px GROUP BY 1)
SELECT m.component_id, class_index, other_component_id, other_class_index, count(*) AS contact, sum(CASE WHEN dx = 0 THEN 0.25 ELSE 0.5 END)::DOUBLE AS contact_m, closed FROM met AS m JOIN whole USING (component_id) WHERE m.component_id <> other_component_id GROUP BY 1, 2, 3, 4, 7"""))
def component_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.adjacency(R.with_components(Tables(spark, sf_dir).labels_a), 0.25, 0.5)


@query("fragment_histogram", oracle("labels_a", f"""{C4}, {_SHAPE}
SELECT class_index, CAST(lim AS INT) AS "limit", count(*) FILTER (pixel_count < lim) AS fragments FROM shape, (VALUES (2), (5), (10), (30)) AS l(lim) GROUP BY GROUPING SETS ((class_index, lim), (lim))"""))
def fragment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fragments(R.components(R.with_components(Tables(spark, sf_dir).labels_a)), [2, 5, 10, 30])


@query("component_distance", oracle("labels_a", f"""{C4}, {_SHAPE}, small AS (SELECT px.* FROM px JOIN shape USING (component_id) WHERE pixel_count BETWEEN 2 AND 20)
SELECT * FROM (SELECT a.component_id, b.component_id AS other_component_id, round(min(sqrt(pow(greatest(abs(a.x - b.x) - 1, 0) * 0.25, 2) + pow(greatest(abs(a.y - b.y) - 1, 0) * 0.5, 2))), 6) AS distance
FROM small AS a JOIN small AS b ON a.class_index = b.class_index AND a.component_id < b.component_id AND abs(a.x - b.x) <= 9 AND abs(a.y - b.y) <= 9 GROUP BY 1, 2) AS d WHERE distance <= 1.5"""))
def component_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between the edges of small components of one class within 1.5 m, for pixels of 0.25 by 0.5 m."""
    pixels = R.with_components(Tables(spark, sf_dir).labels_a)
    small = pixels.join(R.components(pixels).where("pixel_count between 2 and 20").select("component_id"), "component_id")
    return O.component_distances(small, 1.5, 0.25, 0.5).withColumn("distance", F.round("distance", 6))


@query("boundary_length", oracle("labels_a", f"""
WITH met AS (SELECT a.class_index, b.class_index AS other, dx <> 0 AS upright FROM labels_a AS a, {_STEP4}, labels_a AS b WHERE b.x = a.x + dx AND b.y = a.y + dy),
n AS (SELECT class_index, count(*) FILTER (other <> class_index AND upright) AS iu, count(*) FILTER (other <> class_index AND NOT upright) AS il, count(*) FILTER (upright) AS mu, count(*) FILTER (NOT upright) AS ml FROM met GROUP BY 1),
s AS (SELECT class_index, 2 * count(*) AS sides FROM labels_a GROUP BY 1)
SELECT class_index, coalesce(iu + il, 0) AS internal, 2 * sides - coalesce(mu + ml, 0) AS "outer", coalesce(iu * 0.5 + il * 0.25, 0)::DOUBLE AS internal_m, ((sides - coalesce(mu, 0)) * 0.5 + (sides - coalesce(ml, 0)) * 0.25)::DOUBLE AS outer_m FROM s LEFT JOIN n USING (class_index)"""))
def boundary_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.boundary_lengths(Tables(spark, sf_dir).labels_a, 0.25, 0.5)


@query("unit_complexity", oracle("labels_a", f"""{C4}
SELECT p.partition_id, count(DISTINCT component_id) AS components, (SELECT count(*) FROM labels_a AS a, (VALUES (1, 0), (0, 1)) AS d(dx, dy), labels_a AS b WHERE b.x = a.x + dx AND b.y = a.y + dy AND a.class_index <> b.class_index AND a.partition_id = p.partition_id) AS segments
FROM px AS p GROUP BY p.partition_id"""))
def unit_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = R.with_components(Tables(spark, sf_dir).labels_a)
    parts = pixels.groupBy("partition_id").agg(F.countDistinct("component_id").alias("components"))
    return parts.join(contacts.segments(pixels, "partition_id"), "partition_id", "left").fillna(0, ["segments"])


@query("confusion_matrix", oracle("labels_a labels_b", "SELECT a.class_index AS ref, b.class_index AS pred, count(*) AS pixels FROM labels_a AS a JOIN labels_b AS b USING (x, y) GROUP BY 1, 2"))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return R.confusion(t.labels_a, t.labels_b)


_BAND = f"(x % {SIDE} >= {SIDE - 2} OR (x % {SIDE} < 2 AND x >= {SIDE}) OR y % {SIDE} >= {SIDE - 2} OR (y % {SIDE} < 2 AND y >= {SIDE}))"


def _metrics_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""
m AS (SELECT {key}ref, pred, count(*) AS n FROM both_ GROUP BY {key}ref, pred),
c AS (SELECT {key}c, sum(n) AS u, sum(n) FILTER (ref = pred AND side = 0) AS tp FROM (SELECT *, ref AS c, 0 AS side FROM m UNION ALL SELECT *, pred, 1 FROM m) AS s GROUP BY {key}c),
i AS (SELECT {key}avg(coalesce(tp, 0) / (u - coalesce(tp, 0))) AS miou FROM c {group}),
w AS (SELECT {key}CAST(sum(n) AS BIGINT) AS valid_pixels, sum(CASE WHEN ref = pred THEN n ELSE 0 END) / sum(n) AS accuracy FROM m {group})
SELECT {key}valid_pixels, round(accuracy, 6) AS accuracy, round(miou, 6) AS miou FROM w JOIN i {join}"""


@query("segmentation_metrics", oracle("labels_a labels_b", f"WITH both_ AS (SELECT a.class_index AS ref, b.class_index AS pred FROM labels_a AS a JOIN labels_b AS b USING (x, y)), {_metrics_sql('')}"))
def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    m = R.segmentation_metrics(R.confusion(t.labels_a, t.labels_b))
    return m.select("valid_pixels", F.round("accuracy", 6).alias("accuracy"), F.round("miou", 6).alias("miou"))


@query("seam_metrics", oracle("labels_a labels_b", f"WITH both_ AS (SELECT a.class_index AS ref, b.class_index AS pred, {_BAND} AS seam FROM labels_a AS a JOIN labels_b AS b USING (x, y)), {_metrics_sql('seam')}"))
def seam_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ref = t.labels_a.withColumn("seam", R.seam_band(F.col("x"), F.col("y"), SIDE, 2))
    m = R.segmentation_metrics(R.confusion(ref, t.labels_b, ["seam"]), ["seam"])
    return m.select("seam", "valid_pixels", F.round("accuracy", 6).alias("accuracy"), F.round("miou", 6).alias("miou"))


@query("seam_transition_rate", oracle("labels_a", f"""
SELECT 'vertical' AS orientation, b.x AS pixel, round(avg(CASE WHEN a.class_index <> b.class_index THEN 1.0 ELSE 0.0 END), 6) AS rate FROM labels_a AS a JOIN labels_a AS b ON a.x = b.x - 1 AND a.y = b.y WHERE b.x % {SIDE} = 0 GROUP BY b.x
UNION ALL SELECT 'horizontal', b.y, round(avg(CASE WHEN a.class_index <> b.class_index THEN 1.0 ELSE 0.0 END), 6) FROM labels_a AS a JOIN labels_a AS b ON a.y = b.y - 1 AND a.x = b.x WHERE b.y % {SIDE} = 0 GROUP BY b.y"""))
def seam_transition_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.seam_transitions(Tables(spark, sf_dir).labels_a, SIDE).withColumn("rate", F.round("rate", 6))


@query("raster_diff", oracle("labels_a labels_b", """
WITH b AS (SELECT * FROM labels_b WHERE x % 33 <> 5), a AS (SELECT * FROM labels_a WHERE y % 41 <> 7)
SELECT coalesce(a.partition_id, b.partition_id) AS partition_id, count(*) AS pixels, count(*) FILTER (a.class_index <> b.class_index) AS differing, count(*) FILTER (b.x IS NULL) AS gap, count(*) FILTER (a.x IS NULL) AS outside, bool_and(a.class_index IS NOT DISTINCT FROM b.class_index) AS identical
FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y GROUP BY 1"""))
def raster_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return R.raster_diff(t.labels_a.where("y % 41 <> 7"), t.labels_b.where("x % 33 <> 5"))


@query("semantic_safety", oracle("labels_a labels_b labels_c", """
WITH b AS (SELECT * FROM labels_b WHERE class_index <> 3), n AS (SELECT class_index, sum(before) AS before, sum(after) AS after FROM (SELECT class_index, 1 AS before, 0 AS after FROM labels_a UNION ALL SELECT class_index, 0, 1 FROM b) AS u GROUP BY 1),
h AS (SELECT c.class_index, avg(CASE WHEN a.class_index = c.class_index THEN 1.0 ELSE 0.0 END) AS was, avg(CASE WHEN b.class_index = c.class_index THEN 1.0 ELSE 0.0 END) AS now FROM labels_c AS c LEFT JOIN labels_a AS a ON a.x = c.x AND a.y = c.y LEFT JOIN b ON b.x = c.x AND b.y = c.y GROUP BY 1)
SELECT class_index, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, abs(after - before) * 100 > 5 * before AS area_changed, class_index % 5 = 0 AND before <> after AS protected_changed, coalesce(round(was - now, 6) > 0.02, FALSE) AS accuracy_dropped
FROM n LEFT JOIN h USING (class_index)"""))
def semantic_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes whose area changed by over five percent, or at all where protected, or whose share of rightly labelled pixels
    dropped by over two points. Classes that vanish (as class 3 does here) or appear are rows as well."""
    t = Tables(spark, sf_dir)
    return R.semantic_safety(t.labels_a, t.labels_b.where("class_index <> 3"), t.labels_c, F.col("class_index") % 5 == 0, 5, 0.02)


@query("ab_gate", oracle("labels_a labels_b labels_c", f"""
WITH both_ AS (SELECT a.partition_id, b.class_index = a.class_index AS candidate, c.class_index = a.class_index AS baseline, {_BAND} AS seam FROM labels_a AS a JOIN labels_b AS b USING (x, y) JOIN labels_c AS c USING (x, y))
SELECT partition_id, bool_and(ok) AS passed, count(*) AS gates FROM (SELECT partition_id, seam, avg(CASE WHEN candidate THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN baseline THEN 1.0 ELSE 0.0 END) >= -0.01 AS ok FROM both_ GROUP BY partition_id, seam) AS g GROUP BY partition_id"""))
def ab_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition passes if the candidate's accuracy is no more than a point under the baseline's, on seams and off them."""
    t = Tables(spark, sf_dir)
    both = t.labels_a.join(t.labels_b.select("x", "y", F.col("class_index").alias("candidate")), ["x", "y"]).join(t.labels_c.select("x", "y", F.col("class_index").alias("baseline")), ["x", "y"])
    right = lambda c: F.avg((F.col("class_index") == F.col(c)).cast("double"))
    gates = both.groupBy("partition_id", R.seam_band(F.col("x"), F.col("y"), SIDE, 2).alias("seam")).agg((right("candidate") - right("baseline") >= -0.01).alias("ok"))
    return gates.groupBy("partition_id").agg(F.bool_and("ok").alias("passed"), F.count("*").alias("gates"))


_OF = f"CAST(floor(floor(component_id / {WIDE}) / {SIDE}) * 4 + floor(component_id % {WIDE} / {SIDE}) AS BIGINT)"


@query("candidate_ranking", oracle("labels_a labels_b labels_c", f"""WITH RECURSIVE {components_sql(0)}, {components_sql(0, 'labels_b', 'b_')},
f AS (SELECT partition_id, CAST(sum(k) AS BIGINT) AS fewer FROM (SELECT {_OF} AS partition_id, 1 AS k FROM px GROUP BY component_id, class_index HAVING count(*) < {LIMIT} UNION ALL SELECT {_OF}, -1 FROM b_px GROUP BY component_id, class_index HAVING count(*) < {LIMIT}) AS u GROUP BY 1),
g AS (SELECT a.partition_id, avg(CASE WHEN a.class_index = c.class_index THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN b.class_index = c.class_index THEN 1.0 ELSE 0.0 END) AS drop_, count(*) FILTER (a.class_index % 5 = 0 AND b.class_index <> a.class_index) > 8 AS unsafe FROM labels_a AS a JOIN labels_b AS b USING (x, y) JOIN labels_c AS c USING (x, y) GROUP BY 1)
SELECT partition_id, coalesce(fewer, 0) AS fewer, unsafe, CAST(rank() OVER (ORDER BY unsafe, round(coalesce(fewer, 0) - 10 * drop_, 6) DESC, partition_id) AS INT) AS place FROM g LEFT JOIN f USING (partition_id)"""))
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the fragments they remove less ten times the accuracy they lose; those that change many protected pixels last."""
    t = Tables(spark, sf_dir)
    small = lambda labels, k: R.with_components(labels).groupBy("component_id", "class_index").agg(F.count("*").alias("n")).where(f"n < {LIMIT}").select(F.expr(_OF).alias("partition_id"), F.lit(k).alias("k"))
    fewer = small(t.labels_a, 1).unionByName(small(t.labels_b, -1)).groupBy("partition_id").agg(F.sum("k").alias("fewer"))
    both = t.labels_a.join(t.labels_b.select("x", "y", F.col("class_index").alias("new")), ["x", "y"]).join(t.labels_c.select("x", "y", F.col("class_index").alias("truth")), ["x", "y"])
    right = lambda c: F.avg((F.col(c) == F.col("truth")).cast("double"))
    g = both.groupBy("partition_id").agg((right("class_index") - right("new")).alias("drop"), (F.count_if((F.col("class_index") % 5 == 0) & (F.col("new") != F.col("class_index"))) > 8).alias("unsafe"))
    g = g.join(fewer, "partition_id", "left").fillna(0, ["fewer"])
    order = W.partitionBy().orderBy("unsafe", F.round(F.col("fewer") - 10 * F.col("drop"), 6).desc(), "partition_id")  # a row for each candidate
    return g.select("partition_id", "fewer", "unsafe", F.rank().over(order).alias("place"))


@query("cell_entropy", oracle("labels_a", """
SELECT cell_x, cell_y, CAST(sum(n) AS BIGINT) AS pixels, count(*) AS classes, round(-sum(p * ln(p)), 6) AS entropy, round(sum(n) / 100, 6) AS coverage, round(coalesce(sum(p) FILTER (class_index % 5 = 0), 0), 6) AS protected_share FROM (SELECT *, n / sum(n) OVER (PARTITION BY cell_x, cell_y) AS p FROM (
  SELECT CAST(floor(x / 10) AS BIGINT) AS cell_x, CAST(floor(y / 10) AS BIGINT) AS cell_y, class_index, count(*) AS n FROM labels_a GROUP BY 1, 2, 3) AS c) AS s GROUP BY 1, 2"""))
def cell_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.cell_mixture(Tables(spark, sf_dir).labels_a, 10, F.col("class_index") % 5 == 0)
    return rows.withColumns({c: F.round(c, 6) for c in ("entropy", "coverage", "protected_share")})


@query("partition_halo", oracle("labels_a", f"""
SELECT hx AS halo_x, hy AS halo_y, count(*) AS pixels, CAST(sum(class_index) AS BIGINT) AS checksum FROM labels_a,
  LATERAL (SELECT unnest(range(greatest(0, CAST(floor((x - 3) / {SIDE}) AS BIGINT)), least((SELECT max(x) // {SIDE} FROM labels_a), CAST(floor((x + 3) / {SIDE}) AS BIGINT)) + 1)) AS hx) AS a,
  LATERAL (SELECT unnest(range(greatest(0, CAST(floor((y - 3) / {SIDE}) AS BIGINT)), least((SELECT max(y) // {SIDE} FROM labels_a), CAST(floor((y + 3) / {SIDE}) AS BIGINT)) + 1)) AS hy) AS b GROUP BY 1, 2"""))
def partition_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    halo = R.partition_halo(Tables(spark, sf_dir).labels_a, SIDE, 3)
    return halo.groupBy("halo_x", "halo_y").agg(F.count("*").alias("pixels"), F.sum("class_index").alias("checksum"))


@query("zonal_confidence", oracle("labels_a", f"{C4} SELECT component_id, round(avg(confidence), 6) AS confidence_mean, round(stddev_pop(confidence), 6) AS confidence_std FROM px GROUP BY component_id"))
def zonal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_components(Tables(spark, sf_dir).labels_a).groupBy("component_id")
    return rows.agg(F.round(F.avg("confidence"), 6).alias("confidence_mean"), F.round(F.stddev_pop("confidence"), 6).alias("confidence_std"))


@query("objects_from_labels", oracle("labels_a classes", f"""{C4}
SELECT 'obj_' || left(sha1('run-1|' || component_id), 24) AS object_id, class_code, count(*) AS pixels, min(x) AS xmin, min(y) AS ymin, max(x) + 1 AS xmax, max(y) + 1 AS ymax, round(avg(confidence), 6) AS confidence_mean
FROM px JOIN classes USING (class_index) GROUP BY component_id, class_code"""))
def objects_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each component: id, class, box, size, confidence."""
    t = Tables(spark, sf_dir)
    rows = R.with_components(t.labels_a).join(F.broadcast(t.classes), "class_index").groupBy("component_id", "class_code")
    rows = rows.agg(F.count("*").alias("pixels"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), (F.max("x") + 1).alias("xmax"), (F.max("y") + 1).alias("ymax"), F.round(F.avg("confidence"), 6).alias("confidence_mean"))
    return rows.select(F.concat(F.lit("obj_"), F.left(F.sha1(F.concat(F.lit("run-1|"), F.col("component_id"))), F.lit(24))).alias("object_id"), *rows.columns[1:])


@query("probability_evidence", oracle("labels_a", f"""{C4}
SELECT component_id, count(*) AS pixels, round(list_sort(list(confidence))[CAST(ceil(0.1 * count(*)) AS BIGINT)], 6) AS p10, round(avg(confidence), 6) AS mean, round(avg(confidence - (class_index % 3) / 10), 6) AS mean_gap FROM px GROUP BY component_id"""))
def probability_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank tenth percentile, mean, and mean gap of a footprint's probabilities."""
    rows = R.with_components(Tables(spark, sf_dir).labels_a).groupBy("component_id").agg(F.count("*").alias("pixels"), F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY confidence)").alias("p10"), F.avg("confidence").alias("mean"), F.avg(F.col("confidence") - (F.col("class_index") % 3) / 10).alias("mean_gap"))
    return rows.select("component_id", "pixels", *[F.round(c, 6).alias(c) for c in ("p10", "mean", "mean_gap")])


@query("range_mask_audit", oracle("labels_a", """
WITH wanted AS (SELECT o_orderkey % 100 AS x, CAST(floor(o_orderkey / 100) AS BIGINT) AS y FROM orders WHERE (o_orderkey % 100) BETWEEN 10 AND 79)
SELECT count(*) FILTER (w.x IS NOT NULL AND l.x IS NOT NULL) AS kept, count(*) FILTER (w.x IS NULL) AS masked, count(*) FILTER (l.x IS NULL) AS gap, count(*) FILTER (w.x IS NOT NULL AND l.confidence > 0.98) AS invalid
FROM labels_a AS l FULL JOIN wanted AS w ON l.x = w.x AND l.y = w.y"""))
def range_mask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the requested range that are kept, masked, missing, or of invalid confidence."""
    t = Tables(spark, sf_dir)
    wanted = t.orders.select((F.col("o_orderkey") % 100).alias("x"), F.floor(F.col("o_orderkey") / 100).alias("y"), F.lit(True).alias("w")).where("x between 10 and 79")
    both = t.labels_a.withColumn("l", F.lit(True)).join(wanted, ["x", "y"], "full")
    return both.agg(F.count_if(F.col("w") & F.col("l")).alias("kept"), F.count_if(F.col("w").isNull()).alias("masked"), F.count_if(F.col("l").isNull()).alias("gap"), F.count_if(F.col("w") & (F.col("confidence") > 0.98)).alias("invalid"))


@query("coverage_validation", oracle("labels_a labels_b", """
WITH claims AS (SELECT x, y FROM labels_a WHERE x < 60 UNION ALL SELECT x, y FROM labels_b WHERE x >= 55), n AS (SELECT x, y, count(*) AS n FROM claims GROUP BY x, y),
wanted AS (SELECT o_orderkey % 100 AS x, CAST(floor(o_orderkey / 100) AS BIGINT) AS y FROM orders WHERE o_orderkey % 100 < 95)
SELECT count(*) FILTER (n.x IS NULL) AS gap, CAST(coalesce(sum(n - 1) FILTER (w.x IS NOT NULL), 0) AS BIGINT) AS overlap, count(*) FILTER (w.x IS NULL) AS outside,
  count(*) FILTER (n.x IS NULL) <= 60 AND coalesce(sum(n - 1) FILTER (w.x IS NOT NULL), 0) <= 60 AND count(*) FILTER (w.x IS NULL) <= 60 AS passed FROM n FULL JOIN wanted AS w ON n.x = w.x AND n.y = w.y"""))
def coverage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the range without a claim, claimed again, and claimed outside, each held against a tolerance of 60 pixels."""
    t = Tables(spark, sf_dir)
    boxes = lambda cells: contacts.runs(cells.select("x", "y"), []).select("x0", F.col("y").alias("y0"), (F.col("x1") + 1).alias("x1"), (F.col("y") + 1).alias("y1"))
    claims = boxes(t.labels_a.where("x < 60")).unionAll(boxes(t.labels_b.where("x >= 55")))
    wanted = boxes(t.orders.select((F.col("o_orderkey") % 100).alias("x"), F.floor(F.col("o_orderkey") / 100).alias("y")).where("x < 95"))
    return coverage(claims, wanted).withColumn("passed", F.greatest("gap", "overlap", "outside") <= 60)


_RUN = "SELECT 'a' AS stream_id, * FROM labels_a UNION ALL SELECT 'b', * FROM labels_b"


@query("finalize_streams", oracle("labels_a labels_b", f"WITH s AS ({_RUN}) SELECT stream_id, x, y, class_index, confidence FROM s"))
def finalize_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and confidence of all streams of a run in which each has every partition of the plan."""
    run, plan = _run(Tables(spark, sf_dir))
    return R.finalize(run, plan)[0].select("stream_id", "x", "y", "class_index", "confidence")


def _run(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The labels of both streams, and a plan of every partition for each of them."""
    run = t.labels_a.withColumn("stream_id", F.lit("a")).unionByName(t.labels_b.withColumn("stream_id", F.lit("b")))
    cells = t.orders.select((F.floor(F.floor(F.col("o_orderkey") / 100) / SIDE) * (100 // SIDE) + F.floor(F.col("o_orderkey") % 100 / SIDE)).alias("partition_id")).distinct()
    return run, cells.withColumn("stream_id", F.explode(F.array(F.lit("a"), F.lit("b"))))


@query("finalize_refused", oracle("labels_a labels_b", f"""
WITH s AS (SELECT * FROM ({_RUN}) AS r WHERE NOT (stream_id = 'b' AND partition_id % 5 = 3) UNION ALL SELECT 'a', * FROM labels_a WHERE partition_id = 2),
held AS (SELECT stream_id, partition_id, max(n) AS n FROM (SELECT stream_id, partition_id, count(*) AS n FROM s GROUP BY stream_id, partition_id, x, y) AS c GROUP BY 1, 2),
plan AS (SELECT DISTINCT stream_id, CAST(floor(floor(o_orderkey / 100) / {SIDE}) * {100 // SIDE} + floor(o_orderkey % 100 / {SIDE}) AS BIGINT) AS partition_id FROM orders, (VALUES ('a'), ('b')) AS v(stream_id) WHERE o_orderkey >= 0)
SELECT * FROM (SELECT stream_id, partition_id, CASE WHEN held.n IS NULL THEN 'missing' WHEN plan.stream_id IS NULL THEN 'unplanned' WHEN held.n > 1 THEN 'repeated' END AS problem FROM plan FULL JOIN held USING (stream_id, partition_id)) AS p WHERE problem IS NOT NULL"""))
def finalize_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a run is refused: partitions that a stream lacks, and one that it brings twice."""
    t = Tables(spark, sf_dir)
    run, plan = _run(t)
    broken = run.where("not (stream_id = 'b' and partition_id % 5 = 3)").unionByName(t.labels_a.where("partition_id = 2").withColumn("stream_id", F.lit("a")))
    return R.finalize(broken, plan)[1]


@query("class_iou", oracle("labels_a labels_b", """
WITH m AS (SELECT a.class_index AS ref, b.class_index AS pred FROM labels_a AS a JOIN labels_b AS b USING (x, y))
SELECT c AS class_index, CAST(sum(r) AS BIGINT) AS reference, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits, round(sum(h) / (sum(r) + sum(p) - sum(h)), 6) AS iou
FROM (SELECT ref AS c, 1 AS r, 0 AS p, CASE WHEN ref = pred THEN 1 ELSE 0 END AS h FROM m UNION ALL SELECT pred, 0, 1, 0 FROM m) AS s GROUP BY c"""))
def class_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return R.class_iou(R.confusion(t.labels_a, t.labels_b)).withColumn("iou", F.round("iou", 6))


@query("seam_gap", oracle("labels_a labels_b", f"""
WITH m AS (SELECT a.class_index = b.class_index AS hit, {_BAND} AS seam FROM labels_a AS a JOIN labels_b AS b USING (x, y)),
t AS (SELECT avg(r) AS rate FROM (SELECT avg(CASE WHEN a.class_index <> b.class_index THEN 1.0 ELSE 0.0 END) AS r FROM labels_a AS a JOIN labels_a AS b ON a.x = b.x - 1 AND a.y = b.y WHERE b.x % {SIDE} = 0 GROUP BY b.x
  UNION ALL SELECT avg(CASE WHEN a.class_index <> b.class_index THEN 1.0 ELSE 0.0 END) FROM labels_a AS a JOIN labels_a AS b ON a.y = b.y - 1 AND a.x = b.x WHERE b.y % {SIDE} = 0 GROUP BY b.y) AS l)
SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (seam), 6) AS seam_accuracy, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (NOT seam), 6) AS other_accuracy,
  round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (NOT seam) - avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (seam), 6) AS accuracy_gap, round(any_value(rate), 6) AS transition_rate FROM m, t"""))
def seam_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy within and outside the bands along the seams, what the seams cost, and the mean over all lines of their rates of change."""
    t = Tables(spark, sf_dir)
    ref = t.labels_a.withColumn("seam", R.seam_band(F.col("x"), F.col("y"), SIDE, 2))
    by = R.confusion(ref, t.labels_b, ["seam"])
    hit = lambda seam: F.sum(F.when((F.col("seam") == seam) & (F.col("ref") == F.col("pred")), F.col("pixels")).otherwise(0)) / F.sum(F.when(F.col("seam") == seam, F.col("pixels")))
    rate = R.seam_transitions(t.labels_a, SIDE).agg(F.round(F.avg("rate"), 6).alias("transition_rate"))
    return by.agg(F.round(hit(True), 6).alias("seam_accuracy"), F.round(hit(False), 6).alias("other_accuracy"), F.round(hit(False) - hit(True), 6).alias("accuracy_gap")).join(F.broadcast(rate))

