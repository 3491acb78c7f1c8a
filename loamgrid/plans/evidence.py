"""Queries on unit probabilities, budgets, decision traces, distances and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import arrays as A
from loamgrid.operators import cleanup as C
from loamgrid.operators import contacts
from loamgrid.operators import probabilities as P
from loamgrid.operators import rasters as R
from loamgrid.operators.distance import nearest
from loamgrid.plans.fixtures import Tables, oracle
from loamgrid.plans.probability import long
from loamgrid.plans.store import _C8, _candidates, _judged, _targets
from loamgrid.registry import query

_HALO = """halo AS (SELECT x, y, (hx + 3 * hy) % 3 AS model_id FROM (SELECT DISTINCT x, y FROM scores) AS s,
  LATERAL (SELECT unnest(range(greatest(0, CAST(floor((x - 2) / 12) AS BIGINT)), least((SELECT max(x) // 12 FROM scores), CAST(floor((x + 2) / 12) AS BIGINT)) + 1)) AS hx) AS a,
  LATERAL (SELECT unnest(range(greatest(0, CAST(floor((y - 2) / 12) AS BIGINT)), least((SELECT max(y) // 12 FROM scores), CAST(floor((y + 2) / 12) AS BIGINT)) + 1)) AS hy) AS b),
mean AS (SELECT x, y, class_index, sum(p) AS p FROM halo JOIN scores USING (x, y, model_id) GROUP BY 1, 2, 3), unit AS (SELECT x, y, class_index, p / sum(p) OVER (PARTITION BY x, y) AS p FROM mean)"""


def _unit_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the partition halos that cover a pixel, each partition scored by its own model; renormalised."""
    scores = Tables(spark, sf_dir).scores
    halo = R.partition_halo(scores.select("x", "y").distinct(), 12, 2).withColumn("model_id", ((F.col("halo_x") + 3 * F.col("halo_y")) % 3).cast("int"))
    sums = halo.join(scores, ["x", "y", "model_id"]).groupBy("x", "y").agg(*P.class_sums(F.col("probs")))
    return sums.select("x", "y", A.normalized(P.as_array()).alias("probs"))


@query("unit_probability", oracle("scores", f"WITH {_HALO} SELECT x, y, class_index, round(p, 6) AS p FROM unit"))
def unit_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(_unit_probability(spark, sf_dir), "x", "y")


@query("unit_confidence", oracle("scores labels_a", f"WITH {_HALO}, best AS (SELECT x, y, max(p) AS c FROM unit GROUP BY x, y) SELECT l.x, l.y, round(coalesce(c, -1.0), 6) AS confidence FROM labels_a AS l LEFT JOIN best USING (x, y)"))
def unit_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest probability of each labelled pixel, -1 where no model has scored it."""
    best = _unit_probability(spark, sf_dir).select("x", "y", F.array_max("probs").alias("c"))
    rows = Tables(spark, sf_dir).labels_a.select("x", "y").join(best, ["x", "y"], "left")
    return rows.select("x", "y", F.round(F.coalesce("c", F.lit(-1.0)), 6).alias("confidence"))


def _chosen(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    pixels, judged = _judged(t)
    return pixels, judged, _targets(t, pixels, judged)


@query("absorb_budgeted")
def absorb_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under loss and gain budgets of their partition; order matters, so the tests hold it against a loop."""
    pixels, _, chosen = _chosen(Tables(spark, sf_dir))
    owner = pixels.groupBy("component_id").agg(F.min("partition_id").alias("owner"))
    totals = pixels.groupBy(F.col("partition_id").alias("owner"), "class_index").agg(F.count("*").alias("pixels"))
    return C.budgeted(chosen.join(owner, "component_id"), totals, 0.2, 0.1, 5)


@query("boundary_delta", oracle("labels_a classes", f"""{_C8}, c4 AS (SELECT a.component_id, b.class_index AS other_class_index, count(*) AS n FROM px AS a, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy), px AS b WHERE b.x = a.x + dx AND b.y = a.y + dy AND a.component_id <> b.component_id GROUP BY 1, 2)
SELECT component_id, -coalesce(n, 0) AS delta FROM target LEFT JOIN c4 USING (component_id) WHERE c4.other_class_index = target_class
UNION ALL SELECT component_id, 0 FROM target WHERE NOT EXISTS (SELECT 1 FROM c4 WHERE c4.component_id = target.component_id AND c4.other_class_index = target_class)"""))
def boundary_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, _, chosen = _chosen(Tables(spark, sf_dir))
    return C.boundary_delta(chosen, contacts.adjacency(pixels))


@query("explain_decisions", oracle("labels_a classes", f"""{_C8}, f AS (SELECT j.component_id, coalesce(reason, CASE WHEN c.component_id IS NULL THEN 'no_larger_neighbor' WHEN t.component_id IS NULL THEN 'probability_drop' END) AS failed FROM judged AS j LEFT JOIN target AS t USING (component_id) LEFT JOIN (SELECT DISTINCT component_id FROM cand) AS c USING (component_id)),
g AS (SELECT CAST(place AS INT) AS place, gate FROM (VALUES (1, 'outside_threshold'), (2, 'protected_class'), (3, 'touches_processing_border'), (4, 'elongated_component'), (5, 'no_larger_neighbor'), (6, 'probability_drop')) AS v(place, gate))
SELECT component_id, g.place, g.gate, g.gate IS DISTINCT FROM failed AS passed FROM f, g WHERE g.place <= coalesce((SELECT place FROM g AS h WHERE h.gate = failed), 6)"""))
def explain_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    pixels, judged, chosen = _chosen(t)
    return C.explain(judged, _candidates(t, pixels, judged), chosen)


_EDGE = "SELECT DISTINCT a.x, a.y FROM {0} AS a, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy), {0} AS b WHERE b.x = a.x + dx AND b.y = a.y + dy AND a.class_index <> b.class_index"


@query("boundary_distance", oracle("labels_a labels_b", f"""WITH a AS ({_EDGE.format('labels_a')}), b AS ({_EDGE.format('labels_b')}),
d AS (SELECT 'a_to_b' AS way, min(sqrt(pow((a.x - b.x) * 0.25, 2) + pow((a.y - b.y) * 0.5, 2))) AS m FROM a, b GROUP BY a.x, a.y UNION ALL SELECT 'b_to_a', min(sqrt(pow((a.x - b.x) * 0.25, 2) + pow((a.y - b.y) * 0.5, 2))) FROM b, a GROUP BY b.x, b.y)
SELECT way, count(*) AS cells, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.95), 6) AS p95, round(max(m), 6) AS most FROM d GROUP BY way"""))
def boundary_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances in metres from each boundary to the other, both ways, for pixels of 0.25 by 0.5 m."""
    from loamgrid.sources.scratch import saved

    t = Tables(spark, sf_dir)
    a, b = saved(contacts.boundary_cells(t.labels_a), "edge"), saved(contacts.boundary_cells(t.labels_b), "edge")
    both = nearest(a, b, 0.25, 0.5).withColumn("way", F.lit("a_to_b")).unionByName(nearest(b, a, 0.25, 0.5).withColumn("way", F.lit("b_to_a")))
    p = lambda q: F.round(F.percentile("distance", q), 6)
    return both.groupBy("way").agg(F.count("*").alias("cells"), p(0.5).alias("median"), p(0.95).alias("p95"), F.round(F.max("distance"), 6).alias("most"))


@query("sample_cells")
def sample_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten spread-out cells of each of five runs; greedy, so the tests hold its distances and firsts."""
    cells = R.cell_mixture(Tables(spark, sf_dir).labels_a, 4).withColumn("run_id", F.col("cell_y") % 5)
    return R.sample_cells(cells, "run_id", 10, 3)
