"""Queries on proposals of the clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.operators import adjudication
from loamgrid.operators import cleanup as C
from loamgrid.operators import contacts
from loamgrid.operators import proposals as O
from loamgrid.operators import rasters as R
from loamgrid.operators.adjudication import Rules
from loamgrid.plans.fixtures import SIDE, Tables, oracle
from loamgrid.plans.raster import components_sql
from loamgrid.plans.store import _P
from loamgrid.registry import query

REACH, LARGEST = 4, 5
_LIMIT = "(6 + class_index % 5)"
_BASE = f"""WITH RECURSIVE {components_sql(0)},
step AS (SELECT dx, dy FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)),
rim AS (SELECT min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM px),
shape AS (SELECT component_id, class_index, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY 1, 2),
met AS (SELECT a.component_id, a.x, a.y, b.component_id AS target_id, b.class_index AS target_class FROM px AS a, step, px AS b WHERE b.x = a.x + dx AND b.y = a.y + dy),
part AS (SELECT s.*, s.x0 = l OR s.x1 = r OR s.y0 = t OR s.y1 = b OR 4 * n > (SELECT count(*) FROM met WHERE met.component_id = s.component_id) AS outer_, {_LIMIT} AS lim, class_index % 6 = 5 AS protected FROM shape AS s, rim),
src AS (SELECT * FROM part WHERE n < lim AND NOT protected AND NOT outer_),
tgt AS (SELECT DISTINCT m.component_id, target_class, target_id FROM met AS m JOIN src USING (component_id) WHERE m.target_id <> m.component_id),
wanted AS (SELECT DISTINCT target_id AS component_id FROM tgt), tpx AS (SELECT px.* FROM px JOIN wanted USING (component_id)),
dist AS (SELECT a.component_id AS u, b.component_id AS v, min(sqrt(pow(greatest(abs(a.x - b.x) - 1, 0), 2) + pow(greatest(abs(a.y - b.y) - 1, 0), 2))) AS d FROM tpx AS a JOIN tpx AS b ON a.class_index = b.class_index AND a.component_id < b.component_id AND abs(a.x - b.x) <= {REACH + 1} AND abs(a.y - b.y) <= {REACH + 1} GROUP BY 1, 2),
link AS (SELECT component_id, target_class, a.target_id AS u, b.target_id AS v, d FROM tgt AS a JOIN tgt AS b USING (component_id, target_class) JOIN dist ON dist.u = least(a.target_id, b.target_id) AND dist.v = greatest(a.target_id, b.target_id) WHERE a.target_id <> b.target_id AND d <= {REACH}),
walk AS (SELECT component_id, target_class, min(target_id) AS node, CAST(0.0 AS DOUBLE) AS cost FROM tgt GROUP BY 1, 2 UNION SELECT w.component_id, w.target_class, v, greatest(cost, d) FROM walk AS w JOIN link AS l ON l.component_id = w.component_id AND l.target_class = w.target_class AND l.u = w.node),
reach AS (SELECT component_id, target_class, node, min(cost) AS cost FROM walk GROUP BY 1, 2, 3),
neck AS (SELECT t.component_id, t.target_class, CASE WHEN count(cost) = count(*) THEN max(cost) END AS bottleneck FROM tgt AS t LEFT JOIN reach AS r ON r.component_id = t.component_id AND r.target_class = t.target_class AND r.node = t.target_id GROUP BY 1, 2 HAVING count(*) > 1),
delta AS (SELECT t.component_id, t.target_class, count(*) AS k, CAST(CASE WHEN max(s.n) < max(s.lim) THEN 1 ELSE 0 END + count(*) FILTER (p.n < p.lim) - CASE WHEN sum(p.n) + max(s.n) < max(p.lim) THEN 1 ELSE 0 END AS BIGINT) AS gain FROM tgt AS t JOIN src AS s USING (component_id) JOIN part AS p ON p.component_id = t.target_id GROUP BY 1, 2)"""
_ROUTED = f""", cls AS (SELECT t.component_id, s.class_index, s.n, t.target_class, count(*) AS k, t.target_class % 7 <> 3 AS grows FROM tgt AS t JOIN src AS s USING (component_id) GROUP BY 1, 2, 3, 4),
asked AS (SELECT *, count(*) OVER (PARTITION BY component_id) AS classes, (SELECT count(*) FROM px WHERE px.class_index = cls.target_class) AS share FROM cls),
lone AS (SELECT component_id, grows AND (class_index + target_class) % 5 <> 0 AS ok, target_class FROM asked WHERE classes = 1),
bridge AS (SELECT component_id, target_class FROM asked JOIN neck USING (component_id, target_class) JOIN delta USING (component_id, target_class) WHERE classes > 1 AND grows AND (class_index + target_class + 1) % 5 <> 0 AND asked.k > 1 AND n <= {LARGEST} AND bottleneck <= {REACH} AND gain >= 0),
rest AS (SELECT * FROM asked WHERE classes > 1 AND component_id NOT IN (SELECT component_id FROM bridge)),
legal AS (SELECT component_id, target_class, share, (SELECT round(avg({_P.format(k='rest.target_class')}), 9) FROM px WHERE px.component_id = rest.component_id) AS p FROM rest WHERE grows AND (class_index + target_class + 2) % 5 <> 0),
first_ AS (SELECT component_id, target_class FROM legal QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY share, p DESC, target_class) = 1),
routed AS (
  SELECT component_id, CASE WHEN protected THEN 'protected_source' WHEN outer_ THEN 'external_or_invalid_boundary' ELSE 'not_small_fragment' END AS outcome, CAST(NULL AS BIGINT) AS target_class FROM part WHERE component_id NOT IN (SELECT component_id FROM src)
  UNION ALL SELECT component_id, CASE WHEN ok THEN 'unique_enclosure' ELSE 'target_growth_denied' END, CASE WHEN ok THEN target_class END FROM lone
  UNION ALL SELECT component_id, 'same_class_bridge', target_class FROM bridge UNION ALL SELECT component_id, 'multi_neighbour', target_class FROM first_
  UNION ALL SELECT DISTINCT component_id, 'no_legal_target', CAST(NULL AS BIGINT) FROM rest WHERE component_id NOT IN (SELECT component_id FROM first_))"""


class _Work:
    """What the proposal queries share: pixels with components, parts, small sources and what they touch."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        from loamgrid.sources.scratch import saved

        self.pixels = saved(R.with_components(Tables(spark, sf_dir).labels_a), "pixels")
        self.parts = saved(R.components(self.pixels), "parts")
        self.open = contacts.component_open_sides(self.pixels)
        self.contacts = saved(contacts.adjacency(self.pixels), "contacts")
        limit = F.expr(_LIMIT)
        small = self.parts.join(self.open, "component_id").where((F.col("pixel_count") < limit) & (F.col("class_index") % 6 != 5) & ~F.col("touches_border") & (F.col("open") == 0))
        self.targets = saved(O.touched(self.contacts, small), "targets")
        self.limits = self.pixels.select("class_index").distinct().withColumn("limit", limit)

    def bottlenecks(self) -> DataFrame:
        near = self.pixels.join(self.targets.select(F.col("target_id").alias("component_id")).distinct(), "component_id", "left_semi")
        return O.bridge_bottleneck(self.targets, O.component_distances(near, REACH))

    def deltas(self) -> DataFrame:
        return O.topology_delta(self.targets, self.parts, self.limits)

    def means(self) -> DataFrame:
        probs = F.array(*[F.when(F.col("class_index") == k, F.col("confidence")).otherwise((1 - F.col("confidence")) * (1 + (F.col("x") + 3 * F.col("y") + 5 * k) % 7) / 8) for k in range(14)])
        return C.mean_probabilities(self.pixels.withColumn("probs", probs), 14)

    def routed(self) -> DataFrame:
        share = self.pixels.groupBy("class_index").agg(F.count("*").alias("share"))
        policy = self.limits.join(share, "class_index").withColumns({"protected": F.col("class_index") % 6 == 5, "grows": F.col("class_index") % 7 != 3})
        pairs = self.limits.select("class_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(13).cast("long"))).alias("target_class"))
        relations = pairs.select("*", *(O.allowed(F.col("class_index"), F.col("target_class"), i).alias(s) for i, s in enumerate(("unique_enclosure", "same_class_bridge", "multi_neighbour"))))
        return O.route(self.parts, self.contacts, self.open, self.targets, self.means(), self.bottlenecks(), self.deltas(), policy, relations, LARGEST, REACH)


@query("bridge_bottleneck", oracle("labels_a", f"{_BASE} SELECT component_id, target_class, round(bottleneck, 6) AS bottleneck FROM neck"))
def bridge_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Work(spark, sf_dir).bottlenecks().withColumn("bottleneck", F.round("bottleneck", 6))


@query("bridge_path", oracle("labels_a", f"""{_BASE}, go AS (SELECT DISTINCT m.component_id, m.target_class, m.target_id AS start, m.x, m.y, 0 AS steps, CAST(0 AS DOUBLE) AS len FROM met AS m JOIN src USING (component_id) WHERE m.target_id <> m.component_id
UNION SELECT g.component_id, g.target_class, g.start, p.x, p.y, steps + 1, len + CASE WHEN dx = 0 THEN 0.5 ELSE 0.25 END FROM go AS g, step, px AS p, src AS s WHERE p.x = g.x + dx AND p.y = g.y + dy AND p.component_id = g.component_id AND s.component_id = g.component_id AND steps + 1 < s.n),
far AS (SELECT g.component_id, g.target_class, g.start, m.target_id, min(g.len) AS len FROM go AS g JOIN met AS m ON m.component_id = g.component_id AND m.target_class = g.target_class AND m.x = g.x AND m.y = g.y AND m.target_id <> g.start GROUP BY 1, 2, 3, 4)
SELECT t.component_id, t.target_class, coalesce(max(f.len), 0)::DOUBLE AS path FROM (SELECT DISTINCT component_id, target_class FROM tgt) AS t LEFT JOIN far AS f USING (component_id, target_class) GROUP BY 1, 2"""))
def bridge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _Work(spark, sf_dir)
    return O.bridge_path(work.pixels, work.targets, 0.25, 0.5)


@query("topology_delta", oracle("labels_a", f"{_BASE} SELECT component_id, target_class, k AS components_removed, gain AS fragments_removed FROM delta"))
def topology_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Work(spark, sf_dir).deltas()


@query("rarest_target", oracle("labels_a", f"""{_BASE}, s AS (SELECT class_index, count(*) AS share FROM px GROUP BY 1),
o AS (SELECT DISTINCT t.component_id, t.target_class, share, (SELECT round(avg({_P.format(k='t.target_class')}), 9) FROM px WHERE px.component_id = t.component_id) AS p FROM tgt AS t JOIN s ON s.class_index = t.target_class)
SELECT component_id, target_class FROM o QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY share, p DESC, target_class) = 1"""))
def rarest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the classes that a small component touches the rarest, then the likeliest, then the lowest."""
    work = _Work(spark, sf_dir)
    share = work.pixels.groupBy(F.col("class_index").alias("target_class")).agg(F.count("*").alias("share"))
    return O.rarest(work.targets, share, work.means())


@query("route_fragments", oracle("labels_a", f"{_BASE}{_ROUTED} SELECT * FROM routed"))
def route_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Work(spark, sf_dir).routed()


def _proposals(work: _Work) -> tuple[DataFrame, DataFrame]:
    """Routed proposals over whole components, and corridors beside the bridges; with them their cells.

    Rank: fragments and components removed, the target's rarity, its probability, the area, the class, the footprint's digest.
    """
    from loamgrid.sources.scratch import saved

    chosen = saved(work.routed().where("target_class is not null"), "chosen")
    ids = work.targets.groupBy("component_id", "target_class").agg(F.sort_array(F.collect_set("target_id")).alias("target_ids"))
    gains = work.deltas()
    key = F.concat_ws(":", "component_id", "target_class")
    whole = chosen.join(gains, ["component_id", "target_class"]).join(ids, ["component_id", "target_class"]).withColumn("proposal_id", F.concat(key, F.lit(":whole")))
    whole_cells = work.pixels.select("component_id", "x", "y").join(whole.select("component_id", "proposal_id"), "component_id").select("proposal_id", "x", "y")
    bridges = chosen.where("outcome = 'same_class_bridge'")
    ways = O.corridors(work.pixels, work.targets.join(bridges.select("component_id", "target_class"), ["component_id", "target_class"], "left_semi"))
    ways = saved(ways.withColumn("proposal_id", F.concat(key, F.lit(":corridor"))), "corridors")
    cells = saved(whole_cells.unionByName(ways.select("proposal_id", "x", "y")), "footprints")
    area = cells.groupBy("proposal_id").agg(F.count("*").alias("area"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "y", "x"))), ","), 256).alias("digest"))
    narrow = ways.groupBy("proposal_id", "component_id", "target_class").agg(F.first("target_ids").alias("target_ids"))
    sizes = work.parts.select(F.col("component_id").alias("target_id"), (F.col("pixel_count") < F.expr(_LIMIT)).cast("int").alias("small"))
    small = narrow.select("proposal_id", F.explode("target_ids").alias("target_id")).join(sizes, "target_id").groupBy("proposal_id").agg((F.sum("small") - F.min("small")).alias("fragments_removed"))
    narrow = narrow.join(small, "proposal_id").withColumns({"components_removed": F.lit(1).cast("long"), "outcome": F.lit("same_class_bridge")})
    share = work.pixels.groupBy(F.col("class_index").alias("target_class")).agg(F.count("*").alias("share"))  # a row a class
    both = whole.select(*(c for c in narrow.columns)).unionByName(narrow).join(area, "proposal_id").join(F.broadcast(share), "target_class").join(work.means(), "component_id")
    rank = F.struct((-F.col("fragments_removed")).alias("f"), (-F.col("components_removed")).alias("c"), F.col("share").alias("s"), (-F.round(F.get("means", F.col("target_class").cast("int")), 9)).alias("p"), F.col("area").alias("a"), F.col("target_class").alias("t"), F.col("digest").alias("d"))
    return both.select("proposal_id", F.col("outcome").alias("kind"), "target_class", "target_ids", rank.alias("rank")), cells


@query("adjudicate")
def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every proposal under its partition's budgets; order matters, so the tests hold it against recounting after each step."""
    from loamgrid.sources.scratch import saved

    work = _Work(spark, sf_dir)
    proposals, cells = _proposals(work)
    rules = Rules({c: 6 + c % 5 for c in range(14)}, loss=0.2, gain=0.2, bridge_gain=0.01, protected=frozenset(c for c in range(14) if c % 6 == 5))
    return adjudication.adjudicate(saved(proposals, "proposals"), cells, work.pixels, work.parts, rules, SIDE)


_CHANGED = "(x + y) % 4 <> 0"


@query("cleanup_topology_check", oracle("labels_a", f"""{_BASE}{_ROUTED}, one AS (SELECT component_id, min(target_class) AS new_class FROM routed WHERE target_class IS NOT NULL GROUP BY 1),
chg AS (SELECT px.x, px.y, px.class_index, px.component_id, o.component_id AS proposal, o.new_class FROM px LEFT JOIN one AS o ON o.component_id = px.component_id AND {_CHANGED}),
left_ AS (SELECT x, y, component_id AS class_index FROM chg WHERE proposal IS NULL AND component_id IN (SELECT component_id FROM chg WHERE proposal IS NOT NULL)),
result AS (SELECT x, y, coalesce(new_class, class_index) AS class_index, proposal FROM chg), {components_sql(0, 'left_', 'l_')}, {components_sql(0, 'result', 'r_')},
kept AS (SELECT component_id, count(*) FILTER (proposal IS NULL) AS kept FROM r_px GROUP BY 1)
SELECT 'source' AS kind, c.component_id AS id, coalesce(pieces, 0) AS pieces, coalesce(pieces, 0) <= 1 AS safe FROM (SELECT DISTINCT component_id FROM chg WHERE proposal IS NOT NULL) AS c LEFT JOIN (SELECT class_index, count(DISTINCT component_id) AS pieces FROM l_px GROUP BY 1) AS l ON l.class_index = c.component_id
UNION ALL SELECT 'proposal', proposal, count(*), count(*) = 1 AND min(kept) > 0 FROM (SELECT DISTINCT proposal, component_id FROM r_px WHERE proposal IS NOT NULL) AS e JOIN kept USING (component_id) GROUP BY proposal"""))
def cleanup_topology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of which only a part of the pixels is taken, so that some break their source or don't reach a target."""
    work = _Work(spark, sf_dir)
    one = work.routed().where("target_class is not null").groupBy("component_id").agg(F.min("target_class").alias("new_class"))
    changes = work.pixels.where(_CHANGED).join(one, "component_id").select("x", "y", F.col("component_id").alias("proposal"), "new_class")
    return O.topology_check(work.pixels, changes)
