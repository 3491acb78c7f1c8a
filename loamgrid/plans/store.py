"""Queries over the store of accepted objects and over clean-up decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.operators import cleanup as C
from loamgrid.operators import contacts
from loamgrid.operators.coverage import coverage
from loamgrid.operators import rasters as R
from loamgrid.operators import spatial as P
from loamgrid.operators import store as S
from loamgrid.plans.fixtures import SIDE, Tables, oracle
from loamgrid.plans.raster import components_sql
from loamgrid.registry import query


@query("store_audit", oracle("store classes", """
WITH r AS (SELECT *, count(*) OVER (PARTITION BY source, part_id) AS copies FROM store)
SELECT doc_id, unnest(list_filter([CASE WHEN source IS NULL OR source = '' OR part_id = '' THEN 'empty_identity' END, CASE WHEN copies > 1 THEN 'duplicate_identity' END,
  CASE WHEN class_index NOT IN (SELECT class_index FROM classes WHERE class_index <> 13) THEN 'class_map' END, CASE WHEN reviewed <> 1 THEN 'not_reviewed' END, CASE WHEN area <= 0 THEN 'area' END], lambda i: i IS NOT NULL)) AS issue FROM r"""))
def store_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the store against a class map that misses one class."""
    t = Tables(spark, sf_dir)
    return S.audit(t.store, t.classes.where("class_index <> 13"))


@query("store_append", oracle("store", """
SELECT min(doc_id) AS doc_id, source, part_id FROM store AS p WHERE doc_id % 2 = 1 AND source NOT LIKE '%3' AND NOT EXISTS (SELECT 1 FROM store AS s WHERE s.doc_id % 2 = 0 AND s.source = p.source AND s.part_id = p.part_id) GROUP BY source, part_id"""))
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).store
    ready = rows.select("source").distinct().where("source not like '%3'")
    return S.append(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ready).select("doc_id", "source", "part_id")


@query("final_assembly", oracle("store classes", """
SELECT class_code, count(doc_id) AS objects, count(DISTINCT part_id) AS identities, count(doc_id) = 0 AS missing FROM classes LEFT JOIN (SELECT * FROM store WHERE class_index <> 6) AS s USING (class_index) GROUP BY class_code"""))
def final_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the class layers, and the classes that no layer brings."""
    t = Tables(spark, sf_dir)
    rows = t.store.where("class_index <> 6").groupBy("class_index").agg(F.count("*").alias("objects"), F.countDistinct("part_id").alias("identities"))
    rows = t.classes.join(rows, "class_index", "left").fillna(0, ["objects", "identities"])
    return rows.select("class_code", "objects", "identities", (F.col("objects") == 0).alias("missing"))


_SHAPES = "SELECT box_id, class_index, x0, y0, CASE WHEN box_id % 97 = 0 THEN x0 WHEN box_id % 89 = 0 THEN x0 - 2 ELSE x1 END AS x1, y1 FROM {0}"
#: Side of the range that must be covered: the whole plane of the boxes.
_RANGE = 1000


@query("topology_issues", oracle("boxes", f"""
WITH s AS ({_SHAPES.format('boxes')}), ok AS (SELECT * FROM s WHERE x1 > x0 AND y1 > y0),
p AS (SELECT a.class_index = b.class_index AS same, (a.box_id % 10 = 0) <> (b.box_id % 10 = 0) AS accepted FROM ok AS a JOIN ok AS b ON a.box_id < b.box_id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
covered AS (SELECT DISTINCT x, y FROM ok, LATERAL (SELECT unnest(range(x0, x1)) AS x) AS h, LATERAL (SELECT unnest(range(y0, y1)) AS y) AS v)
SELECT CASE WHEN same THEN 'same_class_overlap' ELSE 'cross_class_overlap' END AS issue, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'accepted_overlap', count(*) FROM p WHERE accepted UNION ALL SELECT 'thin', count(*) FROM ok WHERE x1 - x0 < 2 OR y1 - y0 < 2
UNION ALL SELECT 'empty', count(*) FROM s WHERE x1 = x0 OR y1 = y0 UNION ALL SELECT 'invalid', count(*) FROM s WHERE x1 < x0 OR y1 < y0 UNION ALL SELECT 'gap', {_RANGE * _RANGE} - count(*) FILTER (x BETWEEN 0 AND {_RANGE - 1} AND y BETWEEN 0 AND {_RANGE - 1}) FROM covered UNION ALL SELECT 'outside', count(*) FILTER (x NOT BETWEEN 0 AND {_RANGE - 1} OR y NOT BETWEEN 0 AND {_RANGE - 1}) FROM covered"""))
def topology_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of issues in one schema, counted: empty, invalid and thin shapes, overlaps within and across classes and with accepted shapes, area of the plane that no shape covers, and area beyond it."""
    shapes = spark.sql(_SHAPES.format("{boxes}"), boxes=Tables(spark, sf_dir).boxes)
    ok = shapes.where("x1 > x0 and y1 > y0")
    pairs = P.overlap_join(ok, ok, F.col("a.box_id") < F.col("b.box_id"))
    met = pairs.select(F.when(F.col("a.class_index") == F.col("b.class_index"), "same_class_overlap").otherwise("cross_class_overlap").alias("issue"), ((F.col("a.box_id") % 10 == 0) != (F.col("b.box_id") % 10 == 0)).alias("accepted"))
    overlaps = met.select(F.explode(F.array_compact(F.array("issue", F.when(F.col("accepted"), "accepted_overlap")))).alias("issue"))
    kinds = F.array_compact(F.array(F.when(F.expr("x1 = x0 or y1 = y0"), "empty"), F.when(F.expr("x1 < x0 or y1 < y0"), "invalid"), F.when(F.expr("x1 > x0 and y1 > y0 and (x1 - x0 < 2 or y1 - y0 < 2)"), "thin")))
    counts = overlaps.unionAll(shapes.select(F.explode(kinds))).groupBy("issue").agg(F.count("*").alias("n"))
    plane = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", _RANGE), ("y1", _RANGE))])
    found = coverage(ok, plane)
    gap = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("issue"), F.col(c).alias("n")) for c in ("gap", "outside")])).alias("s")).select("s.*")
    names = spark.createDataFrame([(x,) for x in ("accepted_overlap", "thin", "empty", "invalid")], "issue string").select("issue", F.lit(0).cast("long").alias("n"))
    return counts.unionByName(gap).unionByName(names).groupBy("issue").agg(F.sum("n").alias("n"))


@query("workspace_stats", oracle("store", "SELECT class_index, source, count(*) AS n, CAST(sum(area) AS BIGINT) AS area FROM store GROUP BY class_index, source"))
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).store.groupBy("class_index", "source").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("refresh_blockers", oracle("store", """
SELECT class_index, list_sort(list_filter([CASE WHEN bool_or(reviewed = 0) THEN 'unreviewed' END, CASE WHEN bool_or(area < 100) THEN 'edited' END, CASE WHEN count(*) > 75 THEN 'exported' END], lambda r: r IS NOT NULL)) AS blockers FROM store GROUP BY class_index"""))
def refresh_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a class layer must not be refreshed."""
    found = F.array_compact(F.array(F.when(F.bool_or(F.col("reviewed") == 0), "unreviewed"), F.when(F.bool_or(F.col("area") < 100), "edited"), F.when(F.count("*") > 75, "exported")))
    return Tables(spark, sf_dir).store.groupBy("class_index").agg(F.sort_array(found).alias("blockers"))


_OLD = "SELECT doc_id, part_id AS digest, 1 + doc_id % 3 AS revision FROM store WHERE doc_id % 7 <> 0"
_NEW = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha1(part_id) ELSE part_id END AS digest FROM store WHERE doc_id % 11 <> 0"
_DIFF = f"""old AS ({_OLD}), new AS ({_NEW}), d AS (SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, old.revision, CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'deleted' WHEN old.digest <> new.digest THEN 'modified' END AS change FROM old FULL JOIN new ON old.doc_id = new.doc_id)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Tables(spark, sf_dir).store
    return S.diff(spark.sql(_OLD.replace("store", "{s}"), s=store), spark.sql(_NEW.replace("store", "{s}"), s=store), "doc_id", "digest")


@query("edit_diff", oracle("store", f"WITH {_DIFF} SELECT doc_id, change, CASE WHEN change = 'modified' THEN revision + 1 ELSE coalesce(revision, 1) END AS revision FROM d WHERE change IS NOT NULL"))
def edit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query("edit_history", oracle("store", f"WITH {_DIFF} SELECT change, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, change FROM d WHERE change IS NOT NULL UNION ALL SELECT doc_id, 'imported' FROM old) AS h GROUP BY change"))
def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history with the new edits appended, by kind."""
    before = Tables(spark, sf_dir).store.where("doc_id % 7 <> 0").select("doc_id", F.lit("imported").alias("change"))
    rows = before.unionByName(_diff(spark, sf_dir).select("doc_id", "change"))
    return rows.groupBy("change").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("match_revisions")
def match_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new shapes of each edit batch matched one to one by falling overlap; held against brute force in the tests."""
    boxes = Tables(spark, sf_dir).boxes
    old = boxes.select((F.col("box_id") % 50).alias("batch"), F.col("box_id").alias("old_id"), "x0", "y0", "x1", "y1")
    new = boxes.select((F.col("box_id") + 100000).alias("new_id"), *[(F.col(c) + F.col("box_id") % 3).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return S.match_boxes(old, new)


_IV = "SELECT c_custkey AS part_id, c_custkey % 40 AS unit_id, CAST(c_nationkey % 3 AS BIGINT) AS class_code, c_custkey % 2 AS axis, c_nationkey * 10 AS fixed, CAST(c_custkey * 7 % 500 AS DOUBLE) AS lo, CAST(c_custkey * 7 % 500 + 1 + c_custkey % 4 AS DOUBLE) AS hi FROM customer"
_LINKS = f"iv AS ({_IV}), links AS (SELECT DISTINCT a.part_id AS l, b.part_id AS r FROM iv AS a JOIN iv AS b ON a.class_code = b.class_code AND a.axis = b.axis AND a.fixed = b.fixed AND a.unit_id < b.unit_id AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0.5)"


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_IV.replace("FROM customer", "FROM {c}"), c=Tables(spark, sf_dir).customer)


@query("interval_links", oracle("", f'WITH {_LINKS} SELECT l AS "left", r AS "right" FROM links'))
def interval_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interval_links(_intervals(spark, sf_dir), 0.5)


@query("object_identity", oracle("", f"""WITH RECURSIVE {_LINKS}, e AS (SELECT l, r FROM links UNION ALL SELECT r, l FROM links), reach AS (SELECT part_id AS a, part_id AS b FROM iv UNION SELECT reach.a, e.r FROM reach JOIN e ON reach.b = e.l)
SELECT a AS part_id, 'obj_' || left(sha1('run-1|model:a|' || min(b)), 24) AS object_id FROM reach GROUP BY a"""))
def object_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _intervals(spark, sf_dir)
    return S.object_identity(S.interval_links(parts, 0.5), parts.select("part_id"), "run-1|model:a|")


@query("boundary_signatures", oracle("labels_a", f"""WITH RECURSIVE {components_sql(0)},
edge AS (SELECT partition_id, component_id, class_index, 'west' AS edge, x AS fixed, y AS p FROM px WHERE x % {SIDE} = 0 UNION ALL SELECT partition_id, component_id, class_index, 'east', x + 1, y FROM px WHERE x % {SIDE} = {SIDE - 1}
  UNION ALL SELECT partition_id, component_id, class_index, 'north', y, x FROM px WHERE y % {SIDE} = 0 UNION ALL SELECT partition_id, component_id, class_index, 'south', y + 1, x FROM px WHERE y % {SIDE} = {SIDE - 1})
SELECT partition_id, component_id, class_index, edge, fixed, min(p) AS lo, max(p) + 1 AS hi FROM (SELECT *, p - row_number() OVER (PARTITION BY partition_id, component_id, edge, fixed ORDER BY p) AS island FROM edge) AS i GROUP BY partition_id, component_id, class_index, edge, fixed, island"""))
def boundary_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every object lies along the four edges of each partition's window."""
    return R.boundary_signatures(R.with_components(Tables(spark, sf_dir).labels_a), SIDE)


@query("accepted_difference", oracle("labels_a", f"""WITH RECURSIVE open_ AS (SELECT * FROM labels_a WHERE NOT (x % 9 < 2 AND class_index % 2 = 0)), {components_sql(0, 'open_')}
SELECT component_id, class_index, pixels, class_index || ':d' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS part_id
FROM (SELECT component_id, class_index, count(*) AS pixels, row_number() OVER (PARTITION BY class_index ORDER BY component_id) AS n FROM px GROUP BY component_id, class_index) AS p"""))
def accepted_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the objects without the accepted cells, its parts numbered anew within their class."""
    labels = Tables(spark, sf_dir).labels_a
    accepted = labels.where("x % 9 < 2 and class_index % 2 = 0").select("x", "y")
    parts = R.with_components(labels.join(accepted, ["x", "y"], "left_anti")).groupBy("component_id", "class_index").agg(F.count("*").alias("pixels"))
    return S.numbered_parts(parts, 64 * R.WIDE)


_VERTEX = "SELECT vec_id AS ring, i AS seq, sum(CASE WHEN i % 2 = 1 THEN 1 + floor(abs(CAST(embedding[i] AS DOUBLE)) * 10) ELSE 0 END) OVER w AS x, sum(CASE WHEN i % 2 = 0 THEN 1 + floor(abs(CAST(embedding[i] AS DOUBLE)) * 10) ELSE 0 END) OVER w AS y FROM embeddings, range(1, 65) AS t(i) WINDOW w AS (PARTITION BY vec_id ORDER BY i)"


@query("staircase_metrics", oracle("", f"""WITH v AS ({_VERTEX}), s AS (SELECT ring, seq, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM v WINDOW w AS (PARTITION BY ring ORDER BY seq)),
l AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, abs(dy) <= 0.15 AS h, abs(dx) <= 0.15 AS vv FROM s WHERE dx IS NOT NULL), t AS (SELECT *, len <= 2 AND lag(len) OVER w <= 2 AND ((lag(h) OVER w AND vv) OR (lag(vv) OVER w AND h)) AS turn FROM l WINDOW w AS (PARTITION BY ring ORDER BY seq))
SELECT ring, count(*) AS segments, round(count(*) FILTER (len <= 1.5) / count(*), 6) AS short_ratio, count(*) FILTER (turn) AS turns, round(count(*) FILTER (turn) * 100.0 / sum(len), 6) AS turns_per_100px FROM t GROUP BY ring"""))
def staircase_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.posexplode(F.transform("embedding", lambda e: 1 + F.floor(F.abs(e.cast("double")) * 10)))
    rows = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("ring"), step.alias("i", "s"))
    by = W.partitionBy("ring").orderBy("i")
    vertices = rows.select("ring", F.col("i").alias("seq"), F.sum(F.when(F.col("i") % 2 == 0, F.col("s")).otherwise(0)).over(by).alias("x"), F.sum(F.when(F.col("i") % 2 == 1, F.col("s")).otherwise(0)).over(by).alias("y"))
    return S.staircase(vertices).withColumns({c: F.round(c, 6) for c in ("short_ratio", "turns_per_100px")})


_RULES = """(VALUES ('r1', 'allow', '*', '*', '*', 1, 0), ('r2', 'deny', '12', '*', '*', 5, 1), ('r3', 'allow', '12', '13', '*', 1, 2), ('r4', 'deny', '12', '13', 'bridge', 0, 3), ('r5', 'allow', '21', '*', 'bridge', 3, 2),
  ('r6', 'deny', '*', '52', 'bridge', 3, 2), ('r7', 'deny', '31', '52', '*', 2, 2)) AS r(id, effect, source, target, scenario, priority, specificity)"""
_ASKS = "SELECT DISTINCT CAST(a.class_code AS STRING) AS source, CAST(b.class_code AS STRING) AS target, CASE o.o_orderkey % 2 WHEN 0 THEN 'bridge' ELSE 'absorb' END AS scenario FROM {orders} AS o JOIN {classes} AS a ON a.class_index = o.o_custkey % 14 JOIN {classes} AS b ON b.class_index = o.o_orderkey % 14"


@query("relation_permission", oracle("classes", f"""WITH asks AS ({_ASKS.replace('{', '').replace('}', '')}), m AS (SELECT q.*, r.effect, rank() OVER (PARTITION BY q.source, q.target, q.scenario ORDER BY specificity DESC, priority DESC) AS n FROM asks AS q LEFT JOIN {_RULES} ON r.source IN ('*', q.source) AND r.target IN ('*', q.target) AND r.scenario IN ('*', q.scenario))
SELECT source, target, scenario, coalesce(bool_and(effect = 'allow'), false) AS allowed FROM m WHERE n = 1 GROUP BY 1, 2, 3"""))
def relation_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return S.relation_permission(spark.sql(_ASKS, orders=t.orders, classes=t.classes), spark.sql(f"SELECT * FROM {_RULES}"))


@query("policy_diff", oracle("", """
WITH a AS (SELECT c_mktsegment || '.' || c_nationkey AS path, max(c_custkey) AS v FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1), b AS (SELECT c_mktsegment || '.' || c_nationkey AS path, max(c_custkey) AS v FROM customer WHERE c_custkey % 3 <> 1 AND c_nationkey <> 4 GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, a.v AS before, b.v AS after FROM a FULL JOIN b ON a.path = b.path WHERE a.v IS DISTINCT FROM b.v"""))
def policy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose values differ between two versions."""
    c = Tables(spark, sf_dir).customer
    flat = lambda rows, name: rows.groupBy(F.concat_ws(".", "c_mktsegment", "c_nationkey").alias("path")).agg(F.max("c_custkey").alias(name))
    both = flat(c.where("c_custkey % 3 <> 0"), "before").join(flat(c.where("c_custkey % 3 <> 1 and c_nationkey <> 4"), "after"), "path", "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


_PROP = "SELECT l_orderkey AS owner, l_partkey % 7 AS target, l_linenumber AS id, CAST(l_quantity AS BIGINT) AS score FROM lineitem"


@query("dedupe_proposals", oracle("", f"WITH p AS ({_PROP}) SELECT owner, target, count(*) AS discovered, min_by(id, (score, id)) AS id, max(score) > min(score) AS inconsistent FROM p GROUP BY owner, target"))
def dedupe_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposal for each canonical key, how often it was found, and whether its scores disagree."""
    rows = spark.sql(_PROP.replace("FROM lineitem", "FROM {t}"), t=Tables(spark, sf_dir).lineitem)
    return rows.groupBy("owner", "target").agg(F.count("*").alias("discovered"), F.min_by("id", F.struct("score", "id")).alias("id"), (F.max("score") > F.min("score")).alias("inconsistent"))


@query("rank_proposals", oracle("", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_tax, l_quantity DESC, l_extendedprice, sha1(CAST(l_partkey AS VARCHAR)), l_partkey, l_linenumber, l_suppkey) AS INT) AS place FROM lineitem"""))
def rank_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within an owner by fields in policy order, then digest and id."""
    policy = (("l_discount", False), ("l_tax", True), ("l_quantity", False), ("l_extendedprice", True))
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in policy]
    by = W.partitionBy("l_orderkey").orderBy(*order, F.sha1(F.col("l_partkey").cast("string")), "l_partkey", "l_linenumber", "l_suppkey")
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(by).alias("place"))


#: Weights of contact share and mean probability; the drop of probability allowed from HARD pixels on; pixels below which any target is compatible.
SHARE_WEIGHT, P_WEIGHT, DROP, HARD, BYPASS = 0.6, 0.4, 0.75, 3, 4
#: Probability of class k at a pixel: the confidence for its label, a share of the rest for others.
_P = "CASE WHEN {k} = px.class_index THEN px.confidence ELSE (1 - px.confidence) * (1 + (px.x + 3 * px.y + 5 * {k}) % 7) / 8 END"
_PAIR_RULES = "SELECT class_index, CAST(o AS INT) AS other_class_index, (class_index + o) % 4 <> 0 AS compatible, o = 4 AS disallowed FROM classes, range(14) AS t(o)"
_POLICY = "SELECT class_index, 6 + class_index % 5 AS threshold, class_index % 6 = 5 AS protected FROM {classes} WHERE class_index <> 9"
_JUDGED = f"""rules AS ({_PAIR_RULES}), policy AS ({_POLICY.replace('{', '').replace('}', '')}),
shape AS (SELECT component_id, class_index, count(*) AS pixel_count, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY component_id, class_index),
judged AS (SELECT s.*, p.protected, CASE WHEN threshold IS NULL OR pixel_count >= threshold THEN 'outside_threshold' WHEN protected THEN 'protected_class'
  WHEN x0 = (SELECT min(x) FROM px) OR x1 = (SELECT max(x) FROM px) OR y0 = (SELECT min(y) FROM px) OR y1 = (SELECT max(y) FROM px) THEN 'touches_processing_border'
  WHEN pixel_count >= 3 AND greatest(x1 - x0 + 1, y1 - y0 + 1) / least(x1 - x0 + 1, y1 - y0 + 1) >= 3 AND pixel_count / greatest(x1 - x0 + 1, y1 - y0 + 1) <= 1.5 THEN 'elongated_component' END AS reason FROM shape AS s LEFT JOIN policy AS p USING (class_index)),
d8 AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy) WHERE dx <> 0 OR dy <> 0),
ring AS (SELECT DISTINCT a.component_id, a.class_index, b.component_id AS other_component_id, b.class_index AS other_class_index, b.x, b.y FROM px AS a, d8, px AS b WHERE b.x = a.x + dx AND b.y = a.y + dy AND a.component_id <> b.component_id),
contact AS (SELECT component_id, class_index, other_component_id, other_class_index, count(*) AS contact FROM ring GROUP BY 1, 2, 3, 4),
cand AS (SELECT c.*, j.pixel_count, o.pixel_count AS other_pixels FROM contact AS c JOIN judged AS j USING (component_id) JOIN judged AS o ON o.component_id = c.other_component_id
  JOIN rules AS r ON r.class_index = c.class_index AND r.other_class_index = c.other_class_index
  WHERE j.reason IS NULL AND c.class_index <> c.other_class_index AND NOT coalesce(o.protected, false) AND NOT r.disallowed AND (r.compatible OR j.pixel_count < {BYPASS}) AND (o.pixel_count > j.pixel_count OR (o.pixel_count = j.pixel_count AND o.component_id < j.component_id))),
mean AS (SELECT component_id, k AS class_index, avg({_P.format(k='k')}) AS p FROM px JOIN (SELECT DISTINCT component_id FROM cand) AS c USING (component_id), range(14) AS t(k) GROUP BY 1, 2),
best AS (SELECT component_id, class_index, pixel_count, other_class_index AS target_class, other_component_id AS target_id, cc / total AS share, q.p, own.p AS own_p FROM (
  SELECT s.*, mean.p, sum(contact) OVER (PARTITION BY s.component_id) AS total FROM (SELECT *, sum(contact) OVER (PARTITION BY component_id, other_class_index) AS cc FROM cand) AS s JOIN mean ON mean.component_id = s.component_id AND mean.class_index = s.other_class_index) AS q
  JOIN mean AS own USING (component_id, class_index)
  QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY round({SHARE_WEIGHT} * cc / total + {P_WEIGHT} * q.p, 9) DESC, cc DESC, other_class_index, contact DESC, other_pixels DESC, other_component_id) = 1),
target AS (SELECT * FROM best WHERE pixel_count < {HARD} OR round(p, 9) >= round(own_p - {DROP}, 9))"""
_C8 = f"WITH RECURSIVE {components_sql(1)}, {_JUDGED}"


def _judged(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pixels with components, and components with their reasons."""
    from loamgrid.sources.scratch import saved

    pixels = saved(R.with_components(t.labels_a, diagonal=True), "pixels")
    return pixels, C.reasons(R.components(pixels), t.spark.sql(_POLICY, classes=t.classes))


def _rules(t: Tables) -> DataFrame:
    """Whether a class may go to another, for all pairs of classes."""
    pairs = t.classes.select("class_index", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("other_class_index"))
    return pairs.withColumns({"compatible": (F.col("class_index") + F.col("other_class_index")) % 4 != 0, "disallowed": F.col("other_class_index") == 4})


def _candidates(t: Tables, pixels: DataFrame, judged: DataFrame) -> DataFrame:
    return C.candidates(judged, contacts.ring(pixels, judged.where("reason is null")), _rules(t), BYPASS)


def _targets(t: Tables, pixels: DataFrame, judged: DataFrame) -> DataFrame:
    """Chosen targets by contact share and mean probability."""
    shares = F.array(*[F.when(F.col("class_index") == k, F.col("confidence")).otherwise((1 - F.col("confidence")) * (1 + (F.col("x") + 3 * F.col("y") + 5 * k) % 7) / 8) for k in range(14)])
    return C.targets(_candidates(t, pixels, judged), C.mean_probabilities(pixels.withColumn("probs", shares), 14), SHARE_WEIGHT, P_WEIGHT, DROP, HARD)


@query("small_component_reasons", oracle("labels_a classes", f"{_C8} SELECT class_index, reason, count(*) AS n FROM judged GROUP BY 1, 2"))
def small_component_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(Tables(spark, sf_dir))[1].groupBy("class_index", "reason").agg(F.count("*").alias("n"))


@query("absorb_candidates", oracle("labels_a classes", f"{_C8} SELECT component_id, other_component_id, contact, pixel_count, other_pixels FROM cand"))
def absorb_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _candidates(t, *_judged(t)).select("component_id", "other_component_id", "contact", "pixel_count", "other_pixels")


@query("absorb_targets", oracle("labels_a classes", f"{_C8} SELECT component_id, class_index, pixel_count, target_class, target_id, round(share, 6) AS share, round(p, 6) AS p, round(own_p, 6) AS own_p FROM target"))
def absorb_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = _targets(t, *_judged(t))
    return rows.select("component_id", "class_index", "pixel_count", "target_class", "target_id", *(F.round(c, 6).alias(c) for c in ("share", "p", "own_p")))


#: Mean confidence over which a component of HARD pixels stays where no probabilities are at hand.
SURE = 0.76


@query("absorb_by_confidence", oracle("labels_a classes", f"""{_C8}, conf AS (SELECT component_id, avg(confidence) AS c FROM px GROUP BY 1),
pick AS (SELECT s.*, coalesce(s.pixel_count >= {HARD} AND round(conf.c, 9) > {SURE}, false) AS high_confidence FROM (SELECT *, sum(contact) OVER (PARTITION BY component_id, other_class_index) AS cc, sum(contact) OVER (PARTITION BY component_id) AS total FROM cand) AS s JOIN conf USING (component_id)
  QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY round(1.0 * cc / total, 9) DESC, cc DESC, other_class_index, contact DESC, other_pixels DESC, other_component_id) = 1)
SELECT component_id, high_confidence, CASE WHEN NOT high_confidence THEN other_class_index END AS target_class, CASE WHEN NOT high_confidence THEN other_component_id END AS target_id FROM pick"""))
def absorb_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by contact share alone; components whose labels are sure stay."""
    from loamgrid.sources.scratch import saved

    t = Tables(spark, sf_dir)
    pixels, judged = _judged(t)
    found = saved(_candidates(t, pixels, judged), "candidates")
    mean = pixels.groupBy("component_id").agg(F.avg("confidence").alias("confidence"))
    chosen = C.targets(found, hard=HARD, confidence=mean, sure=SURE).select("component_id", F.lit(False).alias("high_confidence"), "target_class", "target_id")
    kept = C.confident(found, mean, HARD, SURE).select("component_id", F.lit(True).alias("high_confidence"), F.lit(None).cast("long").alias("target_class"), F.lit(None).cast("long").alias("target_id"))
    return chosen.select("component_id", "high_confidence", F.col("target_class").cast("long").alias("target_class"), "target_id").unionByName(kept)


@query("absorb_apply", oracle("labels_a classes", f"""{_C8}, walk AS (SELECT component_id, target_id FROM target UNION SELECT w.component_id, t.target_id FROM walk AS w JOIN target AS t ON t.component_id = w.target_id),
ends AS (SELECT component_id, target_id FROM walk WHERE target_id NOT IN (SELECT component_id FROM target))
SELECT p.class_index AS source_class, s.class_index AS target_class, count(*) AS pixels FROM px AS p JOIN ends USING (component_id) JOIN shape AS s ON s.component_id = ends.target_id GROUP BY 1, 2"""))
def absorb_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that change class when every decision chain is followed to its end."""
    t = Tables(spark, sf_dir)
    pixels, judged = _judged(t)
    ends = C.roots(_targets(t, pixels, judged))
    new = C.apply(pixels.withColumn("source_class", F.col("class_index")), ends, judged).join(ends.select("component_id"), "component_id", "left_semi")
    return new.groupBy("source_class", F.col("class_index").alias("target_class")).agg(F.count("*").alias("pixels"))


_AFTER = """walk AS (SELECT component_id, target_id FROM target UNION SELECT w.component_id, t.target_id FROM walk AS w JOIN target AS t ON t.component_id = w.target_id),
ends AS (SELECT component_id, target_id FROM walk WHERE target_id NOT IN (SELECT component_id FROM target)),
after AS (SELECT p.x, p.y, p.class_index AS was, coalesce(s.class_index, p.class_index) AS class_index FROM px AS p LEFT JOIN ends USING (component_id) LEFT JOIN shape AS s ON s.component_id = ends.target_id)"""
_SIDES = "(SELECT a.class_index, count(*) AS n FROM {0} AS a, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy), {0} AS b WHERE b.x = a.x + dx AND b.y = a.y + dy AND a.class_index <> b.class_index GROUP BY 1)"


@query("cleanup_audit", oracle("labels_a classes", f"""{_C8}, {_AFTER}, {components_sql(1, 'after', 'a_')},
b1 AS (SELECT class_index, count(*) AS parts, count(*) FILTER (pixel_count < 6) AS small FROM shape GROUP BY 1),
a1 AS (SELECT class_index, count(*) AS parts, count(*) FILTER (n < 6) AS small FROM (SELECT component_id, class_index, count(*) AS n FROM a_px GROUP BY 1, 2) AS s GROUP BY 1),
flow AS (SELECT class_index, sum(b) AS before, sum(a) AS after, sum(o) AS loss, sum(i) AS gain FROM (SELECT was AS class_index, 1 AS b, 0 AS a, CASE WHEN was <> class_index THEN 1 ELSE 0 END AS o, 0 AS i FROM after UNION ALL SELECT class_index, 0, 1, 0, CASE WHEN was <> class_index THEN 1 ELSE 0 END FROM after) AS f GROUP BY 1),
rows_ AS (SELECT class_index, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(after - before AS BIGINT) AS drift, CAST(loss AS BIGINT) AS loss, CAST(gain AS BIGINT) AS gain,
  coalesce(b1.parts, 0) AS components_before, coalesce(a1.parts, 0) AS components_after, coalesce(b1.small, 0) AS fragments_before, coalesce(a1.small, 0) AS fragments_after, coalesce(sb.n, 0) AS boundary_before, coalesce(sa.n, 0) AS boundary_after,
  CAST(CASE WHEN class_index % 6 = 5 THEN loss ELSE 0 END AS BIGINT) AS protected_loss
  FROM flow LEFT JOIN b1 USING (class_index) LEFT JOIN a1 USING (class_index) LEFT JOIN {_SIDES.format('labels_a')} AS sb USING (class_index) LEFT JOIN {_SIDES.format('after')} AS sa USING (class_index))
SELECT *, sum(components_after) OVER () <= sum(components_before) OVER () AND sum(fragments_after) OVER () <= sum(fragments_before) OVER () AND sum(boundary_after) OVER () <= sum(boundary_before) OVER () AND sum(protected_loss) OVER () = 0 AS passed FROM rows_"""))
def cleanup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each class: areas and their flows, components, fragments and boundary before and after the clean-up; passed if none of the totals grew and no protected class lost."""
    t = Tables(spark, sf_dir)
    pixels, judged = _judged(t)
    after = C.apply(pixels.withColumn("was", F.col("class_index")), C.roots(_targets(t, pixels, judged)), judged).select("x", "y", "was", "class_index")
    return C.audit(pixels, after, 6, F.col("class_index") % 6 == 5)
