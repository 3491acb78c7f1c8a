"""Proposals of the clean-up: routing of small components to scenarios, their bridges, corridors and gains, and a check of the result.

Components touch at sides. A proposal gives the pixels of its source component, or of a corridor through it, to one class; its
targets are the components of that class that it touches.
"""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.operators import rasters as R

_STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def component_distances(pixels: DataFrame, reach: float, width_m: float = 1.0, height_m: float = 1.0) -> DataFrame:
    """component_id, other_component_id (larger), distance in metres between the cells' edges, for components of one class within ``reach`` metres.

    Pixels are that wide and high; they meet on a grid of cells wider than the reach: an equality join.
    """
    size = {"x": width_m, "y": height_m}
    side = {c: int(reach / m) + 2 for c, m in size.items()}
    grid = lambda df: df.select("component_id", "class_index", "x", "y", *[F.floor(F.col(c) / n).alias("g" + c) for c, n in side.items()])
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    a = grid(pixels).withColumn("s", F.explode(around)).select("component_id", "class_index", "x", "y", (F.col("gx") + F.col("s.a")).alias("gx"), (F.col("gy") + F.col("s.b")).alias("gy")).alias("a")
    b = grid(pixels).alias("b")
    gap = lambda c: F.greatest(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) - 1, F.lit(0)) * size[c]
    met = a.join(b, (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.class_index") == F.col("b.class_index")) & (F.col("a.component_id") < F.col("b.component_id")))
    pairs = met.groupBy(F.col("a.component_id"), F.col("b.component_id").alias("other_component_id")).agg(F.min(F.hypot(gap("x"), gap("y"))).alias("distance"))
    return pairs.where(F.col("distance") <= reach)


def touched(contacts: DataFrame, sources: DataFrame) -> DataFrame:
    """component_id, target_class, target_id, contact: components that the sources touch, by class."""
    return contacts.join(sources.select("component_id"), "component_id", "left_semi").select("component_id", F.col("other_class_index").alias("target_class"), F.col("other_component_id").alias("target_id"), "contact")


def rarest(targets: DataFrame, share: DataFrame, means: DataFrame) -> DataFrame:
    """component_id, target_class: of the classes that a component touches the one with the least ``share`` (target_class, share; a row a class), then
    the largest mean probability (component_id, means by class), then the lowest."""
    rows = targets.select("component_id", "target_class").distinct().join(F.broadcast(share), "target_class").join(means, "component_id")
    by = W.partitionBy("component_id").orderBy("share", F.round(F.get("means", F.col("target_class").cast("int")), 9).desc(), "target_class")
    return rows.withColumn("n", F.row_number().over(by)).where("n = 1").select("component_id", "target_class")


def _each(grouped: DataFrame, step, schema: str) -> DataFrame:
    """Rows of ``step`` (a row's values as arguments, a list of tuples back) for each row of ``grouped``.

    A row is all that belongs to one small source; Spark has gathered it, so that thousands of sources come as one batch and none is a group of its own in Python.
    """

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
        names, types = zip(*((n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))), strict=True)
        for batch in batches:
            found = [row for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in step(*values)]
            columns = zip(*found, strict=True) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], list(names))

    return grouped.mapInArrow(run, schema)


def _bottleneck(component: int, target_class: int, nodes: list, us: list, vs: list, distances: list) -> list[tuple]:
    """The longest edge by which a tree grows that always takes the nearest component outside it."""
    edges: dict[int, list] = {}
    for u, v, d in zip(us, vs, distances, strict=True):
        if d is not None:
            edges.setdefault(u, []).append((d, v))
            edges.setdefault(v, []).append((d, u))
    inside, worst, queue = {nodes[0]}, 0.0, list(edges.get(nodes[0], ()))
    heapify(queue)
    while queue and len(inside) < len(nodes):
        d, node = heappop(queue)
        if node not in inside:
            inside.add(node)
            worst = max(worst, d)
            for edge in edges[node]:
                heappush(queue, edge)
    return [(component, target_class, worst if len(inside) == len(nodes) else None)]


def bridge_bottleneck(targets: DataFrame, distances: DataFrame) -> DataFrame:
    """component_id, target_class, bottleneck: the longest edge of the minimum spanning tree over the target components of a source and class.

    Null where the pairs of ``distances`` don't connect them. A group is the surroundings of one small source.
    """
    nodes = targets.groupBy("component_id", "target_class").agg(F.sort_array(F.collect_set("target_id")).alias("nodes")).where(F.size("nodes") > 1)
    one = nodes.select("component_id", "target_class", "nodes", F.explode("nodes").alias("u"))
    pairs = one.select("*", F.explode(F.filter("nodes", lambda v: v > F.col("u"))).alias("v"))
    edges = pairs.join(distances.select(F.col("component_id").alias("u"), F.col("other_component_id").alias("v"), "distance"), ["u", "v"], "left")
    held = edges.groupBy("component_id", "target_class").agg(F.first("nodes").alias("nodes"), F.collect_list(F.struct("u", "v", "distance")).alias("e"))
    return _each(held.select("component_id", "target_class", "nodes", "e.u", "e.v", "e.distance"), _bottleneck, "component_id long, target_class long, bottleneck double")


def _ways(cells: set, start: set, width_m: float, height_m: float) -> dict:
    """The length of the shortest way from ``start`` to each cell, from side to side."""
    known, queue = {}, [(0.0, c) for c in sorted(start)]
    while queue:
        far, at = heappop(queue)
        if at in known:
            continue
        known[at] = far
        for a, b in _STEPS:
            near = (at[0] + a, at[1] + b)
            if near in cells and near not in known:
                heappush(queue, (far + (width_m if a else height_m), near))
    return known


def _contact_sets(xs: list, ys: list, classes: list, ids: list) -> list[tuple]:
    """For each class, by its number, its targets with the cells that touch them."""
    found: dict[int, dict[int, set]] = {}
    for x, y, c, i in zip(xs, ys, classes, ids, strict=True):
        if i is not None:
            found.setdefault(c, {}).setdefault(i, set()).add((x, y))
    return sorted(found.items())


def _longest(width_m: float, height_m: float):
    def step(component: int, xs: list, ys: list, classes: list, ids: list) -> list[tuple]:
        cells, found = set(zip(xs, ys, strict=True)), []
        for target_class, contact in _contact_sets(xs, ys, classes, ids):
            longest = 0.0
            for start in contact if len(contact) > 1 else ():
                far = _ways(cells, contact[start], width_m, height_m)
                longest = max([longest, *(min(far[c] for c in contact[t]) for t in contact if t != start)])
            found.append((component, target_class, longest))
        return found

    return step


def bridge_path(pixels: DataFrame, targets: DataFrame, width_m: float = 1.0, height_m: float = 1.0) -> DataFrame:
    """component_id, target_class, path: the longest of the shortest ways through the source between two of its targets of a class, in metres.

    A way leads from side to side between centres of pixels of that width and height. A row for ``_each`` holds the pixels of one small source.
    """
    return _each(_gathered(pixels, targets), _longest(width_m, height_m), "component_id long, target_class long, path double")


def topology_delta(targets: DataFrame, parts: DataFrame, limits: DataFrame) -> DataFrame:
    """component_id, target_class, components_removed, fragments_removed if the source goes to that class and joins its targets of it.

    ``limits``: class_index, limit in pixels below which a component is a fragment; a row for each class.
    """
    known = parts.select("component_id", "class_index", "pixel_count").join(F.broadcast(limits), "class_index")
    rows = targets.select("component_id", "target_class", "target_id").distinct()
    rows = rows.join(known.select(F.col("component_id").alias("target_id"), F.col("pixel_count").alias("t"), F.col("limit").alias("t_limit")), "target_id")
    rows = rows.join(known.select("component_id", F.col("pixel_count").alias("n"), F.col("limit").alias("n_limit")), "component_id")
    sums = rows.groupBy("component_id", "target_class", "n", "n_limit", "t_limit").agg(F.count("*").alias("k"), F.sum("t").alias("all_t"), F.count_if(F.col("t") < F.col("t_limit")).alias("small"))
    one = lambda c: F.when(c, 1).otherwise(0)
    gain = one(F.col("n") < F.col("n_limit")) + F.col("small") - one(F.col("all_t") + F.col("n") < F.col("t_limit"))
    return sums.select("component_id", "target_class", F.col("k").alias("components_removed"), gain.alias("fragments_removed"))


def route(parts: DataFrame, contacts: DataFrame, open_sides: DataFrame, targets: DataFrame, means: DataFrame, bottlenecks: DataFrame, deltas: DataFrame, policy: DataFrame, relations: DataFrame, largest: int, furthest: float) -> DataFrame:
    """component_id, outcome, target_class of every component: a scenario with its target class, or why there is no proposal.

    ``policy``: class_index, protected, grows, limit, share; ``relations``: class_index, target_class, and whether each of the scenarios
    unique_enclosure, same_class_bridge and multi_neighbour is allowed; both have as many rows as classes or their pairs. In order: protected
    sources, those at the rim or with a side to no pixel, those of ``limit`` pixels or more; then one neighbouring
    class, bridges between components of one class (at most ``largest`` pixels and ``furthest`` apart, several may stand),
    then the rarest of the allowed neighbours, the likeliest, the first.
    """
    rows = parts.join(F.broadcast(policy), "class_index").join(open_sides, "component_id", "left")
    reason = F.when(F.col("protected"), "protected_source").when(F.col("touches_border") | (F.coalesce("open", F.lit(0)) > 0), "external_or_invalid_boundary").when(F.col("pixel_count") >= F.col("limit"), "not_small_fragment")
    rows = rows.select("component_id", "class_index", "pixel_count", reason.alias("reason"))
    by_class = targets.groupBy("component_id", "target_class").agg(F.countDistinct("target_id").alias("k"))
    target_policy = policy.select(F.col("class_index").alias("target_class"), "grows", "share")
    asked = rows.where("reason is null").join(by_class, "component_id").join(F.broadcast(target_policy), "target_class").join(F.broadcast(relations), ["class_index", "target_class"])
    asked = asked.withColumn("classes", F.count("*").over(W.partitionBy("component_id")))
    lone = asked.where("classes = 1").select("component_id", F.when(F.col("grows") & F.col("unique_enclosure"), "unique_enclosure").otherwise("target_growth_denied").alias("outcome"), F.when(F.col("grows") & F.col("unique_enclosure"), F.col("target_class")).alias("target_class"))
    many = asked.where("classes > 1")
    fits = F.col("grows") & F.col("same_class_bridge") & (F.col("k") > 1) & (F.col("pixel_count") <= largest) & (F.col("bottleneck") <= furthest) & (F.col("components_removed") > 0) & (F.col("fragments_removed") >= 0)
    bridges = many.join(bottlenecks, ["component_id", "target_class"]).join(deltas, ["component_id", "target_class"]).where(fits).select("component_id", F.lit("same_class_bridge").alias("outcome"), "target_class")
    rest = many.join(bridges.select("component_id"), "component_id", "left_anti")
    legal = rest.where("grows and multi_neighbour").join(means, "component_id").withColumn("p", F.round(F.get("means", F.col("target_class").cast("int")), 9))
    first = legal.withColumn("n", F.row_number().over(W.partitionBy("component_id").orderBy("share", F.col("p").desc(), "target_class"))).where("n = 1").select("component_id", F.lit("multi_neighbour").alias("outcome"), "target_class")
    none = rest.select("component_id").distinct().join(first, "component_id", "left_anti").select("component_id", F.lit("no_legal_target").alias("outcome"), F.lit(None).alias("target_class"))
    alone = rows.where("reason is null").join(by_class, "component_id", "left_anti").select("component_id", F.lit("external_or_invalid_boundary").alias("outcome"), F.lit(None).alias("target_class"))
    kept = rows.where("reason is not null").select("component_id", F.col("reason").alias("outcome"), F.lit(None).alias("target_class"))
    found = kept
    for part in (alone, lone, bridges, first, none):
        found = found.unionByName(part)
    return found.select("component_id", "outcome", F.col("target_class").cast("long").alias("target_class"))


def _narrowest(component: int, xs: list, ys: list, classes: list, ids: list) -> list[tuple]:
    """The shortest way through one source between two of its targets of a class: x, y of its cells, and the two."""
    cells, found = set(zip(xs, ys, strict=True)), []
    for target_class, contact in _contact_sets(xs, ys, classes, ids):
        best = None
        for start in sorted(contact):
            before, queue = dict.fromkeys(sorted(contact[start], key=lambda c: (c[1], c[0]))), deque(sorted(contact[start], key=lambda c: (c[1], c[0])))
            ends = {c: t for t in sorted(contact, reverse=True) if t > start for c in contact[t]}
            while queue and not (at := queue.popleft()) in ends:
                for a, b in _STEPS:
                    near = (at[0] + a, at[1] + b)
                    if near in cells and near not in before:
                        before[near] = at
                        queue.append(near)
            if at in ends:
                path = [at]
                while before[path[-1]] is not None:
                    path.append(before[path[-1]])
                best = min(filter(None, (best, (len(path), start, ends[at], path))))
        if best:
            found += [(component, target_class, [best[1], best[2]], x, y) for x, y in best[3]]
    return found


def _contacts(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """Pixels of the sources; a row for each target of theirs that a pixel touches, with target_id and target_class."""
    sources = targets.select("component_id").distinct()
    own = pixels.select("component_id", "x", "y").join(sources, "component_id", "left_semi")
    met = R.neighbours(own, ["component_id"], among=pixels).select("component_id", "x", "y", F.col("other_component_id").alias("target_id"))
    met = met.join(targets.select("component_id", "target_class", "target_id"), ["component_id", "target_id"])
    return own.join(met, ["component_id", "x", "y"], "left")


def _gathered(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """``_contacts`` as a row a source: component_id and lists x, y, target_class, target_id."""
    held = _contacts(pixels, targets).groupBy("component_id").agg(F.collect_list(F.struct("x", "y", "target_class", "target_id")).alias("c"))
    return held.select("component_id", "c.x", "c.y", "c.target_class", "c.target_id")


def corridors(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """component_id, target_class, target_ids, x, y: for each source and class the cells of the shortest way through it between two of its targets.

    Equal ways: the targets' smaller ids, then the first found row by row. A row for ``_each`` holds the pixels of one small source.
    """
    return _each(_gathered(pixels, targets), _narrowest, "component_id long, target_class long, target_ids array<long>, x long, y long")


def topology_check(pixels: DataFrame, changes: DataFrame) -> DataFrame:
    """kind, id, pieces, safe for everything that accepted ``changes`` (x, y, proposal, new_class) touch.

    source: a component that lost pixels, and the number of pieces of what is left (safe: at most one). proposal: the components of
    the result that its pixels lie in (safe: one, which also holds another pixel of that class).
    """
    from loamgrid.sources.scratch import saved

    joined = saved(pixels.select("x", "y", "class_index", "component_id").join(changes, ["x", "y"], "left"), "changed")
    hit = joined.where("proposal is not null").select("component_id").distinct()
    rest = joined.where("proposal is null").join(hit, "component_id", "left_semi").select("x", "y", F.col("component_id").alias("class_index"))
    left = R.with_components(rest).groupBy("class_index").agg(F.countDistinct("component_id").alias("pieces"))
    sources = hit.join(left.withColumnRenamed("class_index", "component_id"), "component_id", "left").select(F.lit("source").alias("kind"), F.col("component_id").alias("id"), F.coalesce("pieces", F.lit(0)).alias("pieces"))
    sources = sources.withColumn("safe", F.col("pieces") <= 1)
    result = R.with_components(joined.select("x", "y", F.coalesce("new_class", "class_index").alias("class_index"), "proposal").withColumnRenamed("component_id", "was"))
    whole = result.groupBy("component_id").agg(F.count_if(F.col("proposal").isNull()).alias("kept"))
    each = result.where("proposal is not null").select("proposal", "component_id").distinct().join(whole, "component_id")
    proposals = each.groupBy("proposal").agg(F.count("*").alias("pieces"), F.min("kept").alias("kept"))
    return sources.unionByName(proposals.select(F.lit("proposal").alias("kind"), F.col("proposal").alias("id"), "pieces", ((F.col("pieces") == 1) & (F.col("kept") > 0)).alias("safe")))


def allowed(source: Column, target: Column, scenario: int) -> Column:
    """A relation table by rule, for derived data."""
    return (source + target + scenario) % 5 != 0
