"""Operators on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import arrays as A
from loamgrid.operators import cleanup, contacts, rasters, relational, spatial, store
from loamgrid.operators import probabilities as P
from loamgrid.operators.distance import nearest
from loamgrid.operators.graph import connected_components


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components_of_paths_stars_and_single_nodes(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (500, 500), (None, 3)]
    found = dict(rows(connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 120)} | {500: 500}


def test_components_of_no_edges(spark):
    assert not rows(connected_components(spark.createDataFrame([], "u long, v long")))


def grid(spark, *lines):
    return spark.createDataFrame([(x, y, int(c)) for y, line in enumerate(lines) for x, c in enumerate(line) if c != "."], "x long, y long, class_index long")


def test_four_and_eight_neighbours_differ_on_a_diagonal(spark):
    labels = grid(spark, "10", "01")
    assert len({r.component_id for r in rasters.with_components(labels).collect()}) == 4
    assert len({r.component_id for r in rasters.with_components(labels, diagonal=True).collect()}) == 2


def test_a_pixel_in_a_large_component_is_absorbed_and_a_block_stays(spark):
    lines = [["0"] * 12 for _ in range(12)]
    lines[5][5] = "1"
    for y in range(8, 11):
        for x in range(8, 11):
            lines[y][x] = "1"
    pixels = rasters.with_components(grid(spark, *map("".join, lines)), diagonal=True)
    parts = rasters.components(pixels)
    policy = spark.createDataFrame([(0, 4, False), (1, 4, False)], "class_index long, threshold int, protected boolean")
    judged = cleanup.reasons(parts, policy)
    chosen = cleanup.targets(cleanup.candidates(judged, contacts.ring(pixels)))
    after = cleanup.apply(pixels, cleanup.roots(chosen), judged)
    assert after.where("class_index = 1").count() == 9


def test_decision_chains_end_at_their_root(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "component_id long, target_id long")
    assert {r.root_id for r in cleanup.roots(chain).collect()} == {20}


@pytest.mark.parametrize(("tile_rows", "tile_cols"), [(1, 1), (1, 17), (17, 1), (2, 2), (17, 17), (31, 23)])
def test_units_own_every_cell_once(spark, tile_rows, tile_cols):
    grids = spark.createDataFrame([(1, tile_rows, tile_cols)], "grid_id long, tile_rows long, tile_cols long")
    parts = spatial.plan_partitions(grids, 4, 64, 24, 24)
    units = spatial.plan_units(parts, 8)
    r, c = -(-tile_rows // 4), -(-tile_cols // 4)
    assert dict(rows(units.groupBy("unit_type").count())) == {k: n for k, n in {"core": r * c, "seam_vertical": r * (c - 1), "seam_horizontal": (r - 1) * c, "junction": (r - 1) * (c - 1)}.items() if n}
    assert not rows(spatial.ownership(units))


def test_boxes_of_every_size_meet_once(spark):
    """Boxes from a pixel to the whole plane, empty ones, equal ones, negative corners, against all pairs."""
    import random

    r = random.Random(9)
    boxes = []
    for i in range(260):
        x, y, w, h = r.randrange(-50, 900), r.randrange(-50, 900), r.choice([0, 1, 2, 7, 16, 64, 300]), r.choice([1, 2, 5, 33, 128])
        boxes.append((i, x, y, x + w, y + h))
    boxes += [(900, -100, -100, 1500, 1500), (901, -100, -100, 1500, 1500)]
    want = {(a[0], b[0], (min(a[3], b[3]) - max(a[1], b[1])) * (min(a[4], b[4]) - max(a[2], b[2]))) for a in boxes for b in boxes if min(a[3], b[3]) > max(a[1], b[1]) and min(a[4], b[4]) > max(a[2], b[2]) and a[0] < b[0]}
    df = spark.createDataFrame(boxes, "box_id long, x0 long, y0 long, x1 long, y1 long")
    pairs = spatial.overlap_join(df, df, F.col("a.box_id") < F.col("b.box_id")).select("a.box_id", F.col("b.box_id").alias("other"), spatial.shared_area())
    found = rows(pairs)
    assert set(found) == want and len(found) == len(want)
    assert spatial.overlap_join(df.limit(0), df).count() == spatial.overlap_join(df, df.limit(0)).count() == 0


def test_a_box_over_the_plane_meets_many(spark):
    small = spark.range(100_000).select("id", ((F.col("id") % 400) * 10).alias("x0"), (F.floor(F.col("id") / 400) * 10).alias("y0")).withColumns({"x1": F.col("x0") + 3, "y1": F.col("y0") + 2})
    large = spark.createDataFrame([(-1, 0, 0, 4000, 2500)], "id long, x0 long, y0 long, x1 long, y1 long")
    found = spatial.overlap_join(large, small.unionByName(large))
    assert found.groupBy("a.id").agg(F.count("*"), F.sum(spatial.shared_area())).collect() == [(-1, 100_001, 600_000 + 10_000_000)]
    cells = spatial._cells(spatial._level(small.unionByName(large)).withColumn("at", F.col("level")))
    assert cells.count() <= 4 * 100_001


def test_overlap_tile_weights_sum_to_one(spark):
    at = spark.range(2).select((F.col("id") + 6).alias("a"), F.col("id").alias("b"))
    sums = at.select(A.cosine_weight(F.col("a"), 8, 2) + A.cosine_weight(F.col("b"), 8, 2)).collect()
    assert all(abs(r[0] - 1) < 1e-9 for r in sums)


def test_argmax_takes_the_lowest_index_on_ties(spark):
    assert spark.sql("SELECT array(0.2D, 0.4D, 0.4D) AS a").select(A.argmax(F.col("a"))).first()[0] == 1


def test_contract_violations_have_one_reason(spark):
    data = [([0.5, 0.5],), ([0.5, float("nan")],), ([1.5, -0.5],), ([0.5, 0.6],), ([1.0],), (None,)]
    found = [r[0] for r in spark.createDataFrame(data, "p array<double>").select(A.violation(F.col("p"), 2)).collect()]
    assert found == [None, "not_finite", "negative", "sum", "size", "size"]


def test_weight_zero_and_one_follow_one_model(spark):
    probs = lambda k: [0.9 if i == k else 0.1 / 13 for i in range(14)]
    scores = spark.createDataFrame([(0, 0, 0, probs(3)), (0, 0, 1, probs(1))], "x long, y long, model_id int, probs array<double>")
    weights = spark.createDataFrame([(0, 1.0, [0.0] * 14), (1, 1.0, [1.0] * 14)], "model_id int, temperature double, weights array<double>")
    assert P.decide(P.fuse_weighted(scores, ["x", "y"], weights)).first().class_index == 1


def test_narrow_deny_beats_broad_allow_and_ties_deny(spark):
    rules = [("a", "allow", "*", "*", "*", 9, 0), ("b", "deny", "12", "*", "*", 0, 1), ("c", "allow", "13", "1", "*", 1, 1), ("d", "deny", "13", "1", "*", 1, 1)]
    rules = spark.createDataFrame(rules, "id string, effect string, source string, target string, scenario string, priority int, specificity int")
    asks = spark.createDataFrame([("12", "1", "s"), ("13", "1", "s"), ("14", "1", "s")], "source string, target string, scenario string")
    assert {r.source: r.allowed for r in store.relation_permission(asks, rules).collect()} == {"12": False, "13": False, "14": True}


def test_no_rule_denies(spark):
    rules = spark.createDataFrame([], "id string, effect string, source string, target string, scenario string, priority int, specificity int")
    asks = spark.createDataFrame([("12", "1", "s")], "source string, target string, scenario string")
    assert not store.relation_permission(asks, rules).first().allowed


def test_matching_is_greedy_and_one_to_one(spark):
    pairs = [(1, 1, 10, 5), (1, 1, 11, 9), (1, 2, 11, 8), (1, 2, 10, 1), (2, 1, 10, 3)]
    found = rows(store.match_revisions(spark.createDataFrame(pairs, "batch long, old_id long, new_id long, area long")))
    assert found == [(1, 1, 11, 9), (1, 2, 10, 1), (2, 1, 10, 3)]


def test_escaped_search_takes_wildcards_literally(spark):
    names = spark.createDataFrame([("package_a_b",), ("package_axb",), ("a%b",), ("a\\b",)], "n string")
    found = lambda text: rows(names.where(relational.like_escaped(F.col("n"), text)))
    assert found("a_b") == [("package_a_b",)] and found("a%b") == [("a%b",)] and found("\\") == [("a\\b",)]


@pytest.mark.parametrize(("size", "want"), [(0, ""), (1, "a"), (2, "a"), (3, "aé"), (4, "aé"), (6, "aé€"), (9, "aé€"), (10, "aé€\U00010348"), (99, "aé€\U00010348")])
def test_bounded_text_keeps_whole_characters(spark, size, want):
    row = spark.createDataFrame([("aé€\U00010348",)], "t string")
    assert row.select(relational.bounded_utf8(F.col("t"), size)).first()[0] == want


def test_budgets_skip_what_breaks_them_and_go_on(spark):
    decisions = spark.createDataFrame([(1, 10, 0, 2, 5), (1, 11, 0, 2, 4), (1, 12, 0, 2, 1), (1, 13, 1, 2, 6), (2, 20, 0, 2, 3)], "owner long, component_id long, class_index long, target_class long, pixel_count long")
    totals = spark.createDataFrame([(1, 0, 10), (1, 1, 10), (1, 2, 100), (2, 0, 10), (2, 2, 2)], "owner long, class_index long, pixels long")
    found = {r.component_id: r.outcome for r in cleanup.budgeted(decisions, totals, 0.7, 0.1).collect()}
    # in ascending size: 1 and 4 fit, 5 would lose ten of seven allowed, 6 would win eleven of ten allowed
    assert found == {12: "accepted", 11: "accepted", 10: "source_class_loss_budget", 13: "target_class_gain_budget", 20: "target_class_gain_budget"}


@pytest.mark.parametrize("block", [1, 4, 32])
def test_nearest_equals_all_pairs(spark, block):
    """Crowds, far-off cells, negative places, repeated rows, and pixels that are not square."""
    import math
    import random

    r = random.Random(block)
    place = lambda: (r.randrange(-20, 60), r.randrange(30)) if r.random() < 0.8 else (r.randrange(-900, 900), r.randrange(-300, 300))
    cells, others = [place() for _ in range(150)] + [(5, 5)] * 3, [place() for _ in range(90)]
    found = nearest(*(spark.createDataFrame(v, "x long, y long") for v in (cells, others)), 0.25, 2.0, block)
    want = {c: round(min(math.hypot((c[0] - a) * 0.25, (c[1] - b) * 2.0) for a, b in others), 9) for c in cells}
    assert sorted((x, y, round(d, 9)) for x, y, d in rows(found)) == sorted((*c, d) for c, d in want.items())
    assert nearest(spark.createDataFrame([], "x long, y long"), found).count() == 0
    assert rows(nearest(spark.createDataFrame([(1, 1)], "x long, y long"), found.limit(0))) == [(1, 1, None)]


def test_nearest_looks_as_far_as_it_must(spark):
    cells = spark.createDataFrame([(0, 0), (3, 0), (90, 0)], "x long, y long")
    found = rows(nearest(cells, spark.createDataFrame([(0, 1), (7, 3)], "x long, y long")))
    assert [(x, round(d, 6)) for x, _, d in found] == [(0, 1.0), (3, round(10**0.5, 6)), (90, round((83**2 + 9) ** 0.5, 6))]


def test_nearest_of_crowded_cells_meets_only_those_around(spark, monkeypatch):
    """Boundaries as dense as those of noisy labels: no cell goes on to the blocks, and a site stands in few lots."""
    from loamgrid.operators import distance

    met, seen = distance._met, []
    monkeypatch.setattr(distance, "_met", lambda asked, sites, *size: seen.append(sites.count()) or met(asked, sites, *size))
    monkeypatch.setattr(distance, "_descent", lambda *_: pytest.fail("cells with a near site went on"))
    at = spark.range(200).select(F.col("id").alias("x")).crossJoin(spark.range(200).select(F.col("id").alias("y")))
    found = nearest(at, at.where("(x + y) % 2 = 0"), 0.25, 0.5)
    assert rows(found.groupBy((F.col("x") + F.col("y")) % 2, "distance").count()) == [(0, 0.0, 20000), (1, 0.25, 20000)]
    assert len(seen) == 1 and seen[0] <= 2 * 20000


@pytest.mark.parametrize("limit", [1, 7, 1 << 18])
def test_lots_stay_whole_over_batches(monkeypatch, limit):
    import numpy as np
    import pyarrow as pa

    from loamgrid.operators import distance

    monkeypatch.setattr(distance, "_ROWS", limit)
    r = np.random.default_rng(limit)
    table = np.stack([r.integers(-2, 3, 400), r.integers(-1, 2, 400), r.integers(-40, 40, 400), r.integers(-9, 9, 400), r.integers(0, 4, 400) == 0], 1)
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    names = ["bu", "bv", "u", "v", "site"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c.astype(bool) if n == "site" else c) for n, c in zip(names, table[i : i + 11].T)], names=names) for i in range(0, 400, 11)]
    found = [tuple(row.values()) for b in distance._lots(0.25, 2.0)(iter(batches)) for row in b.to_pylist()]
    sites = table[table[:, 4] == 1]
    near = lambda q: min([np.hypot((q[2] - s[2]) * 0.25, (q[3] - s[3]) * 2.0) for s in sites if (s[:2] == q[:2]).all()], default=np.inf)
    assert [f[:4] for f in found] == [tuple(q[:4]) for q in table if not q[4]]
    assert np.allclose([f[4] for f in found], [near(q) for q in table if not q[4]])


def test_sampled_cells_keep_their_distance(spark):
    cells = [(1, x, y, (x * 7 + y * 3) % 5, 10 + (x + y) % 3, float((x * 13 + y * 29) % 17)) for x in range(20) for y in range(20)]
    found = rasters.sample_cells(spark.createDataFrame(cells, "run_id long, cell_x long, cell_y long, classes long, pixels long, entropy double"), "run_id", 8, 3).collect()
    at = [(r.cell_x, r.cell_y) for r in sorted(found, key=lambda r: r.place)]
    assert len(at) == 8 and all(max(abs(a - c), abs(b - d)) >= 3 for i, (a, b) in enumerate(at) for c, d in at[:i])
    assert at[0] == min(((c[1], c[2]) for c in cells if c[5] == 16.0), key=lambda p: (p[1], p[0]))


def test_a_class_of_over_999_parts_has_distinct_ids(spark):
    from loamgrid.operators.store import numbered_parts

    parts = spark.range(2500).selectExpr("id * 7919 AS component_id", "id % 2 AS class_index", "1L AS pixels")
    rows = sorted(numbered_parts(parts, 100_000).collect(), key=lambda r: r.component_id)
    for c in (0, 1):
        assert [r.part_id for r in rows if r.class_index == c] == [f"{c}:d{k:03d}" for k in range(1, 1251)]


def test_matching_in_rounds_equals_the_loop(spark):
    import random

    from loamgrid.operators.store import match_revisions

    r = random.Random(2)
    pairs = list({(b, r.randrange(15), 100 + r.randrange(15)): r.randrange(6) for b in range(6) for _ in range(60)}.items())
    rows = [(*k, area) for k, area in pairs]
    want, used = set(), set()
    for b, old, new, area in sorted(rows, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if not {(b, "o", old), (b, "n", new)} & used:
            used |= {(b, "o", old), (b, "n", new)}
            want.add((b, old, new, area))
    found = match_revisions(spark.createDataFrame(rows, "batch long, old_id long, new_id long, area long"))
    assert {tuple(x) for x in found.collect()} == want


@pytest.mark.parametrize("most", [500_000, 40])
def test_matching_boxes_equals_matching_their_pairs(spark, most):
    """Copies, boxes that share one area with several, and components that go pair by pair."""
    import random

    r = random.Random(5)
    box = lambda: (x := r.randrange(3) * 2 + r.randrange(2) * 40, y := r.randrange(3), x + r.choice((2, 3, 4)), y + r.choice((0, 1, 2, 3)))
    old = spark.createDataFrame([(i % 3, i, *box()) for i in range(150)], "batch long, old_id long, x0 long, y0 long, x1 long, y1 long")
    new = spark.createDataFrame([(1000 + i, *box()) for i in range(120)], "new_id long, x0 long, y0 long, x1 long, y1 long")
    pairs = spatial.overlap_join(old, new).select("a.batch", "a.old_id", "b.new_id", spatial.shared_area().alias("area")).collect()
    want, used = [], set()
    for batch, i, j, area in sorted(map(tuple, pairs), key=lambda p: (p[0], -p[3], p[1], p[2])):
        if not {(batch, 0, i), (batch, 1, j)} & used:
            used |= {(batch, 0, i), (batch, 1, j)}
            want.append((batch, i, j, area))
    assert len(want) > 100 and rows(store.match_boxes(old, new, most)) == sorted(want, key=str)


def test_copies_are_matched_without_their_pairs(spark):
    """20,000 copies on either side, 400 million pairs."""
    old = spark.range(20_000).selectExpr("1L as batch", "id as old_id", "0L as x0", "0L as y0", "3L as x1", "3L as y1")
    new = spark.range(20_000).selectExpr("id + 7 as new_id", "1L as x0", "1L as y0", "4L as x1", "4L as y1")
    found = store.match_boxes(old, new)
    assert found.count() == 20_000 and found.where("new_id <> old_id + 7 or area <> 4").count() == 0


@pytest.mark.parametrize("most", [500_000, 9])
def test_a_falling_chain_takes_few_rounds(spark, most):
    """Each pair waits for a better one: 10,000 pairs, or 24 where components that large go on in rounds."""
    n = 10_000 if most > 9 else 24
    chain = spark.range(n).selectExpr("1L as batch", "id as old_id", "cast(id % 2 as long) as odd", "id").selectExpr("batch", "(old_id + 1) div 2 as old_id", "old_id div 2 as new_id", "id as area")
    found = store.match_revisions(chain, 2, most).select("area").collect()
    assert sorted(r.area for r in found) == list(range(n - 1, -1, -2))[::-1]


def test_a_dependency_without_an_artifact_blocks(spark):
    from loamgrid.operators.relational import runnable

    jobs = spark.createDataFrame([(i, "fuse", "queued", 0, 4) for i in range(1, 6)], "job_id long, job_type string, status string, attempt int, max_attempts int")
    needs = spark.createDataFrame([(1, 10), (2, 99), (3, 11), (4, 12)], "job_id long, artifact_id long")
    there = spark.createDataFrame([(10, "ready", "mask"), (11, "building", "mask"), (12, "ready", "report")], "artifact_id long, status string, kind string")
    ids = lambda df: sorted(r.job_id for r in df.collect())
    assert ids(runnable(jobs, needs, there)) == [1, 4, 5]
    assert ids(runnable(jobs, needs, there, spark.createDataFrame([("fuse", "mask")], "job_type string, kind string"))) == [1]


def test_samples_equal_the_greedy_walk(spark):
    from loamgrid.operators.rasters import sample_cells

    cells = [(0, x, y, 9 - (x // 5 + y // 5) % 7, 10 + (x * y) % 13, 5.0 - ((x % 10 - 5) ** 2 + (y % 10 - 5) ** 2) / 50) for x in range(40) for y in range(40)]
    df = spark.createDataFrame(cells, "run long, cell_x long, cell_y long, classes long, pixels long, entropy double")
    for size, apart in ((10, 3), (10, 8), (40, 2)):
        taken = []

        def walk(order, most):
            for c in order:
                if most and len(taken) < size and all(max(abs(c[1] - x), abs(c[2] - y)) >= apart for x, y in taken):
                    taken.append((c[1], c[2]))
                    most -= 1

        entropy = sorted(cells, key=lambda c: (-c[5], c[2], c[1]))
        for order in (entropy, sorted(cells, key=lambda c: (-c[3], c[2], c[1])), sorted(cells, key=lambda c: (c[4], c[2], c[1]))):
            walk(order, 1)
        walk(entropy, size)
        found = sorted(sample_cells(df, "run", size, apart).collect(), key=lambda r: r.place)
        assert [(r.cell_x, r.cell_y) for r in found] == taken


def test_components_of_tiles_equal_those_of_the_whole(spark):
    import random

    r = random.Random(3)
    cells = {(x, y): 0 if r.random() < 0.6 else r.randrange(3) for x in range(23) for y in range(19) if r.random() < 0.95}
    df = spark.createDataFrame([(x, y, k) for (x, y), k in cells.items()], "x long, y long, class_index long")
    for diagonal in (False, True):
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
        want = {}
        for c in sorted(cells, key=lambda c: (c[1], c[0])):
            if c not in want:
                queue, want[c] = [c], c[1] * rasters.WIDE + c[0]
                while queue:
                    x, y = queue.pop()
                    for a, b in steps:
                        d = (x + a, y + b)
                        if d in cells and d not in want and cells[d] == cells[c]:
                            want[d] = want[c]
                            queue.append(d)
        for side in (1, 4, 256):
            assert {(p.x, p.y): p.component_id for p in rasters.with_components(df, diagonal, side).collect()} == want


def test_small_sources_are_no_groups_in_python(spark):
    """A way, a corridor and a bottleneck of one source between two targets; a second source has one target only."""
    from loamgrid.operators import proposals as O

    pixels = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 2, 2), (2, 0, 2, 2), (3, 0, 2, 2), (4, 0, 3, 1), (5, 0, 4, 5)], "x long, y long, component_id long, class_index long")
    targets = spark.createDataFrame([(2, 1, 1, 1), (2, 1, 3, 1), (4, 1, 3, 1)], "component_id long, target_class long, target_id long, contact long")
    near = spark.createDataFrame([(1, 3, 3.0)], "component_id long, other_component_id long, distance double")
    found = [O.bridge_path(pixels, targets, 0.5), O.corridors(pixels, targets), O.bridge_bottleneck(targets, near)]
    assert [rows(df) for df in found] == [[(2, 1, 1.0), (4, 1, 0.0)], [(2, 1, [1, 3], x, 0) for x in (1, 2, 3)], [(2, 1, 3.0)]]
    assert rows(O.bridge_bottleneck(targets, near.limit(0))) == [(2, 1, None)]
    assert not any("FlatMapGroups" in df._jdf.queryExecution().toString() for df in found)
