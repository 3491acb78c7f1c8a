"""Adjudication against counting the whole raster anew after each step."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from loamgrid.operators import adjudication
from loamgrid.operators.adjudication import BRIDGE, Arbiter, Rules

STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def around(c):
    return [(c[0] + a, c[1] + b) for a, b in STEPS]


def label_parts(raster):
    """The component of each cell: y * 100 + x of its first cell in row order."""
    part = {}
    for c in sorted(raster, key=lambda c: (c[1], c[0])):
        if c not in part:
            queue, part[c] = [c], c[1] * 100 + c[0]
            while queue:
                for d in around(queue.pop()):
                    if d in raster and d not in part and raster[d] == raster[c]:
                        part[d] = part[c]
                        queue.append(d)
    return part


def counts(raster, rules):
    """Components by class, fragments, their area, boundary sides and metres."""
    part = label_parts(raster)
    size = Counter(part.values())
    kind = {part[c]: k for c, k in raster.items()}
    small = [i for i in size if size[i] < rules.limits[kind[i]]]
    across = sum(raster[c] != raster[d] for c in raster if (d := (c[0] + 1, c[1])) in raster)
    down = sum(raster[c] != raster[d] for c in raster if (d := (c[0], c[1] + 1)) in raster)
    return part, Counter(kind.values()), len(small), sum(size[i] for i in small), across + down, across * rules.height_m + down * rules.width_m


def failures(p, raster, part, cells, taken, now, accepted, core, rules, spent, total, start):
    """Gates that the proposal fails, all of them; the budget gates stand alone, in their order."""
    own, target = p["cells"], p["target"]
    lost, won = spent
    if not own or not own <= core:
        return {"outside_core_owner"}, None
    if own & taken.keys():
        return {"footprint_conflict"}, None
    if any(lost[k] + n > total[k] * rules.loss + 1e-12 for k, n in Counter(raster[c] for c in own).items()):
        return {"source_budget"}, None
    most = rules.bridge_gain if p["kind"] == BRIDGE and target in rules.protected else rules.gain
    if won[target] + len(own) > total[target] * most + 1e-12:
        return {"target_budget"}, None
    then, gone = now | dict.fromkeys(own, target), taken | dict.fromkeys(own, 1)
    found = set()
    for i in {part[c] for c in own}:
        rest = {c: 0 for c in cells[i] if c not in gone}
        if len(set(label_parts(rest).values())) > 1:
            found.add("source_connectivity")
    new, kinds, small, area, sides, metres = counts(then, rules)
    _, kinds0, small0, area0, sides0, metres0 = start
    if any(kinds[k] > kinds0[k] for k in kinds):
        found.add("component_count_increase")
    for name, more in (("dynamic_fragment_increase", small > small0), ("dynamic_fragment_area_increase", area > area0), ("boundary_increase", sides > sides0 or metres > metres0 + 1e-9)):
        if more:
            found.add(name)
    for q in [*accepted, p]:
        ids = {new[c] for c in q["cells"]}
        for t in q["anchors"]:
            kept = [c for c in cells.get(t, ()) if c not in gone]
            if not kept or q["kind"] == BRIDGE and len(kept) < len(cells[t]):
                found.add("target_attachment")
            ids |= {new[c] for c in kept}
        if len(ids) != 1:
            found.add("target_attachment")
    return found, then


@pytest.mark.parametrize("seed", range(120))
def test_outcomes_equal_recounting(seed):
    """Footprints are whole components, parts of one, or ways across several; anchors may be lost, shared or reached through others."""
    r = random.Random(seed)
    side, classes = 13, 4
    share = r.choice([0.45, 0.7])
    raster = {(x, y): 0 if r.random() < share else r.randrange(classes) for x in range(side) for y in range(side) if r.random() < 0.97}
    rules = Rules({k: 4 + k for k in range(classes)}, 0.5, 0.6, 0.3, frozenset({3}), 2.0, 0.5)
    core = {c for c in raster if 0 < c[0] < side - 1}
    start = counts(raster, rules)
    part, cells = start[0], {}
    for c, i in part.items():
        cells.setdefault(i, set()).add(c)
    asked = []
    for _ in range(70):
        first = r.choice(sorted(raster))
        if r.random() < 0.4:
            own = set(cells[part[first]])
        else:
            own, size = {first}, r.randint(1, 5)
            one = r.random() < 0.6
            while len(own) < size and (more := sorted({d for c in own for d in around(c) if d in raster and d not in own and (part[d] == part[first] or not one)})):
                own.add(r.choice(more))
        beside = {}
        for c in own:
            for d in around(c):
                if d in raster and d not in own:
                    beside.setdefault(raster[d], set()).add(part[d])
        for target in sorted(beside.keys() - {raster[c] for c in own}):
            anchors = sorted(beside[target])
            asked.append({"kind": BRIDGE if len(anchors) > 1 and r.random() < 0.5 else "multi_neighbour", "target": target, "anchors": anchors if r.random() < 0.8 else anchors[:1], "cells": own})
    at = sorted(raster)
    column = lambda f: np.array([f(c) for c in at])
    size = Counter(part.values())
    court = Arbiter(column(lambda c: c[0]), column(lambda c: c[1]), column(raster.get), column(part.get), column(lambda c: size[part[c]]), column(lambda c: c in core), rules)
    now, taken, accepted, total, lost, won = dict(raster), {}, [], Counter(raster[c] for c in core), Counter(), Counter()
    for p in asked:
        got = court.judge(court.proposal(p["kind"], p["target"], p["anchors"], [c[0] for c in p["cells"]], [c[1] for c in p["cells"]]))
        wrong, then = failures(p, raster, part, cells, taken, now, accepted, core, rules, (lost, won), total, start)
        assert (got == "selected") == (not wrong) and (got == "selected" or got in wrong or "target_attachment" in wrong), (got, wrong)
        if got == "selected":
            now = then
            taken |= dict.fromkeys(p["cells"], 1)
            accepted.append(p)
            lost.update(raster[c] for c in p["cells"])
            won[p["target"]] += len(p["cells"])
    assert {c: int(court.now[court.at(c[0], c[1])]) for c in raster} == now




def court_of(rows, rules, **kind):
    """An arbiter over a drawing: one character a class, space no pixel, all of it core."""
    raster = {(x, y): int(k) for y, row in enumerate(rows) for x, k in enumerate(row) if k != " "}
    part, at = label_parts(raster), sorted(raster)
    size, column = Counter(part.values()), lambda f: np.array([f(c) for c in at])
    flags = {n: column(lambda c, v=v: c in v) if n != "prior" else v for n, v in kind.items()}
    return Arbiter(column(lambda c: c[0]), column(lambda c: c[1]), column(raster.get), column(part.get), column(lambda c: size[part[c]]), np.ones(len(at), bool), rules, **flags), part


FREE = Rules({0: 3, 1: 3, 2: 3}, 1.0, 9.0, 9.0)


def ask(court, part, kind, target, cells, anchors=None):
    beside = {part[d] for c in cells for d in around(c) if d in part and d not in cells and court.was[court.at(*d)] == target}
    return court.judge(court.proposal(kind, target, sorted(beside) if anchors is None else anchors, [c[0] for c in cells], [c[1] for c in cells]))


def test_a_cut_and_a_way_around_it():
    cut, part = court_of(["11111", "00000", "22222"], FREE)
    assert ask(cut, part, "multi_neighbour", 1, [(2, 1)]) == "source_connectivity"
    ring, part = court_of(["1111111", "0000000", "0222220", "0222220", "0000000"], FREE)
    assert ask(ring, part, "multi_neighbour", 1, [(3, 1)]) == "boundary_increase"  # not cut: the way leads around
    assert ask(ring, part, "multi_neighbour", 1, [(x, 1) for x in range(7)]) == "selected"


def test_an_anchor_may_shrink_but_not_go():
    rows = ["0000000", "0011100", "0011100", "0012100", "0000000"]
    court, part = court_of(rows, FREE)
    assert ask(court, part, "multi_neighbour", 1, [(3, 3)]) == "selected"
    assert ask(court, part, "multi_neighbour", 0, [(2, 3)]) == "selected"  # the pixel of 2 still hangs on the rest
    assert ask(court, part, "multi_neighbour", 0, [c for c, i in part.items() if i == part[2, 1] and c != (2, 3)]) == "target_attachment"
    bridged, part = court_of(rows, FREE)
    assert ask(bridged, part, BRIDGE, 1, [(3, 3)]) == "selected"
    assert ask(bridged, part, "multi_neighbour", 0, [(2, 3)]) == "target_attachment"  # a bridge keeps all of its anchors


def test_masks_and_earlier_budgets():
    rows = ["00000", "01020", "00000"]
    court, part = court_of(rows, FREE, immutable={(1, 1)}, locked={(3, 1)})
    assert ask(court, part, "multi_neighbour", 0, [(1, 1)]) == "round1_immutable"
    assert ask(court, part, "multi_neighbour", 0, [(3, 1)]) == "round1_dependency_lock"
    tight = Rules({0: 3, 1: 3, 2: 3}, 0.5, 0.1, 0.05, frozenset({0}))
    for spent, kind, outcome in (((1, 4, 2, 0, 0), "multi_neighbour", "cumulative_source_budget"), ((0, 40, 0, 4, 0), "multi_neighbour", "cumulative_target_budget"), ((0, 40, 0, 0, 2), BRIDGE, "cumulative_protected_bridge_budget"), ((0, 40, 0, 0, 0), BRIDGE, "selected")):
        court, part = court_of(rows, tight, prior=[(1, 100, 0, 0, 0), spent])
        assert ask(court, part, kind, 0, [(1, 1)]) == outcome


def test_odd_proposals():
    court, part = court_of(["00000", "01020", "00000"], FREE)
    assert ask(court, part, "multi_neighbour", 0, []) == "outside_core_owner"
    assert ask(court, part, "multi_neighbour", 0, [(1, 1), (9, 9)]) == "outside_core_owner"
    assert ask(court, part, "multi_neighbour", 0, [(1, 1), (3, 1)]) == "target_attachment"  # two pieces
    assert ask(court, part, "multi_neighbour", 0, [(1, 1)], anchors=[777]) == "target_attachment"
    assert ask(court, part, "multi_neighbour", 2, [(1, 1)]) == "target_attachment"  # touches nothing of its class


def test_partitions_are_judged_apart(spark):
    """Two partitions with budgets of their own, a proposal across them, one without cells, and ties in rank."""
    raster = {(x, y): 1 if (x, y) in {(2, 2), (5, 2), (9, 2), (7, 5), (8, 5)} else 0 for x in range(16) for y in range(8)}
    part = label_parts(raster)
    size = Counter(part.values())
    pixels = spark.createDataFrame([(x, y, k, part[x, y]) for (x, y), k in raster.items()], "x long, y long, class_index long, component_id long")
    parts = spark.createDataFrame(list(size.items()), "component_id long, pixel_count long")
    where = {"a": [(2, 2)], "b": [(5, 2)], "c": [(9, 2)], "d": [(7, 5), (8, 5)], "e": []}
    proposals = spark.createDataFrame([(i, "multi_neighbour", 0, [0], 1) for i in where], "proposal_id string, kind string, target_class long, target_ids array<long>, rank int")
    cells = spark.createDataFrame([(i, x, y) for i, v in where.items() for x, y in v], "proposal_id string, x long, y long")
    out = adjudication.adjudicate(proposals, cells, pixels, parts, Rules({0: 3, 1: 3}, 0.4, 1.0), 8)
    assert {(r.proposal_id, r.owner, r.outcome) for r in out.collect()} == {("a", 0, "selected"), ("b", 0, "source_budget"), ("c", 1, "source_budget"), ("d", 0, "outside_core_owner"), ("e", None, "outside_core_owner")}
