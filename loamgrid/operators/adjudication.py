"""Adjudication of clean-up proposals in rank order, each over a footprint that may be a part of one or several components.

An owner is a partition; its window is the partition and a rim around it.  Proposals must lie in the partition.  The window is held
as flat arrays with an empty border, so that a neighbour is an index away; a proposal is judged by what it
touches, never by counting the window anew.

What a proposal takes must leave each of its source components in one piece.  The cells around the hole start one front each; fronts
grow by a layer in turn and merge where they meet.  All merged: nothing was cut; one closed before that: it was.
Pieces that only meet outside the window count as cut.

Accepted proposals rely on the components they were joined to, their anchors.  A later proposal may take cells of an anchor if some are
left and everything that touched them is still joined to it, perhaps through other accepted proposals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.operators import rasters as R

BRIDGE = "same_class_bridge"


class Rules(NamedTuple):
    """``limits``: pixels below which a component of a class is a fragment; shares of a class' core pixels that it may lose and gain."""

    limits: dict[int, float]
    loss: float
    gain: float
    bridge_gain: float = 0.0
    protected: frozenset[int] = frozenset()
    width_m: float = 1.0
    height_m: float = 1.0


class Proposal(NamedTuple):
    kind: str
    target: int
    anchors: list[int]
    cells: np.ndarray


class Arbiter:
    """The state of one window. Components are numbered by place in ``ids``."""

    def __init__(self, x, y, kind, component, size, core, rules: Rules, immutable=None, locked=None, prior: Iterable[tuple[int, int, int, int, int]] | None = None) -> None:
        self.rules, self.x0, self.y0 = rules, int(x.min()), int(y.min())
        self.width, self.height = int(x.max()) - self.x0 + 1, int(y.max()) - self.y0 + 1
        self.stride = self.width + 2
        at, n = self.at(x, y), self.stride * (self.height + 2)
        self.ids, number, where = np.unique(component, return_inverse=True)[0], np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        number[at] = np.searchsorted(self.ids, component)
        where[at] = kind
        self.part, self.was, self.now = number, where, where.copy()
        self.taken = np.full(n, -1, np.int32)
        flag = lambda v: np.zeros(n, bool) if v is None else np.bincount(at[np.asarray(v, bool)], minlength=n).astype(bool)
        self.core, self.immutable, self.locked = flag(core), flag(immutable), flag(locked)
        k = len(self.ids)
        self.kind, self.size = np.zeros(k, np.int32), np.zeros(k, np.int64)
        self.kind[number[at]], self.size[number[at]] = kind, size
        self.left, self.grown, self.parent = self.size.copy(), self.size.copy(), np.arange(k)
        self.total = Counter(dict(zip(*(v.tolist() for v in np.unique(self.was[self.core], return_counts=True)), strict=True)))
        self.lost, self.won, self.bridged = Counter(), Counter(), Counter()
        self.cumulative = prior is not None
        for code, total, lost, won, bridged in prior or []:
            self.total[code], self.lost[code], self.won[code], self.bridged[code] = total, lost, won, bridged
        self.parts_more, self.fragments_more, self.area_more, self.sides_more, self.metres_more = Counter(), 0, 0, 0, 0.0
        self.accepted: list[Proposal] = []
        self.home: list[int] = []
        self.beside: dict[int, list[int]] = {}
        self.relied, self.bridge_relied = Counter(), Counter()

    def at(self, x, y):
        return (np.asarray(y, np.int64) - self.y0 + 1) * self.stride + (np.asarray(x, np.int64) - self.x0 + 1)

    def proposal(self, kind: str, target: int, anchors, x, y) -> Proposal:
        """Anchors outside the window are -1, cells outside it 0."""
        x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
        inside = (x >= self.x0) & (x < self.x0 + self.width) & (y >= self.y0) & (y < self.y0 + self.height)
        place = np.searchsorted(self.ids, anchors)
        found = [int(p) if p < len(self.ids) and self.ids[p] == a else -1 for p, a in zip(place, anchors, strict=True)]
        return Proposal(kind, int(target), found, np.unique(np.where(inside, self.at(x, y), 0)))

    def _around(self, cell: int) -> tuple[int, int, int, int]:
        return cell - 1, cell + 1, cell - self.stride, cell + self.stride

    def _root(self, part: int) -> int:
        while self.parent[part] != part:
            self.parent[part] = self.parent[self.parent[part]]
            part = int(self.parent[part])
        return part

    def _small(self, size: int, kind: int) -> bool:
        return 0 < size < self.rules.limits[kind]

    def cuts(self, part: int, gone: set[int]) -> bool:
        """True if what is left of a component is not in one piece, as far as this window shows."""
        free = lambda d: self.part[d] == part and self.taken[d] < 0 and d not in gone
        ring = sorted({d for c in gone for d in self._around(c) if free(d)})
        if not ring:
            return bool(self.left[part] > len(gone))
        of, lead, fronts = {d: i for i, d in enumerate(ring)}, list(range(len(ring))), {i: [d] for i, d in enumerate(ring)}

        def top(i: int) -> int:
            while lead[i] != i:
                lead[i] = lead[lead[i]]
                i = lead[i]
            return i

        while len(fronts) > 1:
            for i in list(fronts):
                if i not in fronts:
                    continue
                layer, fronts[i] = fronts[i], []
                for c in layer:
                    for d in self._around(c):
                        if d in of:
                            a, b = top(i), top(of[d])
                            if a != b:
                                lead[b] = a
                                fronts[a] += fronts.pop(b)
                        elif free(d):
                            of[d] = i
                            fronts[top(i)].append(d)
                if len(fronts) == 1:
                    return False
                if not fronts[top(i)]:
                    return True
        return False

    def _one_piece(self, cells: set[int]) -> bool:
        rest = set(cells)
        queue = [rest.pop()]
        while queue:
            met = rest.intersection(self._around(queue.pop()))
            rest -= met
            queue += met
        return not rest

    def _touches(self, number: int) -> tuple[set[int], set[int]]:
        """Components and accepted proposals that an accepted proposal touches in its class."""
        p, parts, others = self.accepted[number], set(), set()
        for c in p.cells.tolist():
            for d in self._around(c):
                if self.now[d] == p.target:
                    if self.taken[d] < 0:
                        parts.add(int(self.part[d]))
                    elif self.taken[d] != number:
                        others.add(int(self.taken[d]))
        return parts, others

    def joined(self, start: int, parts: set[int], others: set[int] = frozenset()) -> bool:
        """True if an accepted proposal is joined to all of these components and proposals, directly or through others."""
        parts, others, queue, seen, passed = set(parts), set(others) - {start}, [start], {start}, set()
        while queue and (parts or others):
            met, next_ = self._touches(queue.pop())
            parts -= met
            for part in met - passed if parts or others else ():
                passed.add(part)
                next_ |= {q for q in self.beside.get(part, ()) if part in self._touches(q)[0]}
            others -= next_
            queue += next_ - seen
            seen |= next_
        return not parts and not others

    def _attached(self, number: int, sources: dict[int, set[int]]) -> bool:
        """``number`` (just applied) reaches its anchors, and nothing accepted before has lost one."""
        p = self.accepted[number]
        for a in p.anchors:
            if self.left[a] <= 0 or p.kind == BRIDGE and self.left[a] < self.size[a]:
                return False
        if not self.joined(number, set(p.anchors)):
            return False
        for part, gone in sources.items():
            if self.bridge_relied[part] or self.relied[part] and self.left[part] <= 0:
                return False
            near = {int(self.taken[d]) for c in gone for d in self._around(c) if self.taken[d] not in (-1, number) and self.now[d] == self.kind[part]}
            rest = {part} if self.left[part] > 0 else set()
            if all(self.joined(q, rest, set() if rest else near) for q in near):
                continue  # whatever led over the lost contacts leads another way
            met = {self._root(self.home[q]) for q in near}
            if not all(self.joined(q, set(self.accepted[q].anchors)) for q, home in enumerate(self.home) if self._root(home) in met):
                return False
        return True

    def judge(self, p: Proposal) -> str:
        """``selected``, and the window changes, or the first gate that the proposal fails."""
        cells, target, rules, n = p.cells, p.target, self.rules, len(p.cells)
        if self.immutable[cells].any():
            return "round1_immutable"
        if self.locked[cells].any():
            return "round1_dependency_lock"
        if not n or not self.core[cells].all():
            return "outside_core_owner"
        if (self.taken[cells] >= 0).any():
            return "footprint_conflict"
        again = "cumulative_" if self.cumulative else ""
        losses = Counter(self.was[cells].tolist())
        if any(self.lost[c] + k > self.total[c] * rules.loss + 1e-12 for c, k in losses.items()):
            return again + "source_budget"
        shielded = p.kind == BRIDGE and target in rules.protected
        most = rules.bridge_gain if shielded and not self.cumulative else rules.gain
        if self.won[target] + n > self.total[target] * most + 1e-12:
            return again + "target_budget"
        if self.cumulative and shielded and self.bridged[target] + n > self.total[target] * rules.bridge_gain + 1e-12:
            return "cumulative_protected_bridge_budget"
        sources: dict[int, set[int]] = {}
        for c in cells.tolist():
            sources.setdefault(int(self.part[c]), set()).add(c)
        if any(self.cuts(part, gone) for part, gone in sources.items()):
            return "source_connectivity"

        inside = set(cells.tolist())
        beside = {d for c in inside for d in self._around(c) if self.now[d] == target and d not in inside}
        roots = {self._root(a) for a in p.anchors if a >= 0} | {self._root(int(self.part[d]) if self.taken[d] < 0 else self.home[self.taken[d]]) for d in beside}
        if not roots or -1 in p.anchors or target in losses or not self._one_piece(inside) or any(self.grown[r] <= 0 or self.kind[r] != target for r in roots):
            return "target_attachment"
        removed = Counter()
        for part, gone in sources.items():
            removed[self._root(part)] += len(gone)
        parts, fragments, area = Counter(), 0, 0

        def change(size: int, kind: int, by: int) -> None:
            nonlocal fragments, area
            if size > 0:
                parts[kind] += by
            if self._small(size, kind):
                fragments, area = fragments + by, area + by * size

        grown = int(sum(self.grown[r] for r in roots)) + n
        for r, k in removed.items():
            change(int(self.grown[r]), int(self.kind[r]), -1)
            change(int(self.grown[r]) - k, int(self.kind[r]), 1)
        for r in roots:
            change(int(self.grown[r]), target, -1)
        change(grown, target, 1)
        if any(self.parts_more[c] + k > 0 for c, k in parts.items()):
            return "component_count_increase"
        if self.fragments_more + fragments > 0:
            return "dynamic_fragment_increase"
        sides, metres = 0, 0.0
        for c in inside:
            for step, d in zip((1, 1, 0, 0), self._around(c), strict=True):
                if self.now[d] >= 0 and d not in inside:
                    by = int(self.now[d] != target) - int(self.now[d] != self.now[c])
                elif d in inside and d > c:
                    by = -int(self.now[d] != self.now[c])
                else:
                    continue
                sides, metres = sides + by, metres + by * (rules.height_m if step else rules.width_m)
        if self.sides_more + sides > 0 or self.metres_more + metres > 1e-9:
            return "boundary_increase"
        if self.area_more + area > 0:
            return "dynamic_fragment_area_increase"

        number = len(self.accepted)
        self.accepted.append(p)
        self.now[cells], self.taken[cells] = target, number
        for part, gone in sources.items():
            self.left[part] -= len(gone)
        if not self._attached(number, sources):
            self.accepted.pop()
            self.now[cells], self.taken[cells] = self.was[cells], -1
            for part, gone in sources.items():
                self.left[part] += len(gone)
            return "target_attachment"
        self.lost.update(losses)
        self.won[target] += n
        self.bridged[target] += n * shielded
        for part in self._touches(number)[0]:
            self.beside.setdefault(part, []).append(number)
        self.relied.update(p.anchors)
        if p.kind == BRIDGE:
            self.bridge_relied.update(p.anchors)
        for r, k in removed.items():
            self.grown[r] -= k
        head = min(roots)
        for r in roots:
            self.parent[r] = head
        self.grown[head] = grown
        self.home.append(head)
        self.parts_more.update(parts)
        self.fragments_more, self.area_more, self.sides_more, self.metres_more = self.fragments_more + fragments, self.area_more + area, self.sides_more + sides, self.metres_more + metres
        return "selected"


def with_sizes(pixels: DataFrame, parts: DataFrame) -> DataFrame:
    """``pixels`` with their component's pixel_count; the few components that hold a thousandth of all pixels or more, under 1,000, meet theirs by broadcast."""
    sizes = parts.select("component_id", "pixel_count")
    total = sizes.agg(F.sum("pixel_count")).first()[0] or 0
    large = F.broadcast(sizes.where(F.col("pixel_count") * 1000 > total))
    rest = pixels.join(large.select("component_id"), "component_id", "left_anti").join(sizes.where(F.col("pixel_count") * 1000 <= total), "component_id")
    return pixels.join(large, "component_id").unionByName(rest)


def adjudicate(proposals: DataFrame, footprints: DataFrame, pixels: DataFrame, parts: DataFrame, rules: Rules, side: int, rim: int = 1, prior: DataFrame | None = None) -> DataFrame:
    """owner, proposal_id, place, outcome: proposals judged in rank order under the gates of ``Arbiter.judge``.

    ``proposals``: proposal_id, kind, target_class, target_ids (components they join; the cells must be in one piece), rank (any orderable column, smallest first; ties by
    proposal_id); ``footprints``: proposal_id, x, y.  The owner is the partition of the first cell.  ``pixels``: x, y,
    class_index, component_id, and optionally immutable and locked, the cells of an earlier round and those it relies on; ``prior``: owner,
    class_index, total (pixels before that round), lost, won, bridged of it, whose budgets go on.  A proposal without cells is outside its owner, and has none (null).

    A group is one partition with its rim as integer columns, beside its proposals; it grows with ``side``, not with the raster.
    """
    import pyarrow as pa

    last = pixels.agg(F.floor(F.max("x") / side).alias("last"))
    owner = lambda x, y: y * (F.col("last") + 1) + x
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in pixels.columns else F.lit(False).alias(c) for c in ("immutable", "locked")]
    halo = R.partition_halo(with_sizes(pixels.select("x", "y", "class_index", "component_id", *flags), parts), side, rim).join(F.broadcast(last))  # one row
    core = (F.floor(F.col("x") / side) == F.col("halo_x")) & (F.floor(F.col("y") / side) == F.col("halo_y"))
    window = halo.select(owner(F.col("halo_x"), F.col("halo_y")).alias("owner"), "x", "y", "class_index", "component_id", "pixel_count", core.alias("core"), "immutable", "locked")
    cells = footprints.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("cells"))
    asked = proposals.join(cells, "proposal_id", "left").join(F.broadcast(last))
    first = F.get("cells", F.lit(0))
    asked = asked.withColumn("owner", owner(F.floor(first["x"] / side), F.floor(first["y"] / side)).cast("long"))
    asked = asked.select("owner", F.row_number().over(W.partitionBy("owner").orderBy("rank", "proposal_id")).alias("place"), "proposal_id", "kind", F.col("target_class").cast("int"), "target_ids", F.col("cells.x").alias("xs"), F.col("cells.y").alias("ys"))
    if prior is not None:
        spent = prior.groupBy("owner").agg(F.collect_list(F.struct("class_index", "total", "lost", "won", "bridged")).alias("prior"))  # a row a class
        asked = asked.join(spent, "owner", "left")
    placed = asked.where("owner is not null")
    window = window.join(placed.select("owner").distinct(), "owner", "left_semi")
    id_type, again = proposals.schema["proposal_id"].dataType.simpleString(), prior is not None

    def run(asks: pa.Table, cells_: pa.Table) -> pa.Table:
        asks = asks.sort_by("place")
        if not cells_.num_rows:
            outcome = ["outside_core_owner"] * asks.num_rows
        else:
            column = {c: cells_.column(c).to_numpy() for c in cells_.column_names}
            listed = asks.to_pylist()
            spent = [(s["class_index"], s["total"], s["lost"], s["won"], s["bridged"]) for s in listed[0]["prior"] or []] if again and listed else None
            court = Arbiter(column["x"], column["y"], column["class_index"], column["component_id"], column["pixel_count"], column["core"], rules, column["immutable"], column["locked"], spent)
            outcome = [court.judge(court.proposal(a["kind"], a["target_class"], a["target_ids"] or [], a["xs"], a["ys"])) for a in listed]
        return asks.select(["owner", "proposal_id", "place"]).append_column("outcome", pa.array(outcome, pa.string()))

    judged = placed.groupBy("owner").cogroup(window.groupBy("owner")).applyInArrow(run, f"owner long, proposal_id {id_type}, place int, outcome string")
    return judged.unionByName(asked.where("owner is null").select("owner", "proposal_id", "place", F.lit("outside_core_owner").alias("outcome")))
