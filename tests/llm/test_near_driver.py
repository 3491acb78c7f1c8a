"""What near_dedup asks of the driver."""

from __future__ import annotations

from loamgrid.llm import near_copies
from loamgrid.operators import graph
from loamgrid.sources.scratch import saved
from tests.llm.conftest import prose


def _noted(monkeypatch) -> list[tuple[str, str]]:
    """Name and plan of every table saved from now on."""
    seen = []

    def noted(df, name, *more):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return saved(df, name, *more)

    monkeypatch.setattr(near_copies, "saved", noted)
    monkeypatch.setattr(graph, "saved", noted)
    return seen


def test_no_side_that_grows_is_broadcast_however_small(spark, monkeypatch):
    """Only keys with very many copies are; they are met where crowds and equal fingerprints are counted."""
    seen = _noted(monkeypatch)
    base = prose(1, 400).split()
    texts = [" ".join(base), " ".join([*base[:200], "changed", *base[201:]]), " ".join([*base, *prose(4, 60).split()]), prose(2, 400)]
    found = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert {name for name, plan in seen if "BroadcastHashJoin" in plan} <= {"parts", "pairs_simhash"}
    names = {name for name, _ in seen}
    assert "stars" in names and any(n.startswith("sets_") for n in names) and any(n.startswith("links_") for n in names)


def test_components_write_no_round_that_is_not_needed(spark, monkeypatch):
    seen = _noted(monkeypatch)
    components = lambda *edges: {x.id: x.component for x in graph.connected_components(spark.createDataFrame([*edges], "u long, v long")).collect()}
    assert components((3, 3), (None, 4)) == {3: 3}
    assert [name for name, _ in seen] == ["edges"]
    assert components((1, 2), (1, 3), (5, 5)) == {1: 1, 2: 1, 3: 1, 5: 5}
    assert [name for name, _ in seen[1:]] == ["edges", "stars"]
    assert components(*((i, i + 1) for i in range(40))) == dict.fromkeys(range(41), 0)
