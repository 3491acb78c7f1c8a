"""State of units that wait for artifacts, by block."""

from __future__ import annotations

import pandas as pd

from loamgrid.streaming.stateful import Readiness


class Value:
    """A value state that counts its writes."""

    def __init__(self) -> None:
        self.value, self.writes = None, 0

    def get(self):
        return self.value

    def update(self, value) -> None:
        self.value, self.writes = value, self.writes + 1


class Handle:
    def __init__(self) -> None:
        self.state = Value()

    def getValueState(self, name, *schema):  # noqa: N802
        return self.state

    getMapState = getValueState  # noqa: N815


def test_a_block_of_units_writes_its_state_once_a_batch():
    handle, ready = Handle(), Readiness()
    ready.init(handle)
    needs = {u: [u, u + 1000, 5000] for u in range(50)}

    def batch(rows):
        part = pd.DataFrame({"unit_id": [u for u, _ in rows], "artifact_id": [a for _, a in rows], "needs": [needs[u] for u, _ in rows]})
        return [u for out in ready.handleInputRows((0,), iter([part[:20], part[20:]]), None) for u in out["unit_id"].tolist()]

    assert batch([(u, u) for u in range(50) for _ in range(2)]) == batch([(u, u + 1000) for u in range(50)]) == []
    assert handle.state.writes == 2
    assert batch([(u, 5000) for u in range(25)]) == list(range(25))
    assert batch([(u, 5000) for u in range(50)]) == list(range(25, 50))
    assert batch([(u, 5000) for u in range(50)]) == [] and handle.state.writes == 4
