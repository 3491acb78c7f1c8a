"""Processors that keep state by key: values, lists and maps on RocksDB, with timers in event time.

Events that may still be overtaken wait in a list, to which a batch appends without reading it.  A timer at
the earliest of them wakes the key when the watermark is there; only then is the list read, in order of event time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which these processors need; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Keyed(StatefulProcessor):
    """What the processors share: the handle, and timers in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def open(self) -> None:
        """Declare the state."""

    def wake(self, us: int, mark_ms: int) -> None:
        """A timer at ``us``, after the present watermark in any case."""
        self.handle.registerTimer(max(mark_ms, us // 1000) + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from ()

    def close(self) -> None:
        pass


def _users(key: Any, part: pd.DataFrame) -> list:
    """The users of a block's rows; those of the block without a number have none."""
    return [None] * len(part) if key[0] is None else part["user_id"].tolist()


class Latest(Keyed):
    """Each batch every user's latest event and every urgent one; a user is forgotten some time after the last event.

    A key is a block of users, whose events are one value: a batch reads and writes it once.
    """

    def __init__(self, forget_us: int, urgent: str) -> None:
        self.forget_us, self.urgent = forget_us, urgent

    def open(self) -> None:
        self.best = self.handle.getValueState("best", "user array<long>, us array<long>, event_id array<long>, event_type array<string>")

    def held(self) -> dict:
        """user: (us, event_id, event_type)."""
        users, *rest = self.best.get() or ([], [], [], [])
        return dict(zip(users, zip(*rest, strict=True), strict=True))

    def keep(self, best: dict) -> None:
        self.best.update((list(best), *([e[i] for e in best.values()] for i in range(3))))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best, seen = self.held(), {}
        for part in rows:
            users = _users(key, part)
            urgent = part.assign(user_id=users)[part["event_type"] == self.urgent]
            if len(urgent):
                yield urgent[["user_id", "event_id", "event_type"]]
            for user, *event in zip(users, part["us"].tolist(), part["event_id"].tolist(), part["event_type"].tolist(), strict=True):
                seen[user] = best[user] = max(best.get(user, (-1, -1, "")), tuple(event))
        self.keep(best)
        self.wake(min(e[0] for e in seen.values()) + self.forget_us, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"user_id": list(seen), "event_id": [e[1] for e in seen.values()], "event_type": [e[2] for e in seen.values()]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        best, ms = self.held(), timerValues.getCurrentWatermarkInMs()
        rest = {u: e for u, e in best.items() if e[0] + self.forget_us > ms * 1000}
        if rest and len(rest) < len(best):
            self.keep(rest)
        elif best and not rest:
            self.best.clear()
        if rest:
            self.wake(min(e[0] for e in rest.values()) + self.forget_us, ms)
        yield from ()


class Waiting(Keyed):
    """Events of a block of users wait for the watermark; ``step`` then gets those that it has passed, in order.

    A batch reads and writes a block's state once, not once for each user.
    """

    #: Schema of a waiting event; its first fields are the time in microseconds and the user.
    event = "us long, user long"

    def open(self) -> None:
        self.waiting = self.handle.getListState("waiting", self.event)

    def rows(self, key: Any, part: pd.DataFrame) -> list[tuple]:
        """The waiting events of a batch."""
        raise NotImplementedError

    def step(self, due: list[tuple], mark: int) -> tuple[pd.DataFrame | None, int | None]:
        """What is known at ``mark``, and when the block must wake though nothing comes."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [e for part in rows for e in self.rows(key, part)]
        if new:
            self.waiting.appendList(new)
            self.wake(min(e[0] for e in new), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ms = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(e) for e in self.waiting.get())
        due = [e for e in held if e[0] <= ms * 1000]
        rest = held[len(due) :]
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        out, again = self.step(due, ms * 1000)
        if again is not None or rest and due:
            self.wake(min(x for x in (again, rest[0][0] if rest else None) if x is not None), ms)
        if out is not None:
            yield out


class Leases(Waiting):
    """Times at which a user's lease ran out: no heartbeat for ``idle_us``, whether or not another one follows."""

    def __init__(self, idle_us: int) -> None:
        self.idle_us = idle_us

    def open(self) -> None:
        super().open()
        self.last = self.handle.getValueState("last", "user array<long>, us array<long>")

    def rows(self, key: Any, part: pd.DataFrame) -> list[tuple]:
        return list(zip(part["us"].tolist(), _users(key, part), strict=True))

    def step(self, due: list[tuple], mark: int) -> tuple[pd.DataFrame | None, int | None]:
        held = self.last.get()
        before, over = dict(zip(*held, strict=True)) if held else {}, []
        last = dict(before)
        for us, user in due:
            if user in last and us - last[user] > self.idle_us:
                over.append((user, last[user] + self.idle_us))
            last[user] = max(last.get(user, us), us)
        over += [(user, us + self.idle_us) for user, us in last.items() if us + self.idle_us < mark]
        last = {user: us for user, us in last.items() if us + self.idle_us >= mark}
        if last and last != before:
            self.last.update((list(last), list(last.values())))
        elif held and not last:
            self.last.clear()
        out = pd.DataFrame({"user_id": [u for u, _ in over], "expired_us": [us for _, us in over]}) if over else None
        return out, min(last.values()) + self.idle_us if last else None


class Recoveries(Waiting):
    """Failures with the user's next success in event time, at most ``forget_us`` later."""

    event = "us long, user long, event_id long, failed boolean"

    def __init__(self, failed: str, succeeded: str, forget_us: int) -> None:
        self.failed, self.succeeded, self.forget_us = failed, succeeded, forget_us

    def open(self) -> None:
        super().open()
        self.failures = self.handle.getListState("failures", "us long, user long, event_id long")

    def rows(self, key: Any, part: pd.DataFrame) -> list[tuple]:
        part = part[part["event_type"].isin((self.failed, self.succeeded))]
        return list(zip(part["us"].tolist(), _users(key, part), part["event_id"].tolist(), (part["event_type"] == self.failed).tolist(), strict=True))

    def step(self, due: list[tuple], mark: int) -> tuple[pd.DataFrame | None, int | None]:
        before = [tuple(e) for e in self.failures.get()]
        open_, found = {}, []
        for us, user, event in before:
            open_.setdefault(user, []).append((us, event))
        for us, user, event, failed in due:
            if failed:
                open_.setdefault(user, []).append((us, event))
            else:
                found += [(e, event) for t, e in open_.pop(user, ()) if us - t <= self.forget_us]
        left = [(us, user, event) for user, held in open_.items() for us, event in held if us + self.forget_us > mark]
        if left and left != before:
            self.failures.put(left)
        elif before and not left:
            self.failures.clear()
        out = pd.DataFrame({"event_id": [e for e, _ in found], "recovered_by": [e for _, e in found]}) if found else None
        return out, min(o[0] for o in left) + self.forget_us if left else None


class Fusion(Keyed):
    """Sums of the models' class probabilities of each pixel of a block, once when the last of ``models`` has arrived.

    State: one array a model for the block, of which a pixel keeps its first arrival, and which pixels are out. A model's
    arrays go when all pixels that they hold are out; what comes again after that changes nothing.
    """

    def __init__(self, models: list[int], side: int, classes: int) -> None:
        self.models, self.side, self.classes = models, side, classes

    def open(self) -> None:
        self.held = self.handle.getMapState("held", "model_id int", "at array<int>, p array<double>")
        self.out = self.handle.getValueState("out", "at array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        done = set((self.out.get() or ([],))[0])
        held: dict[int, dict[int, list[float]]] = {}
        for m in self.models:
            kept, k = self.held.getValue((m,)), self.classes
            held[m] = {at: kept[1][i * k : (i + 1) * k] for i, at in enumerate(kept[0])} if kept else {}
        sizes = {m: len(v) for m, v in held.items()}
        for part in rows:
            for m, x, y, p in zip(part["model_id"].tolist(), part["x"].tolist(), part["y"].tolist(), part["probs"], strict=True):
                at = (y % self.side) * self.side + x % self.side
                if m in held and at not in done:
                    held[m].setdefault(at, list(p))
        whole = sorted(set.intersection(*map(set, held.values())) - done)
        if whole:
            done |= set(whole)
            self.out.update((sorted(done),))
        for m, v in held.items():
            if v and v.keys() <= done:
                self.held.removeKey((m,))
            elif len(v) != sizes[m]:
                self.held.updateValue((m,), (list(v), [q for p in v.values() for q in p]))
        if whole:
            x0, y0 = key[0] * self.side, key[1] * self.side
            sums = [[math.fsum(held[m][at][c] for m in self.models) for c in range(self.classes)] for at in whole]
            yield pd.DataFrame({"x": [x0 + at % self.side for at in whole], "y": [y0 + at // self.side for at in whole], "sums": sums})


class Readiness(Keyed):
    """Each unit of a block once, when the last of the artifacts that it needs has reported; a repeated report changes nothing.

    State: the block's units that a report has named, and the artifacts that each still waits for (none: it is out). A batch reads
    and writes it once for a block, not for each unit and artifact.
    """

    def open(self) -> None:
        self.held = self.handle.getValueState("held", "unit array<long>, waits array<int>, artifact array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        units, waits, artifacts = self.held.get() or ([], [], [])
        missing, at = {}, 0
        for unit, n in zip(units, waits, strict=True):
            missing[unit] = set(artifacts[at : at + n])
            at += n
        out, changed = [], False
        for part in rows:
            for unit, artifact, needs in zip(part["unit_id"].tolist(), part["artifact_id"].tolist(), part["needs"], strict=True):
                left = missing.get(unit)
                if left is None:
                    left = missing[unit] = set(map(int, needs))
                if artifact in left:
                    left.remove(artifact)
                    changed = True
                    if not left:
                        out.append(unit)
        if changed:
            self.held.update((list(missing), [len(v) for v in missing.values()], [a for v in missing.values() for a in v]))
        if out:
            yield pd.DataFrame({"unit_id": out})
