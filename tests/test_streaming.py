"""Streams that are stopped after each file and started again from their checkpoint."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamgrid.streaming import events as E
from loamgrid.streaming.stateful import rocks

DAY = 86_400


def fed(spark, folder, batches, schema, make):
    """What a stream writes when each batch of rows arrives as a file while it is stopped."""
    source, out = f"{folder}/in", f"{folder}/out"
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a worker for each costs seconds
    try:
        return _fed(spark, folder, batches, schema, make, source, out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def _fed(spark, folder, batches, schema, make, source, out):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        with rocks(spark):
            job = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(out)
        job.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


EVENT = "event_id long, time timestamp, user_id long, event_type string"


def events(spark, folder, batches, make):
    """Rows (id, seconds, user, type)."""
    to = lambda t: __import__("datetime").datetime.fromtimestamp(t, __import__("datetime").timezone.utc)
    return fed(spark, str(folder), [[(i, to(t), u, kind) for i, t, u, kind in rows] for rows in batches], EVENT, make)


def test_order_of_event_times_decides(spark, tmp_path):
    """Two files of a user's events in the wrong order, then a mark; a dead lease expires by its timer."""
    batches = [[(4, 30, 7, "purchase"), (1, 10, 7, "error"), (6, 100, 7, "view")], [(2, 20, 7, "purchase"), (3, 25, 7, "error"), (5, 40, 7, "error")], [(9, 100 * DAY, 8, "view")]]
    assert events(spark, tmp_path / "r", batches, lambda s: E.recovered(s, "1 hour")) == [(1, 2), (3, 4)]
    assert events(spark, tmp_path / "l", batches, lambda s: E.expired(s, 30_000_000, "1 hour")) == [(7, 70_000_000), (7, 130_000_000)]


def test_state_outlives_a_stop(spark, tmp_path):
    """An error of one run is closed in a later one, after a run that brings nothing for its user; one that is too old is not."""
    batches = [[(1, 4, 7, "error"), (2, 5, 8, "error"), (3, 6, 8, "purchase")], [(4, 2 * DAY, 9, "view")], [(5, 3 * DAY, 7, "purchase"), (6, 3 * DAY, 8, "error")], [(7, 9 * DAY, 9, "view")], [(8, 10 * DAY, 8, "purchase")], [(9, 30 * DAY, 9, "view")]]
    assert events(spark, tmp_path / "r", batches, lambda s: E.recovered(s, "1 hour", 5 * DAY * 1_000_000)) == [(1, 5), (2, 3)]
    found = events(spark, tmp_path / "l", batches, lambda s: E.expired(s, 4 * DAY * 1_000_000, "1 hour"))
    us = 1_000_000
    assert found == [(7, 7 * DAY * us), (8, 7 * DAY * us), (8, 14 * DAY * us), (9, 6 * DAY * us), (9, 13 * DAY * us)]


def test_the_latest_event_is_forgotten_in_time(spark, tmp_path):
    batches = [[(1, 50, 7, "view"), (2, 60, 7, "error")], [(3, 55, 7, "view")], [(4, 90 * DAY, 8, "view")], [(5, 90 * DAY, 7, "click")]]
    found = events(spark, tmp_path, batches, lambda s: E.coalesced(s, "100 days"))
    assert found == [(7, 2, "error"), (7, 2, "error"), (7, 2, "error"), (7, 5, "click"), (8, 4, "view")]


@pytest.mark.parametrize("what", ["recovered", "expired"])
def test_users_of_one_block_keep_apart(spark, tmp_path, what):
    """Nine users with negative and positive numbers in two or three blocks; their events cross from one run to the next."""
    rows = [(10 * u + k, 100 + (u * 7 + k * 11) % 50 * 100, u, ("error", "purchase", "view")[(u + k) % 3]) for u in range(-2, 7) for k in range(6)]
    batches = [rows[::2], rows[1::2], [(999, 90 * DAY, 1000, "view")]]
    want, us = [], 1_000_000
    for u in range(-2, 7):
        mine = sorted((t, i, kind) for i, t, user, kind in rows if user == u)
        if what == "recovered":
            want += [(i, next(j for _, j, k in mine[at:] if k == "purchase")) for at, (_, i, kind) in enumerate(mine) if kind == "error" and any(k == "purchase" for *_, k in mine[at:])]
        else:
            want += [(u, (t + 500) * us) for at, (t, *_) in enumerate(mine) if at + 1 == len(mine) or mine[at + 1][0] - t > 500]
    make = (lambda s: E.recovered(s, "1 day", block=4)) if what == "recovered" else (lambda s: E.expired(s, 500 * us, "1 day", block=4))
    assert events(spark, tmp_path, batches, make) == sorted(want)


SCORE = "x long, y long, model_id int, probs array<double>"


def test_repeated_models_change_nothing(spark, tmp_path):
    """A pixel comes out once, with the first row of each model, whatever comes again and in which run."""
    at = lambda x, m, p: (x, 20, m, [p, 1 - p])
    batches = [[at(1, 0, 0.2), at(1, 0, 0.9), at(2, 0, 0.5), at(17, 1, 0.5)], [at(1, 0, 0.7), at(1, 1, 0.4), at(2, 0, 0.5)], [at(1, 1, 0.9), at(1, 5, 0.9)], [at(2, 1, 0.25), at(17, 0, 0.5)], [at(1, 0, 0.1), at(1, 1, 0.1), at(2, 1, 0.9)]]
    found = fed(spark, str(tmp_path), batches, SCORE, lambda s: E.fused(s, [0, 1], 2))
    assert [(x, y, [round(p, 9) for p in s]) for x, y, s in found] == [(1, 20, [0.6, 1.4]), (2, 20, [0.75, 1.25]), (17, 20, [1.0, 1.0])]


def test_repeated_reports_change_nothing(spark, tmp_path):
    needs = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10), (3, 12), (3, 13)], "unit_id long, artifact_id long")
    batches = [[(10,), (10,)], [(10,), (12,)], [(12,), (12,), (99,)], [(11,)], [(11,), (10,)], [(13,)]]
    assert fed(spark, str(tmp_path), batches, "artifact_id long", lambda s: E.ready_units(s, needs)) == [(1,), (2,), (3,)]


def test_the_session_keeps_its_provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(ZeroDivisionError), rocks(spark):
        1 / 0  # noqa: B018
    assert spark.conf.get(name, None) == before
    assert spark.range(1).select(F.lit(1)).count() == 1
