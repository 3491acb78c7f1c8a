"""The committing sink, the log as a stream, span lineage, and the scorer."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import relational, scoring
from loamgrid.sources import shards


def records(spark, n, seed=0):
    return spark.range(n).selectExpr("id", "id % 3 as part", f"concat('v', id + {seed}) as value")


def test_a_write_that_dies_is_invisible(spark, tmp_path):
    path = str(tmp_path)
    dies = records(spark, 100).withColumn("value", F.when(F.col("id") == 70, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        shards.write_shards(dies, path, "id", "part")
    with pytest.raises(shards.ShardError, match="nothing has been committed"):
        shards.read_shards(spark, path, dies.schema)
    shards.write_shards(records(spark, 40), path, "id", "part", source="first")
    with pytest.raises(Exception, match="lost"):
        shards.write_shards(dies, path, "id", "part")
    kept = shards.read_shards(spark, path, records(spark, 1).schema, "part")
    assert kept.count() == 40 and shards.last_commit(spark, path).source == "first"
    shards.write_shards(records(spark, 7, 5), path, "id", "part", source="second")
    assert shards.last_commit(spark, path)[:3:2] == (2, 7)
    assert {r.value for r in shards.read_shards(spark, path, kept.schema, "part").collect()} == {f"v{i + 5}" for i in range(7)}


def test_the_manifest_is_of_the_files(spark, tmp_path):
    """An input that differs each time it is evaluated still agrees with its manifest; files that change afterwards don't."""
    path = str(tmp_path)
    shards.write_shards(spark.range(500).select("id", (F.rand() * 3).cast("long").alias("part"), F.rand().alias("value")), path, "id", "part")
    rows = shards.read_shards(spark, path, spark.read.parquet(f"{path}/records/*").schema, "part")
    assert rows.count() == 500
    name = shards.last_commit(spark, path).name
    one = sorted(Path(path, "records", name).glob("*.parquet"))[0]
    part = spark.read.parquet(str(one))
    n = part.count()
    part.withColumn("value", F.col("value") + 1).coalesce(1).write.parquet(f"{path}/other")
    new = next(Path(path, "other").glob("*.parquet")).read_bytes()
    for crc in one.parent.glob(".*.crc"):
        crc.unlink()
    one.write_bytes(new)
    wrong = shards.manifest_violations(spark, path, "part").collect()
    assert sum(r.rows for r in wrong) == sum(r.found for r in wrong) == n and {r.file for r in wrong} == {one.name}
    with pytest.raises(shards.ShardError, match="differs from its manifest"):
        shards.read_shards(spark, path, rows.schema, "part")
    one.unlink()
    assert {r.found for r in shards.manifest_violations(spark, path, "part").collect()} == {0}


def test_other_columns_and_no_rows(spark, tmp_path):
    path = str(tmp_path)
    shards.write_shards(records(spark, 0), path, "id", "part")
    assert shards.read_shards(spark, path, records(spark, 0).schema, "part").count() == 0
    with pytest.raises(shards.ShardError, match="columns"):
        shards.read_shards(spark, path, spark.range(1).schema)


def test_appended_logs_are_read_once(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    (logs / "a.json").write_text('{"level": "info", "message": "one"}\n{"level": "error", "mess\n')
    good, bad = shards.drain_log(spark, str(logs), out)
    assert (good.count(), [r[0] for r in bad.collect()]) == (1, ['{"level": "error", "mess'])
    (logs / "b.json").write_text('{"level": "info", "message": "one"}\nnot json\n{"timestamp": "t", "level": "warning", "message": "äö"}\n')
    for _ in range(2):
        good, bad = shards.drain_log(spark, str(logs), out)
        assert sorted(r.message for r in good.collect()) == ["one", "one", "äö"] and bad.count() == 2


def test_lineage(spark):
    """A deep chain, a tree, roots whose parent is missing, repeated rows, a cycle, what leads into it, and a span that is its own parent."""
    chain = [(i, i - 1 if i else None) for i in range(300)]
    rows = [*chain, (400, 5), (401, 400), (500, 999), (501, 500), (501, 500), (600, 601), (601, 602), (602, 600), (603, 602), (604, 603), (700, 700), (None, 3)]
    found = {r.span_id: r for r in relational.lineage(spark.createDataFrame(rows, "span_id long, parent_id long")).collect()}
    assert len(found) == 300 + 2 + 2 + 5 + 1
    assert all((found[i].root, found[i].depth, found[i].path) == (0, i, list(range(i + 1))) for i in range(300))
    assert (found[401].root, found[401].depth, found[401].path[-3:]) == (0, 7, [5, 400, 401])
    assert [(found[i].root, found[i].depth, found[i].cyclic) for i in (500, 501)] == [(500, 0, False), (500, 1, False)]
    assert {i for i, r in found.items() if r.cyclic} == {600, 601, 602, 603, 604, 700} and found[603].root is found[603].path is None
    assert relational.lineage(spark.createDataFrame([], "span_id long, parent_id long")).count() == 0


def test_lineage_joins_only_what_is_open(spark, monkeypatch):
    """Roots have no pointer; as keys of the joins they would all be one, so they are written once and left alone."""
    from loamgrid.sources import scratch

    wrote, real = [], scratch.saved
    monkeypatch.setattr(scratch, "saved", lambda df, name: wrote.append(real(df, name)) or wrote[-1])
    rows = [(i, None) for i in range(200)] + [(1000 + i, 1000 + i - 1 if i else 7) for i in range(6)]
    found = {r.span_id: r for r in relational.lineage(spark.createDataFrame(rows, "span_id long, parent_id long")).collect()}
    assert len(found) == 206 and (found[1005].root, found[1005].depth) == (7, 6)
    assert [df.count() for df in wrote] == [206, 6, 5, 3]


def shares(rows):
    total = rows.sum(axis=1, keepdims=True)
    return rows / total


def test_scores_of_a_model_that_is_loaded_once_a_worker(spark):
    pixels = spark.range(1000).selectExpr("id", "id + 1.0 as a", "id * 2 + 1 as b", "'x' as probs").repartition(6)
    out = scoring.score(pixels, "shares", lambda: shares, ["a", "b"], 2, ["id"], rows=50)
    rows = out.collect()
    assert all(abs(r.probs[0] - (r.id + 1) / (3 * r.id + 2)) < 1e-12 for r in rows) and len(rows) == 1000
    by = {}
    for r in rows:
        by.setdefault(r.worker, []).append(r.loaded)
    fresh = {w: sum(v) for w, v in by.items()}
    assert all(n <= 50 for n in fresh.values())  # one batch at most
    counted = scoring.loads(spark.createDataFrame(rows, out.schema)).first()
    assert counted.workers == len(by) and counted.loads <= counted.workers and counted.cached == sum(not x for v in by.values() for x in v)


def test_a_model_of_another_shape_is_refused(spark):
    with pytest.raises(Exception, match="instead of"):
        scoring.score(spark.range(3).selectExpr("id", "1.0 as a"), "wrong", lambda: shares, ["a"], 2, ["id"]).collect()
