"""Relational operators over run-state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in the given order."""
    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__n") <= k).drop("__n")


def like_escaped(column: Column, text: str) -> Column:
    """Contains ``text`` literally: backslash, percent and underscore have no meaning."""
    for c in ("\\", "%", "_"):
        text = text.replace(c, "\\" + c)
    return column.like(f"%{text}%")


def keyset_page(df: DataFrame, key: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The next ``size`` rows in descending order of the key, behind the row with key ``after``."""
    if after is not None:
        df = df.where(F.struct(*key) < F.struct(*[F.lit(a).cast(df.schema[k].dataType).alias(k) for k, a in zip(key, after, strict=True)]))
    return df.orderBy(*[F.col(k).desc() for k in key]).limit(size)


def append_once(events: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of the events with one idempotency key the first one."""
    return latest(events, keys, order)


def upsert_progress(updates: DataFrame, key: str, phase: str, order: Sequence[str]) -> DataFrame:
    """Latest update of each key, with the time when its current phase began (kept while the phase stays)."""
    by = W.partitionBy(key).orderBy(*order)
    changed = updates.withColumn("__new", (F.lag(phase).over(by).isNull()) | (F.lag(phase).over(by) != F.col(phase)))
    began = F.last(F.when(F.col("__new"), F.col("ts")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    return latest(changed.withColumn("phase_started_at", began).drop("__new"), [key], [F.col(c).desc() for c in order])


def recoveries(events: DataFrame, keys: Sequence[str], failed: Column, succeeded: Column) -> DataFrame:
    """Failures with the earliest later success of the same key, if any.

    One sort of each key's events instead of a join of all pairs.
    """
    ahead = W.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(1, W.unboundedFollowing)
    found = events.withColumn("recovered_by", F.first(F.when(succeeded, F.col("event_id")), ignorenulls=True).over(ahead))
    return found.where(failed)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: key, side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def status_counts(df: DataFrame, by: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """A column for each status; one pass, no pivot over unknown values."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def runnable(jobs: DataFrame, dependencies: DataFrame, artifacts: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Queued or interrupted jobs with attempts left whose dependencies all have a ready artifact.

    With ``required`` (job_type, kind), the ready artifacts must also hold every kind that the job's type asks for.
    """
    ready = artifacts.where("status = 'ready'").select("artifact_id", "kind")
    unready = dependencies.join(ready, "artifact_id", "left_anti").select("job_id").distinct()
    open_ = jobs.where("status in ('queued', 'interrupted') and attempt < max_attempts").join(unready, "job_id", "left_anti")
    if required is None:
        return open_
    held = dependencies.join(ready, "artifact_id").select("job_id", "kind").distinct()
    missing = open_.select("job_id", "job_type").join(required, "job_type").join(held, ["job_id", "kind"], "left_anti").select("job_id").distinct()
    return open_.join(missing, "job_id", "left_anti")


def bounded_utf8(text: Column, size: int) -> Column:
    """The longest prefix of whole characters within ``size`` bytes."""
    most = F.sequence(F.lit(0), F.lit(3))
    cut = F.substring(F.encode(text, "UTF-8"), 1, size)
    # a cut inside a character leaves a lead byte with too few followers: drop up to three bytes until it decodes again
    tries = F.transform(most, lambda n: F.substr(cut, F.lit(1), F.length(cut) - n))
    whole = F.filter(tries, lambda b: F.is_valid_utf8(b.cast("string")))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.get(whole, 0).cast("string"))


def lineage(spans: DataFrame, span: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """``span``, root, depth, path (ids from the root on), cyclic of every different span.

    A span without parent, or whose parent has no row, is a root. Pointers jump: each round joins a span's stretch of ancestors with
    that of the last one, so rounds grow with the logarithm of the depth. Spans that lead into a cycle have no root (null, with depth
    and path null). A path is as long as its span is deep.
    """
    from loamgrid.sources.scratch import saved

    ids = spans.select(F.col(span).alias("id"), F.col(parent).alias("up")).where("id is not null").groupBy("id").agg(F.min("up").alias("up"))
    known = ids.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    path = F.array("id").alias("path")
    # rows without a pointer take no part in the joins: their nulls would all be one key
    tops = ids.where("up is null").select("id", "up", path)
    now = ids.where("up is not null").join(known, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up"), path)
    now, done, open_ = saved(tops.unionByName(now), "spans"), None, None
    parts = [now]
    while True:
        waiting = parts[-1].where("up is not null").count()
        if not waiting or waiting == open_:  # after a round that closed none, only cycles are open
            break
        open_ = waiting
        now = parts[-1].where("up is not null")
        closed = parts[-1].where("up is null")
        done = closed if done is None else done.unionByName(closed)
        ahead = now.unionByName(done).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        step = now.join(ahead, "up").select("id", F.col("next").alias("up"), F.concat("above", "path").alias("path"))
        parts.append(saved(step, "spans"))
    last = parts[-1]
    now = last if done is None else last.unionByName(done)
    cyclic = F.col("up").isNotNull()
    return now.select(F.col("id").alias(span), F.when(~cyclic, F.get("path", F.lit(0))).alias("root"), F.when(~cyclic, F.size("path") - 1).alias("depth"), F.when(~cyclic, F.col("path")).alias("path"), cyclic.alias("cyclic"))


def budget_attempts(spans: DataFrame, keys: Sequence[str], counts: Column, order: Sequence[str]) -> DataFrame:
    """``spans`` with attempt_no within ``keys``, and budget_attempt: the attempts so far that count against the budget."""
    by = W.partitionBy(*keys).orderBy(*order)
    return spans.withColumns({"attempt_no": F.row_number().over(by), "budget_attempt": F.sum(F.when(counts, 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")})
