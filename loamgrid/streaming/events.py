"""Event feeds as Structured Streaming jobs; each equals its batch twin over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.sources.shards import new_folder
from loamgrid.streaming import stateful as S

SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream with event time ``time``."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("time", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into files, and return what it wrote."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    with S.rocks(spark):
        job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/out")
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def once(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Of the events with one key only the first within the watermark."""
    return events.withWatermark("time", delay).dropDuplicatesWithinWatermark(keys)


def counts(events: DataFrame, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """Events by window and type."""
    window = F.window("time", size, slide) if slide else F.window("time", size)
    rows = events.withWatermark("time", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Runs of a key's events without a gap: key, start, end, n."""
    rows = events.withWatermark("time", delay).groupBy(F.session_window("time", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _by_user(events: DataFrame, columns: list[str], processor: S.Keyed, output: str, delay: str, block: int) -> DataFrame:
    """Users' events through a processor, ``block`` numbers of users in one state. Start the stream within ``stateful.rocks``."""
    rows = events.withWatermark("time", delay).select(F.floor(F.col("user_id") / block).alias("block"), "user_id", "time", F.unix_micros("time").alias("us"), *columns)
    return rows.groupBy("block").transformWithStateInPandas(processor, output, "Append", "EventTime")


def coalesced(events: DataFrame, delay: str = "1 day", forget_us: int = 30 * 86_400_000_000, block: int = 256) -> DataFrame:
    """Each micro-batch the latest event of every user seen in it, and every error; a user is forgotten ``forget_us`` after the last event."""
    return _by_user(events, ["event_id", "event_type"], S.Latest(forget_us, "error"), "user_id long, event_id long, event_type string", delay, block)


def expired(events: DataFrame, idle_us: int, delay: str = "1 day", block: int = 256) -> DataFrame:
    """user_id, expired_us: times at which a user's lease ran out, by a timer in event time: a user who never comes back is seen as well.

    Heartbeats wait in the state until the watermark has passed them, so they may come in any order within ``delay``.
    """
    return _by_user(events, [], S.Leases(idle_us), "user_id long, expired_us long", delay, block)


def recovered(events: DataFrame, delay: str = "1 day", forget_us: int = 365 * 86_400_000_000, block: int = 256) -> DataFrame:
    """event_id, recovered_by: errors closed by the user's next purchase in event time, at most ``forget_us`` later.

    Events wait in the state until the watermark has passed them; errors leave it when they are closed or ``forget_us`` old.
    """
    return _by_user(events, ["event_id", "event_type"], S.Recoveries("error", "purchase", forget_us), "event_id long, recovered_by long", delay, block)


def fused(scores: DataFrame, models: list[int], classes: int, side: int = 16) -> DataFrame:
    """x, y, sums (of the models' probabilities by class) of every pixel, once when the last model's row has come.

    ``scores``: x, y, model_id, probs. State is kept by block of ``side`` times ``side`` pixels. A repeated row changes nothing, whichever
    model it is of, and however late. Models not listed are ignored. Start the stream within ``stateful.rocks``.
    """
    rows = scores.select(F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"), "x", "y", "model_id", "probs")
    return rows.groupBy("bx", "by").transformWithStateInPandas(S.Fusion(models, side, classes), "x long, y long, sums array<double>", "Append", "None")


def ready_units(reports: DataFrame, dependencies: DataFrame, block: int = 256) -> DataFrame:
    """unit_id of every unit, once when all artifacts that it needs have reported.

    ``reports``: artifact_id, as a stream; ``dependencies``: unit_id, artifact_id. Repeated reports and dependencies change
    nothing. Units without dependencies are never reported. State is kept by ``block`` numbers of units. Start the stream within ``stateful.rocks``.
    """
    pairs = dependencies.select("unit_id", "artifact_id").distinct()
    needs = pairs.join(pairs.groupBy("unit_id").agg(F.collect_list("artifact_id").alias("needs")), "unit_id")  # one unit's dependencies
    rows = reports.select("artifact_id").join(needs, "artifact_id").withColumn("block", F.floor(F.col("unit_id") / block))
    return rows.groupBy("block").transformWithStateInPandas(S.Readiness(), "unit_id long", "Append", "None")
