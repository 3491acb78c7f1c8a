"""Streaming queries over the event feed; the SQL is each one's batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.operators.probabilities import CLASSES
from loamgrid.plans.fixtures import Tables, oracle
from loamgrid.registry import query
from loamgrid.sources.shards import new_folder
from loamgrid.streaming import events as E
from loamgrid.streaming.stateful import rocks

#: Events with one key of a day lie within it.
DELAY = "2 days"


@query("stream_dedupe", oracle("", "SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY user_id, event_type"))
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each user, type and day, counted."""
    rows = E.feed(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return E.drained(E.once(rows, ["user_id", "event_type", "day"], DELAY), "dedupe").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_counts", oracle("", "SELECT event_type, count(*) AS n, count(DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT)) AS windows FROM events GROUP BY event_type"))
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts; those of the last hours are flushed by one late mark far ahead."""
    return _flushed(spark, sf_dir, lambda rows: E.counts(rows, "0 seconds", "1 hour")).groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("windows"))


def _flushed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """A watermarked stream over the events and, in a later micro-batch, a mark that closes every window."""
    source = new_folder(spark, "feed")
    rows = Tables(spark, sf_dir).events.select("event_id", F.col("ts").cast("timestamp").alias("time"), "user_id", "event_type")
    rows.write.parquet(source)
    mark = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp").alias("time"), F.lit(-1).cast("long").alias("user_id"), F.lit("mark").alias("event_type"))
    out = new_folder(spark, "windows")

    def run() -> None:
        stream = make(spark.readStream.schema(rows.schema).parquet(source))
        with rocks(spark):
            job = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/out")
        job.awaitTermination()

    run()
    mark.write.mode("append").parquet(source)
    run()
    return spark.read.parquet(f"{out}/out")


@query("stream_sessions", oracle("", """
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) AS f) AS g GROUP BY user_id, s) AS h GROUP BY user_id"""))
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flushed(spark, sf_dir, lambda s: E.sessions(s, "user_id", "6 hours", "0 seconds")).where("user_id >= 0")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("stream_coalesce", oracle("", """
SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' UNION SELECT arg_max(event_id, (ts, event_id)), user_id, arg_max(event_type, (ts, event_id)) FROM events GROUP BY user_id"""))
def stream_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drained(E.coalesced(E.feed(spark, sf_dir)), "coalesce").select("event_id", "user_id", "event_type").distinct()


@query("stream_lease_expiry", oracle("", """
SELECT user_id, CAST(epoch_us(before) + 43200000000 AS BIGINT) AS expired_us FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) AS e WHERE epoch_us(ts) - epoch_us(before) > 43200000000
UNION ALL SELECT user_id, CAST(epoch_us(max(ts)) + 43200000000 AS BIGINT) FROM events GROUP BY user_id"""))
def stream_lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired leases, the last one of each user among them: a late mark moves the watermark past all."""
    return _flushed(spark, sf_dir, lambda rows: E.expired(rows, 43_200_000_000)).where("user_id >= 0")


@query("stream_recovery", oracle("", """
SELECT event_id, recovered_by FROM (SELECT event_id, event_type, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS recovered_by FROM events) AS e
WHERE event_type = 'error' AND recovered_by IS NOT NULL"""))
def stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flushed(spark, sf_dir, E.recovered)


@query("stream_fusion", oracle("scores", "SELECT x, y, class_index, round(avg(p), 6) AS p FROM scores GROUP BY x, y, class_index"))
def stream_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' mean probabilities of each pixel as its last model arrives; every row of the first model comes twice."""
    source = new_folder(spark, "scores")
    scores = Tables(spark, sf_dir).scores.select("x", "y", F.col("model_id").cast("int"), "probs")
    scores.unionByName(scores.where("model_id = 0")).write.partitionBy("model_id").parquet(source)
    stream = spark.readStream.schema("x LONG, y LONG, probs ARRAY<DOUBLE>, model_id INT").parquet(source)
    rows = E.drained(E.fused(stream, [0, 1, 2], CLASSES), "fused")
    means = rows.select("x", "y", F.posexplode("sums").alias("class_index", "p"))
    return means.withColumn("p", F.round(F.col("p") / 3, 6))


@query("stream_ready_units", oracle("artifacts artifact_dependencies", """
SELECT job_id AS unit_id, count(*) AS needed FROM artifact_dependencies JOIN artifacts USING (artifact_id) GROUP BY job_id HAVING count(*) = count(*) FILTER (status = 'ready')"""))
def stream_ready_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units all of whose dependencies have reported, as reports stream in; every third artifact reports twice."""
    t = Tables(spark, sf_dir)
    source = new_folder(spark, "reports")
    ready = t.artifacts.where("status = 'ready'").select("artifact_id")
    ready.unionByName(ready.where("artifact_id % 3 = 0")).write.parquet(source)
    need = t.artifact_dependencies.select(F.col("job_id").alias("unit_id"), "artifact_id")
    units = E.drained(E.ready_units(spark.readStream.schema("artifact_id LONG").parquet(source), need), "ready")
    return units.join(need.groupBy("unit_id").agg(F.count("*").alias("needed")), "unit_id")
