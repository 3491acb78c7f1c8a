"""Queries over run state: jobs, artifacts, events, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.operators import acceptance
from loamgrid.operators import relational as R
from loamgrid.plans.fixtures import Tables, oracle
from loamgrid.registry import query

STATUSES = ("ready", "running", "queued", "failed", "interrupted")
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)


@query("job_status_counts", oracle("jobs", f"SELECT run_id, job_type, count(*) AS total, {_COUNTS} FROM jobs GROUP BY run_id, job_type"))
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_counts(Tables(spark, sf_dir).jobs, ["run_id", "job_type"], STATUSES)


_DONE = "sum(CASE WHEN status = 'ready' THEN 1.0 WHEN status = 'running' THEN least(1.0, progress_current / progress_total) ELSE 0.0 END)"


@query("job_progress", oracle("jobs", f"SELECT run_id, job_type, count(*) AS total, round({_DONE}, 6) AS completed FROM jobs GROUP BY run_id, job_type"))
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready jobs count one, running ones their fraction."""
    return _progress(Tables(spark, sf_dir).jobs, "run_id", "job_type").withColumn("completed", F.round("completed", 6))


def _progress(jobs: DataFrame, *by: str) -> DataFrame:
    done = F.when(F.col("status") == "ready", 1.0).when(F.col("status") == "running", F.least(F.lit(1.0), F.col("progress_current") / F.col("progress_total"))).otherwise(0.0)
    return jobs.groupBy(*by).agg(F.count("*").alias("total"), F.sum(done).alias("completed"))


@query("overall_completion", oracle("jobs", f"SELECT run_id, count(*) AS groups, round(avg(done / total), 6) AS fraction FROM (SELECT run_id, job_type, count(*) AS total, {_DONE} AS done FROM jobs GROUP BY 1, 2) AS g GROUP BY run_id"))
def overall_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean completion over the planned job groups of each run."""
    groups = _progress(Tables(spark, sf_dir).jobs, "run_id", "job_type")
    return groups.groupBy("run_id").agg(F.count("*").alias("groups"), F.round(F.avg(F.col("completed") / F.col("total")), 6).alias("fraction"))


_PHASE = """CASE WHEN failed_packages > 0 THEN 'package_failed' WHEN active_packages > 0 THEN 'packages' WHEN active_units > 0 THEN 'units'
  WHEN failed_units > 0 THEN 'unit_failed' WHEN ready_units = total_units THEN 'acceptance' ELSE 'finalize' END"""
_PHASE_COUNTS = """
  count_if(job_type = 'score' AND status = 'failed') AS failed_packages, count_if(job_type = 'score' AND status IN ('running', 'queued', 'interrupted')) AS active_packages,
  count_if(job_type <> 'score' AND status IN ('running', 'queued', 'interrupted')) AS active_units, count_if(job_type <> 'score' AND status = 'failed') AS failed_units,
  count_if(job_type <> 'score' AND status = 'ready') AS ready_units, count_if(job_type <> 'score') AS total_units"""


@query("run_phase", oracle("jobs", f"SELECT object_id, {_PHASE} AS phase FROM (SELECT object_id, {_PHASE_COUNTS} FROM jobs GROUP BY object_id) AS c"))
def run_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase of each object's run from conditional counts, by the first rule that holds."""
    counts = Tables(spark, sf_dir).jobs.groupBy("object_id").agg(
        *[F.count_if(F.expr(c)).alias(n) for n, c in (
            ("failed_packages", "job_type = 'score' and status = 'failed'"),
            ("active_packages", "job_type = 'score' and status in ('running', 'queued', 'interrupted')"),
            ("active_units", "job_type <> 'score' and status in ('running', 'queued', 'interrupted')"),
            ("failed_units", "job_type <> 'score' and status = 'failed'"),
            ("ready_units", "job_type <> 'score' and status = 'ready'"),
            ("total_units", "job_type <> 'score'"),
        )]
    )
    rules = F.when(F.col("failed_packages") > 0, "package_failed").when(F.col("active_packages") > 0, "packages").when(F.col("active_units") > 0, "units")
    rules = rules.when(F.col("failed_units") > 0, "unit_failed").when(F.col("ready_units") == F.col("total_units"), "acceptance").otherwise("finalize")
    return counts.select("object_id", rules.alias("phase"))


@query("retry_count", oracle("jobs", "SELECT run_id, CAST(sum(greatest(attempt - 1, 0)) AS BIGINT) AS retries, count(*) AS jobs FROM jobs GROUP BY run_id"))
def retry_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).jobs.groupBy("run_id").agg(F.sum(F.greatest(F.col("attempt") - 1, F.lit(0))).alias("retries"), F.count("*").alias("jobs"))


@query("expired_leases", oracle("jobs", "SELECT job_id, 'interrupted' AS status, CAST(greatest(0, attempt - 1) AS INT) AS attempt FROM jobs WHERE status = 'running' AND lease_expires < 500"))
def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose lease is over: interrupted, the attempt given back."""
    gone = Tables(spark, sf_dir).jobs.where("status = 'running' and lease_expires < 500")
    return gone.select("job_id", F.lit("interrupted").alias("status"), F.greatest(F.lit(0), F.col("attempt") - 1).alias("attempt"))


@query("failure_summary", oracle("jobs", """
SELECT run_id, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'running', 'interrupted')) AS pending, count(*) FILTER (status = 'ready') AS completed,
  list_sort(list(DISTINCT stream_id) FILTER (status = 'failed')) AS failed_streams FROM jobs GROUP BY run_id"""))
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("status") == "failed"
    return Tables(spark, sf_dir).jobs.groupBy("run_id").agg(
        F.count_if(failed).alias("failed"), F.count_if(F.col("status").isin("queued", "running", "interrupted")).alias("pending"), F.count_if(F.col("status") == "ready").alias("completed"),
        F.sort_array(F.collect_set(F.when(failed, F.col("stream_id")))).alias("failed_streams"),
    )


@query("runnable_jobs", oracle("jobs artifacts artifact_dependencies", """
SELECT job_id, job_type, attempt FROM jobs AS j WHERE status IN ('queued', 'interrupted') AND attempt < max_attempts
  AND NOT EXISTS (SELECT 1 FROM artifact_dependencies AS d WHERE d.job_id = j.job_id AND d.artifact_id NOT IN (SELECT artifact_id FROM artifacts WHERE status = 'ready'))
  AND NOT EXISTS (SELECT 1 FROM (VALUES ('fuse', 'mask'), ('assemble', 'shard')) AS r(job_type, kind) WHERE r.job_type = j.job_type
    AND NOT EXISTS (SELECT 1 FROM artifact_dependencies AS d JOIN artifacts AS a USING (artifact_id) WHERE d.job_id = j.job_id AND a.status = 'ready' AND a.kind = r.kind))"""))
def runnable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion needs a mask, assembly a shard, beside what each job depends on."""
    t = Tables(spark, sf_dir)
    required = spark.createDataFrame([("fuse", "mask"), ("assemble", "shard")], "job_type string, kind string")
    return R.runnable(t.jobs, t.artifact_dependencies, t.artifacts, required).select("job_id", "job_type", "attempt")


@query("reset_closure", oracle("jobs artifact_dependencies", """
WITH seed AS (SELECT job_id FROM jobs WHERE status = 'failed' AND job_type = 'score'),
touched AS (SELECT DISTINCT artifact_id FROM artifact_dependencies JOIN seed USING (job_id)),
reset AS (SELECT job_id FROM seed UNION SELECT job_id FROM artifact_dependencies JOIN touched USING (artifact_id) JOIN jobs USING (job_id) WHERE job_type IN ('fit', 'assemble'))
SELECT job_id, job_type, status FROM jobs JOIN reset USING (job_id)"""))
def reset_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed package jobs and all downstream jobs that share an artifact with one."""
    t = Tables(spark, sf_dir)
    seed = t.jobs.where("status = 'failed' and job_type = 'score'").select("job_id")
    touched = t.artifact_dependencies.join(seed, "job_id").select("artifact_id").distinct()
    later = t.jobs.where("job_type in ('fit', 'assemble')").select("job_id")
    reset = seed.union(t.artifact_dependencies.join(touched, "artifact_id").join(later, "job_id").select("job_id")).distinct()
    return t.jobs.join(reset, "job_id", "left_semi").select("job_id", "job_type", "status")


@query("open_frontier", oracle("jobs artifacts artifact_dependencies", """
SELECT job_id, count(*) AS needed, count(*) FILTER (status = 'ready') AS ready, list_sort(list(artifact_id) FILTER (status IS DISTINCT FROM 'ready')) AS run_next
FROM artifact_dependencies LEFT JOIN artifacts USING (artifact_id) GROUP BY job_id HAVING count(*) FILTER (status = 'ready') BETWEEN 1 AND count(*) - 1"""))
def open_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of which some dependencies are ready, but not all, and those to run next to complete them."""
    t = Tables(spark, sf_dir)
    ready = F.coalesce(F.col("status") == "ready", F.lit(False))
    both = t.artifact_dependencies.join(t.artifacts, "artifact_id", "left").groupBy("job_id")
    counts = both.agg(F.count("*").alias("needed"), F.count_if(ready).alias("ready"), F.sort_array(F.collect_list(F.when(~ready, F.col("artifact_id")))).alias("run_next"))
    return counts.where("ready > 0 and ready < needed")


@query("artifact_refcount", oracle("artifacts artifact_dependencies", "SELECT artifact_id, count(job_id) AS ref_count FROM artifacts LEFT JOIN artifact_dependencies USING (artifact_id) GROUP BY artifact_id"))
def artifact_refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    counts = t.artifact_dependencies.groupBy("artifact_id").agg(F.count("*").alias("n"))
    return t.artifacts.join(counts, "artifact_id", "left").select("artifact_id", F.coalesce("n", F.lit(0)).alias("ref_count"))


@query("artifact_bytes", oracle("artifacts", "SELECT kind, status, count(*) AS artifacts, CAST(sum(byte_count) AS BIGINT) AS bytes FROM artifacts GROUP BY CUBE (kind, status)"))
def artifact_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).artifacts.cube("kind", "status").agg(F.count("*").alias("artifacts"), F.sum("byte_count").alias("bytes"))


@query("cleanup_candidates", oracle("artifacts artifact_dependencies", """
SELECT artifact_id, kind, byte_count FROM artifacts WHERE status = 'ready' AND kind IN ('cache', 'shard') AND artifact_id NOT IN (SELECT artifact_id FROM artifact_dependencies)
ORDER BY artifact_id LIMIT 100"""))
def cleanup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred ready artifacts of temporary kinds that nothing refers to."""
    t = Tables(spark, sf_dir)
    free = t.artifacts.where("status = 'ready' and kind in ('cache', 'shard')").join(t.artifact_dependencies, "artifact_id", "left_anti")
    return free.select("artifact_id", "kind", "byte_count").orderBy("artifact_id").limit(100)


@query("reusable_outputs", oracle("artifacts", """
SELECT run_id, kind, count(*) AS expected, bool_and(status = 'ready') AS reusable FROM artifacts GROUP BY run_id, kind"""))
def reusable_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's outputs are reused only if every one is valid."""
    return Tables(spark, sf_dir).artifacts.groupBy("run_id", "kind").agg(F.count("*").alias("expected"), F.bool_and(F.col("status") == "ready").alias("reusable"))


@query("unit_report_summary", oracle("unit_reports", """
SELECT stream_id, CAST(sum(chain_count) AS BIGINT) AS chains, CAST(sum(spline_count) AS BIGINT) AS splines, round(max(max_displacement_px), 6) AS max_displacement_px, count(*) FILTER (status = 'failed') AS failed
FROM unit_reports GROUP BY stream_id"""))
def unit_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).unit_reports.groupBy("stream_id").agg(
        F.sum("chain_count").alias("chains"), F.sum("spline_count").alias("splines"), F.round(F.max("max_displacement_px"), 6).alias("max_displacement_px"), F.count_if(F.col("status") == "failed").alias("failed")
    )


@query("edge_metrics", oracle("unit_reports", "SELECT stream_id, count(*) AS shards, count(DISTINCT unit_id) AS units, CAST(max(chain_count) AS BIGINT) AS most_chains FROM unit_reports WHERE status = 'ready' GROUP BY stream_id"))
def edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).unit_reports.where("status = 'ready'")
    return rows.groupBy("stream_id").agg(F.count("*").alias("shards"), F.countDistinct("unit_id").alias("units"), F.max("chain_count").alias("most_chains"))


@query("entity_counts", oracle("jobs artifacts tiles", """
SELECT 'jobs' AS entity, count(*) AS n FROM jobs UNION ALL SELECT 'artifacts', count(*) FROM artifacts UNION ALL SELECT 'tiles', count(*) FROM tiles"""))
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    parts = [getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("entity"), "n") for n in ("jobs", "artifacts", "tiles")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_KINDS = ("score", "fuse", "fit", "assemble")
_GATES = ["all_jobs_ready", *(f"all_{k}_jobs_ready" for k in _KINDS), "all_jobs_present", "all_streams_present", "all_streams_ready", "attempts_bounded", "all_caches_cleaned", "no_artifact_integrity_errors", "peak_cache_within_budget", "no_error_events"]
_BUDGET = 50_000_000


@query("acceptance_gates", oracle("jobs artifacts monitor_events", f"""
WITH want AS (SELECT o_custkey % 5 AS run_id, count(DISTINCT o_orderkey) AS jobs, count(DISTINCT o_orderkey % 50) AS streams FROM orders GROUP BY 1),
j AS (SELECT run_id, count(*) AS jobs, count(*) FILTER (status = 'ready') AS ready, max(attempt) AS most, {", ".join(f"count(*) FILTER (job_type = '{k}') AS n_{k}, count(*) FILTER (job_type = '{k}' AND status = 'ready') AS r_{k}" for k in _KINDS)} FROM jobs GROUP BY 1),
s AS (SELECT run_id, count(*) AS streams, count(*) FILTER (ready) AS ready_streams FROM (SELECT run_id, stream_id, bool_and(status = 'ready') AS ready FROM jobs GROUP BY 1, 2) AS x GROUP BY 1),
a AS (SELECT run_id, count(*) FILTER (kind = 'cache') AS caches, count(*) FILTER (kind = 'cache' AND status = 'cleaned') AS cleaned, count(*) FILTER (status = 'ready' AND byte_count <= 0) AS broken, sum(CASE WHEN kind = 'cache' AND status <> 'cleaned' THEN byte_count ELSE 0 END) AS cache_bytes FROM artifacts GROUP BY 1),
e AS (SELECT run_id, count(*) FILTER (level = 'error') AS errors FROM monitor_events GROUP BY 1),
facts AS (SELECT w.run_id, coalesce(j.ready = w.jobs, FALSE) AS all_jobs_ready, {", ".join(f"coalesce(n_{k} > 0 AND r_{k} = n_{k}, FALSE) AS all_{k}_jobs_ready" for k in _KINDS)}, coalesce(j.jobs = w.jobs, FALSE) AS all_jobs_present, coalesce(s.streams = w.streams, FALSE) AS all_streams_present,
  coalesce(s.ready_streams = w.streams, FALSE) AS all_streams_ready, coalesce(most <= 5, FALSE) AS attempts_bounded, coalesce(cleaned = caches, FALSE) AS all_caches_cleaned, coalesce(broken, 0) = 0 AS no_artifact_integrity_errors, coalesce(cache_bytes, 0) <= {_BUDGET} AS peak_cache_within_budget, coalesce(errors, 0) = 0 AS no_error_events
  FROM want AS w LEFT JOIN j USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN a USING (run_id) LEFT JOIN e USING (run_id)),
gates AS (UNPIVOT facts ON {", ".join(_GATES)} INTO NAME gate VALUE passed)
SELECT run_id, gate, passed, bool_and(passed) OVER (PARTITION BY run_id) AS accepted FROM gates"""))
def acceptance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual jobs, streams, artifacts and events of each run: every gate as a row, with the overall verdict."""
    t = Tables(spark, sf_dir)
    want = t.orders.groupBy((F.col("o_custkey") % 5).alias("run_id")).agg(F.countDistinct("o_orderkey").alias("want_jobs"), F.countDistinct(F.col("o_orderkey") % 50).alias("want_streams"))
    ready, kind = F.col("status") == "ready", lambda k: F.col("job_type") == k
    counts = [c for k in _KINDS for c in (F.count_if(kind(k)).alias(f"n_{k}"), F.count_if(kind(k) & ready).alias(f"r_{k}"))]
    jobs = t.jobs.groupBy("run_id").agg(F.count("*").alias("jobs"), F.count_if(ready).alias("ready"), F.max("attempt").alias("most"), *counts)
    streams = t.jobs.groupBy("run_id", "stream_id").agg(F.bool_and(ready).alias("whole")).groupBy("run_id").agg(F.count("*").alias("streams"), F.count_if("whole").alias("ready_streams"))
    cache, cleaned = F.col("kind") == "cache", F.col("status") == "cleaned"
    artifacts = t.artifacts.groupBy("run_id").agg(F.count_if(cache).alias("caches"), F.count_if(cache & cleaned).alias("cleaned"), F.count_if(ready & (F.col("byte_count") <= 0)).alias("broken"), F.sum(F.when(cache & ~cleaned, F.col("byte_count")).otherwise(0)).alias("cache_bytes"))
    events = t.monitor_events.groupBy("run_id").agg(F.count_if(F.col("level") == "error").alias("errors"))
    both = want
    for part in (jobs, streams, artifacts, events):
        both = both.join(part, "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    gates = {"all_jobs_ready": F.col("ready") == F.col("want_jobs"), **{f"all_{k}_jobs_ready": (F.col(f"n_{k}") > 0) & (F.col(f"r_{k}") == F.col(f"n_{k}")) for k in _KINDS}}
    gates |= {"all_jobs_present": F.col("jobs") == F.col("want_jobs"), "all_streams_present": F.col("streams") == F.col("want_streams"), "all_streams_ready": F.col("ready_streams") == F.col("want_streams"), "attempts_bounded": F.col("most") <= 5}
    gates |= {"all_caches_cleaned": F.col("cleaned") == F.col("caches"), "no_artifact_integrity_errors": zero("broken") == 0, "peak_cache_within_budget": zero("cache_bytes") <= _BUDGET, "no_error_events": zero("errors") == 0}
    facts = both.select("run_id", *(F.coalesce(gates[g], F.lit(False)).alias(g) for g in _GATES))
    rows = facts.unpivot("run_id", _GATES, "gate", "passed")
    return rows.withColumn("accepted", F.bool_and("passed").over(W.partitionBy("run_id")))


#: A run's parts by rule, over slots of its orders: 4 packages, 12 units of streams, 6 and 6 jobs of the two further kinds.
_PARTS_OF_A_RUN = {
    "slots": "SELECT o_custkey % 40 AS run_id, o_orderkey % 28 AS slot, max(o_orderkey) AS k FROM {orders} GROUP BY 1, 2",
    "plan": "SELECT DISTINCT run_id, 2 AS streams, 6 AS units, 4 AS packages, 5 AS partitions, run_id % 2 = 0 AS v33, run_id % 3 = 0 AS confidence, 1 + run_id % 2 AS storage_schema, 1070 AS cache_budget, 2170 AS managed_budget FROM {slots}",
    "run_jobs": "SELECT run_id, CASE WHEN slot < 4 THEN 'work_package' WHEN slot < 16 THEN 'unit_fit' WHEN slot < 22 THEN 'fragmentation_v33' ELSE 'unit_confidence' END AS job_type, CASE WHEN k % 101 = 0 THEN 'failed' ELSE 'ready' END AS status FROM {slots} WHERE slot < 16 OR (slot < 22 AND run_id % 2 = 0) OR (slot >= 22 AND run_id % 3 = 0)",
    "run_streams": "SELECT run_id, slot AS stream_id, CASE WHEN k % 23 = 0 THEN 'running' ELSE 'ready' END AS status FROM {slots} WHERE slot < 2",
    "run_packages": "SELECT run_id, slot AS package_id, CASE WHEN k % 31 = 0 THEN 'running' ELSE 'ready' END AS status FROM {slots} WHERE slot < 4",
    "run_units": "SELECT run_id, slot % 2 AS stream_id, CASE WHEN k % 89 = 0 THEN 'failed' ELSE 'ready' END AS status FROM {slots} WHERE slot BETWEEN 4 AND 15",
    "run_reports": "SELECT run_id, slot, k % 3 AS fitted_edges, k % 97 <> 0 AS passed FROM {slots} WHERE slot BETWEEN 4 AND 15 AND k % 83 <> 0",
    "run_storage": "SELECT run_id, 1000 + k % 75 AS peak_cache, 2000 + k % 180 AS managed, k % 61 <> 0 AS complete FROM {slots} WHERE slot < 4 AND k % 59 <> 0",
    "run_files": "SELECT run_id, kind, CASE WHEN (slot * 7 + run_id) % 71 = 0 THEN 'ready' ELSE 'cleaned' END AS status, (slot * 3 + run_id) % 37 = 0 AS broken FROM {run_reports} CROSS JOIN (VALUES ('unit_raw_geoparquet'), ('unit_formal_geoparquet'), ('unit_boundary_report'), ('unit_fitted_edges_geoparquet'), ('unit_boundary_signatures')) AS v(kind) WHERE kind <> 'unit_fitted_edges_geoparquet' OR fitted_edges > 0",
}
_COUNTED = {k: f"n_{k} = {n} AND r_{k} = {n}" for k, n in (("work_package", "packages"), ("fragmentation_v33", "v33_jobs"), ("unit_confidence", "confidence_jobs"), ("unit_fit", "reports"))}


@query("scale_acceptance", oracle("", f"""WITH {", ".join(f"{n} AS MATERIALIZED ({q.replace('{', '').replace('}', '')})" for n, q in _PARTS_OF_A_RUN.items())},
p AS (SELECT *, units * streams AS reports, CASE WHEN v33 THEN partitions + 1 ELSE 0 END AS v33_jobs, CASE WHEN confidence THEN units ELSE 0 END AS confidence_jobs FROM plan),
j AS (SELECT run_id, count(*) AS n_jobs, count(*) FILTER (status = 'ready') AS r_jobs, {", ".join(f"count(*) FILTER (job_type = '{k}') AS n_{k}, count(*) FILTER (job_type = '{k}' AND status = 'ready') AS r_{k}" for k in _COUNTED)} FROM run_jobs GROUP BY 1),
f AS (SELECT p.*, j.* EXCLUDE (run_id), (SELECT count(*) FROM run_streams AS x WHERE x.run_id = p.run_id) AS n_streams, (SELECT count(*) FROM run_streams AS x WHERE x.run_id = p.run_id AND status = 'ready') AS r_streams,
  (SELECT count(*) FROM run_packages AS x WHERE x.run_id = p.run_id) AS n_packages, (SELECT count(*) FROM run_packages AS x WHERE x.run_id = p.run_id AND status = 'ready') AS r_packages,
  (SELECT count(*) FROM (SELECT stream_id FROM run_units AS x WHERE x.run_id = p.run_id GROUP BY stream_id HAVING count(*) = 6 AND count(*) FILTER (status = 'ready') = 6) AS y) AS whole_streams, (SELECT count(DISTINCT stream_id) FROM run_units AS x WHERE x.run_id = p.run_id) AS unit_streams,
  (SELECT count(*) FROM run_reports AS x WHERE x.run_id = p.run_id) AS n_reports, (SELECT count(*) FROM run_reports AS x WHERE x.run_id = p.run_id AND fitted_edges > 0) AS n_fitted, (SELECT count(*) FROM run_reports AS x WHERE x.run_id = p.run_id AND NOT passed) AS n_failed,
  (SELECT count(*) FROM run_storage AS x WHERE x.run_id = p.run_id) AS n_storage, (SELECT count(*) FROM run_storage AS x WHERE x.run_id = p.run_id AND NOT complete) AS n_incomplete, (SELECT max(peak_cache) FROM run_storage AS x WHERE x.run_id = p.run_id) AS peak_cache, (SELECT max(managed) FROM run_storage AS x WHERE x.run_id = p.run_id) AS managed,
  (SELECT count(*) FROM run_files AS x WHERE x.run_id = p.run_id) AS n_files, (SELECT count(*) FROM run_files AS x WHERE x.run_id = p.run_id AND status = 'cleaned') AS n_cleaned, (SELECT count(*) FROM run_files AS x WHERE x.run_id = p.run_id AND broken) AS n_broken FROM p JOIN j USING (run_id)),
facts AS (SELECT run_id, n_storage = packages AS all_package_reports_present, n_reports = reports AS all_unit_reports_present, n_files = 4 * reports + n_fitted AND n_cleaned = n_files AS all_unit_intermediates_cleaned, n_packages = packages AND r_packages = packages AS all_work_packages_ready,
  {_COUNTED['work_package']} AS all_work_package_jobs_ready, {_COUNTED['fragmentation_v33']} AS all_v33_jobs_ready, {_COUNTED['unit_confidence']} AS all_unit_confidence_jobs_ready, {_COUNTED['unit_fit']} AS all_unit_jobs_ready,
  n_jobs = packages + reports + v33_jobs + confidence_jobs AND r_jobs = n_jobs AS all_jobs_ready, n_streams = streams AND r_streams = streams AS all_streams_ready, whole_streams = streams AND unit_streams = streams AS all_stream_units_ready, n_broken = 0 AS no_artifact_integrity_errors, n_failed = 0 AS all_boundary_units_passed,
  storage_schema < 2 OR (n_storage = packages AND n_incomplete = 0 AND peak_cache <= cache_budget) AS peak_cache_within_frozen_budget, storage_schema < 2 OR (n_storage = packages AND n_incomplete = 0) AS all_package_storage_metrics_present,
  storage_schema < 2 OR (n_storage = packages AND n_incomplete = 0 AND managed <= managed_budget) AS peak_package_managed_within_frozen_budget FROM f),
gates AS (UNPIVOT facts ON {", ".join(acceptance.GATES)} INTO NAME gate VALUE passed)
SELECT run_id, gate, passed, bool_and(passed) OVER (PARTITION BY run_id) AS accepted FROM gates"""))
def scale_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates of every run: reports, intermediates, packages, jobs of each kind, streams, units, integrity, and the storage budgets."""
    known = {"orders": Tables(spark, sf_dir).orders}
    for name, text in _PARTS_OF_A_RUN.items():
        known[name] = spark.sql(text, **{k: v for k, v in known.items() if "{" + k + "}" in text})
    return acceptance.gates(*(known[n] for n in ("plan", "run_jobs", "run_streams", "run_packages", "run_units", "run_reports", "run_storage", "run_files")))


@query("log_gap", oracle("monitor_events", """
SELECT run_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS elapsed_us, CAST(max(gap) AS BIGINT) AS longest_gap_us
FROM (SELECT run_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id)) AS gap FROM monitor_events) AS g GROUP BY run_id"""))
def log_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed time and longest silent gap of each run's log."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = Tables(spark, sf_dir).monitor_events.select("run_id", "event_id", us.alias("us"))
    rows = rows.withColumn("gap", F.col("us") - F.lag("us").over(W.partitionBy("run_id").orderBy("us", "event_id")))
    return rows.groupBy("run_id").agg((F.max("us") - F.min("us")).alias("elapsed_us"), F.max("gap").alias("longest_gap_us"))


@query("storage_peaks", oracle("unit_reports", """
SELECT status, CAST(max(total) AS BIGINT) AS peak, count(*) AS samples FROM (SELECT reported_at, status, sum(chain_count) AS total FROM unit_reports GROUP BY 1, 2) AS s GROUP BY status"""))
def storage_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest sum of a sample, by status."""
    samples = Tables(spark, sf_dir).unit_reports.groupBy("reported_at", "status").agg(F.sum("chain_count").alias("total"))
    return samples.groupBy("status").agg(F.max("total").alias("peak"), F.count("*").alias("samples"))


@query("run_archive", oracle("jobs monitor_events", """
WITH active AS (SELECT DISTINCT run_id FROM jobs WHERE status = 'running' AND lease_expires >= 990 AND run_id < 2),
errors AS (SELECT run_id, list(event_id ORDER BY event_id DESC)[1:8] AS last_errors FROM monitor_events WHERE level = 'error' GROUP BY run_id)
SELECT j.run_id, j.jobs, j.failed, e.last_errors FROM (SELECT run_id, count(*) AS jobs, count(*) FILTER (status = 'failed') AS failed FROM jobs GROUP BY run_id) AS j
LEFT JOIN errors AS e USING (run_id) WHERE j.run_id NOT IN (SELECT run_id FROM active)"""))
def run_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and last eight errors of each run without an active lease."""
    t = Tables(spark, sf_dir)
    active = t.jobs.where("status = 'running' and lease_expires >= 990 and run_id < 2").select("run_id").distinct()
    counts = t.jobs.groupBy("run_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"))
    errors = R.latest(t.monitor_events.where("level = 'error'"), ["run_id"], [F.col("event_id").desc()], 8)
    errors = errors.groupBy("run_id").agg(F.sort_array(F.collect_list("event_id"), asc=False).alias("last_errors"))
    return counts.join(active, "run_id", "left_anti").join(errors, "run_id", "left")


@query("model_load_counts", oracle("monitor_events", """
SELECT run_id, stream_id, count(*) FILTER (event_type = 'view') AS loads, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'view') > count(*) FILTER (event_type = 'purchase') AS incomplete
FROM monitor_events GROUP BY run_id, stream_id"""))
def model_load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads, cache hits and whether some load never completed, by session and model."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return Tables(spark, sf_dir).monitor_events.groupBy("run_id", "stream_id").agg(n("view").alias("loads"), n("click").alias("hits"), (n("view") > n("purchase")).alias("incomplete"))


@query("progress_upsert", oracle("monitor_events", """
WITH c AS (SELECT *, coalesce(lag(event_type) OVER w <> event_type, true) AS fresh FROM monitor_events WINDOW w AS (PARTITION BY object_id ORDER BY ts, event_id)),
b AS (SELECT *, max(CASE WHEN fresh THEN ts END) OVER (PARTITION BY object_id ORDER BY ts, event_id) AS phase_started_at FROM c)
SELECT object_id, event_id, event_type, value, phase_started_at FROM b QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY ts DESC, event_id DESC) = 1"""))
def progress_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.upsert_progress(Tables(spark, sf_dir).monitor_events, "object_id", "event_type", ["ts", "event_id"])
    return rows.select("object_id", "event_id", "event_type", "value", "phase_started_at")


@query("event_append_idempotent", oracle("monitor_events", "SELECT run_id, idempotency_key, min(event_id) AS event_id FROM monitor_events GROUP BY run_id, idempotency_key"))
def event_append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.append_once(Tables(spark, sf_dir).monitor_events, ["run_id", "idempotency_key"], [F.col("event_id")])
    return rows.select("run_id", "idempotency_key", "event_id")


@query("recovered_events", oracle("monitor_events", """
SELECT f.event_id, min(s.event_id) AS recovered_by FROM monitor_events AS f LEFT JOIN LATERAL (
  SELECT event_id FROM monitor_events AS s WHERE s.object_id = f.object_id AND s.stream_id = f.stream_id AND s.event_type = 'purchase' AND (s.ts, s.event_id) > (f.ts, f.event_id) ORDER BY s.ts, s.event_id LIMIT 1) AS s ON true
WHERE f.event_type = 'error' GROUP BY f.event_id"""))
def recovered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the first later success of the same object and stream."""
    found = R.recoveries(Tables(spark, sf_dir).monitor_events, ["object_id", "stream_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return found.select("event_id", "recovered_by")


@query("event_scope", oracle("monitor_events", """
SELECT scope, level, count(*) AS events FROM (SELECT level, unnest(list_filter([CASE WHEN level IN ('error', 'warning') THEN 'issues' END, CASE WHEN level = 'warning' THEN 'warnings' END,
  CASE WHEN regexp_matches(event_type, '(purchase|signup)') THEN 'recovery' END], lambda s: s IS NOT NULL)) AS scope FROM monitor_events) AS s GROUP BY scope, level"""))
def event_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by scope; one event can be in several."""
    scopes = F.array_compact(F.array(F.when(F.col("level").isin("error", "warning"), "issues"), F.when(F.col("level") == "warning", "warnings"), F.when(F.col("event_type").rlike("(purchase|signup)"), "recovery")))
    return Tables(spark, sf_dir).monitor_events.select("level", F.explode(scopes).alias("scope")).groupBy("scope", "level").agg(F.count("*").alias("events"))


@query("event_filter", oracle("monitor_events", "SELECT event_id, level, stream_id FROM monitor_events WHERE level IN ('error', 'warning') AND stream_id = 3 AND run_id = 2"))
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level list and equality filters, each optional."""
    wanted = {"stream_id": 3, "run_id": 2, "object_id": None}
    rows = Tables(spark, sf_dir).monitor_events.where(F.col("level").isin("error", "warning"))
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.select("event_id", "level", "stream_id")


@query("search_escaped_like", oracle("", r"SELECT p_partkey, p_type || '_' || p_name AS label FROM part WHERE contains(p_type || '_' || p_name, 'Y_s')"))
def search_escaped_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).part.select("p_partkey", F.concat("p_type", F.lit("_"), "p_name").alias("label"))
    return rows.where(R.like_escaped(F.col("label"), "Y_s"))


@query("search_ilike", oracle("", "SELECT conv_id, turn FROM conversations WHERE text ILIKE '%THE%' OR role ILIKE '%THE%'"))
def search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).conversations.where(F.col("text").ilike("%THE%") | F.col("role").ilike("%THE%")).select("conv_id", "turn")


@query("latest_phase", oracle("monitor_events", """
SELECT stream_id, event_type, event_id FROM monitor_events WHERE run_id = 1 QUALIFY row_number() OVER (PARTITION BY stream_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""))
def latest_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.latest(Tables(spark, sf_dir).monitor_events.where("run_id = 1"), ["stream_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return rows.select("stream_id", "event_type", "event_id")


@query("latest_event", oracle("monitor_events", "SELECT stream_id, max(event_id) AS event_id, max_by(props, event_id) AS props FROM monitor_events GROUP BY stream_id"))
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).monitor_events.groupBy("stream_id").agg(F.max("event_id").alias("event_id"), F.max_by("props", "event_id").alias("props"))


@query("attempt_number", oracle("jobs", "SELECT job_id, object_id, CAST(row_number() OVER (PARTITION BY run_id, object_id ORDER BY updated_at, job_id) AS INT) AS attempt_no FROM jobs"))
def attempt_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).jobs.select("job_id", "object_id", F.row_number().over(W.partitionBy("run_id", "object_id").orderBy("updated_at", "job_id")).alias("attempt_no"))


#: Spans by rule: each hangs below one of about half or a quarter of its number; some have no parent, a few form cycles of two.
_SPANS = "SELECT o_orderkey AS span_id, CASE WHEN o_orderkey % 1013 = 7 THEN o_orderkey + 1 WHEN o_orderkey % 1013 = 8 THEN o_orderkey - 1 WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_orderkey / (2 + o_orderkey % 3)) AS BIGINT) END AS parent_id, o_custkey AS object_id, o_orderdate AS began, o_orderstatus AS status FROM {0}"


@query("span_lineage", oracle("", f"""
WITH RECURSIVE spans AS ({_SPANS.format('orders')}), up AS (SELECT s.span_id, p.span_id AS parent_id FROM spans AS s LEFT JOIN spans AS p ON p.span_id = s.parent_id),
walk AS (SELECT span_id, span_id AS root, 0 AS depth, CAST(span_id AS VARCHAR) AS path FROM up WHERE parent_id IS NULL UNION ALL SELECT u.span_id, w.root, depth + 1, path || '/' || u.span_id FROM walk AS w JOIN up AS u ON u.parent_id = w.span_id)
SELECT u.span_id, root, CAST(depth AS INT) AS depth, path, root IS NULL AS cyclic, CAST(row_number() OVER (PARTITION BY object_id ORDER BY began, u.span_id) AS INT) AS attempt_no,
  CAST(count(*) FILTER (status <> 'P') OVER (PARTITION BY object_id ORDER BY began, u.span_id ROWS UNBOUNDED PRECEDING) AS INT) AS budget_attempt FROM up AS u JOIN spans USING (span_id) LEFT JOIN walk AS w ON w.span_id = u.span_id"""))
def span_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and path of every span, cycles among them reported, and its attempts within its object, all and those that count."""
    spans = spark.sql(_SPANS.format("{orders}"), orders=Tables(spark, sf_dir).orders)
    found = R.lineage(spans).withColumn("path", F.array_join("path", "/"))
    attempts = R.budget_attempts(spans, ["object_id"], F.col("status") != "P", ["began", "span_id"])
    return found.join(attempts.select("span_id", "attempt_no", "budget_attempt"), "span_id")


@query("page_keyset", oracle("monitor_events", "SELECT event_id, event_type FROM monitor_events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 50"))
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyset_page(Tables(spark, sf_dir).monitor_events.select("event_id", "event_type"), ["event_id"], [900], 50)


@query("page_keyset_composite", oracle("jobs", "SELECT updated_at, job_id, status FROM jobs WHERE (updated_at, job_id) < (TIMESTAMP '1999-01-01', 700) ORDER BY updated_at DESC, job_id DESC LIMIT 40"))
def page_keyset_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyset_page(Tables(spark, sf_dir).jobs.select("updated_at", "job_id", "status"), ["updated_at", "job_id"], ["1999-01-01 00:00:00", 700], 40)


@query("page_offset", oracle("jobs", "SELECT job_id, status FROM jobs WHERE status = 'failed' ORDER BY job_id LIMIT 25 OFFSET 10"))
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).jobs.where("status = 'failed'").select("job_id", "status").orderBy("job_id").offset(10).limit(25)


@query("page_tiles", oracle("tiles", "SELECT tile_id, row_no, col_no, (SELECT count(*) FROM tiles WHERE status = 'ready') AS total FROM tiles WHERE status = 'ready' ORDER BY row_no, col_no LIMIT 30 OFFSET 5"))
def page_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = Tables(spark, sf_dir).tiles.where("status = 'ready'")
    total = ready.agg(F.count("*").alias("total"))
    return ready.select("tile_id", "row_no", "col_no").orderBy("row_no", "col_no").offset(5).limit(30).join(F.broadcast(total))


@query("page_objects", oracle("jobs artifacts artifact_dependencies", """
SELECT j.job_id, j.status, a.status AS artifact_status, coalesce(CASE WHEN j.status = 'failed' THEN 'job failed' END, CASE WHEN a.status = 'cleaned' THEN 'artifact cleaned' END, '') AS reason
FROM jobs AS j LEFT JOIN (SELECT job_id, min(artifact_id) AS artifact_id FROM artifact_dependencies GROUP BY job_id) AS d USING (job_id) LEFT JOIN artifacts AS a USING (artifact_id)
ORDER BY j.job_id LIMIT 100"""))
def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of jobs with the state of their first artifact and the first reason that applies."""
    t = Tables(spark, sf_dir)
    first = t.artifact_dependencies.groupBy("job_id").agg(F.min("artifact_id").alias("artifact_id"))
    rows = t.jobs.select("job_id", "status").join(first, "job_id", "left").join(t.artifacts.select("artifact_id", F.col("status").alias("artifact_status")), "artifact_id", "left")
    reason = F.coalesce(F.when(F.col("status") == "failed", "job failed"), F.when(F.col("artifact_status") == "cleaned", "artifact cleaned"), F.lit(""))
    return rows.select("job_id", "status", "artifact_status", reason.alias("reason")).orderBy("job_id").limit(100)


@query("topk_errors", oracle("monitor_events", "SELECT run_id, event_id FROM monitor_events WHERE level = 'error' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) <= 8"))
def topk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.latest(Tables(spark, sf_dir).monitor_events.where("level = 'error'"), ["run_id"], [F.col("ts").desc(), F.col("event_id").desc()], 8)
    return rows.select("run_id", "event_id")


@query("set_difference", oracle("", """
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 1)
SELECT id, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).alias("third"))
    return R.set_difference(orders.where("third = 0"), orders.where("third = 1"), "id")


@query("summary_artifact_match", oracle("", """
WITH s AS (SELECT o_orderkey AS id, o_totalprice AS size FROM orders WHERE o_orderkey % 11 <> 0), a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(s.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'no artifact' WHEN s.id IS NULL THEN 'no summary' ELSE 'size' END AS reason FROM s FULL JOIN a ON s.id = a.id WHERE s.id IS NULL OR a.id IS NULL OR s.size <> a.size"""))
def summary_artifact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and report artifacts that don't match, with the reason."""
    o = Tables(spark, sf_dir).orders
    s = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("size"))
    a = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("other"), F.lit(True).alias("held"))
    both = s.join(a, "id", "full")
    reason = F.when(F.col("held").isNull(), "no artifact").when(F.col("size").isNull(), "no summary").when(F.col("size") != F.col("other"), "size")
    return both.select("id", reason.alias("reason")).where("reason is not null")


@query("log_severity", oracle("log_lines", """
SELECT level, severity, count(*) AS lines FROM (SELECT level, CASE WHEN starts_with(low, 'error:') OR starts_with(low, 'fatal:') OR contains(low, 'fatal error') OR regexp_matches(low, '\\b[a-z_][a-z0-9_.]*(error|exception):') THEN 'error'
  WHEN contains(low, 'warn') OR contains(low, '[retry]') OR contains(low, 'fallback') OR level = 'WARNING' THEN 'warning' ELSE 'info' END AS severity
  FROM (SELECT level, lower(CASE conv_id % 5 WHEN 0 THEN 'ValueError: ' || message WHEN 1 THEN 'fallback ' || message WHEN 2 THEN 'Fatal error ' || message ELSE message END) AS low FROM log_lines) AS l) AS s GROUP BY level, severity""".replace("\\\\", "\\")))
def log_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity by the first rule that holds, over lines some of which carry an error or a fallback."""
    m, k = F.col("message"), F.col("conv_id") % 5
    low = F.lower(F.when(k == 0, F.concat(F.lit("ValueError: "), m)).when(k == 1, F.concat(F.lit("fallback "), m)).when(k == 2, F.concat(F.lit("Fatal error "), m)).otherwise(m))
    error = low.startswith("error:") | low.startswith("fatal:") | low.contains("fatal error") | low.rlike(r"\b[a-z_][a-z0-9_.]*(error|exception):")
    warning = low.contains("warn") | low.contains("[retry]") | low.contains("fallback") | (F.col("level") == "WARNING")
    rows = Tables(spark, sf_dir).log_lines.select("level", F.when(error, "error").when(warning, "warning").otherwise("info").alias("severity"))
    return rows.groupBy("level", "severity").agg(F.count("*").alias("lines"))


@query("log_fingerprint", oracle("log_lines", r"""
SELECT conv_id, turn, concat('warning:', lower(level), ':attempt=', turn, ':', lower(trim(regexp_replace(message, '[ \t\n\r]+', ' ', 'g')))) AS fingerprint FROM log_lines WHERE message IS NOT NULL"""))
def log_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text that equal problems share."""
    text = F.lower(F.trim(F.regexp_replace("message", r"[ \t\n\r]+", " ")))
    return Tables(spark, sf_dir).log_lines.where("message is not null").select("conv_id", "turn", F.concat_ws(":", F.lit("warning"), F.lower("level"), F.concat(F.lit("attempt="), F.col("turn")), text).alias("fingerprint"))


_STEP = "CASE o_orderkey % 4 WHEN 0 THEN 'model_batch:m' || o_custkey WHEN 1 THEN 'unit_fit:s' || o_custkey || ':u' || o_orderkey WHEN 2 THEN 'assemble_stream:f' || o_custkey ELSE 'scale_acceptance' END"


@query("step_to_stage", oracle("", f"""
SELECT o_orderkey, step, CASE split_part(step, ':', 1) WHEN 'model_batch' THEN 'inference' WHEN 'unit_fit' THEN 'fitting' WHEN 'assemble_stream' THEN 'assembly' ELSE 'acceptance' END AS stage,
  CASE split_part(step, ':', 1) WHEN 'model_batch' THEN 'model:' || split_part(step, ':', 2) ELSE split_part(step, ':', 2) END AS stream FROM (SELECT o_orderkey, {_STEP} AS step FROM orders) AS s"""))
def step_to_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage and stream of a step's name."""
    rows = Tables(spark, sf_dir).orders.select("o_orderkey", F.expr(_STEP).alias("step"))
    kind, rest = F.substring_index("step", ":", 1), F.split_part(F.col("step"), F.lit(":"), F.lit(2))
    stage = F.when(kind == "model_batch", "inference").when(kind == "unit_fit", "fitting").when(kind == "assemble_stream", "assembly").otherwise("acceptance")
    return rows.select("o_orderkey", "step", stage.alias("stage"), F.when(kind == "model_batch", F.concat(F.lit("model:"), rest)).otherwise(rest).alias("stream"))


@query("assembly_fraction", oracle("jobs", """
SELECT job_id, round(CASE WHEN status = 'ready' THEN 1.0 WHEN attempt < 1 THEN 0.0 ELSE least(1.0, greatest(0.0, (attempt - 1 + least(1.0, greatest(0.0, progress_current / progress_total))) / 5)) END, 6) AS fraction FROM jobs"""))
def assembly_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress through five phases, the attempt standing for the phase."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    inside = clamp(F.col("progress_current") / F.nullif("progress_total", F.lit(0)))
    value = F.when(F.col("status") == "ready", 1.0).when(F.col("attempt") < 1, 0.0).otherwise(clamp((F.col("attempt") - 1 + inside) / 5))
    return Tables(spark, sf_dir).jobs.select("job_id", F.round(value, 6).alias("fraction"))


@query("bounded_text", oracle("", """
SELECT conv_id, turn, CASE WHEN strlen(text) <= 40 THEN text ELSE (SELECT left(text, CAST(max(n) AS BIGINT)) FROM range(0, 41) AS t(n) WHERE strlen(left(text, CAST(n AS BIGINT))) <= 40) END AS bounded FROM conversations"""))
def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", R.bounded_utf8(F.col("text"), 40).alias("bounded"))


@query("json_payload", oracle("monitor_events", "SELECT event_id, CAST(TRY_CAST(json_extract_string(CASE WHEN event_id % 9 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT) AS BIGINT) AS k FROM monitor_events"))
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload's fields; damaged JSON gives nulls."""
    text = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return Tables(spark, sf_dir).monitor_events.select("event_id", F.from_json(text, "k long")["k"].alias("k"))


@query("stable_object_id", oracle("", "SELECT c_custkey, 'obj_' || left(sha1('run-1|' || c_mktsegment || '|' || c_custkey), 24) AS object_id, sha256(concat_ws(',', least(c_custkey, c_nationkey), greatest(c_custkey, c_nationkey))) AS digest FROM customer"))
def stable_object_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that depend on content alone."""
    rows = Tables(spark, sf_dir).customer
    name = F.concat_ws("|", F.lit("run-1"), "c_mktsegment", "c_custkey")
    cells = F.array_sort(F.array("c_custkey", F.col("c_nationkey").cast("long")))
    return rows.select("c_custkey", F.concat(F.lit("obj_"), F.left(F.sha1(name), F.lit(24))).alias("object_id"), F.sha2(F.array_join(F.transform(cells, lambda c: c.cast("string")), ","), 256).alias("digest"))
