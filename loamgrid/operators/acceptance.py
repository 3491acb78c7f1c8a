"""Whether a run may be accepted: every gate of its plan against what is there, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The gates in their order, and the kinds of intermediate files of a unit.
GATES = [
    "all_package_reports_present", "all_unit_reports_present", "all_unit_intermediates_cleaned", "all_work_packages_ready", "all_work_package_jobs_ready", "all_v33_jobs_ready", "all_unit_confidence_jobs_ready", "all_unit_jobs_ready",
    "all_jobs_ready", "all_streams_ready", "all_stream_units_ready", "no_artifact_integrity_errors", "all_boundary_units_passed", "peak_cache_within_frozen_budget", "all_package_storage_metrics_present", "peak_package_managed_within_frozen_budget",
]
UNIT_KINDS = ["unit_raw_geoparquet", "unit_formal_geoparquet", "unit_boundary_report", "unit_fitted_edges_geoparquet", "unit_boundary_signatures"]
JOB_TYPES = {"work_package": "packages", "fragmentation_v33": "v33_jobs", "unit_confidence": "confidence_jobs", "unit_fit": "reports"}


def gates(plan: DataFrame, jobs: DataFrame, streams: DataFrame, packages: DataFrame, stream_units: DataFrame, unit_reports: DataFrame, package_reports: DataFrame, artifacts: DataFrame) -> DataFrame:
    """run_id, gate, passed, accepted (all gates of the run) for every run of ``plan`` and every gate of ``GATES``.

    ``plan``: run_id, streams, units, packages, partitions (numbers), v33, confidence (whether those jobs belong to the run), storage_schema, cache_budget,
    managed_budget.  The others have run_id and: job_type, status; status; status; stream_id, status; fitted_edges, passed; peak_cache, managed,
    complete; kind, status, broken.  What a run lacks counts as zero; a null flag or status as not passed. Budgets
    are asked from storage schema 2 on.
    """
    ready = F.coalesce(F.col("status") == "ready", F.lit(False))
    per = {
        "jobs": jobs.groupBy("run_id").agg(F.count("*").alias("n_jobs"), F.count_if(ready).alias("r_jobs"), *[c for k in JOB_TYPES for c in (F.count_if(F.col("job_type") == k).alias(f"n_{k}"), F.count_if((F.col("job_type") == k) & ready).alias(f"r_{k}"))]),
        "streams": streams.groupBy("run_id").agg(F.count("*").alias("n_streams"), F.count_if(ready).alias("r_streams")),
        "packages": packages.groupBy("run_id").agg(F.count("*").alias("n_packages"), F.count_if(ready).alias("r_packages")),
        "units": stream_units.groupBy("run_id", "stream_id").agg(F.count("*").alias("n"), F.count_if(ready).alias("r")).groupBy("run_id").agg(F.count("*").alias("n_unit_streams"), F.min("r").alias("least_units"), F.max("n").alias("most_units")),
        "reports": unit_reports.groupBy("run_id").agg(F.count("*").alias("n_reports"), F.count_if(F.col("fitted_edges") > 0).alias("n_fitted"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("n_failed")),
        "storage": package_reports.groupBy("run_id").agg(F.count("*").alias("n_package_reports"), F.count_if(~F.coalesce("complete", F.lit(False))).alias("n_incomplete"), F.max("peak_cache").alias("peak_cache"), F.max("managed").alias("managed")),
        "artifacts": artifacts.groupBy("run_id").agg(*[F.count_if(F.col("kind").isin(UNIT_KINDS) & c).alias(n) for n, c in (("n_intermediates", F.lit(True)), ("n_cleaned", F.coalesce(F.col("status") == "cleaned", F.lit(False))))], F.count_if("broken").alias("n_broken")),
    }
    facts = plan.withColumns({"reports": F.col("units") * F.col("streams"), "v33_jobs": F.when(F.col("v33"), F.col("partitions") + 1).otherwise(0), "confidence_jobs": F.when(F.col("confidence"), F.col("units")).otherwise(0)})
    facts = facts.withColumn("all_jobs", sum((F.col(c) for c in JOB_TYPES.values()), F.lit(0)))
    for part in per.values():
        facts = facts.join(part, "run_id", "left")
    facts = facts.fillna(0)
    both = lambda name, wanted: (F.col(f"n_{name}") == F.col(wanted)) & (F.col(f"r_{name}") == F.col(wanted))
    asked = F.col("storage_schema") >= 2
    whole = (F.col("n_package_reports") == F.col("packages")) & (F.col("n_incomplete") == 0)
    within = lambda peak, budget: ~asked | (whole & (F.col(budget) > 0) & (F.col(peak) <= F.col(budget)))
    files = 4 * F.col("reports") + F.col("n_fitted")
    tests = [
        F.col("n_package_reports") == F.col("packages"), F.col("n_reports") == F.col("reports"), (F.col("n_intermediates") == files) & (F.col("n_cleaned") == files), both("packages", "packages"), *[both(k, wanted) for k, wanted in JOB_TYPES.items()],
        both("jobs", "all_jobs"), both("streams", "streams"), (F.col("n_unit_streams") == F.col("streams")) & (F.col("least_units") == F.col("units")) & (F.col("most_units") == F.col("units")), F.col("n_broken") == 0, F.col("n_failed") == 0,
        within("peak_cache", "cache_budget"), ~asked | whole, within("managed", "managed_budget"),
    ]
    rows = facts.select("run_id", *[t.alias(g) for g, t in zip(GATES, tests, strict=True)]).unpivot("run_id", GATES, "gate", "passed")
    return rows.withColumn("accepted", F.bool_and("passed").over(W.partitionBy("run_id")))
