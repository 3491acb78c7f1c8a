"""One broken run for each gate: that gate fails, with those that rest on the same fact, and no other."""

from __future__ import annotations

from loamgrid.operators.acceptance import GATES, UNIT_KINDS, gates

STORAGE = {"peak_cache_within_frozen_budget", "all_package_storage_metrics_present", "peak_package_managed_within_frozen_budget"}
#: What is broken in a run, and the gates that must notice.
BREAKS = {
    "nothing": set(),
    "package report lost": {"all_package_reports_present"} | STORAGE,
    "unit report lost": {"all_unit_reports_present", "all_unit_intermediates_cleaned"},
    "intermediate kept": {"all_unit_intermediates_cleaned"},
    "package open": {"all_work_packages_ready"},
    "package job failed": {"all_work_package_jobs_ready", "all_jobs_ready"},
    "v33 job lost": {"all_v33_jobs_ready", "all_jobs_ready"},
    "confidence job failed": {"all_unit_confidence_jobs_ready", "all_jobs_ready"},
    "unit job null": {"all_unit_jobs_ready", "all_jobs_ready"},
    "another job": {"all_jobs_ready"},
    "stream lost": {"all_streams_ready"},
    "stream unit twice": {"all_stream_units_ready"},
    "file broken": {"no_artifact_integrity_errors"},
    "boundary failed": {"all_boundary_units_passed"},
    "cache too large": {"peak_cache_within_frozen_budget"},
    "metrics incomplete": STORAGE,
    "managed too large": {"peak_package_managed_within_frozen_budget"},
    "old schema, no metrics": set(),
    "nothing is there": set(GATES) - {"no_artifact_integrity_errors", "all_boundary_units_passed"},
}


def test_every_gate_notices_its_fault(spark):
    tables = {n: [] for n in ("plan", "jobs", "streams", "packages", "units", "reports", "storage", "files")}
    for run, what in enumerate(BREAKS):
        tables["plan"].append((run, 2, 3, 2, 4, True, True, 1 if what.startswith("old") else 2, 100, 200))
        if what == "nothing is there":
            continue
        jobs = [[run, k, "ready"] for k, n in (("work_package", 2), ("fragmentation_v33", 5), ("unit_confidence", 3), ("unit_fit", 6)) for _ in range(n)]
        reports = [[run, i % 2, True] for i in range(6)]
        files = [[run, k, "cleaned", False] for i in range(6) for k in UNIT_KINDS if i % 2 or k != UNIT_KINDS[3]] + [[run, "final", "ready", False]]
        storage = [[run, 90, 190, not what.startswith("old")] for _ in range(2)]
        streams, packages, units = [[run, "ready"]] * 2, [[run, "ready"]] * 2, [[run, s, "ready"] for s in (0, 1) for _ in range(3)]
        if what == "package report lost":
            storage.pop()
        elif what == "unit report lost":
            reports.pop()
        elif what == "intermediate kept":
            files[0][2] = "ready"
        elif what == "package open":
            packages[1] = [run, "running"]
        elif what == "package job failed":
            jobs[0][2] = "failed"
        elif what == "v33 job lost":
            jobs.pop(3)
        elif what == "confidence job failed":
            jobs[8][2] = "failed"
        elif what == "unit job null":
            jobs[-1][2] = None
        elif what == "another job":
            jobs.append([run, "other", "ready"])
        elif what == "stream lost":
            streams.pop()
        elif what == "stream unit twice":
            units.append([run, 1, "ready"])
        elif what == "file broken":
            files[-1][3] = True
        elif what == "boundary failed":
            reports[0][2] = None
        elif what == "cache too large":
            storage[1][1] = 101
        elif what == "metrics incomplete":
            storage[0][3] = False
        elif what == "managed too large":
            storage[0][2] = 201
        for name, rows in zip(list(tables)[1:], (jobs, streams, packages, units, reports, storage, files), strict=True):
            tables[name] += rows
    schemas = [
        "run_id long, streams int, units int, packages int, partitions int, v33 boolean, confidence boolean, storage_schema int, cache_budget long, managed_budget long", "run_id long, job_type string, status string", "run_id long, status string",
        "run_id long, status string", "run_id long, stream_id long, status string", "run_id long, fitted_edges long, passed boolean", "run_id long, peak_cache long, managed long, complete boolean", "run_id long, kind string, status string, broken boolean",
    ]
    rows = gates(*(spark.createDataFrame(v, s) for v, s in zip(tables.values(), schemas, strict=True))).collect()
    assert len(rows) == len(GATES) * len(BREAKS)
    for run, (what, failing) in enumerate(BREAKS.items()):
        assert {r.gate for r in rows if r.run_id == run and not r.passed} == failing, what
        assert {r.accepted for r in rows if r.run_id == run} == {not failing}
