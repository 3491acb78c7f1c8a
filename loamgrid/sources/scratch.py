"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Spark's setting that deletes an execution's shuffle files when it is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master (one machine, as in tests) gets a temporary folder; on a
    cluster that is an error, since executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loamgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def saved(df: DataFrame, name: str, seen: dict[str, Column] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: it survives lost executors and is computed once.

    The execution's shuffle files are deleted at its end; the session's own setting for that comes back after.
    ``seen``: aggregates of the rows, observed as they are written; their values are in ``seen`` of the result.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        noted = Observation() if seen else None
        (df.observe(noted, *[c.alias(k) for k, c in seen.items()]) if seen else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if seen:
        out.seen = noted.get or out.agg(*[c.alias(k) for k, c in seen.items()]).first().asDict()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` returned and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
