"""Shards of records as Parquet with a manifest, and line or report files of JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.sources.scratch import scratch_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class ShardError(ValueError):
    """A shard folder that holds no commit, or not what its commit says."""


def _digest(columns: list[str]) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)"))


def _files(records: DataFrame, shard: str) -> DataFrame:
    """file, bytes, shard, rows, digest of records as they lie in their files."""
    own = records.columns
    named = records.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_size").alias("__bytes"))
    return named.groupBy(F.col("__file").alias("file"), F.col("__bytes").alias("bytes"), F.col(shard).cast("string").alias("shard")).agg(F.count("*").alias("rows"), _digest(own).alias("digest"))


def write_shards(records: DataFrame, path: str, key: str, shard: str, source: str | None = None) -> str:
    """Records by range of the key, sorted within files, and a manifest; visible only once both are whole. Returns the commit's id.

    Rows and their digest are observed while they are written, and the manifest is made from the
    files that came of it, so that the two must agree; then one row in ``commits`` publishes them, with ``source``, the
    caller's mark of what they were made from. A write that dies before that leaves what nobody reads; the last commit counts.
    """
    spark, name = records.sparkSession, uuid.uuid4().hex
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation()
    dealt = records.repartitionByRange(parts, shard, key).sortWithinPartitions(shard, key)  # what is dealt by range is sampled first, so watch what comes of it
    dealt.observe(seen, F.count("*").alias("rows"), _digest(records.columns).alias("digest")).write.parquet(f"{path}/records/{name}")
    _files(spark.read.schema(records.schema).parquet(f"{path}/records/{name}"), shard).write.parquet(f"{path}/manifest/{name}")
    whole = spark.read.parquet(f"{path}/manifest/{name}").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("digest").alias("digest")).first()
    if (whole.rows, whole.digest) != (seen.get["rows"], seen.get["digest"]):
        raise ShardError(f"{whole.rows} rows in the files of {path}, {seen.get['rows']} were written")
    order = spark.read.schema(_COMMIT).parquet(f"{path}/commits").agg(F.max("number")).first()[0] if _commits(spark, path) else None
    row = [((order or 0) + 1, name, whole.rows, whole.digest, source)]
    spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return name


_COMMIT = "number long, name string, rows long, digest decimal(38,0), source string"


def _commits(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def last_commit(spark: SparkSession, path: str) -> Row:
    """number, name, rows, digest, source of the folder's last commit."""
    found = spark.read.schema(_COMMIT).parquet(f"{path}/commits").orderBy(F.desc("number"), F.desc("name")).first() if _commits(spark, path) else None
    if found is None:
        raise ShardError(f"nothing has been committed to {path}")
    return found


def read_shards(spark: SparkSession, path: str, schema: T.StructType, shard: str | None = None) -> DataFrame:
    """Records of the last commit in the given schema; other columns fail. With ``shard`` they are first held against the manifest, which takes a pass over them."""
    commit = last_commit(spark, path)
    found = spark.read.parquet(f"{path}/records/{commit.name}").schema
    if {(f.name, f.dataType) for f in found} != {(f.name, f.dataType) for f in schema}:
        raise ShardError(f"columns {found.simpleString()} instead of {schema.simpleString()}")
    if shard and (wrong := manifest_violations(spark, path, shard).limit(5).collect()):
        raise ShardError(f"{path} differs from its manifest in {', '.join(f'{r.file} ({r.shard}: {r.found} of {r.rows} rows)' for r in wrong)}")
    return spark.read.schema(schema).parquet(f"{path}/records/{commit.name}")


def manifest_violations(spark: SparkSession, path: str, shard: str) -> DataFrame:
    """file, shard, rows, found: parts of files that are missing, too many, or other than the last commit's manifest says."""
    name = last_commit(spark, path).name
    there = spark.read.parquet(f"{path}/records/{name}")
    said = spark.read.parquet(f"{path}/manifest/{name}").alias("m")
    found = _files(there, shard).alias("f")
    both = said.join(found, F.col("m.file").eqNullSafe(F.col("f.file")) & F.col("m.shard").eqNullSafe(F.col("f.shard")), "full")
    same = F.col("m.rows").eqNullSafe(F.col("f.rows")) & F.col("m.digest").eqNullSafe(F.col("f.digest"))
    return both.where(~same).select(F.coalesce("m.file", "f.file").alias("file"), F.coalesce("m.shard", "f.shard").alias("shard"), F.coalesce("m.rows", F.lit(0)).alias("rows"), F.coalesce("f.rows", F.lit(0)).alias("found"))


LOG = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("level", T.StringType()), T.StructField("message", T.StringType()), T.StructField("_damaged", T.StringType())])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON log; a damaged one has nulls and its text in ``_damaged``."""
    return spark.read.schema(LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").json(path)


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder of growing JSON logs as a stream: a file that is added is read once; columns as of ``read_log``."""
    return spark.readStream.schema(LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").json(path)


def drain_log(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, DataFrame]:
    """All lines that have come since the last call, appended to ``out``; returns the good lines and the damaged ones so far.

    Offsets are kept in ``out``, and a batch that is run again after a failure replaces what it had written, so every line is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.where("_damaged is null").drop("_damaged").write.mode("overwrite").parquet(f"{out}/lines/batch={number}")
        rows.where("_damaged is not null").select("_damaged").write.mode("overwrite").parquet(f"{out}/damaged/batch={number}")
        rows.unpersist()

    log_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.schema(kind).parquet(f"{out}/{name}") for name, kind in (("lines", "timestamp string, level string, message string"), ("damaged", "_damaged string")))


def read_reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON reports; any malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """code, name of a class map file with a header."""
    return spark.read.schema("code INT, name STRING").option("header", True).option("mode", "FAILFAST").csv(path)
