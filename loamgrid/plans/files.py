"""Queries that write and read files: shards, logs, reports, class maps, control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.plans.fixtures import Tables, oracle
from loamgrid.registry import query
from loamgrid.sources import shards as S


@query("write_shards", oracle("store", "SELECT class_index, doc_id, part_id, area, sha256(source) AS source_sha256 FROM store"))
def write_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as shards and read back in their schema."""
    records = Tables(spark, sf_dir).store.select("class_index", "doc_id", "part_id", "area", F.sha2("source", 256).alias("source_sha256"))
    path = S.new_folder(spark, "shards")
    S.write_shards(records, path, "part_id", "class_index", source="store")
    return S.read_shards(spark, path, records.schema, "class_index")


@query("scan_shards_checked", oracle("store", "SELECT class_index, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (doc_id % 10 <> 0) AS BIGINT) AS found FROM store GROUP BY class_index HAVING count(*) <> count(*) FILTER (doc_id % 10 <> 0)"))
def scan_shards_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of which rows are lost after the commit: their files are written anew without some."""
    records = Tables(spark, sf_dir).store
    path = S.new_folder(spark, "shards")
    name = S.write_shards(records, path, "doc_id", "class_index")
    records.where("doc_id % 10 <> 0").write.mode("overwrite").parquet(f"{path}/records/{name}")
    wrong = S.manifest_violations(spark, path, "class_index").groupBy(F.col("shard").cast("long").alias("class_index"))
    return wrong.agg(F.sum("rows").alias("rows"), F.sum("found").alias("found")).where("rows <> found")


@query("log_scan", oracle("log_lines", "SELECT CASE WHEN (conv_id + turn) % 6 = 0 THEN NULL ELSE level END AS level, (conv_id + turn) % 6 = 0 AS damaged, count(*) AS lines FROM log_lines WHERE message IS NOT NULL GROUP BY 1, 2"))
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines by level, damaged ones counted apart."""
    lines = Tables(spark, sf_dir).log_lines.where("message is not null")
    text = F.to_json(F.struct(F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0")).alias("timestamp"), "level", "message"))
    path = S.new_folder(spark, "log")
    lines.select(F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, F.left(text, F.lit(25))).otherwise(text).alias("value")).write.text(path)
    rows = S.read_log(spark, path).select("level", F.col("_damaged").isNotNull().alias("damaged"))
    return rows.groupBy("level", "damaged").agg(F.count("*").alias("lines"))


@query("log_stream", oracle("log_lines", "SELECT CASE WHEN (conv_id + turn) % 6 = 0 THEN NULL ELSE level END AS level, (conv_id + turn) % 6 = 0 AS damaged, count(*) AS lines FROM log_lines WHERE message IS NOT NULL GROUP BY 1, 2"))
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream: lines of even conversations, then those of odd ones, damaged lines in a table of their own."""
    lines = Tables(spark, sf_dir).log_lines.where("message is not null")
    text = F.to_json(F.struct("level", "message"))
    lines = lines.select("conv_id", F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, F.left(text, F.lit(12))).otherwise(text).alias("value"))
    path, out = S.new_folder(spark, "growing"), S.new_folder(spark, "drained")
    for odd in (0, 1):
        lines.where(F.col("conv_id") % 2 == odd).select("value").write.mode("append").text(path)
        good, damaged = S.drain_log(spark, path, out)
    rows = good.select("level", F.lit(False).alias("damaged")).unionByName(damaged.select(F.lit(None).cast("string").alias("level"), F.lit(True).alias("damaged")))
    return rows.groupBy("level", "damaged").agg(F.count("*").alias("lines"))


@query("report_scan", oracle("unit_reports", "SELECT stream_id, count(*) AS reports, CAST(sum(chain_count) AS BIGINT) AS chains FROM unit_reports GROUP BY stream_id"))
def report_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = Tables(spark, sf_dir).unit_reports.select("stream_id", "unit_id", "chain_count")
    path = S.new_folder(spark, "reports")
    reports.write.json(path)
    return S.read_reports(spark, path, reports.schema).groupBy("stream_id").agg(F.count("*").alias("reports"), F.sum("chain_count").alias("chains"))


@query("class_map_join", oracle("store classes", "SELECT class_code AS code, 'class ' || class_code AS name, count(*) AS n FROM store JOIN classes USING (class_index) GROUP BY 1, 2"))
def class_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by the names of a class map file."""
    t = Tables(spark, sf_dir)
    path = S.new_folder(spark, "classes")
    t.classes.select(F.col("class_code").alias("code"), F.concat(F.lit("class "), F.col("class_code")).alias("name")).write.option("header", True).csv(path)
    rows = t.store.join(F.broadcast(t.classes), "class_index").join(F.broadcast(S.read_class_map(spark, path)), F.col("class_code") == F.col("code"))
    return rows.groupBy("code", "name").agg(F.count("*").alias("n"))


@query("load_control_tables", oracle("tiles", "SELECT run_id, status, count(*) AS tiles, min(tile_id) AS first_tile FROM tiles GROUP BY run_id, status"))
def load_control_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles stored by run, so that reading one run prunes the others."""
    path = S.new_folder(spark, "tiles")
    Tables(spark, sf_dir).tiles.repartition("run_id").write.partitionBy("run_id").parquet(path)
    rows = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("long"))
    return rows.groupBy("run_id", "status").agg(F.count("*").alias("tiles"), F.min("tile_id").alias("first_tile"))


@query("workspace_split", oracle("store", "SELECT class_index, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM store GROUP BY class_index"))
def workspace_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream split into class layers; the total stays."""
    from pyspark.sql import Window as W

    path = S.new_folder(spark, "workspace")
    Tables(spark, sf_dir).store.repartition("class_index").write.partitionBy("class_index").parquet(path)
    rows = spark.read.parquet(path).groupBy(F.col("class_index").cast("long").alias("class_index")).agg(F.count("*").alias("n"))
    return rows.withColumn("total", F.sum("n").over(W.partitionBy()))


@query("assemble_stream", oracle("store", """
SELECT kind, class_index, count(*) AS n, count(DISTINCT object_id) AS objects FROM (SELECT 'raw' AS kind, class_index, 'obj_' || left(sha1(part_id), 24) AS object_id FROM store WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'formal', class_index, 'obj_' || left(sha1(part_id), 24) FROM store WHERE reviewed = 1) AS s GROUP BY kind, class_index"""))
def assemble_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and formal records of a stream with their object ids, written in order and read again."""
    store = Tables(spark, sf_dir).store
    ids = store.select("part_id").distinct().withColumn("object_id", F.concat(F.lit("obj_"), F.left(F.sha1("part_id"), F.lit(24))))
    both = store.where("doc_id % 3 <> 0").withColumn("kind", F.lit("raw")).unionByName(store.where("reviewed = 1").withColumn("kind", F.lit("formal")))
    path = S.new_folder(spark, "stream")
    S.write_shards(both.join(ids, "part_id", "left"), path, "doc_id", "kind")
    rows = spark.read.parquet(f"{path}/records/{S.last_commit(spark, path).name}")
    return rows.groupBy("kind", "class_index").agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("objects"))
