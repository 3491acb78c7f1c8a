"""Tables of the library's data model as projections of the given tables.

The given tables hold no rasters and no run state, so each table here is
defined over one that exists, in SQL that Spark and DuckDB read alike.  Every
definition covers the whole table it reads, so the derived ones grow with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels in a row of the derived rasters, pixels of a partition's side.
WIDTH, SIDE = 100, 25
#: Class codes in the order of the class axis.
CLASS_CODES = (12, 13, 21, 31, 32, 33, 43, 51, 52, 53, 54, 61, 62, 71)
_CODES = ", ".join(f"({i}, {c})" for i, c in enumerate(CLASS_CODES))


def _labels(every: int) -> str:
    base = "(CAST(floor((o_orderkey % 100) / 9) AS BIGINT) * 5 + CAST(floor(floor(o_orderkey / 100) / 7) AS BIGINT) * 3) % 14"
    return f"""
    SELECT x, y, class_index, confidence, CAST(floor(y / {SIDE}) AS BIGINT) * {WIDTH // SIDE} + CAST(floor(x / {SIDE}) AS BIGINT) AS partition_id FROM (
      SELECT o_orderkey % {WIDTH} AS x, CAST(floor(o_orderkey / {WIDTH}) AS BIGINT) AS y,
        CASE WHEN o_custkey % {every} = 0 THEN ({base} + 1 + o_custkey % 13) % 14 ELSE {base} END AS class_index,
        0.5 + (CAST(floor(o_totalprice) AS BIGINT) % 50) / 100 AS confidence
      FROM {{orders}} WHERE o_orderkey % 397 <> 0) AS p"""


_BOX = "c_custkey * 37 % 1000"
TABLES = {
    "classes": f"SELECT class_index, class_code FROM (VALUES {_CODES}) AS v(class_index, class_code)",
    "labels_a": _labels(17),
    "labels_b": _labels(23),
    "labels_c": _labels(11),
    "jobs": """
    SELECT o_orderkey AS job_id, o_custkey % 5 AS run_id, o_custkey AS object_id, o_orderkey % 50 AS stream_id,
      CASE o_orderkey % 4 WHEN 0 THEN 'score' WHEN 1 THEN 'fuse' WHEN 2 THEN 'fit' ELSE 'assemble' END AS job_type,
      CASE WHEN o_custkey % 29 = 0 THEN 'failed' WHEN o_custkey % 31 = 0 THEN 'interrupted' WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS status,
      CAST(substr(o_orderpriority, 1, 1) AS INT) AS attempt, 4 AS max_attempts,
      CAST(floor(o_totalprice) AS BIGINT) % 101 AS progress_current, CAST(100 AS BIGINT) AS progress_total,
      o_orderkey % 1000 AS lease_expires, o_orderdate AS updated_at
    FROM {orders}""",
    "artifacts": """
    SELECT p_partkey AS artifact_id, p_partkey % 5 AS run_id,
      CASE p_size % 5 WHEN 0 THEN 'mask' WHEN 1 THEN 'confidence' WHEN 2 THEN 'report' WHEN 3 THEN 'shard' ELSE 'cache' END AS kind,
      CASE p_partkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'ready' WHEN 2 THEN 'building' ELSE 'cleaned' END AS status,
      CAST(floor(p_retailprice * 100) AS BIGINT) AS byte_count
    FROM {part}""",
    "artifact_dependencies": "SELECT DISTINCT l_orderkey AS job_id, l_partkey AS artifact_id FROM {lineitem} WHERE l_partkey % 10 <> 0",
    "monitor_events": """
    SELECT event_id, ts, user_id % 7 AS run_id, user_id AS object_id, user_id % 11 AS stream_id, event_type, value, props,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS level,
      concat(CAST(user_id AS STRING), ':', event_type, ':', CAST(date_trunc('hour', ts) AS STRING)) AS idempotency_key
    FROM {events}""",
    "log_lines": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'INFO' WHEN 'assistant' THEN 'DEBUG' ELSE 'WARNING' END AS level, text AS message FROM {conversations}",
    "store": "SELECT d.doc_id, d.source, sha1(coalesce(d.text, '')) AS part_id, d.doc_id % 14 AS class_index, coalesce(l.quality, 0) AS reviewed, length(coalesce(d.text, '')) AS area FROM {documents} AS d LEFT JOIN {labels} AS l ON d.doc_id = l.doc_id",
    "boxes": f"""
    SELECT c_custkey AS box_id, {_BOX} AS x0, c_custkey * 91 % 1000 AS y0, {_BOX} + 1 + c_custkey % 12 AS x1, c_custkey * 91 % 1000 + 1 + c_nationkey % 9 AS y1,
      CAST(c_nationkey % 14 AS BIGINT) AS class_index
    FROM {{customer}}""",
    "unit_reports": """
    SELECT l_orderkey % 50 AS stream_id, l_orderkey AS unit_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS chain_count, CAST(floor(l_quantity / 2) AS BIGINT) AS spline_count,
      l_discount * 10 AS max_displacement_px, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ready' END AS status, l_shipdate AS reported_at
    FROM {lineitem}""",
    "tiles": f"""
    SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS row_no, o_orderkey % 20 AS col_no, o_orderkey AS tile_id,
      o_orderkey % 20 * 320 AS x0, CAST(floor(o_orderkey / 20) AS BIGINT) * 320 AS y0, o_orderkey % 20 * 320 + 512 AS x1, CAST(floor(o_orderkey / 20) AS BIGINT) * 320 + 512 AS y1,
      o_custkey % 5 AS run_id, CASE WHEN o_custkey % 9 = 0 THEN 'failed' ELSE 'ready' END AS status
    FROM {{orders}}""",
}
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Given and derived tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "scores":
            return scores(self.embeddings)
        text = TABLES.get(name)
        if text is None:
            raise AttributeError(name)
        return self.spark.sql(text, **{t: getattr(self, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def scores(embeddings: DataFrame) -> DataFrame:
    """vec_id, model_id, x, y, probs: three models' class probabilities for each vector's pixel."""
    part = lambda m: F.transform(F.slice("embedding", 14 * m + 1, 14), lambda e: F.exp(8 * e.cast("double")))
    models = F.array(*[F.struct(F.lit(m).alias("model_id"), part(m).alias("raw")) for m in range(3)])
    rows = embeddings.select("vec_id", (F.col("vec_id") % 25).alias("x"), F.floor(F.col("vec_id") / 25).alias("y"), F.explode(models).alias("m"))
    total = F.aggregate("m.raw", F.lit(0.0), lambda a, e: a + e)
    return rows.select("vec_id", "m.model_id", "x", "y", F.transform("m.raw", lambda e: e / total).alias("probs"))


_SCORES_SQL = """
    SELECT vec_id, model_id, vec_id % 25 AS x, CAST(floor(vec_id / 25) AS BIGINT) AS y, class_index, raw / sum(raw) OVER (PARTITION BY vec_id, model_id) AS p
    FROM (SELECT vec_id, CAST(m AS INT) AS model_id, CAST(c AS INT) AS class_index, exp(8 * CAST(embedding[14 * m + c + 1] AS DOUBLE)) AS raw
      FROM embeddings, range(3) AS t(m), range(14) AS u(c)) AS r"""


def oracle(tables: str, select: str) -> str:
    """DuckDB SQL: ``select`` over the named derived tables; ``scores`` has one row for each class there."""
    parts = [f"{t} AS ({_SCORES_SQL if t == 'scores' else re.sub(r'[{](\w+)[}]', r'\1', TABLES[t])})" for t in tables.split()]
    body = select.strip()
    if not parts:
        return body
    for word in ("WITH RECURSIVE", "WITH"):
        if body.startswith(word):
            return f"{word} " + ",\n".join([*parts, body[len(word) :].strip()])
    return "WITH " + ",\n".join(parts) + "\n" + body
