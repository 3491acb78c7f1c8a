"""Op 8: mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in a fixed random order, form blocks.  With weight
w = quota / period, block k of a source may not run before slot floor((k - 1) / w)
(its release) and must run before slot ceil(k / w) (its deadline).  Earliest
deadline first among the released blocks fills one slot after another; as
the quotas add up to the period, every block meets its window, so that after any number of
slots each source has run within one block of its share.

The schedule repeats after one period.  So only one period is simulated, over
the quotas alone, and every block finds its slot by arithmetic: the work is parallel
and the simulation bounded by ``resolution`` plus the number of sources (10,000 sources take seconds).

A source's order is dealt over 4096 hash buckets; documents are ranked within a
bucket and buckets by a prefix sum of their counts, so that a hot source
never meets in one task (null ids by a hash of their rows).  A source that has run out leaves its slots empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgrid.llm.shared import table

BLOCK_DOCS = 64
RESOLUTION = 1000


def schedule(quotas: DataFrame) -> DataFrame:
    """source, quota, period, slots (of the source's blocks within a period) from source, quota (one row each).

    One fold over the slots of a period: its state is the sorted queue of released blocks, each as one number of
    deadline and source, so that a step takes the first, and merges what the next slot releases.  Ties go to the first
    source.  The queue never holds more than a block of each source.
    """
    every, by = W.partitionBy(), W.orderBy("source")  # quotas are one row a source
    numbered = quotas.select("source", "quota", (F.row_number().over(by) - 1).cast("long").alias("number"), F.sum("quota").over(every).alias("period"), F.count("*").over(every).alias("n"))
    blocks = numbered.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("k"))
    release, deadline = F.floor((F.col("k") - 1) * F.col("period") / F.col("quota")), F.ceil(F.col("k") * F.col("period") / F.col("quota"))
    freed = blocks.groupBy(release.alias("slot")).agg(F.sort_array(F.collect_list(deadline * F.col("n") + F.col("number"))).alias("jobs"))
    slots = numbered.where("number = 0").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("period") - 1)).alias("slot"))
    none = F.array().cast("array<long>")
    freed = slots.join(freed, "slot", "left").select("slot", "n", F.coalesce("jobs", none).alias("jobs"))
    one = freed.agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("slot", "jobs"))), lambda x: x["jobs"]).alias("jobs"))
    start = F.struct(F.get("jobs", F.lit(0)).alias("queue"), none.alias("picks"))

    def step(state: Column, new: Column) -> Column:
        rest = F.slice(state["queue"], F.lit(2), F.size(state["queue"]))
        queue = F.when(F.size(new) == 0, rest).otherwise(F.sort_array(F.concat(rest, new)))
        return F.struct(queue.alias("queue"), F.concat(state["picks"], F.slice(state["queue"], 1, 1)).alias("picks"))

    later = F.concat(F.slice("jobs", F.lit(2), F.size("jobs")), F.array(none))
    picked = one.where(F.size("jobs") > 0).select("n", F.posexplode(F.aggregate(later, start, step, lambda s: s["picks"])).alias("slot", "job"))
    turns = picked.select("slot", (F.col("job") % F.col("n")).alias("number"))
    return turns.join(numbered, "number").groupBy("source", "quota", "period").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def root_quotas(counts: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """Quotas in proportion to the square root of a source's documents, one at least, about ``resolution`` in all."""
    root = F.floor(F.sqrt("n"))
    return counts.select("source", F.greatest(F.lit(1), F.floor(root * resolution / F.sum(root).over(W.partitionBy()))).alias("quota"))


def mix_sources(docs: DataFrame, quotas: DataFrame | None = None, block_docs: int = BLOCK_DOCS, resolution: int = RESOLUTION) -> DataFrame:
    """All columns of ``docs`` and each row's block, place in the block, release, deadline and slot.

    ``docs`` needs doc_id and source.  ``quotas`` (source, quota of 1 or more) sets the target weights; sources that it
    misses get 1.  By default they follow ``root_quotas``.  Rows are mixed by slot, then place.  Null sources form one of their own,
    as do empty names; null ids come first in their source; rows that share an id follow each other in the order of a hash of
    all their columns; repeated rows stay.  Columns named block, place, release, deadline or slot are replaced.
    """
    docs = docs.drop("block", "place", "release", "deadline", "slot")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    part = F.when(F.col("doc_id").isNull(), F.concat(F.lit(" "), F.pmod(whole, F.lit(4096)))).otherwise(F.substring(order, 1, 3))
    rows = docs.withColumns({"__source": key, "__order": order, "__part": part, "__whole": whole})
    sizes = rows.groupBy("__source", "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__source").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__source", "__part", before.alias("__before"))
    totals = sizes.groupBy(F.col("__source").alias("source")).agg(F.sum("__n").alias("n"))
    if quotas is None:
        quotas = root_quotas(totals, resolution)
    else:
        given = quotas.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), F.col("quota").cast("long").alias("quota"))
        quotas = totals.join(given, "source", "left").select("source", F.coalesce("quota", F.lit(1)).alias("quota"))
    plan = schedule(quotas).select(F.col("source").alias("__source"), F.col("quota").alias("__quota"), F.col("period").alias("__period"), F.col("slots").alias("__slots"))
    within = F.row_number().over(W.partitionBy("__source", "__part").orderBy("__order", "doc_id", "__whole"))
    placed = rows.withColumn("__rank", within).join(offsets, ["__source", "__part"]).join(plan, "__source")
    rank, quota, period = F.col("__before") + F.col("__rank") - 1, F.col("__quota"), F.col("__period")
    placed = placed.withColumn("block", F.floor(rank / block_docs) + 1).withColumn("place", rank % block_docs)
    done = F.col("block") - 1
    return placed.select(
        *docs.columns,
        "block",
        "place",
        F.floor(done * period / quota).alias("release"),
        F.ceil(F.col("block") * period / quota).alias("deadline"),
        (F.floor(done / quota) * period + F.get("__slots", (done % quota).cast("int"))).alias("slot"),
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


OP8_SQL = f"""
WITH RECURSIVE ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id) - 1 AS n FROM documents),
roots AS (SELECT source, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM documents GROUP BY source),
quotas AS (SELECT source, greatest(1, root * {RESOLUTION} // (sum(root) OVER ())::BIGINT) AS quota FROM roots),
listed AS (SELECT list(quota ORDER BY source NULLS FIRST) AS q, list(source ORDER BY source NULLS FIRST) AS s, CAST(sum(quota) AS BIGINT) AS period, count(*) AS k FROM quotas),
runs AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS pick, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS done FROM listed
  UNION ALL
  SELECT slot, pick, list_transform(done, lambda d, j: CASE WHEN j = pick + 1 THEN d + 1 ELSE d END) FROM (
    SELECT runs.slot + 1 AS slot, done,
      list_min(list_transform(list_filter(range(0, k), lambda i: done[i + 1] < q[i + 1] AND done[i + 1] * period // q[i + 1] <= runs.slot + 1),
        lambda i: ((done[i + 1] + 1) * period + q[i + 1] - 1) // q[i + 1] * k + i)) % k AS pick
    FROM runs, listed WHERE runs.slot + 1 < period)),
slots AS (SELECT s[pick + 1] AS source, q[pick + 1] AS quota, period, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn FROM runs, listed WHERE slot >= 0),
blocks AS (SELECT doc_id, ranked.source, n // {BLOCK_DOCS} + 1 AS block, n % {BLOCK_DOCS} AS place FROM ranked)
SELECT doc_id, blocks.source, block, place, (block - 1) * period // quota AS release, (block * period + quota - 1) // quota AS deadline,
  (block - 1) // quota * period + slot AS slot
FROM blocks JOIN slots ON blocks.source IS NOT DISTINCT FROM slots.source AND (block - 1) % quota = turn
"""
