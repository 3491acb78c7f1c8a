"""What the corpus operators share: saved intermediate tables, folds, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.sources.scratch import discard, saved, scratch_dir

__all__ = ["clip_long", "discard", "held_out", "join_copies", "saved", "scratch_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold kept out of training: crc32 of the id as text leaves 1 modulo 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def join_copies(rows: DataFrame, groups: DataFrame, key: str | list[str], total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``groups``, one row for each ``key`` (a column or several), whose column ``copies`` (dropped) counts the rows with that key.

    ``total``: the sum of ``copies``, where the caller has it.

    Keys that hold over a thousandth of all rows, of which there are under 1,000, meet their rows by broadcast;
    all others by a shuffle in which no key is hot.
    """
    total = total if total is not None else groups.agg(F.sum("copies")).first()[0] or 0
    large = F.col("copies") * 1000 > total
    hot = F.broadcast(groups.where(large).drop("copies"))  # under 1,000 rows
    rest = rows.join(hot.select(key if isinstance(key, str) else [*key]), key, "left_anti").join(groups.where(~large).drop("copies"), key)
    return rows.join(hot, key).unionByName(rest)


def clip_long(value: int) -> int:
    """An unsigned 64-bit number as the signed long with the same bits."""
    return value - (1 << 64) if value >= 1 << 63 else value
