"""A corpus pipeline of five stages, each one operator of ``loamgrid.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  A stage works on every row that
its predecessor kept.  No stage reads anything but ``docs``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.language_id import identify_languages
from loamgrid.llm.near_copies import near_copies
from loamgrid.llm.packing import pack
from loamgrid.llm.pii import find_pii, redact
from loamgrid.llm.shared import join_copies, saved, table
from loamgrid.llm.source_mixing import mix_sources, root_quotas

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Files of the mixed corpus, at least; each holds a run of consecutive slots.
MIX_PARTS = 64


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter go. ``lang`` becomes the prediction. Rows without doc_id stay."""
    found = identify_languages(docs, extra=("text", "source", "n_chars"))
    return _columns(found.where("lang_pred <> 'und'").withColumnRenamed("lang_pred", "lang"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id (null last), then by hashes of its text and of the row.

    Near copies share 0.8 or more of their five-word shingles: op 3's SimHash gives the first links, minimum hashes those that four bits miss,
    and each is checked on the shingles. Rows that
    share a doc_id are judged by their own texts; a repeated row stays once.
    """
    rows = _columns(docs).withColumns({"__text": F.xxhash64("text"), "__row": F.xxhash64(*COLUMNS), "__id": F.coalesce("doc_id", F.lit(-1))})
    groups = near_copies(rows.select(F.col("__text").alias("doc_id"), "text"))
    groups = saved(groups.groupBy(F.col("doc_id").alias("__text"), "component_id").agg(F.count("*").alias("copies")), "text_groups", {"copies": F.sum("copies")})
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__text", "__row", "__id")
    first = join_copies(rows.select("doc_id", "__text", "__row", "__id"), groups, "__text", groups.seen["copies"] or 0).groupBy("component_id").agg(F.min(order).alias("first"))
    return _columns(rows.join(first.select("first.__row", "first.__id").hint("merge"), ["__row", "__id"], "left_semi").dropDuplicates(["__row", "__id"]))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    return _columns(redact(find_pii(docs)).withColumn("n_chars", F.length("text").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files, and rows in them, follow the slots."""
    mixed = mix_sources(docs)
    parts = max(MIX_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _columns(mixed.repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place"))


def _in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``order``: rows read from files by the number in the file's name, as Spark's writers give it, then by
    their number in the file, however Spark splits the files; any others by partition."""
    try:
        rows = docs.select("*", docs.metadataColumn("_metadata").alias("__from"))
    except AnalysisException:  # not read from files
        return docs.withColumn("order", F.monotonically_increasing_id())
    name = F.col("__from.file_name")
    number = F.coalesce(F.regexp_extract(name, r"^part-(\d{1,9})\b", 1).try_cast("long"), F.crc32(name.cast("binary")) % 1_000_000_000)
    return rows.select(*docs.columns, F.shiftleft(number, 33).bitwiseOR(F.col("__from.row_index")).alias("order"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    Each source's documents come in the order of the mix, and its share of the
    tokens is its weight there until a source has run out; then the others share what it leaves.
    """
    quotas = root_quotas(docs.groupBy("source").agg(F.count("*").alias("n")))
    return pack(_in_order(docs.select("doc_id", "source", "text")), shares=quotas.withColumnRenamed("quota", "share"), order="order")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: XXH64 fingerprints, learned models and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
