"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.sources.scratch import discard, saved


def _state() -> dict[str, Column]:
    """Number and order-free digest of the edges between two nodes."""
    between = F.col("u") > F.col("v")
    return {"n": F.count_if(between), "digest": F.bit_xor(F.when(between, F.xxhash64("u", "v")))}


def stars(edges: DataFrame, u: str = "u", v: str = "v") -> tuple[DataFrame, DataFrame | None]:
    """The edges as u >= v, and a star (u, its component's smallest node v) of each component; None if no edge joins two nodes. Both are saved tables.

    Alternating star contraction: each round ties every node's larger, then
    its smaller neighbours to the smallest one it knows, until each component is
    a star around its smallest node (a logarithmic number of rounds in
    practice).  A node's neighbours are never gathered: minima are
    pre-aggregated, and the joins that follow can be split by Spark where a
    node is hot.  Each round is written to the shared folder, which cuts the
    lineage, and the one before is deleted; what tells that nothing has changed is observed
    as it is written.  No round broadcasts a side, which would go through the driver's memory.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    start = saved(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", _state())
    if not start.seen["n"]:
        return start, None
    now, state, last = start.where("u > v"), start.seen, None
    while True:
        low = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("low"))
        far = now.join(low.hint("merge"), "v", "left").select("u", F.coalesce("low", "v").alias("v")).distinct()
        low = far.groupBy("u").agg(F.min("v").alias("low"))
        near = far.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v")
        now = saved(near.union(low).distinct(), "stars", _state())
        if last is not None:
            discard(last)
        if now.seen == state:
            return start, now
        last, state = now, now.seen


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Columns id, component (smallest id of the component) for every end of an edge, by ``stars``.

    Self-edges give single-node components; null ends are dropped.
    """
    start, now = stars(edges, u, v)
    if now is None:
        now = start.where("u > v")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        start.select(F.col("v").alias("id")).union(start.where("u = v").select("u")).distinct().join(now.select(F.col("u").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
    )
