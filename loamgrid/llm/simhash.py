"""Op 3: near-duplicate groups by SimHash fingerprints and pigeonring filtering.

A fingerprint's 64 bits are cut into ``segments`` on a ring.  If two
fingerprints differ in at most ``bits`` bits, then from some segment on every
chain of consecutive segments, of any length L, holds at most
L * bits / segments differing bits (the pigeonring principle).  Candidates come
from chains of ``chain`` segments: each fingerprint is listed under its own
bits of every chain and looked up under all variants that the chain's budgets allow
(five segments, four bits, chain two: the first segment equal, the second
with one differing bit at most, so 26 key bits and 14 lookups a segment).
Longer chains then prune, and only what is left meets the full Hamming check.

Equal fingerprints are one node, so copies never pair up.  Keys listed by very many different fingerprints are
not joined: their fingerprints are tied to two centres each, and where a key then still holds
fingerprints of several components, its chain grows by a segment, which splits the key (a pair that passes the budgets from a
segment on passes them for every length).  A group of near copies is one component by then
and goes no further, so that it never meets pair by pair.  What is left crowded at the longest
chain is compared in blocks of bounded size, each of which returns a spanning forest.

Up to a billion fingerprints a chain of two costs least; beyond, three segments (38 key bits at 266
lookups a segment) are taken.  Every setting finds the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.shared import clip_long, join_copies, saved, table
from loamgrid.operators.graph import connected_components

#: Fingerprints beyond which keys of three segments cost less than keys of two.
_LARGE = 1 << 30
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; zero without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip((end - size)[:n].tolist(), end[k - 1 :].tolist())], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [clip_long(fingerprint(x.as_py(), shingle)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], schema=_SCHEMA)

    return run


class Ring:
    """Segments of a 64-bit ring and the budgets of chains of them."""

    def __init__(self, bits: int, segments: int, chain: int) -> None:
        if not 0 < bits < segments <= 64 or not 0 < chain <= segments:
            raise ValueError("need bits < segments <= 64 and chain <= segments")
        self.bits, self.segments, self.chain = bits, segments, chain
        edge = [64 * i // segments for i in range(segments + 1)]
        self.places = [range(edge[i], edge[i + 1]) for i in range(segments)]

    def budget(self, length: int) -> int:
        return length * self.bits // self.segments

    def mask(self, first: int, length: int) -> int:
        return sum(1 << b for j in range(first, first + length) for b in self.places[j % self.segments])

    def variants(self, first: int) -> list[int]:
        """All differences that the budgets of the chain from ``first`` allow."""
        found = [0]
        for length in range(1, self.chain + 1):
            places = self.places[(first + length - 1) % self.segments]
            level = found
            for _ in range(self.budget(length)):
                level = list({d | 1 << b for d in level for b in places if not d >> b & 1})
                found = [*found, *(d for d in level if d.bit_count() <= self.budget(length))]
            found = list(dict.fromkeys(found))
        return sorted(found, key=lambda d: (d.bit_count(), d))


def _long(value: int) -> Column:
    return F.lit(clip_long(value)).cast("long")


def _near(ring: Ring, a: str, b: str, first: str, chain: int) -> Column:
    """Chains longer than ``chain`` from segment ``first`` within their budgets, then the whole ring."""
    differing = F.col(a).bitwiseXOR(F.col(b))
    budgets = [F.bit_count(differing.bitwiseAND(_mask(ring, F.col(first), n))) <= ring.budget(n) for n in range(chain + 1, ring.segments)]
    return reduce(lambda x, y: x & y, [*budgets, F.bit_count(differing) <= ring.bits])


def _mask(ring: Ring, first: Column, length: int) -> Column:
    return F.get(F.array(*[_long(ring.mask(i, length)) for i in range(ring.segments)]), first)


def _lookups(ring: Ring, first: int) -> Column:
    """All keys of the chain from ``first`` under which a near fingerprint can be listed."""
    mask = _long(ring.mask(first, ring.chain))
    differences = F.array(*[_long(d) for d in ring.variants(first)])
    return F.transform(differences, lambda d: F.struct(F.lit(first).alias("first"), F.col("fp").bitwiseXOR(d).bitwiseAND(mask).alias("key"), d.alias("d")))


def _longer(ring: Ring, chain: int) -> Column:
    """All differences within budget of a lookup whose difference ``d`` is known for one segment less than ``chain``."""

    def within(places: range) -> list[int]:
        return [sum(1 << b for b in c) for n in range(ring.budget(chain) + 1) for c in combinations(places, n)]

    more = F.array(*[F.array(*map(_long, within(ring.places[(i + chain - 1) % ring.segments]))) for i in range(ring.segments)])
    fits = F.filter(F.get(more, F.col("first")), lambda v: F.bit_count(v) + F.bit_count("d") <= ring.budget(chain))
    return F.transform(fits, lambda v: v.bitwiseOR(F.col("d")))


def _forest(bits: int):
    """Links of one block pair, reduced to a spanning forest: (fp, root)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        fps, at = np.unique(block["fp"].to_numpy(), return_inverse=True)
        listed = block["listed"].to_numpy(bool)
        rows, cols = np.unique(at[listed]), np.unique(at[~listed])
        close = np.bitwise_count(fps[rows].view(np.uint64)[:, None] ^ fps[cols].view(np.uint64)[None, :]) <= bits
        root = np.arange(len(fps))
        while True:
            old = root.copy()
            low = np.where(close, root[cols][None, :], len(fps)).min(1, initial=len(fps))
            root[rows] = np.minimum(root[rows], low)
            low = np.where(close, root[rows][:, None], len(fps)).min(0, initial=len(fps))
            root[cols] = np.minimum(root[cols], low)
            if (old == root).all():
                break
        linked = root != np.arange(len(fps))
        return pd.DataFrame({"u": fps[linked], "v": fps[root[linked]]})

    return run


def _met(listed: DataFrame, asked: DataFrame, ring: Ring, chain: int) -> DataFrame:
    """Links between listed and asking fingerprints of equal keys."""
    a, b = listed.alias("a"), asked.alias("b")
    met = a.hint("merge").join(b, (F.col("a.first") == F.col("b.first")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _near(ring, "a.fp", "b.fp", "a.first", chain))
    return met.select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))


def links(fps: DataFrame, ring: Ring, hot: int = 256, block: int = 512) -> DataFrame:
    """Edges u, v between fingerprints (column ``fp``, distinct) within the ring's bits; enough for connectivity.

    Keys listed by ``hot`` or more fingerprints take longer chains, see above; all other keys give every link.
    """
    at = ["first", "key"]
    own = [F.struct(F.lit(i).alias("first"), F.col("fp").bitwiseAND(_long(ring.mask(i, ring.chain))).alias("key")) for i in range(ring.segments)]
    listed = fps.select(F.explode(F.array(*own)).alias("at"), "fp").select("at.*", "fp")
    asked = fps.select(F.explode(F.concat(*[_lookups(ring, i) for i in range(ring.segments)])).alias("at"), "fp").select("at.*", "fp")
    # Spark's estimates don't see how many rows explode gives: by them it would broadcast the lookups of up to 10 MB of fingerprints
    listed, asked = listed.hint("merge"), asked.hint("merge")
    crowd = lambda rows: saved(rows.groupBy(*at).agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where(F.col("n") >= hot), "crowded", {"keys": F.count("*")})
    crowded = crowd(listed)
    found = _met(listed.join(crowded, at, "left_anti"), asked, ring, ring.chain)
    if not crowded.seen["keys"]:
        return found.distinct()
    listed, asked = listed.join(crowded.select(*at), at), asked.join(crowded.select(*at), at)
    stars = listed.join(crowded, at).select("fp", F.explode(F.array("low", "high")).alias("v")).where((F.col("fp") != F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= ring.bits))
    found = saved(found.union(stars.select(F.greatest("fp", "v").alias("u"), F.least("fp", "v").alias("v"))).distinct(), "links")
    parts = connected_components(found).withColumnRenamed("id", "fp")
    parts = saved(fps.join(parts.hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")), "parts")
    for chain in range(ring.chain + 1, ring.segments + 1):
        members = listed.select(*at, "fp").union(asked.select(*at, "fp")).hint("merge").join(parts, "fp")
        several = saved(members.groupBy(*at).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(*at), "several", {"keys": F.count("*")})
        if not several.seen["keys"]:
            break
        listed, asked = listed.join(several, at), asked.join(several, at)
        if chain == ring.segments:
            found = found.union(_blocks(listed, asked, ring, block))
            break
        mask = _mask(ring, F.col("first"), chain)
        listed = saved(listed.select("first", F.col("fp").bitwiseAND(mask).alias("key"), "fp").distinct(), "listed")
        asked = asked.select("first", "fp", F.explode(_longer(ring, chain)).alias("d"))
        asked = saved(asked.select("first", F.col("fp").bitwiseXOR(F.col("d")).bitwiseAND(mask).alias("key"), "d", "fp").join(listed.select(*at).distinct(), at, "left_semi"), "asked")
        crowded = crowd(listed)
        found = found.union(_met(listed.join(crowded, at, "left_anti"), asked, ring, chain))
        listed, asked = listed.join(crowded.select(*at), at), asked.join(crowded.select(*at), at)
    return found.distinct()


def _blocks(listed: DataFrame, asked: DataFrame, ring: Ring, block: int) -> DataFrame:
    """Links of crowded keys as spanning forests of pairs of blocks; each side of a key is dealt over blocks of about ``block``."""
    at = ["first", "key"]
    size = listed.groupBy(*at).agg(F.count("*").alias("n_listed")).join(asked.groupBy(*at).agg(F.count("*").alias("n_asked")), at)
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    part = lambda n: F.pmod(F.xxhash64("fp"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = listed.join(size, at).select(*at, part("n_listed").alias("i"), every("n_asked").alias("j"), "fp", F.lit(True).alias("listed"))
    right = asked.join(size, at).select(*at, every("n_listed").alias("i"), part("n_asked").alias("j"), "fp", F.lit(False).alias("listed"))
    return left.union(right).groupBy(*at, "i", "j").applyInPandas(_forest(ring.bits), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, segments: int = 5, chain: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    ``docs`` needs doc_id and text; other columns are ignored.  Texts without
    words (null, empty) have fingerprint zero and link like any other.
    component_id is the smallest doc_id within any number of links, itself
    included.  Repeated rows stay.  Rows without doc_id get the component
    of their fingerprint, null where only such rows hold it, and link no others.
    ``chain``: segments of a key, by default 2, or 3 for more than a billion fingerprints.
    """
    each = saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    nodes = saved(each.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "nodes")
    fps = nodes.where("node is not null").select("fp")
    chain = chain or (2 if fps.count() <= _LARGE else 3)
    parts = connected_components(links(fps, Ring(bits, segments, chain))).select(F.col("id").alias("fp"), "component")
    parts = nodes.join(parts, "fp")
    least = parts.groupBy("component").agg(F.min("node").alias("component_id"))
    moved = parts.join(least, "component").select("fp", "component_id")
    group = saved(nodes.join(moved, "fp", "left").select("fp", "copies", F.coalesce("component_id", "node").alias("component_id")), "groups")
    return join_copies(each, group, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
