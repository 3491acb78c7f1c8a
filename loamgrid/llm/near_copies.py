"""Groups of near copies by word-shingle similarity, for the pipeline.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
The first links are op 3's: SimHash fingerprints, here of five-word shingles, that pigeonring chains find within four bits.
These join copies and closest texts; texts of similarity 0.8 differ in about ten bits, which no ring lookup reaches, some
unrelated ones too.  So further candidates share one of ``BANDS`` keys of ``ROWS`` minimum hashes each (two texts of
similarity 0.8 share one with probability 0.9998, more similar ones with more), of whose ``HASHES`` sketched
minima ``AGREE`` agree (missed by one in 100,000 at 0.8; pairs after the rounds agree in ``BITS_AGREE`` of ``BITS``
one-bit minima instead), and every link is then checked on the shingle sets themselves, held as 32-bit hashes; these are made anew, and only for texts in such pairs.

Texts with equal sets are one node.  In a few rounds nodes meet two centres of each of their keys, of which only those still
matter that hold several components: the node whose keys are most crowded, mostly the text that the others were made from, and any other; after that all pairs of nodes in a key that are not yet in one component are compared, so a
large group of near copies doesn't meet pair by pair, and no link between components is left out.

All these joins are merge joins: their sides grow with the corpus, and on a small one Spark would build and hold about a hundred
of them in the driver to broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.shared import clip_long, discard, join_copies, saved
from loamgrid.llm.simhash import Ring, fingerprint, links
from loamgrid.llm.words import Words, mix, slices, text_bytes, windows
from loamgrid.operators.graph import stars

SHINGLE = 5
BANDS, ROWS, HASHES, AGREE = 16, 4, 128, 84
#: One-bit minima of nodes that are still open after the rounds, and how many must agree (missed by one in 100,000 at 0.8).
BITS, BITS_AGREE = 1024, 880
_U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=_U64)).reshape(2, HASHES) | _U64(1)
_BIT_SEEDS = mix(np.arange(1001, 2 * BITS + 1001, dtype=_U64)).reshape(2, BITS) | _U64(1)
#: Op 3's settings: differing bits of a link, segments of the ring, segments of a key.
RING = (4, 5, 2)
_SKETCHED = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in order, and the n + 1 bounds of the rows; a text of fewer words is one shingle."""
    data, off = text_bytes(column)
    words = Words(pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(_LOWER[data])))
    hashes, count = words.hashes(), np.diff(words.first)
    found = windows(hashes, width, width)
    inside = np.arange(len(found)) + width <= words.ends()[: len(found)]
    all_, rows = [found[inside]], [words.row[: len(found)][inside]]
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        if len(short):
            all_.append(windows(hashes, n, n)[words.first[short]])
            rows.append(short)
    grams, row = np.concatenate(all_), np.concatenate(rows)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(column) + 1))


def names_of(grams: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A number for each row's set of shingles."""
    node, full = np.zeros(len(edge) - 1, _U64), np.flatnonzero(np.diff(edge))
    if len(full):
        node[full] = np.add.reduceat(mix(grams), edge[full])
    return node


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            grams, edge = shingles(part.column("text"))
            n, full = part.num_rows, np.flatnonzero(np.diff(edge))
            node, least = names_of(grams, edge), np.zeros((HASHES, n), _U64)
            if len(full):
                for k in range(HASHES):
                    least[k, full] = np.minimum.reduceat(grams * _SEEDS[0, k] + _SEEDS[1, k], edge[full])
            least = mix(least)
            keys = np.empty((n, BANDS), _U64)
            for b in range(BANDS):
                key = np.full(n, b + 1, _U64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    key = mix(key * _U64(0x9E3779B97F4A7C15) + least[k])
                keys[:, b] = key
            nibbles = (least & _U64(15)).reshape(HASHES // 16, 16, n) << (_U64(4) * np.arange(16, dtype=_U64))[None, :, None]
            sketch = np.bitwise_or.reduce(nibbles, axis=1).T
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).reshape(-1).view(np.int64)))
            fps = pa.array([clip_long(fingerprint(x.as_py(), SHINGLE)) for x in part.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), fps, pa.array(node.view(np.int64)), lists(keys), lists(sketch)], schema=_SKETCHED)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's node and one bit of each of ``BITS`` minima."""
    for batch in batches:
        for part in slices(batch):
            grams, edge = shingles(part.column("text"))
            full = np.flatnonzero(np.diff(edge))
            bits = np.zeros((part.num_rows, BITS // 64), _U64)
            if len(full):
                for k in range(BITS):
                    bit = mix(np.minimum.reduceat(grams * _BIT_SEEDS[0, k] + _BIT_SEEDS[1, k], edge[full])) & _U64(1)
                    bits[full, k // 64] |= bit << _U64(k % 64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names_of(grams, edge).view(np.int64)), lists], names=["node", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's node and its set of shingles as sorted 32-bit hashes."""
    for batch in batches:
        for part in slices(batch):
            grams, edge = shingles(part.column("text"))
            sets = [np.unique((grams[a:b] >> _U64(32)).astype("<u4")).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names_of(grams, edge).view(np.int64)), pa.array(sets, pa.binary())], names=["node", "grams"])


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for a, b in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                close.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(close, pa.bool_()))

    return run


def _agree(a: str, b: str) -> Column:
    """Minima of the two sketches that agree in their four bits."""

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return HASHES - reduce(lambda x, y: x + y, [differing(i) for i in range(HASHES // 16)])


def _bits_agree(a: str, b: str) -> Column:
    return BITS - reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)])


#: Keys that a node goes by in each round against centres: the first key alone joins most of a large group, the next ones the rest.
_STEPS = ((0, 1), (1, 4), (4, BANDS), (0, BANDS))


def near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id and component_id of every row: the smallest doc_id within any number of links of ``percent`` similarity or more.

    ``docs`` needs doc_id and text; other columns are ignored.  Words are as in ``words``, ASCII letters in lower case.  A text of
    fewer than five words is one shingle; those without words (null, empty) are equal.  Repeated rows stay.  Rows without doc_id
    are no one's smallest.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    each = saved(docs.select(F.xxhash64("text").alias("doc_id"), "text", F.col("doc_id").alias("id")).mapInArrow(_sketch, "doc_id long, id long, fp long, node long, keys array<long>, sketch array<long>").withColumnsRenamed({"doc_id": "body", "id": "doc_id"}), "sketches")
    nodes = saved(each.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("body").alias("body"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    owners = saved(each.select("doc_id", "node"), "owners")
    discard(each)
    sketches, many = nodes.select("node", "sketch"), {"rows": F.count("*")}

    def texts_of(some: DataFrame) -> DataFrame:
        """One text for each of these nodes, of which ``some`` may repeat some."""
        bodies = nodes.join(some.hint("merge"), "node", "left_semi").select("body")
        return docs.withColumn("body", F.xxhash64("text")).join(bodies.hint("merge"), "body", "left_semi").dropDuplicates(["body"]).select("text")

    def links_of(pairs: DataFrame, name: str) -> DataFrame | None:
        """Those of the pairs (u, v) of nodes whose sets are similar; None without any."""
        pairs = saved(pairs.select("u", "v").distinct(), "pairs_" + name, many)
        if not pairs.seen["rows"]:
            return None
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
        sets = saved(texts_of(ends).mapInArrow(_sets, "node long, grams binary"), "sets_" + name)
        grams = lambda end, name: sets.select(F.col("node").alias(end), F.col("grams").alias(name)).hint("merge")
        met = pairs.join(grams("u", "a_grams"), "u").join(grams("v", "b_grams"), "v")
        found = saved(met.select("u", "v", "a_grams", "b_grams").mapInArrow(_similar(percent), "u long, v long"), "links_" + name, many)
        discard(pairs, sets)
        return found if found.seen["rows"] else None

    def joined(parts: DataFrame, links: DataFrame | None) -> DataFrame:
        """``parts`` (node, part, keys, crowd, sketch) after these links."""
        if links is None:
            return parts
        part = lambda end, name: parts.select(F.col("node").alias(end), F.col("part").alias(name)).hint("merge")
        across = links.join(part("u", "from"), "u").join(part("v", "to"), "v")
        edges, moved = stars(across.where("from <> to").select("from", "to"), "from", "to")
        if moved is None:
            discard(edges, links)
            return parts
        whole = moved.select(F.col("u").alias("part"), F.col("v").alias("component"))
        out = saved(parts.join(whole.hint("merge"), "part", "left").select("node", F.coalesce("component", "part").alias("part"), "keys", "crowd", "sketch"), "parts")
        discard(parts, links, edges, moved)
        return out

    def keyed(parts: DataFrame, first: int, last: int) -> DataFrame:
        return parts.select("node", "part", "crowd", F.explode(F.slice("keys", first + 1, last - first)).alias("key"))

    def sketched(rows: DataFrame, node: str, name: str) -> DataFrame:
        return rows.join(sketches.select(F.col("node").alias(node), F.col("sketch").alias(name)).hint("merge"), node)

    # how crowded a node's keys are: the text that a group's members were made from has kept all keys that most of them kept
    each_key, copied = nodes.select("node", F.explode("keys").alias("key")), {"copies": F.sum(F.when(F.col("copies") > 1, F.col("copies")))}
    crowds = saved(each_key.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").withColumn("crowd", F.col("copies")), "crowds", copied)
    crowded = join_copies(each_key, crowds, "key", crowds.seen["copies"] or 0).groupBy("node").agg(F.sum("crowd").alias("crowd"))
    parts = saved(nodes.select("node", F.col("node").alias("part"), "keys", "sketch").join(crowded.hint("merge"), "node", "left").select("node", "part", "keys", F.coalesce("crowd", F.lit(0)).alias("crowd"), "sketch"), "parts")
    discard(crowds)

    # fingerprints within the ring's bits; nodes of one fingerprint meet its first
    marks = saved(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("copies")), "marks", copied)
    end = lambda c: marks.select(F.col("fp").alias(c), F.col("first").alias("node_" + c)).hint("merge")
    close = links(marks.select("fp"), Ring(*RING)).join(end("u"), "u").join(end("v"), "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    equal = join_copies(nodes.select("fp", "node"), marks.where("copies > 1"), "fp", marks.seen["copies"] or 0).where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    parts = joined(parts, links_of(close.union(equal), "simhash"))
    discard(marks)

    for turn, (first, last) in enumerate(_STEPS):
        # two centres for each key that still holds several parts, its most crowded node and any other; only nodes of other parts meet them
        listed = keyed(parts, first, last)
        some, other = F.xxhash64("node", F.lit(turn)), F.xxhash64("node", F.lit(-1 - turn))
        c, d = F.max(F.struct("crowd", some.alias("by"), "node", "part")), F.min(F.struct(other.alias("by"), "node", "part"))
        open_ = listed.groupBy("key").agg(c.alias("c"), d.alias("d"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
        open_ = open_.select("key", *(F.col(f"{x}.{y}").alias(f"{x}{z}") for x in "cd" for y, z in (("node", ""), ("part", "_part"))))
        open_ = sketched(sketched(open_, "c", "c_sketch"), "d", "d_sketch")
        # nodes have their sketches with them, so that only pairs whose sketches agree come out of the join
        mine = parts.select("node", "part", "sketch", F.explode(F.slice("keys", first + 1, last - first)).alias("key"))
        by_c, by_d = ((F.col("part") != F.col(x + "_part")) & (_agree("sketch", x + "_sketch") >= AGREE) for x in "cd")
        l, o = mine.alias("l"), open_.alias("o")
        met = l.join(o.hint("merge"), (F.col("l.key") == F.col("o.key")) & (by_c | by_d))
        us = F.array_compact(F.array(F.when(by_c, F.col("c")), F.when(by_d, F.col("d"))))
        parts = joined(parts, links_of(met.select(F.explode(us).alias("u"), F.col("node").alias("v")), f"centres{turn}"))

    # what is still open takes more bits along; a pair comes from the first key that both have
    listed = parts.select("node", "part", "keys", F.posexplode("keys").alias("i", "key"))
    open_ = listed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    still = saved(listed.join(open_.hint("merge"), "key", "left_semi"), "still")
    bits = texts_of(still.select("node").distinct()).mapInArrow(_bits, "node long, bits array<long>")
    left = saved(still.join(bits.hint("merge"), "node"), "open")
    a, b = left.alias("a"), left.alias("b")
    earlier = F.arrays_overlap(F.slice("a.keys", F.lit(1), F.col("a.i")), F.slice("b.keys", F.lit(1), F.col("a.i")))
    close = _bits_agree("a.bits", "b.bits") >= BITS_AGREE
    pairs = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.part") < F.col("b.part")) & close & ~earlier)
    parts = joined(parts, links_of(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), "open"))
    group = saved(parts.select("node", F.col("part").alias("group")).join(nodes.select("node", "doc_id", "copies").hint("merge"), "node"), "groups", {"copies": F.sum("copies")})
    least = group.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    discard(nodes, parts, still, left)
    return join_copies(owners, group.join(least.hint("merge"), "group").select("node", "copies", "component_id"), "node", group.seen["copies"] or 0).select("doc_id", "component_id")
