"""Merkle manifest of a table: digests of all rows in trees that prove each row's place under one root.

Leaves of one group (here a language) ascend by key; two consecutive nodes have one parent, an odd last one a parent of its
own, up to the group's root; the groups' roots form a last tree in the same way.  H is the lowercase hex SHA-256
of its inputs in a row, digests as hex text.

A tree is cut into aligned blocks of ``2 ** height`` leaves.  A block is one row: its digests lie in van Emde Boas order
(the upper half of the levels first, then each lower subtree, each of them stored likewise), so a walk from a leaf to the
block's root touches few cache lines whatever their size.  The roots of the blocks are the leaves of the next
level's blocks, until one block is left.  Blocks are the unit of all shuffles; none grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamgrid.llm.shared import saved, table

#: Levels of a block below its root: 1,024 leaves, 64 KB of digests.
HEIGHT = 10
#: A step of a path: 0 no sibling, 1 a left one, 2 a right one; then its digest.
_STEP = 33


@lru_cache(maxsize=64)
def layout(height: int) -> list[np.ndarray]:
    """Address of every node of a complete tree in van Emde Boas order, by depth and index.

    A tree of L levels stores its upper L // 2 levels first and then its lower subtrees one by one.  For a depth at which lower
    subtrees begin, the address is that of the upper tree's root, plus the upper tree's size, plus the subtree's number times its size.
    """
    above, upper, lower = [0] * (height + 1), [0] * (height + 1), [0] * (height + 1)

    def split(depth: int, levels: int) -> None:
        if levels > 1:
            top = levels // 2
            at = depth + top
            above[at], upper[at], lower[at] = depth, (1 << top) - 1, (1 << levels - top) - 1
            split(depth, top)
            split(at, levels - top)

    split(0, height + 1)
    found = [np.zeros(1, np.int64)]
    for d in range(1, height + 1):
        index = np.arange(1 << d)
        found.append(found[above[d]][index >> (d - above[d])] + upper[d] + (index & upper[d]) * lower[d])
    return found


def height_of(total: int, height: int) -> int:
    """Levels below the root of a block of a level with ``total`` nodes: ``height``, or as many as it needs if it is the tree's uppermost."""
    return min(height, max(0, (total - 1).bit_length()))


def _parent(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def store(leaves: list[bytes], height: int) -> bytes:
    """The block of these leaves: its digests by address, zeros where no node is. Its root comes first."""
    at, out = layout(height), bytearray(32 * ((2 << height) - 1))
    for depth in range(height, -1, -1):
        for place, digest in zip(at[depth].tolist(), leaves, strict=False):
            out[32 * place : 32 * place + 32] = digest
        if depth:
            leaves = [_parent(leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return bytes(out)


def walk(nodes: bytes, leaf: int, n: int, height: int) -> bytes:
    """The steps from a leaf of a block with ``n`` leaves to its root."""
    at, steps = layout(height), []
    for depth in range(height, 0, -1):
        sibling = leaf ^ 1
        if sibling < n:
            place = 32 * int(at[depth][sibling])
            steps += [b"\1" if sibling < leaf else b"\2", nodes[place : place + 32]]
        else:
            steps.append(bytes(_STEP))
        leaf, n = leaf >> 1, (n + 1) >> 1
    return b"".join(steps)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf gives with the siblings of a path."""
    for i in range(0, len(path), _STEP):
        side, digest = path[i], path[i + 1 : i + _STEP]
        leaf = _parent([leaf] if not side else [digest, leaf] if side == 1 else [leaf, digest])
    return leaf


def proof_digest(path: bytes) -> str:
    """H of a path's siblings."""
    return sha256("".join(path[i + 1 : i + _STEP].hex() for i in range(0, len(path), _STEP) if path[i]).encode()).hexdigest()


def row_digest(*columns: Column) -> Column:
    """H of the columns: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n``: the rows before this one with its group, in a partition sorted by group."""
    held, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("grp")
        code = group.dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n = np.arange(len(code)) - np.repeat(begin, np.diff(np.r_[begin, len(code)]))
        if group[0].as_py() == held:
            n[: begin[1] if len(begin) > 1 else len(n)] += count
        held, count = group[len(group) - 1].as_py(), int(n[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, "n"])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, their place in the order within ``grp`` (a string, not null), and ``total``, the group's size.

    Rows are dealt by range; equal ones, which may be many, by their place in the input as well. Each partition numbers its
    groups, and running sums over the partitions' counts make the places whole.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order, "__tie"]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = dealt.drop("__tie").withColumn("part", F.spark_partition_id())
    numbered = saved(dealt.mapInArrow(_number, f"{', '.join(f'`{n}` {t}' for n, t in dealt.dtypes)}, n long"), "numbered")
    by = W.partitionBy("grp")
    before = F.sum("c").over(by.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts_ = numbered.groupBy("grp", "part").agg(F.count("*").alias("c")).select("grp", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(by).alias("total"))
    return numbered.join(parts_, ["grp", "part"]).select("*", (F.col("before") + F.col("n")).alias("rank")).drop("part", "n", "before")


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.Array]]:
    column = batch.column(name)
    for i in range(batch.num_rows):
        yield i, column[i].values


def _store(full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("total").to_pylist()
            nodes = [store(items.field("leaf").to_pylist(), height_of(total[i], full)) for i, items in _lists(batch, "items")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary()), pa.array([x[:32] for x in nodes], pa.binary())], names=[*batch.schema.names, "nodes", "root"])

    return run


def _blocks(leaves: DataFrame, payload: list[str], height: int) -> DataFrame:
    item = F.struct((F.col("rank") % (1 << height)).alias("place"), "leaf", *payload)
    items = F.sort_array(F.collect_list(item))  # 2 ** height at most
    rows = leaves.groupBy("grp", F.shiftright("rank", height).alias("block")).agg(F.first("total").alias("total"), items.alias("items"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", nodes binary, root binary"
    return saved(rows.mapInArrow(_store(height), schema), "merkle")


def _paths(full: int):
    """The path of each leaf of the blocks: grp, block (the leaf's place in its level), above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, block, total, nodes, above = (batch.column(c).to_pylist() for c in ("grp", "block", "total", "nodes", "above"))
            for i, items in _lists(batch, "items"):
                n, height = len(items), height_of(total[i], full)
                paths = [walk(nodes[i], j, n, height) + above[i] for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([grp[i]] * n), pa.array(np.arange(n) + (block[i] << full)), pa.array(paths, pa.binary())], names=["grp", "block", "above"])

    return run


class Tree(NamedTuple):
    """The blocks of one tree a group, from the leaves up: grp, block, total (nodes of the level), items, nodes, root."""

    levels: list[DataFrame]
    height: int

    def _last(self, blocks: DataFrame, yes: bool = True) -> DataFrame:
        """Blocks that are the uppermost of their tree, or all others."""
        return blocks.where((F.col("total") <= 1 << self.height) == yes)

    def roots(self) -> DataFrame:
        """grp, root."""
        done = [self._last(b).select("grp", "root") for b in self.levels]
        out = done[0]
        for more in done[1:]:
            out = out.union(more)
        return out

    def under(self, above: DataFrame) -> DataFrame:
        """The lowest blocks with ``above``: the steps from their root on, ``above`` (grp, above) being those from each tree's root."""
        upper = None
        for blocks in reversed(self.levels):
            out = self._last(blocks).join(above, "grp")
            if upper is not None:
                out = out.unionByName(self._last(blocks, False).join(upper, ["grp", "block"]))
            upper = self.paths(out)
        return out


    def paths(self, under: DataFrame) -> DataFrame:
        """grp, block (a leaf's place), above: the steps from each leaf of these blocks on."""
        return under.select("grp", "block", "total", "items", "nodes", "above").mapInArrow(_paths(self.height), "grp string, block long, above binary")


def grow(leaves: DataFrame, payload: list[str] | None = None, height: int = HEIGHT) -> Tree:
    """The tree of each group over its leaves: grp, rank, total, leaf, and columns that the lowest blocks carry along."""
    full, levels = 1 << height, [_blocks(leaves, payload or [], height)]
    while (levels[-1].agg(F.max("total")).first()[0] or 0) > full:
        roots = levels[-1].where(F.col("total") > full)
        up = roots.select("grp", F.col("block").alias("rank"), F.shiftright(F.col("total") + (full - 1), height).alias("total"), F.col("root").alias("leaf"))
        levels.append(_blocks(up, [], height))
    return Tree(levels, height)


class Manifest(NamedTuple):
    """A tree for each group, one tree over their roots, and its root (None without rows)."""

    groups: Tree
    top: Tree
    #: grp, above: the steps from each group's root to the root.
    above: DataFrame
    root: str | None


def build(rows: DataFrame, order: list[str], payload: list[str] | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of rows with ``grp`` (its text order is the groups'), ``leaf`` and the columns of ``order``."""
    groups = grow(ranked(rows, order), payload, height)
    subroots = saved(ranked(groups.roots().select(F.col("grp").alias("named"), F.lit("").alias("grp"), F.col("root").alias("leaf")), ["named"]), "subroots")
    top = grow(subroots, None, height)
    steps = top.paths(top.under(top.roots().select("grp", F.lit(b"").alias("above"))))
    above = saved(steps.join(subroots.select(F.col("rank").alias("block"), "named"), "block").select(F.col("named").alias("grp"), "above"), "above")
    root = top.roots().first()
    return Manifest(groups, top, above, root.root.hex() if root else None)


def _audit(full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, nodes, above, subroot = (batch.column(c).to_pylist() for c in ("total", "nodes", "above", "subroot"))
            for i, items in _lists(batch, "items"):
                n, height = len(items), height_of(total[i], full)
                leaf, other = items.field("leaf").to_pylist(), items.field("other").to_pylist()
                paths = [walk(nodes[i], j, n, height) + above[i] for j in range(n)]
                folded = [fold(o or x, p).hex() for x, o, p in zip(leaf, other, paths, strict=True)]
                columns = [items.field("id"), pa.array([x.hex() for x in leaf]), pa.array([subroot[i].hex()] * n), pa.array([proof_digest(p) for p in paths]), pa.array(folded)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return run


def audit(docs: DataFrame, tampered: Column, changed: Column, height: int = HEIGHT) -> DataFrame:
    """Every row's leaf, its proof, and the root that the proof gives for the row as it is now.

    ``docs``: doc_id, source, lang, n_chars, text; other columns are ignored.  A row now holds ``changed`` as n_chars where
    ``tampered`` is true.  Groups are languages; null comes first, and an empty one is a language like any other.
    Within one, null doc_ids come first, and rows that share a doc_id go by their digests; repeated rows have a leaf
    each.  The proof of a lone row is that of no siblings.  No rows give no rows.
    """
    others = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaf, now = (row_digest(*others, n, F.col("text")) for n in (F.col("n_chars"), changed))
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = saved(docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf.alias("leaf"), F.when(tampered, now).alias("other")), "leaves")
    manifest = build(rows, ["id", "leaf"], ["id", "other"], height)
    subroots = manifest.groups.roots().withColumnRenamed("root", "subroot")
    found = manifest.groups.under(manifest.above).join(subroots, "grp").select("total", "items", "nodes", "above", "subroot")
    found = found.mapInArrow(_audit(height), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.select("doc_id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(manifest.root)).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where 7 divides the id's crc32, the row now holds one character more."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return audit(docs, hit, F.col("n_chars") + 1)


_LEAF = "sha256(concat({}))".format(", ".join(f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')" for c in ("doc_id", "source", "lang", "{n}", "text")))
#: An unsigned crc32: the bytes of the id, eight shifts behind each; -1 marks a shift.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: [ord(substr(CAST(doc_id AS VARCHAR), i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE listed AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS grp, {_LEAF.format(n='n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(n='(n_chars + 1)')} END AS other FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM listed),
trees AS (SELECT grp, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM leaves
  UNION ALL SELECT grp, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM trees WHERE n > 1 GROUP BY grp, level, i // 2),
nodes AS MATERIALIZED (SELECT * FROM trees),
subroots AS MATERIALIZED (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS i FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2),
top_nodes AS MATERIALIZED (SELECT * FROM tops),
steps AS (
  SELECT l.r, p.level, p.i, s.h FROM leaves AS l JOIN nodes AS p ON p.grp = l.grp AND p.n > 1 AND p.i = l.i >> p.level LEFT JOIN nodes AS s ON s.grp = p.grp AND s.level = p.level AND s.i = xor(p.i, 1)
  UNION ALL SELECT l.r, 100 + p.level, p.i, s.h FROM leaves AS l JOIN subroots AS g ON g.grp = l.grp JOIN top_nodes AS p ON p.n > 1 AND p.i = g.i >> p.level LEFT JOIN top_nodes AS s ON s.level = p.level AND s.i = xor(p.i, 1)),
paths AS (SELECT r, list(CASE WHEN h IS NULL THEN 'N' WHEN i % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS path FROM steps GROUP BY r),
folded AS (SELECT l.*, coalesce(path, []) AS path, list_reduce(list_prepend(coalesce(other, leaf), coalesce(path, [])), lambda a, e: sha256(CASE e[1] WHEN 'L' THEN substr(e, 2) || a WHEN 'R' THEN a || substr(e, 2) ELSE a END)) AS folded_root
  FROM leaves AS l LEFT JOIN paths USING (r)),
root AS (SELECT h AS root FROM top_nodes WHERE n = 1)
SELECT f.doc_id, f.leaf, g.h AS subroot, root.root, sha256(coalesce(array_to_string(list_transform(f.path, lambda e: substr(e, 2)), ''), '')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM folded AS f JOIN subroots AS g USING (grp), root"""
