"""Manifests and proofs against a plain recursion."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loamgrid.llm import merkle
from tests.llm.conftest import SCHEMA


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, more=0):
    values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and the (side, sibling) steps of every leaf."""
    steps, level, owner = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for leaf, at in enumerate(owner):
            other = at ^ 1
            steps[leaf].append(None if other >= len(level) else (other < at, level[other]))
        owner = [at // 2 for at in owner]
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in groups[g]])
    root, above = tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        for r, low in zip(groups[g], trees[g][1], strict=True):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            now = leaf_of(r, 1 if hit else 0)
            for step in low + up:
                now = digest(now) if step is None else digest(step[1], now) if step[0] else digest(now, step[1])
            proof = digest(*(s[1] for s in low + up if s))
            out.append((r.doc_id, leaf_of(r), trees[g][0], root, proof, now, now == root))
    return sorted(out, key=str)


def audited(docs, height):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = merkle.audit(docs, hit, F.col("n_chars") + 1, height)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("height", [1, 3, 10])
def test_proofs_equal_the_recursion(spark, height):
    """Whole and partial blocks, lone rows, a language of null, ids that repeat and are null, and many equal rows."""
    rows = [(i * 37 % 1500, f"text {i}", ("en", "fr", None, "", "zü")[min(i % 17, 4)], f"s{i % 3}", i) for i in range(1300)]
    rows += [(7, "same", "en", None, None)] * 40 + [(None, None, "en", None, None), (9, "", "lone", "s", 0), (10, "x", "two", "s", 1), (21, "y", "two", "s", 1)]
    if height < 3:
        rows = rows[::12] + rows[-5:]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert audited(docs, height) == brute(docs.collect())


def test_many_groups_of_one_row(spark):
    docs = spark.createDataFrame([(i, "t", f"l{i}", "s", 1) for i in range(50)], SCHEMA)
    assert audited(docs, 2) == brute(docs.collect())


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(n)], SCHEMA)
    assert audited(docs, 10) == brute(docs.collect())


def test_odd_rows(spark, odd, nothing):
    assert audited(odd, 10) == brute(odd.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert audited(nothing, 10) == []


@pytest.mark.parametrize("height", range(12))
def test_layout_keeps_subtrees_together(height):
    """Every address is used once, and each subtree that a split makes fills one stretch."""
    at = merkle.layout(height)
    assert sorted(x for level in at for x in level.tolist()) == list(range(2 ** (height + 1) - 1))

    def stretch(depth, index, levels):
        own = [int(at[depth + d][(index << d) + i]) for d in range(levels) for i in range(1 << d)]
        assert sorted(own) == list(range(min(own), min(own) + len(own))) and own[0] == min(own)
        if levels > 1:
            top = levels // 2
            stretch(depth, index, top)
            for i in range(1 << top):
                stretch(depth + top, (index << top) + i, levels - top)

    stretch(0, 0, height + 1)
