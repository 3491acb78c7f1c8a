from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loamgrid.llm import substring_dedup
from loamgrid.llm.substring_dedup import remove_repeats
from tests.llm.test_llm_operators import brute_repeats


def test_repeats_cut_out_of_runs_equal_brute_force(spark):
    """Runs of which a window sees only a part, and which are named in one document but not in the other."""
    r, texts = random.Random(5), {}
    for longest in (4, 6, 8, 12, 70):
        for _ in range(24):
            words = []
            while len(words) < 150:
                words += [r.choice(["ra", "rb", "rc"])] * r.randint(1, longest)
            for _ in range(4):
                at = r.randrange(40)
                texts[len(texts)] = " ".join([*(f"w{r.randrange(99)}" for _ in range(r.randrange(4))), *words[at : at + r.randint(50, 100)], *(f"w{r.randrange(99)}" for _ in range(r.randrange(4)))])
    found = remove_repeats(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in found} == brute_repeats(texts)


def test_symbols_pass_the_jvm_packed(spark, monkeypatch):
    """A table between two steps holds no lists of symbols, words or windows, and no row for a window that stands once."""
    saved, seen = substring_dedup.saved, {}

    def noted(df, name):
        out = saved(df, name)
        seen.setdefault(name, []).append((dict(out.dtypes), out.count()))
        return out

    monkeypatch.setattr(substring_dedup, "saved", noted)
    words = [f"w{i}" for i in range(200)]
    texts = {0: " ".join(words), 1: " ".join(["x", *words[20:160]]), 2: " ".join(["y", *words[50:140], "z"]), 3: " ".join(words[100:]), 4: None}
    found = remove_repeats(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in found} == brute_repeats(texts)
    lists = {name for name, tables in seen.items() for types, _ in tables if any(t.startswith("array") for t in types.values())}
    assert lists == {"listed"} and len(seen["parse"]) > 1
    assert {seen["segments"][0][0][c] for c in ("words", "name", "shape")} == {"binary"}


@pytest.mark.parametrize("words", [1, 30, 1 << 19])
def test_documents_stay_whole_over_batches(monkeypatch, words):
    monkeypatch.setattr(substring_dedup, "_SLICE_WORDS", words)
    ids = np.sort(np.concatenate([np.random.default_rng(words).integers(-20, 20, 300), np.full(90, 7)]))
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 9]), pa.array(np.arange(i, min(i + 9, len(ids))))], names=["doc_id", "row"]) for i in range(0, len(ids), 9)]
    found = [b.to_pydict() for b in substring_dedup._documents(iter(batches))]
    assert [r for f in found for r in f["row"]] == list(range(len(ids)))
    assert sum(len(set(f["doc_id"])) for f in found) == len(set(ids.tolist()))
    assert len(found) > 5 or words > 30


def test_packed_rows_come_back():
    r = np.random.default_rng(3)
    sizes = r.integers(0, 4, 50)
    names, shapes = r.integers(0, 1 << 63, sizes.sum()).astype(np.uint64), r.integers(-9, 1 << 14, (sizes.sum(), 3)).astype(np.int16)
    rows = pa.RecordBatch.from_arrays([substring_dedup._packed(sizes, names), substring_dedup._packed(sizes, shapes)], names=["name", "shape"])
    for a, b in ((0, 50), (7, 30), (20, 20)):
        part, of = rows.slice(a, b - a), slice(sizes[:a].sum(), sizes[:b].sum())
        assert substring_dedup._sizes(part, "name").tolist() == sizes[a:b].tolist()
        assert (substring_dedup._unpacked(part, "name", np.uint64) == names[of]).all()
        assert (substring_dedup._unpacked(part, "shape", np.int16).reshape(-1, 3) == shapes[of]).all()
