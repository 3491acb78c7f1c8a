"""The one-bit minima by which open pairs of near_copies are chosen."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from loamgrid.llm.near_copies import BITS, BITS_AGREE, _bits, shingles


def _agreeing(a: str, b: str) -> tuple[float, int]:
    """Similarity of the two texts' shingle sets, and how many of their bits agree."""
    grams, edge = shingles(pa.array([a, b]))
    x, y = set(grams[edge[0] : edge[1]].tolist()), set(grams[edge[1] : edge[2]].tolist())
    (out,) = _bits(iter([pa.RecordBatch.from_arrays([pa.array([a, b])], names=["text"])]))
    left, right = (np.array(v, np.int64).view(np.uint64) for v in out.column("bits").to_pylist())
    return len(x & y) / len(x | y), BITS - int(np.bitwise_count(left ^ right).sum())


def test_similar_texts_agree_in_enough_bits():
    r = random.Random(5)
    seen = 0
    for _ in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 900))]
        # a piece of new words at the end leaves four fifths or a little more
        new = [f"v{r.randrange(10**6)}" for _ in range(int(len(words) * r.uniform(0.19, 0.24)))]
        share, agree = _agreeing(" ".join(words), " ".join(words + new))
        if share >= 0.8:
            seen += 1
            assert agree >= BITS_AGREE
        assert abs(agree - BITS * (1 + share) / 2) < 60
    assert seen > 20


def test_unlike_texts_agree_in_about_half_of_the_bits_and_texts_without_words_in_all():
    a, b = (" ".join(f"{c}{i}" for i in range(300)) for c in "ab")
    assert abs(_agreeing(a, b)[1] - BITS // 2) < 80
    (out,) = _bits(iter([pa.RecordBatch.from_arrays([pa.array(["", None, " "])], names=["text"])]))
    assert all(not any(bits) for bits in out.column("bits").to_pylist())
