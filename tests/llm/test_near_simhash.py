"""The SimHash step of the pipeline's near_dedup."""

from __future__ import annotations

import corpus_pipeline
from loamgrid.llm import near_copies
from tests.llm.conftest import SCHEMA, prose


def test_simhash_links_alone_join_close_texts(spark, monkeypatch):
    """Without the rounds of minimum hashes: a text, an edit of it and a reordered copy with the same shingles hang together, others don't."""
    monkeypatch.setattr(near_copies, "_STEPS", ())
    monkeypatch.setattr(near_copies, "BITS_AGREE", near_copies.BITS + 1)
    base = prose(1, 900).split()
    texts = [" ".join(base), " ".join([*base[:450], "changed", *base[451:]]), " ".join(base).upper(), prose(2, 900), " ".join(prose(3, 900).split()[:450] + base[450:])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 3, 4]
