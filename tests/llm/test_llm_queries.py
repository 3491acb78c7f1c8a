"""The registered queries and the pipeline over the smallest tables."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from loamgrid.llm import near_copies, source_mixing
from loamgrid.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import database, differences
from tests.llm.conftest import SCHEMA, prose


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf_dir):
    assert not differences(QUERIES[name], ORACLE_SQL[name], spark, sf_dir, database(sf_dir))


def test_learned_operators_hold_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lang = QUERIES["op2_language_id"](spark, sf_dir).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.where("lang = lang_pred").count() >= 0.97 * lang.count()
    good = QUERIES["op7_line_crf"](spark, sf_dir).where("held_out").join(labels, "doc_id")
    assert good.where("quality = predicted").count() >= 0.95 * good.count()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema, before = docs.schema.simpleString(), docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.schema.simpleString() == schema, name
        assert 0.8 * before <= docs.count() <= before, name
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).cache()
    assert pieces.select("doc_id").distinct().count() == before
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` < 2048").count() <= 1


def run_stages(spark, docs):
    """Rows of ``docs`` after each stage, and the packed pieces."""
    found = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found.append(stage(spark, docs, "").collect())
        docs = spark.createDataFrame(found[-1], SCHEMA)
    return found, corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_pipeline_bears_odd_rows(spark, odd):
    """Nulls, empty and long texts, ties, repeated rows, shared and missing ids, clashing columns."""
    (lang, dedup, pii, mixed), pieces = run_stages(spark, odd)
    lettered = [r for r in odd.collect() if any(map(str.isalpha, r.text or ""))]
    assert sorted(str((r.doc_id, r.text)) for r in lang) == sorted(str((r.doc_id, r.text)) for r in lettered)
    texts = [r.text for r in dedup]
    assert len(set(texts)) == len(texts) and set(texts) == {r.text for r in lettered}
    assert {r.doc_id for r in dedup if r.text == prose(1, 120)} == {100} and None in {r.doc_id for r in dedup}
    assert sorted(map(str, pii)) == sorted(map(str, mixed)) and len(pii) == len(dedup)
    assert sum(r.start == 0 for r in pieces) == len(mixed)


def test_pipeline_of_no_rows(spark):
    assert run_stages(spark, spark.createDataFrame([], SCHEMA)) == ([[]] * 4, [])


def test_near_dedup_judges_rows_that_share_an_id_by_their_texts(spark):
    rows = [(1, prose(1, 60)), (1, prose(2, 60)), (1, prose(2, 60)), (2, prose(1, 60)), (None, prose(3, 60)), (None, prose(3, 60) + " x"), (None, prose(2, 60))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA), "").collect()
    assert sorted((str(r.doc_id), r.text[:9]) for r in kept) == sorted([("1", prose(1, 60)[:9]), ("1", prose(2, 60)[:9]), ("None", prose(3, 60)[:9])])


@pytest.mark.parametrize("split", ["128m", "16k"])
def test_sequences_follow_the_mix(spark, tmp_path, split):
    rows = [(i, prose(i % 50, 40 + i % 7), "en", "hot" if i % 10 else "rare", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = source_mixing.mix_sources(docs.select("doc_id", "source")).toPandas().sort_values(["slot", "place"])
    corpus_pipeline.mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pieces = corpus_pipeline.packing(spark, spark.read.parquet(str(tmp_path / "mixed")), "").toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pieces.length.sum() == pieces[pieces.start == 0].doc_tokens.sum() and pieces.doc_id.nunique() == 4000
    pieces = pieces.merge(mixed[["doc_id", "source"]], "left").sort_values(["sequence_id", "offset"])
    for source in ("hot", "rare"):
        assert pieces[(pieces.source == source) & (pieces.start == 0)].doc_id.tolist() == mixed[mixed.source == source].doc_id.tolist()
    weight = {"hot": int(3600**0.5), "rare": int(400**0.5)}
    first = pieces[pieces.sequence_id < 20].groupby("source").length.sum()
    assert abs(first["rare"] / first.sum() - weight["rare"] / sum(weight.values())) < 0.03


def test_one_of_each_group_of_near_copies_stays(spark):
    """Copies with edits here and there, of similarities on both sides of 0.8, against all pairs."""
    texts = {}
    for g in range(8):
        base = [f"w{g}x{k}" for k in range(200)]
        for c in range(9):
            words = list(base)
            for k in range(c):
                words[7 + 23 * k] = f"e{g}x{c}x{k}"
            texts[100 * g + c] = " ".join(words)
    texts |= {900: "a B c", 901: "A  b c", 902: "a b", 903: "", 904: None}
    grams = {}
    for i, t in texts.items():
        words = (t or "").lower().split()
        grams[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    near = lambda i, j: len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])
    root = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            root[i] = min(root[j] for j in texts if near(i, j))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(root.values())
    assert len(kept) < len(texts) - 30


def test_recall_by_similarity(spark):
    """Pairs of texts with more and more words changed, 120 for each number: those of similarity 0.8 or more are found, however similar."""
    r, rows, bands = random.Random(4), [], {}
    for changed in range(1, 7):
        for _ in range(120):
            base = [f"w{r.randrange(10**6)}" for _ in range(160)]
            other = list(base)
            for k in r.sample(range(0, 160, 5), changed):
                other[k] = f"e{r.randrange(10**6)}"
            a, b = ({tuple(t[k : k + 5]) for k in range(156)} for t in (base, other))
            rows += [(2 * len(rows), " ".join(base)), (2 * len(rows) + 1, " ".join(other))]
            share = len(a & b) / len(a | b)
            bands.setdefault("below" if share < 0.8 else "0.8" if share < 0.85 else "0.85" if share < 0.9 else "0.9", []).append(rows[-2:])
    part = {x.doc_id: x.component_id for x in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k: sum(part[a] == part[b] for (a, _), (b, _) in v) / len(v) for k, v in bands.items()}
    assert {k: round(f, 3) for k, f in found.items()} == {"below": 0.0, "0.8": 1.0, "0.85": 1.0, "0.9": 1.0} and min(map(len, bands.values())) >= 120


def test_near_dedup_of_no_rows(spark):
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_shingles_of_slices():
    texts = pa.array(["A b c d e f g", None, "x Y", "", "a b c d e f", *[prose(i, 9).upper() for i in range(5)]])
    each = [near_copies.shingles(texts.slice(i, 1))[0].tolist() for i in range(len(texts))]
    for at, n in ((0, 10), (1, 3), (4, 6), (1, 1)):
        grams, edge = near_copies.shingles(texts.slice(at, n))
        assert [grams[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == each[at : at + n]
    assert [len(x) for x in each[:5]] == [3, 0, 1, 0, 2] and set(each[4]) < set(each[0])
