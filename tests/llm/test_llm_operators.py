"""Each operator against brute force on small rows, and on rows that are odd."""

from __future__ import annotations

import hashlib
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from loamgrid.llm import language_id, line_crf, media_sniff, packing, pii, quality_rules, simhash, source_mixing, substring_dedup, url_filter
from loamgrid.llm.words import Words, windows
from loamgrid.operators.graph import connected_components
from tests.llm.conftest import ODD_TEXTS, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- words ----


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    column = pa.array(ODD_TEXTS)
    w = Words(column)
    got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in ODD_TEXTS for x in WORD.findall(t or "")]
    assert np.diff(w.first).tolist() == [len(WORD.findall(t or "")) for t in ODD_TEXTS]


def test_equal_words_and_windows_have_equal_hashes():
    import pyarrow as pa

    w = Words(pa.array(["a b c a b c", "b c a"]))
    h = w.hashes()
    assert len(set(h.tolist())) == 3
    assert windows(h, 3)[1] == windows(h, 3)[6]


# ---- op 1 ----


def base_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), failed


def test_quality_counts_equal_brute_force(spark, odd):
    texts = [*ODD_TEXTS, prose(5, 300), prose(5, 40) + "\n" + prose(5, 40), "# * $ <a> | b & %\n" * 30]
    docs = documents(spark, list(enumerate(texts)))
    found = by_id(quality_rules.quality_rules(docs, docs.where("doc_id >= 16")))
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t), i
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_equal_brute_force(spark):
    """Log ratios and threshold from plain counts; with so many buckets hardly any n-grams share one."""
    texts = {i: prose(i % 20, 24 + i) for i in range(30)} | {100 + i: " ".join(f"{w}{i}" for w in prose(i, 25).split()) for i in range(8)} | {200: None, 201: "few words"}
    trusted = {i for i in texts if i % 3 == 0 and i < 30} | {105, 201}
    found = by_id(quality_rules.quality_rules(documents(spark, list(texts.items())), documents(spark, [(i, None) for i in trusted] + [(None, None), (3, "")]), buckets=1 << 23, quantile=0.1))
    grams = {i: [g for n in (1, 2) for g in zip(*(WORD.findall(t or "")[k:] for k in range(n)), strict=False)] for i, t in texts.items()}
    raw, good = Counter(g for x in grams.values() for g in x), Counter(g for i in trusted for g in grams[i])
    total = {id(c): sum(c.values()) + (1 << 23) for c in (raw, good)}
    ratio = lambda g: np.log((good[g] + 1) / total[id(good)]) - np.log((raw[g] + 1) / total[id(raw)])
    score = {i: np.mean([ratio(g) for g in x]) if x else 0.0 for i, x in grams.items()}
    assert all(abs(found[i].llr - score[i]) < 1e-5 for i in texts)
    bins = sorted(np.floor(found[i].llr * 1000) for i in trusted if not found[i].base_failed)
    at = lambda q: max(b for b in bins if sum(x < b for x in bins) <= q * len(bins))
    edge = (2 * at(0.1) - at(0.5)) / 1000
    assert {i: r.kept for i, r in found.items()} == {i: not base_rules(t)[5] and found[i].llr >= edge for i, t in texts.items()}
    assert 0 < sum(r.kept for r in found.values()) < sum(not r.base_failed for r in found.values())


def test_quality_rejects_what_the_trusted_never_hold(spark):
    vocabulary = sorted(set(prose(0, 60).split()))[:30]
    good = [(i, " ".join(np.random.default_rng(i).choice(vocabulary, 200))) for i in range(60)]
    bad = [(i, " ".join(f"zq{i}x{k} ##{k}" for k in range(60))) for i in range(60, 70)]
    docs = documents(spark, good + bad)
    found = by_id(quality_rules.quality_rules(docs, docs.where("doc_id < 50")))
    assert all(found[i].kept for i in range(50)) and not any(found[i].kept for i, _ in bad)


def test_quality_verdicts_do_not_depend_on_partitions(spark):
    docs = documents(spark, [(i, prose(i, 100)) for i in range(40)])
    a, b = (by_id(quality_rules.quality_rules(docs.repartition(n), docs)) for n in (1, 7))
    assert a == b


def test_quality_counts_every_trusted_document(spark):
    """Where all documents are trusted, both multinomials are one and every log ratio is zero, with many documents too."""
    docs = spark.range(0, 100_400, numPartitions=4).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20), k -> concat('w', id * k % 9973))) AS text")
    assert quality_rules.quality_rules(docs, docs).where("llr <> 0").count() == 0


# ---- op 2 ----


def test_languages_held_out(spark):
    r = np.random.default_rng(0)
    syllables = {"en": "th er on an re he in ed nd ha", "fr": "eau ou les que ment oi ai en la re"}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang].split(), 3)) for _ in range(n))
    rows = [(i, text(("en", "fr")[i % 2], 60), ("en", "fr")[i % 2], "s", 0) for i in range(120)]
    rows += [(1000, text("en", 150) + " " + text("fr", 50), None, "s", 0), (1001, "123 !?", "en", "s", 0)]
    found = by_id(language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    assert all(found[i].lang_pred == lang for i, _, lang, *_ in rows[:120])
    assert found[3].held_out == (zlib.crc32(b"3") % 3 == 1)
    shares = dict(x.split(":") for x in found[1000].languages.split())
    assert abs(float(shares["en"]) - 0.75) < 0.08 and abs(found[1000].score - 0.75) < 0.08
    assert (found[1001].lang_pred, found[1001].score) == ("und", 0.0)


def test_language_sets_equal_brute_force():
    """All sets of the nested order by proportion, with plain expectation-maximisation for each document alone."""
    r = np.random.default_rng(4)
    size = r.integers(1, 120, 30)
    logs = np.concatenate([r.normal(0, 2, (n, 4)) + np.where(np.arange(4) == r.choice(4, (n, 1), p=r.dirichlet([0.5] * 4)), 4, 0) for n in size])
    edge = np.concatenate([[0], np.cumsum(size)])
    found = language_id.choose(logs, edge, 2.0, 1e-6)

    def run(like, allowed):
        share = allowed / allowed.sum()
        for _ in range(3000):
            p = like * share
            share = (p / p.sum(1, keepdims=True)).mean(0)
        return share, np.log((like * share).sum(1)).sum()

    for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
        like = np.exp(logs[a:b] - logs[a:b].max(1, keepdims=True))
        order = np.argsort(-run(like, np.ones(4))[0], kind="stable")
        sets = [run(like, np.isin(np.arange(4), order[:k]).astype(float)) for k in range(1, 5)]
        values = [v - 2.0 * (k + 1) * np.log(b - a + 1) for k, (_, v) in enumerate(sets)]
        assert np.allclose(found[i], sets[int(np.argmax(values))][0], atol=2e-3), i


def test_nothing_learned_is_und(spark):
    docs = documents(spark, [(1, prose(1, 30))]).withColumn("lang", F.lit(None).cast("string"))
    assert by_id(language_id.identify_languages(docs))[1].lang_pred == "und"


# ---- op 3 ----


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in fps}


def test_fingerprints_equal_brute_force():
    for t in [*ODD_TEXTS, prose(1, 3), prose(1, 4), prose(9, 700)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("hot", [256, 2])
def test_components_equal_brute_force(spark, hot, monkeypatch):
    base = prose(7, 60).split(" ")
    texts = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(40)] + ["", None, "a b", "A  b", *[prose(i, 30) for i in range(20, 40)]]
    monkeypatch.setattr(simhash.links, "__defaults__", (hot, 4))
    found = by_id(simhash.near_duplicates(documents(spark, list(enumerate(texts)))))
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == fps
    assert {i: r.component_id for i, r in found.items()} == brute_components(fps)


@pytest.mark.parametrize(("segments", "chain"), [(5, 1), (5, 2), (5, 3), (6, 2), (8, 4)])
def test_every_setting_of_the_ring_finds_every_link(spark, segments, chain):
    r = np.random.default_rng(segments * 10 + chain)
    fps = [int(x) for x in r.integers(0, 1 << 63, 30)]
    for x in fps[:30]:
        for bits in range(1, 7):
            fps.append(x ^ sum(1 << int(b) for b in r.choice(64, bits, replace=False)))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {tuple(sorted(x % (1 << 64) for x in row)) for row in simhash.links(df, simhash.Ring(4, segments, chain)).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}


@pytest.mark.parametrize("dense", [False, True])
def test_a_key_of_ten_thousand_fingerprints(spark, dense):
    """All share the bits of two segments; apart elsewhere, or in two groups of near fingerprints that don't link."""
    r = np.random.default_rng(5)
    low = np.uint64((1 << 26) - 1)
    fps = (r.integers(0, 1 << 63, 10_000).astype(np.uint64) & ~low) | np.uint64(12345)
    if dense:
        near = lambda base, n: base ^ (np.uint64(1) << r.integers(26, 60, n).astype(np.uint64)) ^ (np.uint64(1) << r.integers(26, 60, n).astype(np.uint64))
        fps = np.concatenate([near(fps[0], 600), near(fps[0] ^ np.uint64(0x1FF << 40), 600), fps[:8800]])
    else:
        fps[5000:5400] = fps[:400] ^ (np.uint64(7) << r.integers(26, 60, 400).astype(np.uint64))
    fps = np.unique(fps)
    root, n = np.arange(len(fps)), 0
    pairs = [(i, i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4)) for i in range(len(fps))]
    while n != (n := int(root.sum())):
        for i, js in pairs:
            if len(js):
                root[i] = root[js] = min(root[i], root[js].min())
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = {x.id: x.component for x in connected_components(simhash.links(df, simhash.Ring(4, 5, 2))).collect()}
    groups = lambda of: {frozenset(np.flatnonzero(of == k).tolist()) for k in np.unique(of)}
    assert groups(np.array([found.get(int(f), int(f)) for f in fps.view(np.int64)])) == groups(root)
    assert len(set(root.tolist())) < len(root) - 300


# ---- op 4 ----


def brute_repeats(texts, wide=50):
    first, out = {}, {}
    for i in sorted(texts):
        words = WORD.findall(texts[i] or "")
        gone = [False] * len(words)
        for s in range(len(words) - wide + 1):
            if first.setdefault(tuple(words[s : s + wide]), i) < i:
                gone[s : s + wide] = [True] * wide
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    passage, long_run = prose(50, 90).split(), ["the"] * 70
    texts = {0: prose(1, 200), 1: prose(1, 200), 2: " ".join(passage), 3: "x " + " ".join(passage[:50]), 4: "y " + " ".join(passage[:49]), 5: " ".join(prose(2, 30).split() + passage + prose(3, 30).split())}
    texts |= {6: " ".join(prose(4, 33).split() + passage[20:75] + prose(5, 9).split() + passage[:60]), 7: " ".join(long_run), 8: "q " + " ".join(long_run), 9: " ".join(passage + passage), 10: " ".join(["a", "b"] * 60), 11: " ".join(["b", "a"] * 40)}
    texts |= {20 + i: t for i, t in enumerate(ODD_TEXTS)} | {60: "the " * 3000, 61: prose(1, 120) + " tail"}
    for k in range(12):
        texts[100 + k] = " ".join(prose(60 + k, 25 + k).split() + passage[k : k + 50 + k] + prose(80 + k, 20).split())
    found = by_id(substring_dedup.remove_repeats(documents(spark, sorted(texts.items())).repartition(5)))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items()} == brute_repeats(texts)
    assert hashlib.sha256(found[5].kept_text.encode()).hexdigest() == found[5].kept_sha256


# ---- op 5 ----


def test_urls(spark):
    want = {
        "http://EXAMPLE.com/en/7x": ("example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://a.example.com/en/8?q#f": ("a.example.com", "/en/8", "com/en/", "block"),
        "x://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "x://badexample.net/de/8": ("badexample.net", "/de/8", "net/de/", "allow"),
        "http://casino-win.io/": ("casino-win.io", "/", None, "block"),
        "http://casinos.io/": ("casinos.io", "/", None, "allow"),
        "http://free.io/poker": ("free.io", "/poker", None, "block"),
        "http://free.io/free": ("free.io", "/free", None, "allow"),
        "http://ads-track.io/": ("ads-track.io", "/", None, "allow"),
        "http://casino.io/Casino": ("casino.io", "/Casino", None, "allow"),
        "http://ads-track.io/free-bets": ("ads-track.io", "/free-bets", None, "block"),
        "http://xads.io/FREEbets-9": ("xads.io", "/FREEbets-9", None, "allow"),
        "http://xads-track.io/FREE-bets9": ("xads-track.io", "/FREE-bets9", None, "allow"),
        "http://xads-track.io/FREE-bets9/hot": ("xads-track.io", "/FREE-bets9/hot", None, "block"),
        "http://stream.io/download": ("stream.io", "/download", None, "allow"),
        "http://stream.io/download/casino": ("stream.io", "/download/casino", None, "block"),
        "http://free-adult-x.com/": ("free-adult-x.com", "/", None, "block"),
        "no scheme/en/7": ("", "", None, "allow"),
        "http://h?x://y/z": ("h", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(want)] + [(None, None, None)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    assert got[None] == ("", "", None, "allow")


def test_odd_pages_all_come_back(spark):
    """Nulls, repeated rows and ids, a very long URL, clashing columns."""
    long = "http://h.io/" + "a-" * 200_000 + "casino-win"
    rows = [(1, None), (1, ""), (None, "x://h/casino-win"), (None, "x://h/casino-win"), (2, long), (2, long + "s"), (3, "x://h/\n casino-win \u0130")] * 3
    pages = spark.createDataFrame([(*r, "h", "v", 1, 2) for r in rows], "page_id long, url string, host string, verdict string, strict_hits int, term int")
    out = url_filter.filter_urls(pages)
    assert sorted(str((r.page_id, r.verdict)) for r in out.collect()) == sorted(["(1, 'allow')", "(1, 'allow')", "(None, 'block')", "(None, 'block')", "(2, 'block')", "(2, 'allow')", "(3, 'block')"] * 3)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_strict_terms_are_never_hidden(spark):
    terms = [("adult-x", "strict", 0), ("free-adult", "soft", 1), ("x", "soft", 2)]
    pages = spark.createDataFrame([(0, "x0://free-adult-x.com"), (1, "x0://free-adult.com"), (2, "x0://free-adult/x")], "page_id long, url string")
    got = {r.page_id: (r.strict_hits, r.soft_hits, r.soft_weight, r.verdict) for r in url_filter.filter_urls(pages, terms).collect()}
    assert got == {0: (1, 2, 3, "block"), 1: (0, 1, 1, "allow"), 2: (0, 2, 3, "block")}


def test_a_vocabulary_is_data(spark):
    terms = spark.createDataFrame([("Alpha", "strict", None), ("b", "soft", 1), ("b-c", "soft", 5), ("c", "soft", None), ("alpha", "soft", 1), ("", "soft", 9)], "term string, kind string, weight int")
    urls = ["x://h/alpha", "x://h/b-c", "x://h/b.c", "x://h/b-c/b", "x://h/b/b", None, "", "b c b-c " * 20_000, "alphabet"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.strict_hits, r.soft_hits, r.soft_weight, r.verdict) for r in url_filter.filter_urls(pages, terms).collect()}
    assert got == {0: (1, 0, 0, "block"), 1: (0, 1, 5, "allow"), 2: (0, 2, 2, "allow"), 3: (0, 2, 6, "block"), 4: (0, 1, 1, "allow"), 5: (0, 0, 0, "allow"), 6: (0, 0, 0, "allow"), 7: (0, 3, 7, "block"), 8: (0, 0, 0, "allow")}
    assert url_filter.filter_urls(pages.limit(0), terms).count() == 0
    assert url_filter.filter_urls(pages, terms.limit(0)).where("verdict = 'block'").count() == 0


# ---- op 6 ----


def png() -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_texts_come_back_from_their_media(spark, odd):
    for r in media_sniff.store_texts(odd.where("doc_id is not null")).collect():
        text = (prose(1, 120) if r.doc_id in (100, 101) else prose(3, 4000) if r.doc_id == 102 else ODD_TEXTS[r.doc_id] or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and r.feature.startswith("audio/wav")


def test_types_are_corrected_and_media_carved(spark):
    import gzip

    gif = b"GIF89a\x01\0\x01\0\0\0\0\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0\x3b"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3a12\xff\0 3\xff\xd9"
    ogg = b"OggS\0\6" + bytes(20) + b"\1\3abc"
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    whole = [png(), gif, bmp, jpeg, ogg, pdf, gzip.compress(b"abc" * 99), media_sniff.wav(b"12")]
    kinds = "image/png image/gif image/bmp image/jpeg audio/ogg application/pdf application/gzip audio/wav".split()
    rows = [(i, "text/plain", m) for i, m in enumerate(whole)] + [(10, "image/png", png()[:-1]), (11, "text/plain", b"abc" + png() + gif + b"GIF89a"), (12, None, None), (13, "x", b"")]
    got = by_id(media_sniff.sniff_media(spark.createDataFrame(rows, "doc_id long, declared_type string, content binary")))
    assert [(got[i].media_type, got[i].valid, got[i].media_bytes) for i in range(8)] == [(k, True, len(m)) for k, m in zip(kinds, whole, strict=True)]
    assert (got[10].media_type, got[10].valid) == ("image/png", False)
    assert [tuple(e) for e in got[11].embedded] == [(3, len(png()), "image/png"), (3 + len(png()), len(gif), "image/gif")]
    assert (got[12].valid, got[13].valid, got[13].media_type) == (False, False, "x")


@pytest.mark.parametrize(
    "unit",
    [m for m, *_ in media_sniff.FORMATS]
    + [b"%PDF-1.4 ", b"%PDF-1.4 startxref ", b"GIF89aaaaaaaa,", b"GIF89a\x01\0\x01\0\0\0\0\x21\xff\x02aa", b"RIFF\xff\xff\x7f\0WAVEfmt \0\0\0\0", b"OggS\0\2" + bytes(20) + b"\0", b"fLaC\0\0\0\x22" + bytes(34), b"\xff\xd8\xff\xda\0\2ab", b"\x1f\x8b\x08\x08" + b"a" * 8, png()[:33], b"BM" + bytes(24)],
)
def test_long_repeats_of_a_beginning_take_linear_time(unit):
    """Over 1 MB, 10 MB for what texts may well hold; walking on from every beginning would take minutes."""
    data = unit * ((10 << 20 if unit == b"%PDF-1.4 " else 1 << 20) // len(unit))
    began = time.process_time()
    found = media_sniff.Sniffer().media(data)
    assert time.process_time() - began < 10
    assert all(check(media_sniff.Content(data), at) == n for at, n, kind in found[:3] for *_, k, check in media_sniff.FORMATS if k == kind)


# ---- op 7 ----


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    unary, step = r.normal(size=7), r.normal(size=(2, 2))
    edge = np.array([0, 4, 4, 5, 7])
    good, moves, logs = line_crf.forward_backward(unary, step, edge, pairs=True)
    want, want_moves, want_logs = np.zeros(7), np.zeros((2, 2)), 0.0
    for a, b in zip(edge, edge[1:], strict=False):
        paths = [[k >> i & 1 for i in range(b - a)] for k in range(1 << (b - a))] if b > a else []
        weight = np.exp([sum(unary[a + i] * y for i, y in enumerate(p)) + sum(step[p[i], p[i + 1]] for i in range(len(p) - 1)) for p in paths])
        for p, w in zip(paths, weight / weight.sum() if len(paths) else [], strict=True):
            want[a:b] += w * np.array(p)
            for i in range(len(p) - 1):
                want_moves[p[i], p[i + 1]] += w
        want_logs += np.log(weight.sum()) if len(paths) else 0
    assert np.allclose(good, want) and np.allclose(moves, want_moves) and np.isclose(logs, want_logs)


def test_quality_held_out(spark):
    junk = lambda i: "\n".join(" | ".join(f"{c}{i}" for c in "abcdefg") for _ in range(6))
    rows = [(i, prose(i, 80) if i % 2 else junk(i)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    found = by_id(line_crf.classify_quality(documents(spark, rows), labels))
    assert all(found[i].predicted == i % 2 for i in range(120))
    assert all(0 <= r.score <= 1 for r in found.values())


def test_lines_of_one_document_differ(spark):
    """Documents of both kinds of lines, labelled by what most of their text is: the lines' own states come out, and change within documents."""
    good, junk = (lambda i: prose(i, 18).replace("\n", " ") + "."), (lambda i: " | ".join(f"{c}{i}" for c in "abcdefg"))
    texts = [[(good if (k < 5) != bool(i % 2) else junk)(i * 10 + k) for k in range(10)] + [(good if i % 2 else junk)(k) for k in range(3 + i % 5)] for i in range(200)]
    docs = documents(spark, [(i, "\n".join(t)) for i, t in enumerate(texts)])
    field_scores = by_id(line_crf.classify_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")))
    assert np.mean([field_scores[i].predicted == i % 2 for i in range(200)]) > 0.95
    import pyarrow as pa

    lines = line_crf.Lines(pa.array(["\n".join(t) for t in texts]))
    label = np.arange(200) % 2
    field = line_crf.train(lines.features.astype(float), lines.edge, lines.weight, label, 120, 1e-3, 0.7)
    marginal, _, _ = line_crf.forward_backward(((lines.features - field.mean) / field.scale) @ field.weight, field.step, lines.edge)
    truth = np.array(["|" not in x for t in texts for x in t])
    assert np.mean((marginal > 0.5) == truth) > 0.9


def test_long_documents_teach(spark):
    """All labelled documents have hundreds of lines; the bound takes some of them, whole."""
    junk = lambda i: "\n".join(" | ".join(f"{c}{i}" for c in "abcdefg") for _ in range(150))
    rows = [(i, "\n".join(prose(i * 200 + k, 9).replace("\n", " ") for k in range(150)) if i % 2 else junk(i)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = by_id(line_crf.classify_quality(documents(spark, rows), labels, train_lines=900))
    assert all(found[i].predicted == i % 2 for i in range(40))


def test_without_labels_every_score_is_a_half(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert by_id(line_crf.classify_quality(documents(spark, [(1, "a b"), (2, None)]), none))[2].score == 0.5


# ---- op 8 ----


def test_every_prefix_is_within_one_block_of_its_shares(spark):
    rows = [(i, f"s{0 if i % 3 else i % 7}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    quotas = spark.createDataFrame([("s0", 5), ("s1", 3), ("s2", 1), ("s3", 1), ("s4", 2), ("s5", 3), ("s6", 2)], "source string, quota long")
    mixed = source_mixing.mix_sources(docs, quotas, block_docs=4).toPandas()
    assert len(mixed) == 4000 and (mixed.release <= mixed.slot).all() and (mixed.slot < mixed.deadline).all()
    blocks = mixed.drop_duplicates(["source", "block"])
    assert blocks.slot.is_unique
    full = blocks.groupby("source").slot.max().min()
    share = {"s0": 5, "s1": 3, "s2": 1, "s3": 1, "s4": 2, "s5": 3, "s6": 2}
    for t in range(1, int(full)):
        ran = blocks[blocks.slot < t].groupby("source").size()
        assert all(abs(ran.get(s, 0) - t * q / 17) < 1 for s, q in share.items())


def test_ten_thousand_sources(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', id % 10000) AS source")
    began = time.perf_counter()
    mixed = source_mixing.mix_sources(rows, block_docs=1).toPandas()
    assert time.perf_counter() - began < 30
    assert len(mixed) == 30_000 and mixed.slot.is_unique and (mixed.release <= mixed.slot).all() and (mixed.slot < mixed.deadline).all()


def test_rows_that_share_an_id_have_one_order(spark):
    rows = [(None if i % 3 else 7, "s", f"t{i % 50}") for i in range(200)]
    a, b = (source_mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(n), block_docs=8) for n in (1, 5))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_mixing_keeps_every_row_and_column(spark, odd):
    mixed = source_mixing.mix_sources(odd)
    assert mixed.count() == odd.count() and set(odd.columns) <= set(mixed.columns)


# ---- op 9 ----


def test_pieces_hold_every_id_once(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD_TEXTS, "<|endoftext|> a", " lead  two   three \n x ", "it's we'll\u00a0 x", "trailing ", prose(1, 3000)]
    rows = packing.pack(documents(spark, list(enumerate(texts))).repartition(3)).collect()
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in ids.items()}
    end = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert all(n == 2048 for s, n in end.items() if s < max(end))


def deficit_round_robin(size, amount, period):
    """The loop: (queue, place in it) of every token in order."""
    deficit, sent, out = [0] * len(size), [0] * len(size), []
    while sum(sent) < sum(size):
        for q in range(len(size)):
            deficit[q] += amount[q]
            send = min(deficit[q] // period, size[q] - sent[q])
            deficit[q] -= period * (deficit[q] // period)
            out += [(q, sent[q] + k) for k in range(send)]
            sent[q] += send
    return out


@pytest.mark.parametrize("seed", range(8))
def test_places_equal_the_loop(seed):
    r = np.random.default_rng(seed)
    lengths = [r.integers(1, 900, r.integers(1, 12)) for _ in range(r.integers(1, 30 if seed == 3 else 6))]
    size = np.array([x.sum() for x in lengths])
    share = size.astype(float) if seed % 2 else r.integers(1, 50, len(size)).astype(float)
    rounds = packing.Rounds(size, share, 16 if seed == 3 else 64)
    assert rounds.amount.sum() == rounds.period * rounds.window
    at = {t: i for i, t in enumerate(deficit_round_robin(size.tolist(), rounds.amount.tolist(), rounds.period))}
    queue = np.repeat(np.arange(len(size)), [len(x) for x in lengths])
    n = np.concatenate(lengths)
    ahead = np.concatenate([np.cumsum(x) - x for x in lengths])
    shuffled = r.permutation(len(n))
    seen = set()
    for d, start, length, place in zip(*rounds.pieces(queue[shuffled], ahead[shuffled], n[shuffled]), strict=True):
        i = shuffled[d]
        assert place // rounds.window == (place + length - 1) // rounds.window
        for k in range(length):
            assert at[queue[i], ahead[i] + start + k] == place + k
            seen.add(place + k)
    assert seen == set(range(size.sum()))


def test_every_window_holds_its_target_shares(spark):
    """Documents of many windows each; every full window within one quantum of each target while all queues last."""
    rows = [(i, " ".join(f"{c}{i % 7}{k % 10}" for k in range((300, 40, 2500)[i % 3])), "en", "abc"[i % 3], 0) for i, c in enumerate("xyz" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {"a": 0.5, "b": 0.1, "c": 0.4}
    got = packing.pack(docs, shares=spark.createDataFrame(list(want.items()), "source string, share double"), window=256).toPandas()
    got["source"] = ["abc"[i % 3] for i in got.doc_id]
    last = got.groupby("source").sequence_id.max().min()
    assert last > 10 and got.groupby("doc_id").length.sum().max() > 10 * 256
    for sequence, part in got[got.sequence_id < last].groupby("sequence_id"):
        assert part.length.sum() == 256
        for source, share in want.items():
            assert abs(part[part.source == source].length.sum() - share * 256) <= max(1, share * 256), (sequence, source)


def test_ten_thousand_queues():
    size = np.arange(10_000) % 97 + 1
    rounds = packing.Rounds(size, np.ones(len(size)), 2048)
    doc, start, length, at = rounds.pieces(np.arange(len(size)), np.zeros(len(size), np.int64), size)
    order = np.argsort(at)
    assert (at[order] == np.cumsum(length[order]) - length[order]).all() and length.sum() == size.sum()


@pytest.mark.parametrize("ordered", [True, False])
def test_queue_places_are_prefix_sums(spark, ordered):
    rows = [((i % 5 << 40) + i, f"s{i % 3 and 1}", 1 + i % 7) for i in range(3000)]
    got = packing.queue_places(spark.createDataFrame(rows, "row long, source string, n long"), ordered).toPandas().merge(pd.DataFrame(rows, columns=["row", "source", "n"]), on=["row", "source"])
    for _, part in got.groupby("source"):
        part = part.sort_values("ahead")
        assert (part.ahead.to_numpy() == np.cumsum(part.n) - part.n).all()
        assert not ordered or part.row.is_monotonic_increasing


# ---- op 10 ----

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


CHECKS = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": luhn, "phone": lambda s: 8 <= sum(c.isdigit() for c in s) <= 15}
PERSONAL = [
    "mail a.b+c@x-y.co.uk, d@e.f@g.h and @no.pe x@y a@b..c a@b.c.", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1.1 0001.02.3.255 1.2.3.256", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111110",
    "+49 (30) 123-4567, +1 2 3, +1234567890123456 +12+34567890", "\U0001f600 é x@y.zz \U0001f600 10.0.0.1", "a\x01@b.c 1\x032 4111\x031111", "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE88370400440532013000", "ssn 123-45-6789 but, in a table of numbers that is far away from any such word, 123-45-6780",
]


def test_spans_equal_plain_patterns(spark):
    texts = [*ODD_TEXTS, *PERSONAL]
    found = by_id(pii.find_pii(documents(spark, list(enumerate(texts)))))
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if CHECKS[k](m[0])]
        assert [(s.kind, s.start, s.end) for s in found[i].pii if s.kind in BASE] == want, t
    assert [s.kind for s in found[len(texts) - 2].pii if s.kind == "iban"] == ["iban", "iban"]
    assert [(s.kind, s.start) for s in found[len(texts) - 1].pii if s.kind == "ssn"] == [("ssn", 4)]


CONTEXT = [
    ("the token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" is", [("secret", 0.7)]),
    ("commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff is", []),
    ("an example token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", []),
    ("bsn 111222333 of", [("bsn", 0.6)]),
    ("bsn 111222334 of", []),
    ("number 111222333 of", []),
    ("DE89370400440532013000", [("iban", 0.6)]),
    ("for example DE89370400440532013000", []),
    ("example account DE89370400440532013000", [("iban", 0.7)]),
    ("at 00:1b:44:11:3a:b7 now", [("mac", 0.6)]),
    ("sample 00:1b:44:11:3a:b7 now", []),
    ("ff:ff:ff:ff:ff:ff device", []),
    ("123-45-6789 is the social number", [("ssn", 0.6)]),
    ("write to a@b.cd", [("email", 0.9)]),
    ("example mail a@b.cd", [("email", 1.0)]),
    ("example host 1.2.3.4", [("ip", 1.0)]),
    ("a sample: 1.2.3.4", [("ip", 0.6)]),
]


def test_context_decides(spark):
    found = by_id(pii.find_pii(documents(spark, [(i, t) for i, (t, _) in enumerate(CONTEXT)])))
    for i, (t, want) in enumerate(CONTEXT):
        assert [(s.kind, s.score) for s in found[i].pii] == want, t


def test_many_matches_in_one_text(spark):
    text = "".join(f"user{i}@mail{i % 9}.org, " for i in range(8000))
    docs = documents(spark, [(1, text)])
    began = time.perf_counter()
    row = pii.find_pii(docs).collect()[0]
    assert time.perf_counter() - began < 10
    assert [(s.start, s.end) for s in row.pii] == [m.span() for m in re.finditer(BASE["email"], text)]


def test_redaction_hides_every_span(spark):
    docs = documents(spark, list(enumerate([*PERSONAL, None, "clean text"])))
    out = by_id(pii.redact(pii.find_pii(docs)))
    assert out[0].text.startswith("mail [EMAIL], [EMAIL]") and out[len(PERSONAL) + 1].text == "clean text" and out[len(PERSONAL)].text is None
    left = pii.find_pii(docs.sparkSession.createDataFrame([(i, r.text) for i, r in out.items()], "doc_id long, text string")).where("size(pii) > 0")
    assert not left.collect()


# ---- all ----

RUNS = {
    "op1": lambda d: quality_rules.quality_rules(d, d),
    "op2": language_id.identify_languages,
    "op3": simhash.near_duplicates,
    "op4": substring_dedup.remove_repeats,
    "op6": media_sniff.store_texts,
    "op7": lambda d: line_crf.classify_quality(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")),
    "op8": source_mixing.mix_sources,
    "op9": packing.pack,
    "op10": pii.find_pii,
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_all_come_back(name, odd):
    out = RUNS[name](odd)
    ids = Counter(r.doc_id for r in (out.where("start = 0") if name == "op9" else out).select("doc_id").collect())
    assert ids == Counter(r.doc_id for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(RUNS))
def test_an_empty_table_gives_an_empty_one(name, nothing):
    assert RUNS[name](nothing).count() == 0
