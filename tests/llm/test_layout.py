"""Sharding, search, packing and pieces: exact laws and round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np

from terrella.llm import packing, pieces, sharding, topk

from .fixtures import ODD, documents, odd


def test_shards_are_near_equal_in_bytes_and_numbered_without_gaps(spark, sf):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = sharding.shard_documents(docs, leaves=8).toPandas()
    assert len(got) == docs.count() and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() < 0.03 * size.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples())
    shards = got.assign(t=got.doc_id.map(text)).groupby("t").shard.nunique()
    assert (shards == 1).mean() > 0.99


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same text for all", None, None, None) for i in range(800)] + [(1000 + i, f"text {i}", None, None, None) for i in range(100)]
    got = sharding.shard_documents(odd(spark, rows), leaves=8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() < 1.1 * size.mean()


def test_shards_of_odd_documents(spark):
    got = sharding.shard_documents(odd(spark), leaves=8).collect()
    assert len(got) == 17 and all(0 <= r.shard < 8 for r in got)
    assert next(r for r in got if r.doc_id == 3)["size"] == 1
    assert sharding.shard_documents(odd(spark).limit(0), leaves=8).collect() == []
    assert {r.shard for r in sharding.shard_documents(odd(spark), target_bytes=10**9).collect()} == {0}


def brute_top(rows, every, k):
    out = {}
    for q, v in rows:
        if q % every == 0 and q not in out:
            s = {(-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in rows if c != q and len(w) == len(v)}
            out[q] = [(c, -x) for x, c in sorted(s)[:k]]
    return out


def test_top_k_with_ties_gaps_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-0.5, 0.25, 0.5)) for _ in range(4)], 0) for i in range(300)]
    bad = [(301, None, 0), (302, [None, 1.0, 0.0, 0.0], 0), (303, [float("nan"), 0.0, 0.0, 0.0], 0), (304, [float("inf"), 0.0, 0.0, 0.0], 0), (350, [0.5, 0.5], 0), (None, [0.5] * 4, 0)]
    df = spark.createDataFrame([*rows, *bad, rows[7]], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in topk.top_k(df, 50, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows] + [(350, [128, 128])]
    assert got == {q: r for q, r in brute_top(ints, 50, 5).items() if r}
    assert topk.top_k(df.limit(0), 50, 5).collect() == []


def test_top_k_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in df.collect()]
    got = {}
    for r in topk.top_k(df, 50, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(ints, 50, 5)


def test_top_k_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 30)]) for i in range(150)]
    rows += [(200, [1e12, 1.0, 0.0]), (250, [2e12, 1.0, 0.0]), (251, [-2e12, 1.0, 0.0]), (252, [3e38, -3e38, 3e38]), (-50, [1e-3, -1e-3, 1.0]), (300, [2e15 + 0.25, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    import math
    from fractions import Fraction

    ints = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    want = {q: [(c, max(-(2**63), min(2**63 - 1, s))) for c, s in r] for q, r in brute_top(ints, 50, 5).items()}
    got = {}
    for r in topk.top_k(df, 50, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    beyond = [topk._order_text(x) for x in (-(10**40), -(10**39) - 5, -(10**39), -(2**63) - 1, -(2**63), 0, 2**63, 2**63 + 1, 10**25)]
    assert beyond == sorted(beyond)


def test_plan_equals_best_fit_decreasing():
    for seed in range(150):
        rng = random.Random(seed)
        cap = rng.choice([10, 16, 50, 64])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 150))]
        hist = {x: items.count(x) for x in set(items)}
        bins = []
        for x in sorted(items, reverse=True):
            fits = [(b, i) for i, b in enumerate(bins) if b >= x]
            if fits:
                bins[min(fits)[1]] -= x
            else:
                bins.append(cap - x)
        used = {}
        for r in packing.plan(hist, cap):
            for i in range(r.count):
                used.setdefault(r.bin + i // r.each, []).append((r.offset + (i % r.each) * r.length, r.length))
        for parts in used.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
        assert sorted(cap - sum(n for _, n in p) for p in used.values()) == sorted(bins)


def check_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).toPandas()
    rows = docs.select("doc_id", "text").distinct().collect()
    for r in rows:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = got[got.doc_id == r.doc_id] if r.doc_id is not None else got[got.doc_id.isna()]
        mine = mine.drop_duplicates("piece").sort_values("piece")
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids)
        assert (mine.length.iloc[1:] == 1024).all()
        assert [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine.itertuples()] == list(mine.ids_crc32)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    return got


def test_packing_documents(spark, sf):
    got = check_packing(documents(spark, sf))
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 1024 + 1


def test_packing_odd_documents(spark):
    assert len(check_packing(odd(spark))) >= 17
    assert packing.pack_documents(odd(spark).limit(0)).collect() == []


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    p = pieces.Pieces(pieces.default_model())
    rng = random.Random(1)
    texts = [r.text for r in documents(spark, sf).collect()] + [t for _, t, *_ in ODD[:12] if t is not None]
    texts += [" a", "a ", "  ", "\n\nab\tc", "ﬁ ① é 日本 😀 x​b", "a▁b", "<s> </s>", "\x00a", " " * 40, "a" * 50]
    texts += ["".join(rng.choice("abcdeinrst  \n.,ÄéТ日▁") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    got = p.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == sp.encode(texts)
    assert [p.decode(b) for b in got] == [t.replace("▁", " ") for t in texts]


def test_pieces_of_very_long_words_and_runs_of_spaces():
    import time

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    p = pieces.Pieces(pieces.default_model())
    rng = random.Random(5)
    texts = [" " * 100_000, "a" + " " * 70_001 + "b", "x" * 100_000, "".join(rng.choice("etaoinshrdlué日😀") for _ in range(100_000)), " " * 50_000 + "\n" + " " * 33]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(3_000)) for _ in range(20)]
    began = time.perf_counter()
    got = p.encode(texts)
    assert time.perf_counter() - began < 30
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == sp.encode(texts)


def test_pieces_round_trip(spark):
    got = {r.doc_id: r for r in pieces.round_trip(odd(spark)).collect()}
    assert all(r.same for r in got.values()) and got[3].n_pieces == 0 and got[4].n_pieces == 0
    back = pieces.decode_documents(pieces.encode_documents(odd(spark))).collect()
    assert {r.doc_id: r.text for r in back} == {d: t or "" for d, t, *_ in ODD}


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline as c
    from terrella.llm.scratch import materialize

    assert [n for n, _ in c.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "substring_dedup", "best_fit_packing"]
    docs = documents(spark, sf)
    for name, stage in c.STAGES[:-1]:
        left = materialize(stage(spark, docs, sf), name)
        assert left.columns == docs.columns and 0 < left.count() <= docs.count()
        docs = left
    last = c.STAGES[-1][1](spark, docs, sf)
    assert last.select("doc_id").distinct().count() == docs.count()
    assert last.count() == c.run(spark, sf).count()
