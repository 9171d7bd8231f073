"""Sharding, classifier, languages, rules and the pipeline's stages against plain versions of their methods."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from terrella.llm import langid, quality, rules, sharding
from terrella.llm.scratch import materialize
from terrella.llm.stats import EXTRA, text_stats

from .fixtures import ODD, documents, labels, odd, words
from .test_layout import check_packing
from .test_models import plain_stats
from .test_pairs import brute, repeats_by_force

MID = "/root/testdata/sf0.01"


def plain_shards(rows, leaves):
    """Weighted medians along the widest dimension, by sorting each node."""
    span = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in sharding.DIMENSIONS} if rows else {}
    out = {}

    def cross(groups, goal):
        under = 0
        for key, w in groups:
            if under + w >= goal or key == groups[-1][0]:
                return key, under, w
            under += w

    def near(under, w, goal, room):
        miss = [abs(under - goal), abs(under + w - goal)]
        return miss.index(min(miss)) if min(miss) <= room else None

    def split(node, first, k):
        if k == 1 or not node:
            out.update({id(r): first for r in node})
            return
        dim = max(sharding.DIMENSIONS, key=lambda d: (max(r[d] for r in node) - min(r[d] for r in node)) / max(1, span[d]))
        total = sum(r["w"] for r in node)
        goal, room = total * (k // 2) / k, sharding.TOLERANCE / k * total
        some, under, place = node, 0, []
        for key in (dim, "h", "id"):
            groups = Counter()
            for r in some:
                groups[r[key]] += r["w"]
            at, more, w = cross(sorted(groups.items()), goal - under)
            under += more
            side = near(under, w, goal, total if key == "id" else room)
            place.append(at + (side or 0))
            some = [r for r in some if r[key] == at]
            if side is not None:
                break
        left = [r for r in node if tuple(r[c] for c in (dim, "h", "id"))[: len(place)] < tuple(place)]
        ids = set(map(id, left))
        split(left, first, k // 2)
        split([r for r in node if id(r) not in ids], first + k // 2, k - k // 2)

    split(rows, 0, leaves)
    return [out[id(r)] for r in rows]


@pytest.mark.parametrize("leaves,source", [(8, "documents"), (5, "documents"), (8, "odd"), (40, "documents")])
def test_shards_equal_plain_medians(spark, leaves, source):
    docs = documents(spark, MID) if source == "documents" else odd(spark)
    rows = materialize(sharding.metadata(docs), "metadata")
    found = sharding.partition(rows, leaves).select("doc_id", "h", *sharding.DIMENSIONS, "w", "id", "shard").collect()
    plain = [{**r.asDict(), "d_size": r.d_size} for r in found]
    assert [r.shard for r in found] == plain_shards(plain, leaves)


def plain_extra(text):
    t = text or ""
    w = words(t)
    kinds = lambda f: sum(map(f, t))
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) >= 128
    lines = sum(bool(words(x)) for x in t.split("\n"))
    punct = "!\"'(),-./:;?@[\\]^_`{}~+="
    return (
        lines, kinds(lambda c: "A" <= c <= "Z"), kinds(lambda c: "a" <= c <= "z"), kinds(lambda c: "0" <= c <= "9"), kinds(lambda c: c in punct), t.count("!"),
        len(set(w)), sum(not any(map(letter, x)) for x in w), max(map(len, w), default=0),
    )


def test_extra_statistics_equal_plain_ones(spark, sf):
    texts = [r.text for r in documents(spark, sf).collect()] + [t for _, t, *_ in ODD]
    got = text_stats(pa.array(texts, pa.string()))
    assert [tuple(int(got[c][i]) for c in EXTRA) for i in range(len(texts))] == list(map(plain_extra, texts))


def discriminant(x, y):
    """Scores for all rows from labelled ones (y 0 or 1; -1 without), by the textbook."""
    d = x.shape[1]
    part = [x[y == k] for k in (0, 1)]
    n = [len(p) for p in part]
    every = np.concatenate(part)
    center = every.mean(axis=0)
    scale = np.sqrt(np.maximum(every.var(axis=0), 1e-8))
    cov = [np.cov(p.T, bias=True) / np.outer(scale, scale) for p in part]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    z = np.clip((x - center) / scale, -quality.CLIP, quality.CLIP)
    log = []
    for k in (0, 1):
        c = (1 - quality.TO_POOLED) * cov[k] + quality.TO_POOLED * pooled
        c = (1 - quality.TO_IDENTITY) * c + quality.TO_IDENTITY * np.trace(c) / d * np.eye(d)
        m = (part[k].mean(axis=0) - center) / scale
        log.append(np.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def quality_by_force(rows, marks, train):
    y = {}
    for r in marks:
        if r.doc_id is not None and r.quality in (0, 1):
            y[r.doc_id] = min(r.quality, y.get(r.doc_id, 1))
    x = quality.features(pa.array([r.text for r in rows], pa.string()))
    return discriminant(x, np.array([y.get(r.doc_id, -1) if r.doc_id is not None and train(r.doc_id) else -1 for r in rows]))


def test_quality_scores_equal_plain_ones(spark):
    docs, marks = documents(spark, MID), spark.read.parquet(f"{MID}/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], quality_by_force(rows, marks.collect(), lambda d: zlib.crc32(str(d).encode()) % 3 != 1), strict=True))
    got = {r.doc_id: r.score for r in quality.classify(docs, marks).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-6, abs_tol=1e-9) for d in want)


def plain_languages(sample, texts):
    names = sorted({r.lang for r in sample})
    split = lambda t: words(t.lower())
    word, gram = defaultdict(Counter), [defaultdict(Counter) for _ in range(langid.NGRAM)]

    def grams(w, n):
        return [w[i + 1 - n : i + 1] if i + 1 >= n else "^" + w[: i + 1] if i + 2 == n else None for i in range(len(w))]

    for r in sample:
        for w in split(r.text):
            word[w][r.lang] += 1
            for n in range(1, langid.NGRAM + 1):
                for g in grams(w, n):
                    if g is not None:
                        gram[n - 1][n, g][r.lang] += 1

    def logs(table, smooth):
        total = {x: sum(c[x] for c in table.values()) for x in names}
        return {k: [math.log((c[x] + smooth) / (total[x] + smooth * (len(table) + 1))) for x in names] for k, c in table.items()}

    word_logs, gram_logs = logs(word, langid.WORD_SMOOTH), [logs(t, langid.GRAM_SMOOTH) for t in gram]
    out = []
    for t in texts:
        if not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0))
            continue
        total = np.zeros(len(names))
        for w in split(t):
            if w in word_logs:
                total += word_logs[w]
                continue
            by = {n: grams(w, n) for n in range(1, langid.NGRAM + 1)}
            for i in range(len(w)):
                for n in range(langid.NGRAM, 0, -1):
                    if by[n][i] is not None and (n, by[n][i]) in gram_logs[n - 1]:
                        total += langid.GRAM_WEIGHT * np.array(gram_logs[n - 1][n, by[n][i]])
                        break
        out.append((names[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())))
    return out


def test_languages_equal_plain_ones(spark, sf, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANG", 20)  # so that many words are unseen
    docs = documents(spark, sf).select("doc_id", "text", "lang").unionByName(odd(spark).filter("doc_id < 10").selectExpr("doc_id + 100000 as doc_id", "text", "lang"))
    rows = docs.collect()
    sample = langid.training_sample(docs, quality.bucket_of(4) != 2).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    for r, (lang, score) in zip(rows, plain_languages(sample, [r.text for r in rows]), strict=True):
        assert got[r.doc_id][0] == lang and math.isclose(got[r.doc_id][1], score, rel_tol=1e-6, abs_tol=1e-9), r.doc_id


def test_samples_take_equal_texts_each_by_its_own_doc_id(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).withColumn("text", F.when(F.col("id") % 2 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id")))).selectExpr("id as doc_id", "text", "'en' as lang")
    some = langid.training_sample(df).collect()
    assert 800 < len(some) < 1200 and 0.4 < sum(r.text == "the same text" for r in some) / len(some) < 0.6
    from terrella.llm.sift import sample_by_hash

    some = sample_by_hash(df, 2000, "doc_id", "text").collect()
    assert 1700 < len(some) < 2300 and 0.44 < sum(r.text == "the same text" for r in some) / len(some) < 0.56


def plain_rules(texts):
    out = []
    for t in texts:
        n, chars, symbols, dup, rep = map(float, plain_stats(t))
        lines, upper, _, _, punct, bangs, distinct, wordless, _ = map(float, plain_extra(t))
        c, w = chars + 50, n + 10
        out.append([symbols / c, dup / (lines + 3), rep / w, c / w, upper / c, punct / c, bangs / c, (distinct + 30) / (n + 30), wordless / w])
    return np.array(out)


def plain_anomaly(forest, row):
    total = 0.0
    for t in range(len(forest.rule)):
        node = 0
        while forest.child[t][node]:
            node = int(forest.child[t][node] + (row[forest.rule[t][node]] >= forest.cut[t][node]))
        total += forest.length[t][node]
    return 2 ** (-total / len(forest.rule) / rules.expected(forest.per_tree))


def rules_by_force(rows, marks, forest):
    """kept of each row: limits, then the threshold that separates labelled scores best, over all thresholds of the histogram."""
    x = plain_rules([r.text for r in rows])
    base = [plain_stats(r.text) for r in rows]
    failed = np.array([b[0] < 50 or 100 * b[4] > 50 * b[0] for b in base])
    score = np.array([plain_anomaly(forest, v) for v in x])
    y = {}
    for r in marks:
        if r.doc_id is not None and r.quality in (0, 1):
            y[r.doc_id] = min(r.quality, y.get(r.doc_id, 1))
    known = [(y[r.doc_id], s) for r, s, f in zip(rows, score, failed, strict=True) if not f and r.doc_id in y]
    bad, good = (np.array([s for k, s in known if k == q]) for q in (0, 1))
    best = (0.0, 2.0)
    for b in range(rules.BINS):
        gone = [np.mean(np.minimum(np.floor(v * rules.BINS), rules.BINS - 1) >= b) for v in (bad, good)]
        if gone[1] <= rules.MAX_GOOD_LOST and gone[0] - gone[1] > best[0] + 1e-12:
            best = (gone[0] - gone[1], b / rules.BINS)
    return score, ~failed & (score < best[1])


def test_rules_equal_plain_ones(spark):
    docs, marks = documents(spark, MID), spark.read.parquet(f"{MID}/labels.parquet")
    rows = docs.collect()
    forest = rules.fit_forest(rules.with_stats(docs))
    assert np.allclose(np.array([r["rules"] for r in sorted(rules.with_stats(docs).collect(), key=lambda r: r["doc_id"])]), plain_rules([r.text for r in sorted(rows, key=lambda r: r.doc_id)]))
    score, kept = rules_by_force(rows, marks.collect(), forest)
    got = {r.doc_id: r for r in rules.judge(docs, marks).collect()}
    assert all(math.isclose(got[r.doc_id].anomaly, s, rel_tol=1e-9) for r, s in zip(rows, score, strict=True))
    assert [got[r.doc_id].kept for r in rows] == kept.tolist()


def test_pipeline_stages_equal_plain_ones(spark):
    """Each stage on its own input: the classifier's and rules' decisions, near copies and repeats by brute force, the packing's laws."""
    import corpus_pipeline as c

    sf = MID
    marks = spark.read.parquet(f"{sf}/labels.parquet").collect()
    docs = documents(spark, sf)
    stage = dict(c.STAGES)
    rows = docs.collect()
    good = materialize(stage["quality_classifier"](spark, docs, sf), "good")
    score = quality_by_force(rows, marks, lambda d: True)
    left = good.collect()
    assert {r.doc_id for r in left} == {r.doc_id for r, s in zip(rows, score, strict=True) if s >= 0.5} and {tuple(r) for r in left} <= {tuple(r) for r in rows}

    regular = materialize(stage["quality_rules"](spark, good, sf), "regular")
    _, kept = rules_by_force(left, marks, rules.fit_forest(rules.with_stats(good)))
    assert {r.doc_id for r in regular.collect()} == {r.doc_id for r, k in zip(left, kept, strict=True) if k}

    one = materialize(stage["near_dedup"](spark, regular, sf), "one")
    groups = brute([(r.doc_id, r.text) for r in regular.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (_, first) in groups.items() if d == first)

    cut = materialize(stage["substring_dedup"](spark, one, sf), "cut")
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (one, cut))
    touched = repeats_by_force(before.items(), 50)
    assert before.keys() == after.keys() and {d for d in before if before[d] != after[d]} == touched
    assert touched and all(len(after[d]) < len(before[d]) for d in touched)
    check_packing(cut)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd(spark), odd(spark).limit(0)):
        for name, stage in c.STAGES[:-1]:
            left = materialize(stage(spark, docs, str(tmp_path)), name)
            assert left.columns == docs.columns and left.count() <= docs.count()
        last = c.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
