"""Models and statistics: against plain Python, and by accuracy on rows held out."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terrella.llm import kneser_ney, langid, quality, rules
from terrella.llm.stats import COUNTS, text_stats

from .fixtures import ODD, documents, labels, odd, words

MID = "/root/testdata/sf0.01"


def plain_stats(text):
    text = text or ""
    w = words(text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(win)
    covered = {i + j for i, x in enumerate(win) if twice[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_plain_ones(spark, sf):
    texts = [r.text for r in documents(spark, sf).collect()] + [t for _, t, *_ in ODD]
    got = text_stats(pa.array(texts, pa.string()))
    assert [tuple(int(got[c][i]) for c in COUNTS) for i in range(len(texts))] == list(map(plain_stats, texts))


def test_rules_on_documents_and_odd_ones(spark):
    docs, marks = documents(spark, MID), spark.read.parquet(f"{MID}/labels.parquet")
    got = rules.judge(docs, marks)
    j = got.join(marks, "doc_id").filter("not base_failed").toPandas()
    assert (~j.kept[j.quality == 0]).mean() > 0.95 and j.kept[j.quality == 1].mean() > 0.97
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    few = rules.judge(odd(spark), labels(spark))
    assert few.count() == 17 and few.columns[:7] == ["doc_id", *COUNTS, "base_failed"]
    assert rules.judge(odd(spark).limit(0), labels(spark)).collect() == []
    assert rules.keep_regular(odd(spark), labels(spark).limit(0)).columns == odd(spark).columns


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    f = rules.grow(x)
    assert f.score(np.full((1, 3), 6.0))[0] > np.quantile(f.score(x), 0.99)
    same = rules.grow(np.zeros((10, 3)))
    assert np.isfinite(same.score(np.zeros((2, 3)))).all()


def test_quality_on_held_out_rows(spark):
    docs, marks = documents(spark, MID), spark.read.parquet(f"{MID}/labels.parquet")
    got = quality.classify(docs, marks).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    y = {r.doc_id: r.quality for r in marks.collect()}
    held = [r.predicted == y[r.doc_id] for r in got if r.held_out and r.doc_id in y]
    assert sum(held) / len(held) > 0.95


def test_quality_of_odd_documents(spark):
    got = quality.classify(odd(spark), labels(spark)).collect()
    assert len(got) == 17 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = quality.classify(odd(spark), labels(spark).limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(odd(spark).limit(0), labels(spark)).collect() == []
    assert quality.keep_good(odd(spark), labels(spark)).columns == odd(spark).columns


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(5)
    m = quality.Discriminant(center=np.zeros(2), scale=np.ones(2))
    covs = [np.array([[2.0, 0.3], [0.3, 1.0]]), np.eye(2)]
    for mean, c in zip(([1.0, 0.0], [0.0, 0.0]), covs, strict=True):
        f = np.linalg.cholesky(c)
        m.means.append(np.array(mean))
        m.inverse.append(np.linalg.inv(f))
        m.offset.append(-np.log(np.diag(f)).sum())
    x = rng.normal(size=(5, 2))
    dens = [np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - u, np.linalg.inv(c), x - u)) / np.sqrt(np.linalg.det(c)) for u, c in zip(m.means, covs, strict=True)]
    assert np.allclose(m.score(x), dens[1] / (dens[0] + dens[1]))


def test_languages_on_held_out_rows(spark):
    docs = documents(spark, MID)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == r.lang for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_languages_of_odd_documents(spark):
    got = langid.identify(odd(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 17 and all(0 <= r.score <= 1 for r in got)
    assert {by[i].lang_pred for i in (3, 4, 5, 9)} == {"und"} and by[11].lang_pred != "und"
    none = langid.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(odd(spark).limit(0)).collect() == []


def plain_model(rows, mod=5, hold=1):
    """Interpolated modified Kneser-Ney bigrams in dictionaries."""
    tok = lambda t: [*words(t, lower=True), None]
    train = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % mod != hold]
    uni, bi = Counter(), Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        bi.update(zip(["^", *w[:-1]], w, strict=True))
    cont = Counter(w for _, w in bi)
    of = lambda c: kneser_ney._discounts([Counter(c.values())[k] for k in (1, 2, 3, 4)])
    d1, d2, n, v = of(cont), of(bi), sum(uni.values()), len(uni)
    total, after = Counter(), {}
    for (a, _), k in bi.items():
        total[a] += k
        after.setdefault(a, [0, 0, 0])[min(k, 3) - 1] += 1
    kinds = Counter(min(c, 3) for c in cont.values())
    rest = sum(d1[k - 1] * kinds[k] for k in (1, 2, 3)) / sum(cont.values())
    cut = lambda c, d: max(c - [0, *d][min(c, 3)], 0)

    def p(a, w):
        low = cut(cont.get(w, 0), d1) / sum(cont.values()) + rest / (v + 1)
        if a not in total:
            return low
        return cut(bi.get((a, w), 0), d2) / total[a] + sum(x * y for x, y in zip(d2, after[a], strict=True)) / total[a] * low

    def score(t):
        w = tok(t)
        base = sum(math.log10((uni.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        return len(w), sum(x in uni for x in w), n, base, sum(math.log10(p(a, x)) for a, x in zip(["^", *w[:-1]], w, strict=True))

    return score, p, uni


def test_kneser_ney_equals_a_plain_model(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    score, p, uni = plain_model(rows)
    got = kneser_ney.score_documents(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t)
    for r in got:
        fits = [np.allclose([r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score], score(t), rtol=1e-8) for t in texts[r.doc_id]]
        assert any(fits), r
    assert abs(sum(p("the", w) for w in uni) + p("the", "never seen") - 1) < 1e-9


def test_kneser_ney_without_training_rows(spark):
    got = kneser_ney.score_documents(odd(spark).filter("doc_id is null")).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in got] == [(0, 0, 0.0)]
    assert kneser_ney.score_documents(odd(spark).limit(0)).collect() == []


def test_a_higher_order_predicts_better(spark):
    docs = documents(spark, MID)
    mean = {n: kneser_ney.score_documents(docs, order=n).filter("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first() for n in (2, 3)}
    assert mean[3][0] > mean[2][0] > mean[2][1]
