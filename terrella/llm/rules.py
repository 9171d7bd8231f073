"""Quality rules: hard limits, then an isolation forest over rule statistics.

The forest's trees are grown on the driver from a bounded sample of the documents (about ``SAMPLE`` of them, those whose
hash of doc_id and statistics is least; a documented bound of the method, which grows each
tree on a few hundred rows).  Documents with equal texts enter each by its own doc_id, so a group of copies
has its share of the sample.  Every document is scored.  The threshold comes from a
histogram of the scores of all labelled rows: the one that separates the labels best while rejecting at most
``MAX_GOOD_LOST`` of the good ones.  Without labels of both kinds nothing is rejected but by the limits.

Defined results: null and empty texts have zero counts and fail the limits; repeated rows of one doc_id
and text are one row of the sample and are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import clean_labels
from .scratch import discard, materialize, release
from .sift import sample_by_hash
from .stats import COUNTS, text_stats

SAMPLE, TREES, PER_TREE, SEED = 8192, 300, 256, 17
MAX_GOOD_LOST = 0.01
BINS = 2000
MIN_WORDS, MAX_REPEAT = 50, 50
RULES = ("symbols", "dup_lines", "repeats", "word_length", "upper", "punct", "bangs", "variety", "wordless")


def rule_values(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, rules): the shares that the rules look at."""
    s = {k: v.astype(np.float64) for k, v in s.items()}
    chars, words = s["word_chars"] + 50, s["n_words"] + 10
    cols = [s["n_symbols"] / chars, s["n_dup_lines"] / (s["n_lines"] + 3), s["n_repeat_words"] / words, (s["word_chars"] + 50) / words]
    cols += [s["upper"] / chars, s["punct"] / chars, s["bangs"] / chars, (s["distinct_words"] + 30) / (s["n_words"] + 30), s["wordless"] / words]
    return np.stack(cols, axis=1)


@dataclass
class Forest:
    """Trees as flat arrays: rule, cut, first child (0 at a leaf) and path length."""

    rule: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    per_tree: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected): near 1 for the isolated."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.rule)):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.ceil(np.log2(max(2, self.per_tree))))):
                down = self.child[t][node]
                node = np.where(down > 0, down + (x[rows, self.rule[t][node]] >= self.cut[t][node]), node)
            total += self.length[t][node]
        return np.exp2(-total / (len(self.rule) * max(expected(self.per_tree), 1e-9)))


def expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(sample: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED) -> Forest:
    """Random splits of random subsets of the sample."""
    rng = np.random.default_rng(seed)
    per_tree = min(per_tree, len(sample))
    depth = int(np.ceil(np.log2(max(2, per_tree))))
    size = 2 ** (depth + 1)
    rule, cut, child, length = (np.zeros((trees, size), k) for k in (np.int64, np.float64, np.int64, np.float64))
    for t in range(trees):
        todo, used = [(0, sample[rng.choice(len(sample), per_tree, replace=False)], 0)], 1
        while todo:
            at, rows, d = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            wide = np.flatnonzero(high > low)
            if d == depth or len(rows) <= 1 or not len(wide):
                length[t, at] = d + expected(len(rows))
                continue
            r = int(wide[rng.integers(len(wide))])
            c = rng.uniform(low[r], high[r])
            c = c if c > low[r] else high[r]
            rule[t, at], cut[t, at], child[t, at] = r, c, used
            right = rows[:, r] >= c
            todo += [(used, rows[~right], d + 1), (used + 1, rows[right], d + 1)]
            used += 2
    return Forest(rule, cut, child, length, per_tree)


def stats_column(text: str = "text") -> Column:
    """An Arrow UDF column: the base counts and the rule values."""
    kind = f"struct<{', '.join(f'{c}: long' for c in COUNTS)}, rules: array<double>>"

    @F.arrow_udf(kind)
    def of(t: pa.Array) -> pa.Array:
        s = text_stats(t)
        v = rule_values(s)
        rules = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
        return pa.StructArray.from_arrays([*[pa.array(s[c]) for c in COUNTS], rules], [*COUNTS, "rules"])

    return of(F.col(text).cast("string"))


def base_failed(words: str = "n_words", repeats: str = "n_repeat_words") -> Column:
    return (F.col(words) < MIN_WORDS) | (100 * F.col(repeats) > MAX_REPEAT * F.col(words))


def anomaly(forest: Forest, source: Column) -> Column:
    @F.arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(forest.score(x.flatten().to_numpy().reshape(len(x), -1)))

    return of(source)


def fit_forest(stats: DataFrame) -> Forest | None:
    """``stats``: doc_id and rules array<double>.  Null if there are no rows."""
    got = sample_by_hash(stats, SAMPLE, "doc_id", "rules").select("rules", F.xxhash64("doc_id", "rules").alias("h")).distinct().collect()
    return grow(np.array([r["rules"] for r in sorted(got, key=lambda r: (r["h"], r["rules"]))])) if got else None  # in the sample's own order, not that of arrival


def calibrate(scored: DataFrame) -> float:
    """The threshold over ``anomaly`` for rows with ``label``, from a histogram of all of them."""
    b = F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    hist = np.zeros((2, BINS))
    for r in scored.groupBy("label", b).agg(F.count(F.lit(1)).alias("n")).collect():
        hist[r["label"], r["bin"]] = r["n"]
    totals = hist.sum(axis=1)
    if not totals.all():
        return 2.0
    above = hist[:, ::-1].cumsum(axis=1)[:, ::-1] / totals[:, None]  # rejected if at or above the bin's lower edge
    gain = np.where(above[1] <= MAX_GOOD_LOST, above[0] - above[1], -1.0)
    best = int(np.argmax(gain))
    return best / BINS if gain[best] > 0 else 2.0


def rule_model(stats: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """Forest and threshold from documents' stats (doc_id, rules, base_failed); rows that fail the limits calibrate nothing."""
    forest = fit_forest(stats)
    if forest is None:
        return None, 2.0
    known = stats.filter("not base_failed").join(clean_labels(labels), "doc_id").select("label", anomaly(forest, F.col("rules")).alias("anomaly"))
    return forest, calibrate(known)


def with_stats(docs: DataFrame) -> DataFrame:
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stats_column().alias("s")).select("doc_id", "s.*")
    return x.withColumn("base_failed", base_failed())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, anomaly; one pass over the texts."""
    x = materialize(with_stats(docs), "rules")
    forest, limit = rule_model(x, labels)
    score = anomaly(forest, F.col("rules")) if forest else F.lit(0.0)
    out = x.select("doc_id", *COUNTS, "base_failed", score.alias("anomaly"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))


def keep_regular(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass limits and forest; texts are read twice and not shuffled."""
    x = materialize(with_stats(docs), "rules")
    forest, limit = rule_model(x, labels)
    discard(x)
    release(docs.sparkSession)
    if forest is None:
        return docs

    @F.arrow_udf("boolean")
    def passes(t: pa.Array) -> pa.Array:
        s = text_stats(t)
        ok = (s["n_words"] >= MIN_WORDS) & (100 * s["n_repeat_words"] <= MAX_REPEAT * s["n_words"])
        return pa.array(ok & (forest.score(rule_values(s)) < limit))

    return docs.filter(passes(F.col("text").cast("string")))
