"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a dozen transformed, length-smoothed statistics.  Both classes get a
mean and a covariance shrunk towards the pooled covariance and towards a scaled identity;
the score is the logistic of the difference of the two log densities (each from a
Mahalanobis distance by a cached Cholesky factor) plus the log odds of the classes.

The moments are sums over all labelled training rows, made by Spark; the driver sees one row for each class.

Defined results: null and empty texts have the statistics of an empty text and get a
score like any other; labels other than 0 and 1 and rows with a null doc_id do not train;
a doc_id labelled twice trains with its lower label; without both classes in training the
score is the share of label 1 seen (0.5 if none).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, release
from .stats import text_stats

#: Shrinkage of a class covariance: towards the pooled one, then towards the identity.
TO_POOLED, TO_IDENTITY = 0.2, 0.05
#: Standardised features are held within this range, so that one wild statistic does not decide alone.
CLIP = 8.0
NAMES = ("symbols", "upper", "digits", "punct", "bangs", "dup_lines", "repeats", "wordless", "word_length", "variety", "longest")


def features(column: pa.Array) -> np.ndarray:
    """(texts, features): square roots of shares and logs of lengths, smoothed so that short texts are near the ordinary."""
    s = {k: v.astype(np.float64) for k, v in text_stats(column).items()}
    chars, words = s["word_chars"] + 50, s["n_words"] + 10
    cols = [np.sqrt(s[k] / chars) for k in ("n_symbols", "upper", "digits", "punct", "bangs")]
    cols += [
        np.sqrt(s["n_dup_lines"] / (s["n_lines"] + 3)), np.sqrt(s["n_repeat_words"] / words), np.sqrt(s["wordless"] / words),
        np.log((s["word_chars"] + 100) / (s["n_words"] + 20)), np.log((s["distinct_words"] + 30) / (s["n_words"] + 30)), np.log(s["longest_word"] + 10),
    ]
    return np.stack(cols, axis=1)


def features_column(text: str = "text") -> Column:
    """An Arrow UDF column: array<double> of the features."""

    @F.arrow_udf("array<double>")
    def of(t: pa.Array) -> pa.Array:
        x = features(t)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return of(F.col(text).cast("string"))


@dataclass
class Discriminant:
    """A fitted model; small and picklable."""

    base: float = 0.5
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list = field(default_factory=list)
    inverse: list = field(default_factory=list)  # of the Cholesky factors
    offset: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.center is None:
            return np.full(len(x), self.base)
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        log = [o - 0.5 * np.square((z - m) @ li.T).sum(axis=1) for m, li, o in zip(self.means, self.inverse, self.offset, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(rows: DataFrame) -> Discriminant:
    """``rows``: features array<double>, label 0 or 1.  One aggregate over all of them."""
    d = len(NAMES)
    f = [F.col("features")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(f)], *[F.sum(f[i] * f[j]).alias(f"p{i}_{j}") for i, j in pairs]]
    got = {r["label"]: r for r in rows.groupBy("label").agg(*aggs).collect()}
    n = {k: got[k]["n"] if k in got else 0 for k in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant(base=n[1] / max(1, n[0] + n[1]) if n[0] + n[1] else 0.5)
    mean = {k: np.array([got[k][f"s{i}"] for i in range(d)]) / n[k] for k in n}
    cov = {}
    for k in n:
        m = np.zeros((d, d))
        for i, j in pairs:
            m[i, j] = m[j, i] = got[k][f"p{i}_{j}"] / n[k] - mean[k][i] * mean[k][j]
        cov[k] = m
    total = n[0] + n[1]
    center = (n[0] * mean[0] + n[1] * mean[1]) / total
    within = (n[0] * cov[0] + n[1] * cov[1]) / total
    spread = within + sum(n[k] / total * np.outer(mean[k] - center, mean[k] - center) for k in n)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-8))
    out = Discriminant(base=n[1] / total, center=center, scale=scale)
    pooled = within / np.outer(scale, scale)
    for k in (0, 1):
        c = (1 - TO_POOLED) * cov[k] / np.outer(scale, scale) + TO_POOLED * pooled
        c = (1 - TO_IDENTITY) * c + TO_IDENTITY * max(np.trace(c) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(c)
        out.means.append((mean[k] - center) / scale)
        out.inverse.append(np.linalg.inv(factor))
        out.offset.append(float(np.log(n[k] / total) - np.log(np.diag(factor)).sum()))
    return out


def clean_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, label: one row for each labelled doc_id."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return y.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))


def bucket_of(mod: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def featured(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), features_column().alias("features"))


def score_column(model: Discriminant, source: Column) -> Column:
    """The score of a features column."""

    @F.arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy().reshape(len(x), -1)))

    return of(source)


def classify(docs: DataFrame, labels: DataFrame, mod: int = 3, hold: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; one pass over the texts.

    Rows whose crc32 remainder is ``hold`` do not train.
    """
    x = materialize(featured(docs).withColumn("held_out", F.coalesce(bucket_of(mod) == hold, F.lit(False))), "features")
    model = fit(x.filter("not held_out").join(clean_labels(labels), "doc_id"))
    out = x.select("doc_id", "held_out", score_column(model, F.col("features")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least 0.5, trained on all labelled rows among them.

    Two passes over texts: one writes the features of each row, of which the labelled ones are found by a join of ids and
    features; the second scores each text where it is read.  Texts are never shuffled.
    """
    x = materialize(featured(docs), "features")
    model = fit(x.join(clean_labels(labels), "doc_id"))
    discard(x)
    release(docs.sparkSession)

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        return pa.array(model.score(features(t)))

    return docs.filter(score(F.col("text").cast("string")) >= 0.5)
