"""Language identification, word first: known words by their frequency in each language, unseen ones by character n-grams.

Training counts the words of a bounded sample of texts with a known language (about ``PER_LANG`` documents of each, those
whose hash of doc_id is least; a documented bound on labelled rows) and the
n-grams of those words.  A known word scores by its smoothed log frequency in each
language.  In an unseen word, each end position scores by the longest n-gram ending
there that training has seen, from ``NGRAM`` characters down to one, with the word's begin included.

Tables are sorted arrays of 64-bit hashes; their size is bounded by the sample.

Defined results: ``und`` with score 0 for texts that are null or have no letter, and when training
has no language; ties go to the first language in order; rows with a null language or doc_id don't train, nor do
texts longer than ``TRAIN_CHARS``; repeated rows train once; beyond ``MAX_LANGS`` languages those with most documents are learned.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, per_text
from .quality import bucket_of
from .scratch import materialize
from .sift import below

PER_LANG = 1000
MAX_LANGS = 256
#: Longer texts are not taken into the training sample, so that its size is bounded.
TRAIN_CHARS = 32_000
NGRAM = 5
WORD_SMOOTH, GRAM_SMOOTH = 0.05, 0.5
#: A letter's weight per unseen end position against a known word's.
GRAM_WEIGHT = 0.35


def _has_letter(b: Block) -> np.ndarray:
    d = b.data
    found = per_text(((d | 32) >= 97) & ((d | 32) <= 122), b.offsets) > 0
    for i in np.flatnonzero(~found & (per_text(d >= 0x80, b.offsets) > 0)):
        found[i] = any(map(str.isalpha, b.text(int(b.offsets[i]), int(b.offsets[i + 1]))))
    return found


def _lower_upper_latin(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def grams(b: Block, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character of the words given, and the word of each.

    An n-gram that would begin one character before its word begins with a mark instead; one that would begin earlier has hash 0.
    """
    chars = b.characters
    first = np.searchsorted(chars, starts)
    size = np.searchsorted(chars, ends) - first
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    last = np.repeat(first, size) + at
    end = chars[last + 1]  # a word ends where a character begins, or the block does
    out = np.zeros(len(end), np.uint64)
    ok = at + 1 >= n
    out[ok] = b.span_hash(chars[last[ok] + 1 - n], end[ok])
    edge = at + 2 == n  # the mark and the first n - 1 characters
    out[edge] = ~b.span_hash(chars[last[edge] + 2 - n], end[edge])
    return out, word


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Row of each key in a sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Languages:
    names: list[str]
    words: np.ndarray
    word_logs: np.ndarray
    grams: list[np.ndarray]
    gram_logs: list[np.ndarray]

    def word_scores(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) of log scores, and the bounds of each text's words."""
        s, e, at = b.words
        h = b.span_hash(s, e)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        row = find(self.words, uniq)
        logs = np.zeros((len(uniq), len(self.names)))
        logs[row >= 0] = self.word_logs[row[row >= 0]]
        new = first[row < 0]
        if len(new):
            best = None
            for n in range(NGRAM, 0, -1):
                g, word = grams(b, s[new], e[new], n)
                if best is None:
                    best, found = np.zeros((len(g), len(self.names))), np.zeros(len(g), bool)
                r = find(self.grams[n - 1], g)
                use = (r >= 0) & ~found
                best[use] = self.gram_logs[n - 1][r[use]]
                found |= use
            add = np.zeros((len(new), len(self.names)))
            np.add.at(add, word, best)
            logs[row < 0] = add * GRAM_WEIGHT
        return logs[inverse], at

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The language (by number; -1 for none) and its posterior share for each text."""
        best, share = [], []
        for b in blocks(_lower_upper_latin(column)):
            logs, at = self.word_scores(b)
            total = np.stack([_sums(logs[:, j], at) for j in range(len(self.names))], axis=1)
            ok = _has_letter(b)
            top = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            best.append(np.where(ok, top, -1))
            share.append(np.where(ok, p, 0.0))
        return np.concatenate([*best, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*share, np.zeros(0)])


def _sums(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.zeros(len(v) + 1)
    np.cumsum(v, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def _counted(h: np.ndarray, lang: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a block and how often each language has them."""
    uniq, inverse = np.unique(h, return_inverse=True)
    return uniq, np.bincount(inverse * n_langs + lang, minlength=len(uniq) * n_langs).reshape(len(uniq), n_langs).astype(np.int32)


def _logs(parts: list[tuple[np.ndarray, np.ndarray]], smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all blocks, and the smoothed log share of each language's total."""
    h, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    count = np.add.reduceat(counts[order], at, axis=0).astype(float) if len(h) else counts.astype(float)
    total = count.sum(axis=0)
    return h[at], np.log((count + smooth) / (total + smooth * (len(at) + 1)))


def training_sample(docs: DataFrame, allowed: Column | None = None) -> DataFrame:
    """doc_id, lang and text of about ``PER_LANG`` documents of each language."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    if allowed is not None:
        d = d.filter(allowed)
    h = F.xxhash64("doc_id")
    counts = d.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    share = F.lit(False)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], below(h, min(1.0, PER_LANG / max(1, r["n"])))).otherwise(share)
    return d.filter(share).distinct()


def _tables(sample: DataFrame, rows: int = 512):
    """The rows in small Arrow tables, one partition after the other."""
    it = sample.select("lang", "text").toLocalIterator()
    while held := list(itertools.islice(it, rows)):
        yield pa.table({"lang": [r["lang"] for r in held], "text": pa.array([r["text"] for r in held], pa.string())})


def fit(docs: DataFrame, allowed: Column | None = None) -> Languages | None:
    """Train on the sample; null without any rows.  The driver reads it part by part and keeps only tables of counts."""
    got = materialize(training_sample(docs, allowed), "langs")
    names = sorted(r["lang"] for r in got.select("lang").distinct().collect())
    if not names:
        return None
    number = {n: i for i, n in enumerate(names)}
    word_parts, gram_parts = [], [[] for _ in range(NGRAM)]
    for some in _tables(got):
        lang = np.array([number[x] for x in some.column("lang").to_pylist()])
        row = 0
        for b in blocks(_lower_upper_latin(some.column("text").combine_chunks()), limit=1 << 18):
            s, e, at = b.words
            of = np.repeat(lang[row : row + b.n], np.diff(at))
            row += b.n
            word_parts.append(_counted(b.span_hash(s, e), of, len(names)))
            for n in range(1, NGRAM + 1):
                g, word = grams(b, s, e, n)
                ok = g != 0
                gram_parts[n - 1].append(_counted(g[ok], of[word[ok]], len(names)))
    words, word_logs = _logs(word_parts, WORD_SMOOTH)
    tables = [_logs(p, GRAM_SMOOTH) for p in gram_parts]
    return Languages(names, words, word_logs, [t[0] for t in tables], [t[1] for t in tables])


def identify(docs: DataFrame, mod: int = 4, hold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; rows whose crc32 remainder is ``hold`` do not train."""
    model = fit(docs, bucket_of(mod) != hold)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def of(t: pa.Array) -> pa.Array:
        m = shared.value
        if m is None:
            return pa.StructArray.from_arrays([pa.array(["und"] * len(t)), pa.array(np.zeros(len(t)))], ["lang_pred", "score"])
        best, share = m.predict(t)
        names = pa.array([*m.names, "und"])
        return pa.StructArray.from_arrays([names.take(pa.array(best % len(names))), pa.array(share)], ["lang_pred", "score"])

    held = F.coalesce(bucket_of(mod) == hold, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, of(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.*")
