"""Substring deduplication by content-defined chunks.

1. A gear rolling hash of the last ``GEAR_BYTES`` bytes is taken at the end of each word.  A cut is where it is least among some
   ``Rule.reach`` words in a row; from each cut a chunk goes on to the word, between ``Rule.least`` and ``Rule.least + Rule.slack``
   words later, where the hash is least again.  So chunks vary in length and depend on the words around their cut alone: an insertion changes
   only chunks it touches, and two texts with a passage of ``min_words`` whole words in common have a chunk of it in
   common, however they differ elsewhere.  Chunks are deduplicated by the digest of their bytes.
2. Every window of ``min_words`` words is led by the chunk at its own cut.  If that chunk's digest stands in
   several documents, the window is written out with the digest of all its bytes.  Each digest's owner is its first place in
   (doc_id, position) order.  So a passage's owner has the whole of it, wherever its parts were seen first.
3. Documents are compared with their windows' owners: both whole texts along the windows' distance,
   and every maximal equal stretch of at least ``min_words`` whole words is a repeat.  A distance whose windows
   all lie in stretches already found with that owner adds nothing and is left out.

So a repeat is exact and never chance agreement of digests, every window that an earlier document has lies in a repeat, and the
first place of a passage stays.  Hot digests are combined to one owner before the shuffle; their rows meet the owner by a
bounded broadcast (``sift.join_split``), and only rows of shared digests are moved at all.

Defined results: null and empty texts have no chunks; rows with a null doc_id are neither owners nor repeats; repeated
rows of one doc_id are no repeats of each other; repeats inside one document are left alone.  Passages are whole words of both
texts; a stretch found may begin or end inside a longer word of the owner.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, Block, blocks, mix64, slices
from .near_dup import _attach, _own_ids
from .scratch import discard, materialize, release
from .sift import hot_keys, join_split, rows_of, sift

MIN_WORDS, FEWEST_WORDS = 50, 24
#: Pairs of texts held as Python objects at once.
COMPARED = 256
#: What the rolling hash looks back on: so many bytes are at most half as many words.
GEAR_BYTES = 16
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(48)).astype(np.uint16)


@dataclass(frozen=True)
class Rule:
    """How chunks are cut for passages of some words: ``skip + reach + least + slack`` words hold a cut, its chunk and what decides on both."""

    skip: int  # words at a passage's begin whose hash looks at what is before it
    reach: int
    least: int
    slack: int

    @staticmethod
    def of(min_words: int) -> Rule:
        if min_words < FEWEST_WORDS:
            raise ValueError(f"passages need at least {FEWEST_WORDS} words")
        skip, least = GEAR_BYTES // 2 + 1, min_words // 4  # one word more, as the first may be part of a longer one elsewhere
        free = min_words - skip - least
        return Rule(skip, free * 2 // 3, least, free - free * 2 // 3)


def gear(b: Block) -> np.ndarray:
    """The rolling hash at each byte of a block; a text's hashes are free of its neighbours'."""
    size = np.diff(b.offsets)
    place = np.arange(len(b.data)) + GEAR_BYTES * (1 + np.repeat(np.arange(b.n), size))
    h = np.zeros(len(b.data) + GEAR_BYTES * (b.n + 1), np.uint16)
    h[place] = GEAR[b.data]
    shift = 1
    while shift < GEAR_BYTES:  # sums over twice as many bytes at each step
        step = h.copy()
        step[shift:] += h[:-shift] << np.uint16(shift)
        h, shift = step, 2 * shift
    return h[place]


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Where the (first) least of each ``n`` values in a row stands."""
    out = (x.astype(np.uint64) << np.uint64(40)) + np.arange(len(x), dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return (out & np.uint64((1 << 40) - 1)).astype(np.int64)


def chunks(b: Block, g: np.ndarray, i: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Starts and ends of the words of a block's i-th text, and for each window of ``min_words`` words (by its first word) its chunk's first and last word and digest; none for a text shorter than a passage."""
    starts, ends, at = b.words
    s, e = starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]
    n = len(s) - min_words + 1
    if n <= 0:
        return None
    rule, h = Rule.of(min_words), g[e - 1]
    cut = _sliding_least(h[rule.skip :], rule.reach)[:n] + rule.skip
    last = rule.skip + rule.least + _sliding_least(h[rule.skip + rule.least :], rule.slack)[cut - rule.skip]
    first = cut + 1
    return s, e, first, last, b.span_hash(s[first], e[last])


def _chunker(min_words: int):
    """Rows (doc_id, text) -> the first place of each chunk of a text."""

    def run(batches):
        for batch in batches:
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for b in blocks(batch.column("text")):
                g = gear(b)
                out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))]
                for i in range(b.n):
                    if (found := chunks(b, g, i, min_words)) is None:
                        continue
                    s, _, first, _, digest = found
                    digest, row = np.unique(digest, return_index=True)
                    out.append((np.full(len(digest), docs[b.row + i], np.int64), (s[first[row]] - b.offsets[i]).astype(np.int32), digest))
                doc, start, digest = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(digest.view(np.int64))], ["doc_id", "start", "digest"])

    return run


def _writer(min_words: int):
    """Rows (id, text, shared) -> place, bytes and digest of each passage-long window whose chunk is shared, and whether it is the text's first with that digest."""
    kinds = (np.int64, np.int32, np.int32, np.int64, np.bool_)

    def run(batches):
        for batch in batches:
            docs, shared = batch.column("id").to_numpy(), batch.column("shared")
            for b in blocks(batch.column("text")):
                g = gear(b)
                out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, k) for k in kinds)]
                for i in range(b.n):
                    if (found := chunks(b, g, i, min_words)) is None:
                        continue
                    s, e, _, _, digest = found
                    p = np.flatnonzero(np.isin(digest, shared[b.row + i].values.to_numpy().view(np.uint64)))
                    s, e = s[p], e[p + min_words - 1]
                    h = b.span_hash(s, e).view(np.int64)
                    first = np.zeros(len(p), bool)
                    first[np.unique(h, return_index=True)[1]] = True
                    out.append((np.full(len(p), docs[b.row + i], np.int64), (s - b.offsets[i]).astype(np.int32), (e - s).astype(np.int32), h, first))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc_id", "start", "size", "digest", "first"])

    return run


def equal_stretches(a: bytes, b: bytes, distance: int, min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, words) in ``a`` of maximal stretches equal to ``b`` moved by ``distance``, in whole words of ``a``."""
    lo, hi = max(0, distance), min(len(a), len(b) + distance)
    if hi <= lo:
        return []
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    same = np.concatenate([[False], x[lo:hi] == y[lo - distance : hi - distance], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1]) + lo
    space = SPACE[x]
    out = []
    for s, e in zip(edge[::2], edge[1::2], strict=True):
        if e - s < 2 * min_words - 1:
            continue
        if s > 0 and not space[s - 1] and not space[s]:  # begins within a word
            gaps = np.flatnonzero(space[s:e])
            s = s + gaps[0] if len(gaps) else e
        if e < len(a) and e > s and not space[e] and not space[e - 1]:
            gaps = np.flatnonzero(space[s:e])
            e = s + gaps[-1] if len(gaps) else s
        inside = ~space[s:e]
        words = int((inside[1:] & ~inside[:-1]).sum() + inside[0]) if e > s else 0
        if words >= min_words:
            out.append((int(s), int(e), words))
    return out


def _comparer(min_words: int):
    """Rows (doc_id, owner_id, hits, ta, tb) -> repeats; hits are the first start, last end and distance of windows."""

    def run(batches):
        for t in slices(batches, COMPARED):
            rows = []
            cols = [t.column(c).to_pylist() for c in ("doc_id", "owner_id", "hits", "ta", "tb")]
            for doc, owner, hits, ta, tb in zip(*cols, strict=True):
                a, b, found = ta.encode(), tb.encode(), []
                for hit in sorted(hits, key=lambda x: (x["start"], -x["end"], x["distance"])):
                    if not any(s <= hit["start"] and hit["end"] <= e for s, e in found):
                        for s, e, w in equal_stretches(a, b, hit["distance"], min_words):
                            found.append((s, e))
                            rows.append((doc, owner, s, e, s - hit["distance"], w))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "owner_id", "start", "end", "owner_start", "n_words"])

    return run


def _owned(rows: DataFrame) -> DataFrame:
    """The owner's place of each digest that several documents have; ``rows`` bear ``first`` at a document's first place of a digest.

    Aggregates of numbers alone, which combine in hash tables.
    """
    at = F.min_by(F.when(F.col("first"), F.col("start")), F.when(F.col("first"), F.col("doc_id")))
    found = rows.groupBy("digest").agg(F.min("doc_id").alias("owner_id"), at.alias("owner_start"), F.max("doc_id").alias("last"))
    return found.filter("last > owner_id").select("digest", "owner_id", "owner_start")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, owner_id, start, end, owner_start (bytes), n_words of passages that an earlier document (by doc_id) has too."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    found = materialize(named.mapInArrow(_chunker(min_words), "doc_id long, start int, digest long"), "chunks")
    known = found.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("digest")
    known = materialize(known, "known")
    several = materialize(sift(found, "digest", known.select(F.col("digest").alias("id"))), "several")
    discard(found)
    shared = join_split(several, known, ["digest"], hot_keys(several, ["digest"], ["doc_id", "start"]))
    marks = materialize(shared.groupBy("doc_id").agg(F.collect_list("digest").alias("shared")), "marks")
    discard(several, known)
    release(docs.sparkSession)
    # marks take a fraction of the texts' bytes, so their hash table fits where texts would have to be sorted
    full = sift(named, "doc_id", marks.select(F.col("doc_id").alias("id"))).join(marks.hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("id"), "text", "shared")
    rows = materialize(full.mapInArrow(_writer(min_words), "doc_id long, start int, size int, digest long, first boolean"), "windows")
    owned = materialize(_owned(rows), "owned")
    held = materialize(sift(rows, "digest", owned.select(F.col("digest").alias("id"))).drop("first"), "held")
    discard(rows, marks)
    release(docs.sparkSession)
    hits = join_split(held, owned, ["digest"], hot_keys(held, ["digest"], ["doc_id", "start"])).filter("doc_id > owner_id")
    hits = hits.groupBy("doc_id", "owner_id", (F.col("start") - F.col("owner_start")).alias("distance")).agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    pairs = materialize(hits.groupBy("doc_id", "owner_id").agg(F.collect_list(F.struct("start", "end", "distance")).alias("hits")), "evidence")
    both = pairs.select(F.explode(F.array("doc_id", "owner_id")).alias("id")).distinct()
    texts = materialize(rows_of(named.withColumnRenamed("doc_id", "id"), "id", both), "passages")
    full = _attach(pairs, "owner_id", texts, {"text": "tb"}, "doc_id")
    full = full.join(texts.select(F.col("id").alias("doc_id"), F.col("text").alias("ta")), "doc_id").select("doc_id", "owner_id", "hits", "ta", "tb")
    kind = "doc_id long, owner_id long, start long, end long, owner_start long, n_words long"
    return full.mapInArrow(_comparer(min_words), kind).distinct()


def _cut_out(text: Column, spans: Column) -> Column:
    """A text without the spans (start and end in bytes, at bounds of words) given, in the JVM: nothing is copied to Python."""
    raw = text.cast("binary")
    part = lambda lo, size: F.substring(raw, (lo + 1).cast("int"), size.cast("int"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.unhex(F.lit("")).alias("out"))

    def pass_by(acc: Column, x: Column) -> Column:
        out = F.when(x["start"] > acc["at"], F.concat(acc["out"], part(acc["at"], x["start"] - acc["at"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    return F.aggregate(F.array_sort(spans), begin, pass_by, lambda acc: F.concat(acc["out"], part(acc["at"], F.octet_length(raw)))).cast("string")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the passages that an earlier document has; each passage's first place stays.

    ``n_chars``, where there is one, follows the text.
    """
    own = _own_ids(docs)  # places of one text are none of another with its doc_id
    spans = repeats(own.select(F.col("_own").alias("doc_id"), "text"), min_words).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))  # of one document

    joined = own.join(spans, F.col("_own") == F.col("_doc"), "left")
    touched = F.col("_spans").isNotNull()
    out = joined.withColumn("_new", F.when(touched & F.col("text").isNotNull(), _cut_out(F.col("text").cast("string"), F.col("_spans"))).otherwise(F.col("text")))
    keep = []
    for c in docs.columns:
        if c == "text":
            keep.append(F.col("_new").alias("text"))
        elif c == "n_chars":
            keep.append(F.when(touched, F.length("_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            keep.append(F.col(f"`{c}`"))
    return out.select(*keep)
