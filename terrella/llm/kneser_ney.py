"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Counting.  Each task turns its texts into 64-bit word hashes, combines equal n-grams in
chunks of bounded size and sends each chunk's sorted n-grams as packed arrays, dealt by ranges of the
context's hash.  A reducer merges its arrays, so it has all n-grams of a context and writes
one file: n-gram hashes in order with their counts, context hashes in order with total count and
numbers of n-grams seen once, twice and more.  It passes each distinct n-gram's suffix on: a
continuation count of the next lower order.  The lowest order also gets plain word counts.
All counts cover all training rows; nothing is pruned or sampled.

Parts.  Their number follows the bytes of the training texts, so that a reducer holds as much at any size.

Hot contexts.  Contexts of any length with a large share of the tokens, found in a hash sample of the rows, have
their n-grams dealt by the last word over all reducers, and their totals summed over all reducers by an
aggregate.  The sample only decides where n-grams are counted, never what is counted.

Scoring.  Workers map the files (see ``scratch.fetch``) and look up whole blocks of tokens
with searches of sorted arrays; memory in use does not grow with the model.

An n-gram context before the first word is one begin mark, as for published toolkits; n-grams
that begin with it keep plain counts in lower orders.  Unseen words share the mass of one extra word type.

Defined results: null and empty texts are the end token alone; rows with a null doc_id do not train;
without training rows every token has probability 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, mix64
from .quality import bucket_of
from .scratch import fetch, materialize, scratch_path, store_bytes
from .sift import below

#: Fits the disk allowed for a model of all n-grams; any order from 2 on works.
ORDER = 2
CHUNK_TOKENS = 3_000_000
#: Bytes of training text for each part.
PART_BYTES = 8 << 20
HOT_SHARE, HOT_SAMPLE = 0.0005, 64
BEGIN, END = (mix64(np.array([x], np.uint64))[0] for x in (0xBE61, 0xE4D))
_C = np.uint64(0xC2B2AE3D27D4EB4F)

ROW = "level int, part int, n long, blob binary"
META = "level int, part int, n long, blob binary"
#: The level that rows with totals of hot contexts bear; descriptions of files bear their level's negative.
HOT = -1000


def chain(cols: list[np.ndarray]) -> np.ndarray:
    """The hash of a tuple of word hashes."""
    h = mix64(cols[0] + np.uint64(len(cols)))
    for c in cols[1:]:
        h = mix64(h * _C + c)
    return h


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash: sorted hashes have sorted parts."""
    return ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def word_parts(parts: int) -> int:
    """Words are few beside n-grams, and every reducer sends to each of their parts: so those are fewer."""
    return max(8, parts // 4)


def place(ctx: np.ndarray, last: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Where an n-gram is counted and looked up, by its context's hash or, in a hot context, by its last word's."""
    p = part_of(ctx, parts)
    is_hot = _member(hot, ctx)
    p[is_hot] = part_of(mix64(last[is_hot]), parts)
    return p


def _member(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def sequences(column: pa.Array):
    """Token hashes of each block's texts, each text closed by the end token, and the texts' bounds."""
    for b in blocks(column, lower=True):
        h, at = b.word_hashes()
        ends = at[1:] + np.arange(b.n)
        bounds = np.concatenate([[0], ends + 1])
        out = np.full(len(h) + b.n, END, np.uint64)
        words = np.ones(len(out), bool)
        words[ends] = False
        out[words] = h
        yield b, out, bounds


def tuples(tokens: np.ndarray, bounds: np.ndarray, m: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of the m-grams ending at tokens that have one, and those tokens' positions."""
    start = np.repeat(bounds[:-1], np.diff(bounds))
    i = np.arange(len(tokens)) - start
    pos = np.flatnonzero(i >= m - 2) if m > 1 else np.arange(len(tokens))
    cols = []
    for back in range(m - 1, 0, -1):
        c = tokens[np.maximum(pos - back, 0)]
        c = np.where(i[pos] < back, BEGIN, c)
        cols.append(c)
    return [*cols, tokens[pos]], pos


def combine(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples in order, with summed counts."""
    if not len(counts):
        return cols, counts
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in cols], np.add.reduceat(counts[order], at)


def _rows(level: int, cols: list[np.ndarray], counts: np.ndarray, part: np.ndarray):
    """Rows of packed arrays, one for each part."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange((int(part.max()) if len(part) else -1) + 2))
    for p in range(len(cuts) - 1):
        o = order[cuts[p] : cuts[p + 1]]
        if len(o):
            blob = b"".join([*(c[o].tobytes() for c in cols), counts[o].astype(np.int64 if counts.dtype == np.int64 and counts[o].max() >= 2**31 else np.int32).tobytes()])
            yield level, p, len(o), blob


def _unpack(n: int, blob: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    cols = [np.frombuffer(blob, np.uint64, n, 8 * n * i) for i in range(width)]
    kind = np.int32 if len(blob) == n * (8 * width + 4) else np.int64
    return cols, np.frombuffer(blob, kind, n, 8 * n * width).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["level", "part", "n", "blob"])


def _counter(order: int, parts: int, hot: np.ndarray):
    """Texts -> packed n-grams: level ``order`` with all, lower levels with those after the begin mark, level 0 with words."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]):
        tokens = np.concatenate([t for t, _ in held])
        size = np.cumsum([0, *[len(t) for t, _ in held]])
        bounds = np.concatenate([[0], *[b[1:] + s for (_, b), s in zip(held, size, strict=False)]])
        for m in range(order, 1, -1):
            cols, _ = tuples(tokens, bounds, m)
            if m < order:
                first = cols[0] == BEGIN
                cols = [c[first] for c in cols]
            cols, counts = combine(cols, np.ones(len(cols[0]), np.int64))
            part = place(chain(cols[:-1]), cols[-1], hot, parts)
            yield _batch(list(_rows(m, cols, counts, part)))
        words, counts = np.unique(tokens, return_counts=True)
        yield _batch(list(_rows(0, [words], counts.astype(np.int64), part_of(words, word_parts(parts)))))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, tokens, bounds in sequences(batch.column("text")):
                held.append((tokens, bounds))
                n += len(tokens)
                if n >= CHUNK_TOKENS:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, 255 for those in the list of large ones."""
    return np.minimum(counts, 255).astype(np.uint8), np.flatnonzero(counts >= 255)


def _reducer(level: int, parts: int, hot: np.ndarray, folder: str):
    """Packed n-grams of one part and level -> a file, its description, and suffixes for the level below; other rows pass."""
    import json
    import uuid

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        mine: list = [[] for _ in range(level + 1)]
        passed, raw = [], []
        for lv, n, blob in zip(*(group.column(c).to_pylist() for c in ("level", "n", "blob")), strict=True):
            if lv == level:
                cols, counts = _unpack(n, blob, level)
                for a, c in zip(mine, [*cols, counts], strict=True):
                    a.append(c)
            elif lv == 0 and level == 1:
                raw.append(_unpack(n, blob, 1))
            else:
                passed.append((lv, part, n, blob))
        out = passed
        cols, counts = combine([np.concatenate([*a, np.zeros(0, np.uint64)]) for a in mine[:-1]], np.concatenate([*mine[-1], np.zeros(0, np.int64)]))
        about: dict = {"n": len(counts), "seen": [int((counts == k).sum()) for k in (1, 2, 3, 4)], "total": int(counts.sum())}
        if level > 1 and len(counts):
            ctx = chain(cols[:-1])
            new = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            kinds = [counts, counts == 1, counts == 2, counts >= 3]
            stats = [np.add.reduceat(k.astype(np.int64), new) for k in kinds]
            whole = ~_member(hot, ctx[new])
            if not whole.all():
                out.append((HOT, part, int((~whole).sum()), b"".join([ctx[new][~whole].tobytes(), *(x[~whole].astype(np.int64).tobytes() for x in stats)])))
            by = np.argsort(ctx[new][whole], kind="stable")
            key = mix64(ctx * _C + cols[-1])
            o = np.argsort(key, kind="stable")
            small, large = _narrow(counts[o])
            arrays = [key[o], large.astype(np.int64), counts[o][large], ctx[new][whole][by], stats[0][whole][by], *(s[whole][by].astype(np.uint32) for s in stats[1:]), small]
            suffix = cols[1:]
            suffix, n1 = combine(suffix, np.ones(len(counts), np.int64))
            target = part_of(suffix[0], word_parts(parts)) if level == 2 else place(chain(suffix[:-1]), suffix[-1], hot, parts)
            starts = suffix[0] == BEGIN  # these keep plain counts, which the texts gave
            out += list(_rows(level - 1, [c[~starts] for c in suffix], n1[~starts], target[~starts]))
        elif level == 1:
            words, plain = combine([np.concatenate([*[c[0][0] for c in raw], np.zeros(0, np.uint64)])], np.concatenate([*[c[1] for c in raw], np.zeros(0, np.int64)]))
            cont = np.zeros(len(plain), np.int64)
            cont[np.searchsorted(words[0], cols[0])] = counts
            arrays = [words[0], plain, cont]
            about |= {"words": len(plain), "tokens": int(plain.sum())}
        if len(counts) or level == 1:
            name = f"{folder}/{level}-{part}-{uuid.uuid4().hex}"
            store_bytes(name, *arrays)
            about |= {"file": name, "sizes": [len(a) for a in arrays], "kinds": [a.dtype.str for a in arrays]}
        out.append((-level, part, 0, json.dumps(about).encode()))
        return pa.Table.from_batches([_batch(out)])

    return run


@dataclass
class Model:
    """Descriptions of the files; workers open them when they first need them."""

    order: int
    parts: int
    hot: np.ndarray
    files: dict = field(default_factory=dict)  # (level, part) -> description
    discounts: dict = field(default_factory=dict)
    hot_names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hot contexts, in order
    hot_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))  # total, and n-grams seen once, twice and more
    words: int = 0
    tokens: int = 0
    total: int = 0  # of continuation counts
    kinds: tuple = (0, 0, 0)  # words with continuation count 1, 2, more


_open: dict[str, list[np.ndarray]] = {}


def arrays_of(about: dict) -> list[np.ndarray]:
    """The arrays of a file, mapped."""
    name = about["file"]
    if name not in _open:
        if len(_open) > 20_000:
            _open.clear()
        raw = np.memmap(fetch(name), np.uint8, "r") if sum(about["sizes"]) else np.zeros(0, np.uint8)
        at, out = 0, []
        for n, kind in zip(about["sizes"], about["kinds"], strict=True):
            size = n * np.dtype(kind).itemsize
            out.append(raw[at : at + size].view(kind))
            at += size
        _open[name] = out
    return _open[name]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _by_part(part: np.ndarray, keys: np.ndarray):
    """(part, rows) with rows in order of their keys, so that searches walk through the file."""
    order = np.lexsort((keys, part))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(part[order[lo]]), order[lo:hi]


def word_counts(model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain and continuation counts of words."""
    plain, cont = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for p, rows in _by_part(part_of(words, word_parts(model.parts)), words):
        if about := model.files.get((1, p)):
            table, a, b = arrays_of(about)
            at, ok = _find(table, words[rows])
            plain[rows[ok]], cont[rows[ok]] = a[at[ok]], b[at[ok]]
    return plain, cont


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def probabilities(model: Model, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each token after its context, and its plain count."""
    uniq, inverse = np.unique(tokens, return_inverse=True)
    plain, cont = word_counts(model, uniq)
    if model.total:
        d = model.discounts[1]
        rest = sum(x * k for x, k in zip(d, model.kinds, strict=True)) / model.total
        p = (_discounted(cont, d) / model.total + rest / (model.words + 1))[inverse]
    else:
        p = np.full(len(tokens), 1 / (model.words + 1))
    for m in range(2, model.order + 1):
        if m not in model.discounts:
            continue
        cols, pos = tuples(tokens, bounds, m)
        ctx = chain(cols[:-1])
        key = mix64(ctx * _C + cols[-1])
        count, total, rest = np.zeros(len(pos), np.int64), np.zeros(len(pos)), np.zeros(len(pos))
        d = model.discounts[m]
        for p_, rows in _by_part(place(ctx, cols[-1], model.hot, model.parts), key):
            if (about := model.files.get((m, p_))) and "file" in about:
                keys, large, values, contexts, sums, n1, n2, n3, small = arrays_of(about)
                at, ok = _find(keys, key[rows])
                c = small[at].astype(np.int64)
                big = np.flatnonzero(ok & (c == 255))
                c[big] = values[np.searchsorted(large, at[big])]
                count[rows] = np.where(ok, c, 0)
                at, ok = _find(contexts, ctx[rows])
                r, at = rows[ok], at[ok]
                total[r] = sums[at]
                rest[r] = d[0] * n1[at] + d[1] * n2[at] + d[2] * n3[at]
        at, ok = _find(model.hot_names, ctx)
        total[ok] = model.hot_stats[at[ok], 0]
        rest[ok] = model.hot_stats[at[ok], 1:] @ np.array(d)
        seen = total > 0
        t = np.where(seen, total, 1.0)
        p[pos] = np.where(seen, _discounted(count, d) / t + rest / t * p[pos], p[pos])
    return p, plain[inverse]


def _discounts(seen: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from counts of counts; plain ones where counts are too few."""
    n1, n2, n3, n4 = seen
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [k - (k + 1) * y * b / a if a else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True))


def hot_contexts(docs: DataFrame, order: int) -> np.ndarray:
    """Hashes of contexts of any length with a large share of the tokens in a sample of the texts by hash; at most a few thousand a length."""
    most = int(1 / HOT_SHARE)

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for _, t, bounds in sequences(batch.column("text")):
                if n < CHUNK_TOKENS:
                    held.append((t, bounds))
                    n += len(t)
        for m in range(2, order + 1):
            ctx = [chain(tuples(t, bounds, m)[0][:-1]) for t, bounds in held]
            c, k = np.unique(np.concatenate([*ctx, np.zeros(0, np.uint64)]), return_counts=True)
            top = np.argsort(-k, kind="stable")[:most]
            top = top[k[top] >= max(2, HOT_SHARE * n / 8)]
            yield pa.RecordBatch.from_arrays([pa.array(c[top].view(np.int64)), pa.array(k[top]), pa.array(np.zeros(len(top), np.int64))], ["c", "n", "total"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], ["c", "n", "total"])

    part = docs.filter(below(F.xxhash64("text"), 1 / HOT_SAMPLE)).select("text").mapInArrow(count, "c long, n long, total long")
    sums = part.groupBy("c").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = sums.orderBy(F.desc("total"), F.desc("n"), "c").limit(order * most).collect()
    total = max([r["total"] for r in rows], default=0)
    found = [r["c"] for r in rows if not r["total"] and r["n"] >= HOT_SHARE * total]
    begin = [chain([np.array([BEGIN])] * m)[0] for m in range(1, order)]  # every text has these
    return np.unique(np.concatenate([np.array(found, np.int64).view(np.uint64), np.array(begin, np.uint64)]))


def _hot_totals(meta: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot contexts and their totals over all parts."""

    def run(batches):
        for batch in batches:
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(blob, np.int64).reshape(5, n)], ["c", "t", "n1", "n2", "n3"])

    stats = meta.filter(F.col("level") == HOT).select("n", "blob").mapInArrow(run, "c long, t long, n1 long, n2 long, n3 long")
    got = stats.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("t", "n1", "n2", "n3")]).collect()
    names = np.array([r["c"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([tuple(r)[1:] for r in got], np.float64).reshape(-1, 4)[order]


def train(docs: DataFrame, order: int = ORDER, parts: int | None = None) -> Model:
    """Count the texts given; rows without an id are left out by the caller."""
    import json

    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    parts = parts or max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    hot = hot_contexts(texts, order)
    folder = scratch_path(spark, "ngrams")
    rows = texts.mapInArrow(_counter(order, parts, hot), ROW)
    for level in range(order, 0, -1):
        rows = rows.groupBy("part").applyInArrow(_reducer(level, parts, hot, folder), META)
    model = Model(order, parts, hot)
    seen: dict[int, np.ndarray] = {}
    meta = materialize(rows, "counted")
    model.hot_names, model.hot_stats = _hot_totals(meta)
    for r in meta.filter(F.col("level") > HOT).collect():  # descriptions only: one row for each level and part
        level, about = -r["level"], json.loads(bytes(r["blob"]))
        seen[level] = seen.get(level, 0) + np.array([*about["seen"], about["n"], about["total"]], np.int64)
        if level == 1:
            model.words += about["words"]
            model.tokens += about["tokens"]
        if "file" in about:
            model.files[level, r["part"]] = {k: about[k] for k in ("file", "sizes", "kinds")}
    for level, s in seen.items():
        if s[4]:
            model.discounts[level] = _discounts([int(x) for x in s[:4]])
    if 1 in seen:
        n1, n2, _, _, n, total = (int(x) for x in seen[1])
        model.total, model.kinds = total, (n1, n2, n - n1 - n2)
    return model


def scores_column(model: Model, text: str = "text") -> Column:
    """An Arrow UDF column: n_tokens, n_known, base_score and score of whole texts."""
    shared = None

    def attach(spark):
        nonlocal shared
        shared = spark.sparkContext.broadcast(model)

    from pyspark.sql import SparkSession

    attach(SparkSession.getActiveSession())
    held = shared

    @F.arrow_udf("struct<n_tokens: long, n_known: long, base_score: double, score: double>")
    def of(t: pa.Array) -> pa.Array:
        m = held.value
        out: list[list] = [[], [], [], []]
        for _, tokens, bounds in sequences(t):
            p, plain = probabilities(m, tokens, bounds)
            base = np.log10((plain + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
            out[0].append(np.diff(bounds))
            out[1].append(np.add.reduceat((plain > 0).astype(np.int64), bounds[:-1]))
            out[2].append(np.add.reduceat(base, bounds[:-1]))
            out[3].append(np.add.reduceat(np.log10(p), bounds[:-1]))
        cols = [np.concatenate([*o, np.zeros(0, k)]).astype(k) for o, k in zip(out, (np.int64, np.int64, np.float64, np.float64), strict=True)]
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["n_tokens", "n_known", "base_score", "score"])

    return of(F.col(text).cast("string"))


def score_documents(docs: DataFrame, order: int = ORDER, mod: int = 5, hold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; rows whose crc32 remainder is ``hold`` do not train."""
    model = train(docs.filter(bucket_of(mod) != hold), order)
    held = F.coalesce(bucket_of(mod) == hold, F.lit(False)).alias("held_out")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, scores_column(model).alias("s"))
    return x.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score")
