"""Near-duplicate groups by b-bit MinHash.

1. Each text gets the set of its distinct word shingles (as 64-bit hashes), an exact set
   digest, full MinHash minima hashed into band keys, and a packed signature that
   retains only the low bits of the minima.
2. Texts with equal sets form a class; everything after works on one document of each class.
3. A band bucket proposes pairs.  Each document is first paired with the ``HOOKS`` smallest
   of its buckets' smallest ids, and the two of every bucket of two with each other: linear
   in documents, however large a bucket is.
4. Pairs pass if the similarity estimated from signature bits, corrected for chance
   collisions, is not far below the threshold; then both full sets are compared.
5. Components of the links found so far label each document.  A bucket whose members all
   bear one label can add nothing.  In the others, each member outside the commonest label is
   compared with all members of other labels, in blocks of bounded size, on packed
   signatures: first only its most promising pair is confirmed, then, with what labels are
   left, every promising pair, compared where the block is so that no pairs are sent on.  So no bucket is capped, and no proposed pair that could join two components goes unseen.

Recall: rows per band are the most for which a pair just at the threshold is missed by
all bands with probability below ``MISS``.

Defined results: null or wordless texts have an empty set and are linked with nothing; a
text with fewer words than a shingle has its whole word sequence as one shingle; a
row with a null doc_id gets a null component and stays; repeated rows of one doc_id
share its component.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, mix64, slices, windows
from .scratch import materialize, release, shared_dir
from .sift import hot_keys, join_split, rows_of

BANDS = 32
MISS = 1e-5
LOW_BITS = 2
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 5.0
BLOCK_ROWS = 1024
#: Pairs whose full sets are held at once.
VERIFIED = 512
#: Bucket heads that each document is first compared with, the smallest ids.
HOOKS = 2
SALTS = 32


def rows_per_band(num: int, den: int) -> int:
    t, r = num / den, 1
    while r < 16 and (1 - t ** (r + 1)) ** BANDS < MISS:
        r += 1
    return r


def least_size(num: int, den: int) -> int:
    """The smallest set that can be linked with an unequal one: n / (n + 1) must reach the threshold."""
    return -(-num // (den - num)) if den > num else 1 << 40


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for block in blocks(column, lower=True):
        h, at = block.word_hashes()
        w, first = windows(h, at, k)
        cut = np.searchsorted(first, at)
        for i in range(block.n):
            n = at[i + 1] - at[i]
            if n >= k:
                yield np.unique(w[cut[i] : cut[i + 1]])
            elif n:
                yield windows(h[at[i] : at[i + 1]], np.array([0, n]), int(n))[0]
            else:
                yield w[:0]


class Hasher:
    """Minima of one set under ``bands * rows`` affine permutations of 32-bit values."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        self.a = (seeds[: bands * rows] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.b = (seeds[bands * rows :] >> np.uint64(32)).astype(np.uint32)[:, None]

    def minima(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(x), 1024):
            v = x[None, lo : lo + 1024] * self.a
            v += self.b
            np.minimum(best, v.min(axis=1), out=best)
        return best

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(self.bands, self.rows).astype(np.uint64)
        key = mix64(np.arange(1, self.bands + 1, dtype=np.uint64))
        for j in range(self.rows):
            key = mix64(key * np.uint64(0xC2B2AE3D27D4EB4F) + m[:, j])
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> bytes:
        """The low bits of each (remixed) minimum, one bit plane after the other."""
        low = mix64(minima.astype(np.uint64))
        return b"".join(np.packbits((low >> np.uint64(j)).astype(np.uint8) & 1).tobytes() for j in range(LOW_BITS))


def _signer(k: int, num: int, den: int):
    def run(batches):
        hasher, least = Hasher(BANDS, rows_per_band(num, den)), least_size(num, den)
        for batch in batches:
            n, lo, hi, sig, bands = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                lo.append(int(mix64(s).sum().view(np.int64)))
                hi.append(int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)))
                if len(s) >= least:
                    m = hasher.minima(s)
                    sig.append(hasher.packed(m))
                    bands.append(hasher.band_keys(m))
                else:
                    sig.append(None)
                    bands.append(np.zeros(0, np.int64))
            off = np.zeros(len(bands) + 1, np.int32)
            np.cumsum([len(b) for b in bands], out=off[1:])
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                ["doc_id", "n_shingles", "set_lo", "set_hi", "sig", "bands"],
            )

    return run


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, set digest, packed signature and band keys of each document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _signer(k, num, den), "doc_id long, n_shingles long, set_lo long, set_hi long, sig binary, bands array<long>"
    )


def estimate(same_bits: np.ndarray, hashes: int) -> np.ndarray:
    """Similarity from the share of minima whose retained bits agree, less chance agreement."""
    chance = 0.5**LOW_BITS
    return (same_bits / hashes - chance) / (1 - chance)


def estimate_floor(num: int, den: int) -> float:
    """The estimate below which a pair at the threshold falls with negligible probability."""
    t, chance, hashes = num / den, 0.5**LOW_BITS, BANDS * rows_per_band(num, den)
    p = t + (1 - t) * chance
    return t - SLACK * (p * (1 - p) / hashes) ** 0.5 / (1 - chance)


def _planes(sigs: list[bytes], hashes: int) -> np.ndarray:
    a = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), LOW_BITS, hashes // 8)
    return np.ascontiguousarray(a)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of minima whose retained bits all agree; broadcasts over leading axes."""
    diff = a[..., 0, :] ^ b[..., 0, :]
    for j in range(1, LOW_BITS):
        diff = diff | (a[..., j, :] ^ b[..., j, :])
    return a.shape[-1] * 8 - np.bitwise_count(diff).sum(axis=-1, dtype=np.int64)


def _sizes_fit(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.minimum(na, nb) * den >= np.maximum(na, nb) * num


def _estimator(num: int, den: int):
    """Rows (a, b, na, nb, sa, sb) -> the (a, b) that may reach the threshold."""

    def run(batches):
        hashes, floor = BANDS * rows_per_band(num, den), estimate_floor(num, den)
        for t in batches:
            if not t.num_rows:
                continue
            a, b = (_planes(t.column(c).to_pylist(), hashes) for c in ("sa", "sb"))
            ok = estimate(agreeing(a, b), hashes) >= floor
            ok &= _sizes_fit(t.column("na").to_numpy(), t.column("nb").to_numpy(), num, den)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _groups(batches) -> Iterator[pa.Table]:
    """The rows of each group ``g``, from batches sorted by it; groups are blocks of bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(g)], strict=True):
            if held and held[-1].column("g")[0].as_py() != g[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _promising(t: pa.Table, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(minor row, rows of other labels that may reach the threshold, estimates) of a block."""
    hashes, floor = BANDS * rows_per_band(num, den), estimate_floor(num, den)
    minor, labels, n = (t.column(c).to_numpy() for c in ("minor", "label", "size"))
    left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
    if len(left) and len(right):
        sigs = _planes(t.column("sig").to_pylist(), hashes)
        for x in left:
            y = right[(labels[right] != labels[x]) & _sizes_fit(n[x], n[right], num, den)]
            guess = estimate(agreeing(sigs[x], sigs[y]), hashes)
            ok = guess >= floor
            if ok.any():
                yield x, y[ok], guess[ok]


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array([max(p) for p in pairs], np.int64)
    b = np.array([min(p) for p in pairs], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _best_pairs(num: int, den: int):
    """Blocks -> the most promising pair of each minor row."""

    def run(batches):
        for t in _groups(batches):
            ids = t.column("id").to_numpy()
            pairs = []
            for x, y, guess in _promising(t, num, den):
                pairs.append((int(ids[x]), int(ids[y[np.lexsort((ids[y], -guess))[0]]])))
            yield _pair_batch(pairs)

    return run


def _flags(num: int, den: int):
    """Blocks -> their numbers, of those with a promising pair."""

    def run(batches):
        for t in _groups(batches):
            if any(True for _ in _promising(t, num, den)):
                yield pa.RecordBatch.from_arrays([pa.array([t.column("g")[0].as_py()], pa.int64())], ["g"])

    return run


def _block_links(k: int, num: int, den: int):
    """Blocks with texts -> links, at most one for two labels already joined within the block; each pair in the first bucket it shares."""

    def run(batches):
        for t in _groups(batches):
            ids, labels, key = (t.column(c).to_numpy() for c in ("id", "label", "key"))
            bands = np.array(t.column("bands").to_pylist(), np.int64)
            sets = list(shingle_sets(t.column("text").combine_chunks(), k))
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            links = []
            for x, y, guess in _promising(t, num, den):
                band = int(np.flatnonzero(bands[x] == key[x])[0])
                for z in y[np.argsort(-guess, kind="stable")]:
                    one, other = find(int(labels[x])), find(int(labels[z]))
                    if one == other or (bands[x, :band] == bands[z, :band]).any():
                        continue
                    both = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                    if both > 0 and both * den >= num * (len(sets[x]) + len(sets[z]) - both):
                        root[max(one, other)] = min(one, other)
                        links.append((int(ids[x]), int(ids[z])))
            yield _pair_batch(links)

    return run


def _verifier(k: int, num: int, den: int):
    """Rows (a, b, ta, tb) -> the (a, b) whose full sets reach the threshold."""

    def run(batches):
        for t in slices(batches, VERIFIED):
            ok = np.zeros(t.num_rows, bool)
            tb = t.column("tb").to_pylist()
            distinct = list(dict.fromkeys(tb))
            right = dict(zip(distinct, shingle_sets(pa.array(distinct, pa.string()), k), strict=True))
            for i, s in enumerate(shingle_sets(t.column("ta"), k)):
                other = right[tb[i]]
                both = len(np.intersect1d(s, other, assume_unique=True))
                ok[i] = both > 0 and both * den >= num * (len(s) + len(other) - both)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _attach(pairs: DataFrame, key: str, table: DataFrame, cols: dict[str, str], by: str) -> DataFrame:
    """Join columns of ``table`` (by its ``id``) to pairs on ``key``, a hot key's pairs dealt over salts."""
    p = pairs.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    needed = p.select(F.col(key).alias("_k"), F.col("_s").alias("_t")).distinct()
    side = needed.join(table.select(F.col("id").alias("_id"), *[F.col(c).alias(n) for c, n in cols.items()]), F.col("_k") == F.col("_id"))
    return p.join(side, (p[key] == side["_k"]) & (p["_s"] == side["_t"])).drop("_s", "_k", "_t", "_id")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over links (a, b), by alternating large and small stars.

    Each round is a few shuffles of the links alone; stars are rewritten by minima, which
    combine before the shuffle.  Rounds grow with the logarithm of the longest path.
    """
    spark = links.sparkSession
    shared_dir(spark)
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = large.distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = small.distinct().checkpoint()
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            release(spark)
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
        last = now


def _verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links among candidate pairs (a, b), confirmed on full sets."""
    pairs = materialize(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = materialize(rows_of(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), "id", ids), "texts")
    full = _attach(pairs, "b", texts, {"text": "tb"}, "a")
    full = full.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return materialize(full.mapInArrow(_verifier(k, num, den), "a long, b long").distinct(), "links")


def _blocks(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Buckets of three or more with several labels as blocks ``g``: some of the rows outside the commonest label (minor) against some of all rows."""
    labelled = members.filter("n > 2").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    labelled = labelled.join(mixed, "key", "left_semi")
    counts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", F.col("label").alias("main"))).alias("m"), F.sum("c").alias("n")).select("key", "n", F.col("m.main").alias("main"), (F.col("n") - F.col("m.c")).alias("minor_n"))
    cells = labelled.join(main, "key").withColumn("l", F.ceil(F.col("minor_n") / BLOCK_ROWS).cast("int")).withColumn("r", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    cells = cells.join(reps.select("id", F.col("n").alias("size"), "sig", "bands"), "id")
    place = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    row = ["key", "id", "label", "size", "sig", "bands"]
    left = cells.filter("label <> main").select(*row, F.lit(True).alias("minor"), place("l").alias("i"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("j"))
    right = cells.select(*row, F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("l") - 1)).alias("i"), place("r").alias("j"))
    return left.unionByName(right).withColumn("g", F.xxhash64("key", "i", "j")).drop("i", "j")


def _by_block(rows: DataFrame, f, kind: str) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(f, kind)


def _late_links(members: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between different labels within buckets, among all pairs that may reach the threshold: blocks with such pairs get the texts and compare them there."""
    rows = materialize(_blocks(members, labels, reps), "blocks")
    flagged = materialize(_by_block(rows.drop("bands"), _flags(num, den), "g long").distinct(), "flagged")
    rows = rows.join(flagged, "g", "left_semi")
    texts = rows_of(docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("text").cast("string").alias("text")), "t_id", rows.select("id").distinct())
    full = rows.join(materialize(texts, "late_texts"), F.col("id") == F.col("t_id")).drop("t_id")
    return materialize(_by_block(full, _block_links(k, num, den), "a long, b long").distinct(), "late")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; links at ``den * shared >= num * union``."""
    spark: SparkSession = docs.sparkSession
    signed = materialize(signatures(docs, shingle, num, den), "signed")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("set_lo", "set_hi", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    banded = signed.filter("size(bands) > 0 and doc_id is not null")
    reps = materialize(
        banded.join(classes.select(F.col("rep").alias("doc_id"), "set_lo", "set_hi", "n_shingles"), ["doc_id", "set_lo", "set_hi", "n_shingles"], "left_semi")
        .dropDuplicates(["doc_id", "set_lo", "set_hi"])
        .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "bands"),
        "reps",
    )
    sigs = reps.select("id", "n", "sig")
    rows = reps.select("id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(rows.join(buckets, "key"), "members")

    # no later step sees a bucket of two, so its pair is always compared here
    few = F.explode(F.array_union(F.slice(F.array_sort(F.collect_set("rep")), 1, HOOKS), F.collect_set(F.when(F.col("n") == 2, F.col("rep"))))).alias("b")
    star = members.filter("id <> rep").groupBy(F.col("id").alias("a")).agg(few)
    star = _attach(star, "b", sigs, {"sig": "sb", "n": "nb"}, "a")
    star = star.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a")
    tried = materialize(star.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_estimator(num, den), "a long, b long"), "tried")
    links = _verify(tried, docs, shingle, num, den)
    labels = materialize(components(links), "labels")
    release(spark)
    best = _by_block(_blocks(members, labels, reps).drop("bands", "key"), _best_pairs(num, den), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    for found in (_verify(best, docs, shingle, num, den), None):
        found = _late_links(members, labels, reps, docs, shingle, num, den) if found is None else found
        if not found.isEmpty():
            stars = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
            labels = materialize(components(stars.unionByName(found)), "labels")

    component = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_lo", "set_hi", "n_shingles", F.coalesce("label", "rep").alias("component"))
    keys = ["set_lo", "set_hi", "n_shingles"]
    inside = join_split(filled.select("doc_id", *keys), component, keys, hot_keys(filled, keys, ["doc_id"]))
    out = inside.unionByName(signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", *keys, F.lit(None).cast("long").alias("component")))
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _own_ids(docs: DataFrame) -> DataFrame:
    """The documents with ``_own``: the doc_id, but for further texts of one doc_id a number of their own, above usual ids."""
    named, text = docs["doc_id"].cast("long"), F.xxhash64(F.col("text"))
    many = docs.select(named.alias("_id"), text.alias("_h")).filter("_id is not null").groupBy("_id").agg(F.min("_h").alias("_least"), F.max("_h").alias("_most"))
    many = materialize(many.filter("_least <> _most").select("_id", "_least"), "many")
    further = F.xxhash64(named, F.col("text")).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    own = F.when(F.col("_least").isNull() | (text == F.col("_least")), named).otherwise(further)
    return docs.join(many, named == F.col("_id"), "left").withColumn("_own", own).drop("_id", "_least")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, one of each near-duplicate group; repeated rows of a kept doc_id and text count as one, other texts of a doc_id stand for themselves."""
    from pyspark.sql import Window

    own = _own_ids(docs)
    gone = near_duplicates(own.select(F.col("_own").alias("doc_id"), "text"), shingle, num, den).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = own.join(gone, F.col("_own") == F.col("_gone"), "left_anti")
    w = Window.partitionBy("_own").orderBy(F.xxhash64("text"))
    return left.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1 or _own is null").drop("_nth", "_own")
