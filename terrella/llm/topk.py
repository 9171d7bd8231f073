"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors become integers; equal vectors are kept once, with the few smallest ids that a
result can hold.  Each shard of bounded size gets a ball tree.  A node's inner products with a
query q are at most q . centre + |q| * radius; each query visits leaves in the order of
their bounds and stops when the next bound is below its current k-th score, or at once for
subtrees whose bound is.  Shards are searched in waves, each twice as many as before; after a wave every
query's k-th score over all shards so far goes to the next, which starts with it.
Queries are searched in blocks, each against every shard; neither side is ever broadcast whole.

Inner products are exact: in doubles where they stay below 2 ** 53, else in integers of any size
(slower; the tree's bounds then only have to leave room for rounding).

Defined results: vectors that are null, or hold a null or a component that is not finite (also not after scaling), take no part;
vectors of different lengths are not compared; equal scores go to the smaller id; a query meets
every row but those of its own id; repeated equal rows count once.
Ranks follow exact scores; a score that does not fit in 64 bits is given as the nearest number that does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

SHARD_ROWS, QUERY_ROWS, LEAF = 16384, 4096, 64
#: Relative slack of bounds against rounding.
EPS = 1e-9
LONG = 2**63
#: Where a vector has fewer ids.
NO_ID = -LONG


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``v`` array<double> of whole numbers, of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double") * float(scale))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    ok &= ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # from 2 ** 52 on a double is whole; floor itself gives a long, which holds no more than 2 ** 63; + 0 turns -0 into 0
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c) + F.lit(0.0))
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class BallTree:
    """Nodes as arrays; leaves hold consecutive rows of ``points``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        centers, radii, parents, is_leaf = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            rows = points[order[lo:hi]]
            c = rows.mean(axis=0)
            d = np.sqrt(np.square(rows - c).sum(axis=1))
            at = len(centers)
            centers.append(c)
            radii.append(d.max())
            parents.append(parent)
            if hi - lo <= leaf or d.max() == 0:
                is_leaf.append(len(self.leaves))
                self.leaves.append((lo, hi))
                continue
            is_leaf.append(-1)
            a = rows[d.argmax()]
            b = rows[np.square(rows - a).sum(axis=1).argmax()]
            side = rows @ (b - a)
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(side, half)]
            todo += [(lo, lo + half, at), (lo + half, hi, at)]
        self.order, self.points = order, points[order]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.parents, self.is_leaf = np.array(parents), np.array(is_leaf)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves): upper bounds, each no greater than its ancestors'."""
        size = np.sqrt(np.square(q).sum(axis=1))[:, None]
        b = q @ self.centers.T + size * self.radii[None, :]
        b += size * (np.sqrt(np.square(self.centers).sum(axis=1)) + self.radii)[None, :] * EPS + EPS  # terms may cancel
        b = np.where(np.isnan(b), np.inf, b)  # past the range of doubles
        for i in range(1, len(self.centers)):  # parents come before children
            np.minimum(b[:, i], b[:, self.parents[i]], out=b[:, i])
        leaf = np.flatnonzero(self.is_leaf >= 0)
        return b[:, leaf[np.argsort(self.is_leaf[leaf])]]


def _exact(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of any size."""
    return np.frompyfunc(int, 1, 1)(x)


def search_large(q: np.ndarray, q_ids: np.ndarray, tree: BallTree, ids: np.ndarray, k: int, known: np.ndarray) -> list[tuple[int, int, int]]:
    """The same as ``search`` in integers of any size, query by query."""
    ids, bounds, out = ids[tree.order], tree.bounds(q), []
    for r, row in enumerate(q):
        mine, best = _exact(row), []  # (-score, id)
        for leaf in np.argsort(-bounds[r], kind="stable"):
            if bounds[r, leaf] < known[r] or (len(best) >= k and bounds[r, leaf] < -best[k - 1][0]):  # exact between a double and an int
                break
            a, b = tree.leaves[leaf]
            scores = _exact(tree.points[a:b]) @ mine if len(mine) else [0] * (b - a)
            best += [(-s, int(c)) for s, some in zip(scores, ids[a:b], strict=True) for c in some if c != NO_ID and c != q_ids[r]]
            best = sorted(best)[:k]
        out += [(r, c, -s) for s, c in best if -s >= known[r]]
    return out


def search(q: np.ndarray, q_ids: np.ndarray, tree: BallTree, ids: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of candidates that contain the k best of this shard with a score of at least ``known``.

    ``ids``: for each point the smallest ids that share its vector, padded with ``NO_ID``.
    """
    n, width = len(q), ids.shape[1]
    ids = ids[tree.order]
    best = np.full((n, k), -np.inf)
    who = np.full((n, k), np.iinfo(np.int64).max)
    bounds = tree.bounds(q)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(n)
    for step in range(bounds.shape[1]):
        leaf = visit[active, step]
        live = bounds[active, leaf] >= np.maximum(best[active, k - 1], known[active])
        active, leaf = active[live], leaf[live]
        if not len(active):
            break
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = active[order[lo:hi]]
            a, b = tree.leaves[leaf[order[lo]]]
            score = np.repeat(q[rows] @ tree.points[a:b].T, width, axis=1)
            cand = np.broadcast_to(ids[a:b].ravel(), score.shape)
            score = np.where((cand == NO_ID) | (cand == q_ids[rows][:, None]), -np.inf, score)
            score = np.concatenate([best[rows], score], axis=1)
            cand = np.concatenate([who[rows], cand], axis=1)
            top = np.lexsort((cand, -score), axis=1)[:, :k]
            best[rows] = np.take_along_axis(score, top, axis=1)
            who[rows] = np.take_along_axis(cand, top, axis=1)
    r, c = np.nonzero(np.isfinite(best) & (best >= known[:, None]))
    return r, who[r, c], best[r, c]


def _order_text(s: int) -> str:
    """A text that sorts as whole numbers do beyond 64 bits; ``FITS`` for those that fit."""
    if -LONG <= s < LONG:
        return FITS
    digits = str(abs(s))
    if s > 0:
        return f"{FITS}{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


FITS = "1"
FOUND = "query_id long, vec_id long, score long, beyond string"


def _searcher(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64"), "beyond": pd.Series(dtype="str")})
        right = right.sort_values("first").reset_index(drop=True)
        points = np.array(right["v"].tolist(), np.float64)
        q = np.array(left["v"].tolist(), np.float64)
        ids = np.full((len(right), k + 1), NO_ID, np.int64)
        for i, x in enumerate(right["ids"]):
            ids[i, : len(x)] = x
        q_ids, known = left["vec_id"].to_numpy(), left["known"].to_numpy(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            tree = BallTree(points)
            if not points.shape[1] or np.abs(points).max() * np.abs(q).max() * points.shape[1] < 2**53:
                r, who, score = search(q, q_ids, tree, ids, k, known)
                return pd.DataFrame({"query_id": q_ids[r], "vec_id": who, "score": score.astype(np.int64), "beyond": FITS})
            found = search_large(q, q_ids, tree, ids, k, known)
        rows = [(int(q_ids[r]), who, max(-LONG, min(LONG - 1, s)), _order_text(s)) for r, who, s in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "beyond"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _floor() -> Column:
    """A double that the score found is no less than."""
    low = F.col("score").cast("double")
    return F.when(F.col("beyond") < FITS, float("-inf")).otherwise(low - F.abs(low) * 2.0**-51)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``."""
    rows = materialize(quantized(vectors), "vectors")
    w = Window.partitionBy("v").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "v"]).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k + 1)  # limited before the shuffle too
    points = materialize(few.groupBy("v").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    n = points.count()
    shards = max(1, -(-n // SHARD_ROWS))
    points = points.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("dim", F.size("v"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    lanes = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def phase(q: DataFrame, lo: int, hi: int) -> DataFrame:
        left = q.select("vec_id", "v", "known", "dim", "block", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("shard"))
        right = points.filter(F.col("shard").between(lo, hi - 1)).select("first", "ids", "v", "dim", "shard", lanes)
        by = ["dim", "shard", "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_searcher(k), FOUND)

    found = materialize(_best(phase(queries.withColumn("known", F.lit(float("-inf"))), 0, 1), k).drop("rank"), "found")
    done = 1
    while done < shards:
        kth = _best(found, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), _floor().alias("known"))
        rest = queries.join(kth, "vec_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
        step = min(shards, 3 * done)
        found = materialize(_best(found.unionByName(phase(rest, done, step)), k).drop("rank"), "found")
        done = step
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
