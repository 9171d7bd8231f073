"""K-d tree partitioning of rows into shards of near-equal bytes.

Nodes are split at weighted medians along the metadata dimension that is widest in them
(relative to its range in all rows) until there are as many leaves as the target
bytes ask for.  All nodes of a level are split together: their cuts are a table of one row a node, joined
by node (the one broadcast, of as many rows as there are leaves).  A median is found exactly by
distributed histograms that narrow an interval of integer keys; all of a step have ``COUNTERS``
bins together, so the driver sees a bounded number of counters and never rows.

The order along a dimension is (coordinate, text hash, doc_id).  Coordinates are the same for
equal texts, so groups of equal texts stay whole unless a cut at the group's border would
miss the target by more than ``TOLERANCE`` of the node; then the group is cut between its doc_ids.

Defined results: a null text has no bytes and the weight 1; rows with a null doc_id are ordered as
doc_id 0 and repeated rows fall side by side; an empty table gives an empty result; some
shards stay empty if there are fewer rows than shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import gapless
from .scratch import discard, materialize

TOLERANCE = 0.01
#: Bins of a histogram at most and at least, and of all histograms of a step together.
BINS, FEWEST_BINS, COUNTERS = 1024, 8, 1 << 18
#: Dimensions, each an integer from the text's own statistics.
DIMENSIONS = ("d_size", "d_chars", "d_lines", "d_hash")


@dataclass
class Cut:
    """Rows of ``node`` below (value, hash, doc) in ``dim`` go left."""

    node: int
    dim: str
    goal: float  # weight to the left
    total: int
    tolerance: float
    value: int = 0
    hash: int | None = None
    doc: int | None = None
    before: int = 0


CUTS = "c_node int, c_dim string, c_value long, c_hash long, c_doc long, c_lo long, c_hi long, c_step long"


def _beside(rows: DataFrame, cuts: list[Cut], intervals: dict[int, tuple] | None = None, how: str = "inner") -> DataFrame:
    """Rows (``how`` inner: only those of the nodes cut), each with its node's cut, ``v`` (its coordinate there) and the interval searched."""
    none = (None, None, None)
    table = rows.sparkSession.createDataFrame([(c.node, c.dim, c.value, c.hash, c.doc, *(intervals or {}).get(c.node, none)) for c in cuts], CUTS)
    dims = F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.col(d))])
    return rows.join(F.broadcast(table), F.col("node") == F.col("c_node"), how).withColumn("v", dims[F.col("c_dim")])


def _goes_left() -> Column:
    """Whether a row beside its cut lies below it."""
    v, h = F.col("v"), F.col("h")
    same = F.col("c_hash").isNotNull() & (v == F.col("c_value"))
    tied = same & F.col("c_doc").isNotNull() & (h == F.col("c_hash"))
    return (v < F.col("c_value")) | F.coalesce(same & (h < F.col("c_hash")), F.lit(False)) | F.coalesce(tied & (F.col("id") < F.col("c_doc")), F.lit(False))


def _crossings(rows: DataFrame, cuts: list[Cut], key: Column, where: Column) -> dict[int, tuple[int, int, int]]:
    """For each cut the key at which the running weight passes its goal: (key, weight below it, weight at it).

    ``key`` is the integer searched and ``where`` tells the rows that count, both over rows beside their cut; ``cut.before`` is the weight below them.
    """
    ends = _beside(rows, cuts).filter(where).groupBy("node").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    before = {c.node: c.before for c in cuts}
    bounds = {r["node"]: (r["lo"], r["hi"], before[r["node"]]) for r in ends}
    goal = {c.node: c.goal for c in cuts}
    out: dict[int, tuple[int, int, int]] = {}
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  # differences of 64-bit keys can pass 64 bits
    while todo := [c for c in cuts if c.node in bounds and c.node not in out]:
        bins = max(FEWEST_BINS, min(BINS, COUNTERS // len(todo)))
        step = {c.node: max(1, -(-(bounds[c.node][1] - bounds[c.node][0] + 1) // bins)) for c in todo}
        sub = _beside(rows, todo, {c.node: (*bounds[c.node][:2], step[c.node]) for c in todo}).filter(where).withColumn("k", key).filter("k between c_lo and c_hi")
        bin_ = F.floor((wide("k") - wide("c_lo")) / wide("c_step")).cast("long")
        hist: dict[int, list[tuple[int, int]]] = {}
        for r in sub.groupBy("node", bin_.alias("b")).agg(F.sum("w").alias("w")).collect():
            hist.setdefault(r["node"], []).append((r["b"], r["w"]))
        for c in todo:
            low, high, under = bounds[c.node]
            found = sorted(hist[c.node])
            for b, w in found:
                if under + w >= goal[c.node] or b == found[-1][0]:
                    break
                under += w
            low += b * step[c.node]
            if step[c.node] == 1:
                out[c.node] = (low, under, w)
            else:
                bounds[c.node] = (low, min(high, low + step[c.node] - 1), under)
    return out


def _settle(cut: Cut, before: int, at: int) -> int | None:
    """How many of the key's own rows go left, none (0) or all (1), if either comes near enough to the goal."""
    cut.before = before
    miss = [abs(before - cut.goal), abs(before + at - cut.goal)]
    return miss.index(min(miss)) if min(miss) <= cut.tolerance * cut.total else None


def _split(rows: DataFrame, cuts: list[Cut]) -> list[Cut]:
    """Fix each cut's place: by value, within equal values by text hash, within equal texts by doc_id."""
    here = F.col("v") == F.col("c_value")
    stages = (("value", F.col("v"), F.lit(True)), ("hash", F.col("h"), here), ("doc", F.col("id"), here & (F.col("h") == F.col("c_hash"))))
    left = {c.node: c for c in cuts}
    for name, key, where in stages:
        if not left:
            break
        found = _crossings(rows, list(left.values()), key, where)
        for node, (at, before, weight) in found.items():
            c = left[node]
            if name == "doc":
                c.tolerance = 1.0
            side = _settle(c, before, weight)
            setattr(c, name, at + (side or 0))
            if side is not None:
                del left[node]
    return cuts


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions; one pass over the texts, in the JVM."""
    t = F.col("text").cast("string")
    full = F.coalesce(t, F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(full) + 1).cast("long").alias("size"),
        F.when(t.isNotNull(), F.crc32(t.cast("binary"))).alias("text_crc32"),
        F.xxhash64(t.isNull(), full).alias("h"),
        F.length(full).cast("long").alias("d_chars"),
        (F.length(full) - F.length(F.replace(full, F.lit("\n"), F.lit("")))).cast("long").alias("d_lines"),
    ).select(
        "*",
        F.col("size").alias("w"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.col("size").alias("d_size"),
        F.shiftright("h", 8).alias("d_hash"),
    )


def partition(rows: DataFrame, leaves: int) -> DataFrame:
    """Add ``shard`` (0 to leaves - 1) to a materialised table with ``w``, ``h``, ``id`` and the dimensions; each level's nodes are written out."""
    columns = rows.columns
    rows = rows.withColumn("node", F.lit(0))  # another frame than the caller's table, which stays
    parts = {0: (0, leaves)}  # node -> first leaf and number of leaves
    span: dict[str, int] = {}
    while todo := {k: v for k, v in parts.items() if v[1] > 1}:
        aggs = [F.sum("w").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]]
        got = {r["node"]: r for r in rows.groupBy("node").agg(*aggs).collect() if r["node"] in todo}
        width = {n: {d: r[f"hi_{d}"] - r[f"lo_{d}"] for d in DIMENSIONS} for n, r in got.items()}
        span = span or (next(iter(width.values())) if width else {})
        cuts = []
        for n, r in got.items():
            k = todo[n][1]
            dim = max(DIMENSIONS, key=lambda d: width[n][d] / max(1, span[d]))  # the first of equally wide ones
            cuts.append(Cut(n, dim, r["w"] * (k // 2) / k, r["w"], TOLERANCE / k))
        if not cuts:
            break
        # children are numbered by their first leaf, which the left one shares with its parent
        second = {c.node: (todo[c.node][0] + todo[c.node][1] // 2, None, None) for c in cuts}
        settled = _split(rows, cuts)
        node = F.when(F.col("c_node").isNull() | _goes_left(), F.col("node")).otherwise(F.col("c_lo").cast("int")).alias("node")
        moved = materialize(_beside(rows, settled, second, "left").select(*columns, node), "nodes")
        discard(rows)
        rows = moved
        new = {}
        for n, (first, k) in parts.items():
            new[n] = (first, k // 2 if k > 1 else 1)
            if k > 1:
                new[first + k // 2] = (first + k // 2, k - k // 2)
        parts = new
    return rows.withColumnRenamed("node", "shard")


def shard_documents(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) of each document.

    Give ``target_bytes`` for as many leaves as the whole needs, or ``leaves``.
    """
    rows = materialize(metadata(docs), "metadata")
    if leaves is None:
        total = rows.agg(F.sum("w")).first()[0] or 0
        leaves = max(1, -(-total // max(1, target_bytes or 1)))
    placed = materialize(partition(rows, leaves).select("doc_id", "size", "text_crc32", "h", "shard"), "shards")
    out = gapless(placed, "shard", F.struct("doc_id", "h"), ["doc_id", "h"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
