"""Flow networks: downstream cells, node degrees, chains of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Fixed order of the eight neighbours (row, column): the first of equals is downstream.
D8 = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def downstream(cells: DataFrame, min_flow: int = 0) -> DataFrame:
    """row, col, fa and the neighbour (to_row, to_col, to_fa) with the greatest flow above the cell's own.

    Each cell is sent to its neighbours and the best per cell is a combined aggregate; nothing is joined but by key.
    """
    offers = F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(i).alias("k")) for i, (dr, dc) in enumerate(D8)])
    sent = cells.filter("fa is not null").select("row", "col", "fa", F.explode(offers).alias("o"))
    # seen from the receiver, the sender lies at the k-th offset
    got = sent.select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.struct("fa", (-F.col("o.k")).alias("k"), F.col("row").alias("r"), F.col("col").alias("c")).alias("n"))
    best = got.groupBy("row", "col").agg(F.max("n").alias("n"))
    own = cells.filter(F.col("fa") >= min_flow)
    return own.join(best, ["row", "col"]).filter(F.col("n.fa") > F.col("fa")).select("row", "col", "fa", F.col("n.r").alias("to_row"), F.col("n.c").alias("to_col"), F.col("n.fa").alias("to_fa"))


def degrees(edges: DataFrame) -> DataFrame:
    """Number of segment ends at each node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def chains(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """src, dst, flow and ``chain``: segments joined at nodes of degree 2, named by the chain's least edge number.

    Edges must have a unique ``edge`` number.  Two edges at a node of degree 2 are linked; labels spread by minima and
    jump to their label's label, so rounds grow with the logarithm of a chain's length.  Each round is a checkpoint.
    """
    checkpoint_dir(edges.sparkSession)
    at = edges.select("edge", F.explode(F.array("src", "dst")).alias("node"))
    pairs = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("a"), F.max("edge").alias("b")).filter("n = 2 and a <> b").select("a", "b")
    links = pairs.union(pairs.select("b", "a")).toDF("edge", "other").checkpoint()
    label = edges.select("edge", F.col("edge").alias("label")).checkpoint()
    for _ in range(max_rounds):
        near = links.join(label.withColumnRenamed("edge", "other"), "other").groupBy("edge").agg(F.min("label").alias("m"))
        low = label.join(near, "edge", "left").select("edge", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = low.join(low.select(F.col("edge").alias("label"), F.col("label").alias("far")), "label").select("edge", F.least("label", "far").alias("label")).checkpoint()
        moved = jump.join(label.withColumnRenamed("label", "old"), "edge").filter("label <> old").limit(1).count()
        label = jump
        if not moved:
            break
    else:
        raise RuntimeError(f"chains did not settle in {max_rounds} rounds")
    return edges.join(label.withColumnRenamed("label", "chain"), "edge")
