"""Map algebra on cells as rows (row, col, value).

Neighbourhood operators send each cell's value to the cells around and combine there: one
shuffle with partial sums, and no join of the grid with itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a window; the bounds reach the scan."""
    return cells.filter(F.col("row").between(*rows) & F.col("col").between(*cols))


def around(cells: DataFrame, value: str, half: int) -> DataFrame:
    """(row, col, dr, dc, v): each cell's value as seen from the cells around it."""
    off = F.sequence(F.lit(-half), F.lit(half))
    sent = cells.select("row", "col", F.col(value).alias("v"), F.explode(off).alias("dr")).select("*", F.explode(off).alias("dc"))
    return sent.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", "v")


def focal(cells: DataFrame, value: str, half: int, **aggs: Column) -> DataFrame:
    """Aggregates over the (2 * half + 1)² window of each cell there is, over the neighbours there are; ``v`` is the value, ``dr`` and ``dc`` its place."""
    there = F.bool_or((F.col("dr") == 0) & (F.col("dc") == 0)).alias("_there")
    return around(cells, value, half).groupBy("row", "col").agg(there, *[a.alias(n) for n, a in aggs.items()]).filter("_there").drop("_there")


def block_mean(cells: DataFrame, value: str, factor: int, name: str = "mean") -> DataFrame:
    """Mean of each block of factor² cells."""
    b = lambda c: F.floor(F.col(c) / F.lit(float(factor))).cast("long").alias(f"b{c}")
    return cells.groupBy(b("row"), b("col")).agg(F.avg(value).alias(name))


def at_bilinear(points: DataFrame, cells: DataFrame, value: str, x: str = "x", y: str = "y", name: str = "value") -> DataFrame:
    """Bilinear samples at (x = column, y = row) of points with a unique ``id``; centres lie at whole numbers, missing corners drop out and the rest is renormalised."""
    c0, r0 = F.floor(x), F.floor(y)
    fx, fy = F.col(x) - c0, F.col(y) - r0
    corner = lambda i, j: F.struct((r0 + j).alias("row"), (c0 + i).alias("col"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    corners = points.select("id", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("c")).select("id", "c.*").filter("w > 0")
    hit = corners.join(cells.select("row", "col", F.col(value).alias("_v")), ["row", "col"]).filter("_v is not null")
    return points.join(hit.groupBy("id").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(name)), "id", "left")


def at_nearest(points: DataFrame, cells: DataFrame, value: str, x: str = "x", y: str = "y", name: str = "value") -> DataFrame:
    """The value of the cell that holds each point: a class is never invented."""
    near = points.withColumns({"row": F.floor(F.col(y) + 0.5), "col": F.floor(F.col(x) + 0.5)})
    return near.join(cells.select("row", "col", F.col(value).alias(name)), ["row", "col"], "left")


def bspline_weights(t: Column) -> list[Column]:
    """Cubic B-spline weights of the four samples around a fraction."""
    return [F.pow(1 - t, 3) / 6, (3 * F.pow(t, 3) - 6 * F.pow(t, 2) + 4) / 6, (-3 * F.pow(t, 3) + 3 * F.pow(t, 2) + 3 * t + 1) / 6, F.pow(t, 3) / 6]


def at_bspline(points: DataFrame, cells: DataFrame, value: str, x: str = "x", y: str = "y", name: str = "value") -> DataFrame:
    """Smooth samples from the 16 cells around."""
    c0, r0 = F.floor(x), F.floor(y)
    wx, wy = bspline_weights(F.col(x) - c0), bspline_weights(F.col(y) - r0)
    parts = [F.struct((r0 + j - 1).alias("row"), (c0 + i - 1).alias("col"), (wx[i] * wy[j]).alias("w")) for i in range(4) for j in range(4)]
    hit = points.select("id", F.explode(F.array(*parts)).alias("c")).select("id", "c.*").join(cells.select("row", "col", F.col(value).alias("_v")), ["row", "col"]).filter("_v is not null")
    return points.join(hit.groupBy("id").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(name)), "id", "left")


def nearest_distance(cells: DataFrame, target: Column, reach: int, size: float, name: str = "distance") -> DataFrame:
    """Distance to the nearest target cell within ``reach`` cells; null beyond.  Targets send their distance out; the least is combined before the shuffle."""
    off = F.sequence(F.lit(-reach), F.lit(reach))
    t = cells.filter(target).select("row", "col", F.explode(off).alias("dr")).select("*", F.explode(off).alias("dc"))
    d = t.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2")).filter(F.col("d2") <= reach * reach)
    return cells.join(d.groupBy("row", "col").agg((F.sqrt(F.min("d2")) * size).alias(name)), ["row", "col"], "left")


def horn(cells: DataFrame, value: str, size: float, z: float) -> DataFrame:
    """Gradients (gx east, gy south) by Horn's weights for cells with all eight neighbours; null at edges."""
    v = F.greatest(F.col("v"), F.lit(0)) * z
    side = lambda along, across: F.sum(v * F.col(along) * F.when(F.col(across) == 0, 2).otherwise(1)) / (8 * size)
    g = focal(cells, value, 1, n=F.count("v"), gx=side("dc", "dr"), gy=side("dr", "dc"))
    return g.select("row", "col", *[F.when(F.col("n") == 9, F.col(c)).alias(c) for c in ("gx", "gy")])


def shade(gx: Column, gy: Column, altitude: float = 45.0, azimuth: float = 315.0) -> Column:
    """Light on a slope, 0 to 1; flat light where the slope is unknown."""
    import math

    alt, az = math.radians(altitude), math.radians(azimuth)
    # light from azimuth: east component sin(az), south component -cos(az); a surface rising east faces west
    lit = (math.sin(alt) - math.cos(alt) * (gx * math.sin(az) - gy * math.cos(az))) / F.sqrt(1 + gx * gx + gy * gy)
    return F.coalesce(F.greatest(F.least(lit, F.lit(1.0)), F.lit(0.0)), F.lit(math.sin(alt)))


def ramp(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear between stops, clamped to the ends; null stays null.  A few fixed stops are a CASE, not a join."""
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(x < x1, F.lit(float(y0)) + (x - float(x0)) * ((y1 - y0) / float(x1 - x0))).otherwise(out)
    out = F.when(x <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)
    return F.when(x.isNotNull(), out)


def mosaic(sources: DataFrame, order: Column) -> DataFrame:
    """One row for each cell of several sources: the first by ``order`` (then by source) with a value."""
    w = Window.partitionBy("row", "col").orderBy(order, "source")
    return sources.filter("value is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def owner_clip(source: DataFrame, owners: DataFrame, index: int) -> DataFrame:
    """A source's cells, null where another owner has them; unowned cells stay."""
    o = owners.select("row", "col", "owner")
    return source.join(o, ["row", "col"], "left").withColumn("value", F.when(F.coalesce(F.col("owner") == index, F.lit(True)), F.col("value"))).drop("owner")


def to_chunks(cells: DataFrame, value: str, side: int) -> DataFrame:
    """Cells as dense square chunks (chunk_row, chunk_col, v: values by place, null where there is no cell)."""
    at = ((F.col("row") % side) * side + F.col("col") % side).cast("int")
    key = lambda c: F.floor(F.col(c) / F.lit(float(side))).cast("long")
    g = cells.groupBy(key("row").alias("chunk_row"), key("col").alias("chunk_col")).agg(F.collect_list(F.struct(at.alias("k"), F.col(value).cast("float").alias("v"))).alias("c"))

    @F.arrow_udf("array<float>")
    def dense(c: pa.Array) -> pa.Array:
        flat, n = c.flatten(), side * side
        v = flat.field("v")
        place = np.repeat(np.arange(len(c)) * n, c.value_lengths().to_numpy()) + flat.field("k").to_numpy()
        out, there = np.zeros(len(c) * n, np.float32), np.zeros(len(c) * n, bool)
        out[place], there[place] = v.fill_null(0).to_numpy(), v.is_valid().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * n), pa.array(out, mask=~there))

    return g.select("chunk_row", "chunk_col", dense("c").alias("v"))


def from_chunks(chunks: DataFrame, side: int, name: str = "value") -> DataFrame:
    """The cells of chunks again."""
    e = chunks.select("chunk_row", "chunk_col", F.posexplode("v").alias("k", name)).filter(F.col(name).isNotNull())
    return e.select((F.col("chunk_row") * side + F.floor(F.col("k") / side)).cast("long").alias("row"), (F.col("chunk_col") * side + F.col("k") % side).cast("long").alias("col"), name)
