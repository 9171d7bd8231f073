"""Geometry of settlements and sites, as rows from their canon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scalar
from .joins import box_join, nearest_point_on

#: Least population counted, wall threshold, tower count.
MIN_POP, WALL_POP, TOWERS = 30, 8000, 12


def _h(a, b=0.0, k=1.0):
    return F.round(scalar.hash01(a, b, k), 6)


def radii(settlements: DataFrame) -> DataFrame:
    """Core and clearing radii in projected metres (rc, rf), the field angle and the inflation at the latitude."""
    core = 30 + 5 * F.sqrt(F.greatest(F.col("pop"), F.lit(MIN_POP)))
    s = settlements.withColumn("infl", geo.inflation(F.col("lat")))
    return s.withColumns({"rc": core * F.col("infl"), "rf": (400 + 2.5 * core) * F.col("infl"), "ang": math.pi * _h(F.col("id"), 11)})


def lanes(sites: DataFrame) -> DataFrame:
    """Two to six lanes out of each settlement, by its population: k, angle, length."""
    n = scalar.clamp(1 + F.floor(F.log10(F.greatest(F.col("pop"), F.lit(MIN_POP)) + 1)), 2, 6).cast("int")
    s = sites.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return s.withColumns({"angle": 2 * math.pi * (F.col("k") - 1 + 0.8 * _h(F.col("id"), F.col("k"))) / F.col("n"), "length": F.col("rf") * (0.7 + 0.25 * _h(F.col("id"), F.col("k"), 2))})


def towers(sites: DataFrame) -> DataFrame:
    """The towers of walled places, evenly around the ring from a hashed phase."""
    s = sites.filter(F.col("pop") >= WALL_POP).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(TOWERS - 1))))
    a = 2 * math.pi * (F.col("k") + 0.5 * _h(F.col("id"), 31)) / TOWERS
    return s.withColumns({"dx": 0.8 * F.col("rc") * F.cos(a), "dy": 0.8 * F.col("rc") * F.sin(a)})


def stones(sites: DataFrame) -> DataFrame:
    """Stones of sites with a number ``n``: six and two more for each tier over seven; of destroyed rings those kept by hash."""
    s = sites.withColumns({"stones": (6 + 2 * (F.col("tier") - 7)).cast("int"), "r": (18 + 9 * F.col("tier")) * geo.inflation(F.col("lat"))})
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("stones") - 1))).filter(~F.col("destroyed") | (_h(F.col("n"), 22 + F.col("i")) < 0.45))
    a = 2 * math.pi * (_h(F.col("n"), 21) + F.col("i") / F.col("stones"))
    return s.withColumns({"dx": 0.6 * F.col("r") * F.cos(a), "dy": 0.6 * F.col("r") * F.sin(a)})


def footprint(cells: DataFrame) -> DataFrame:
    off = F.array(F.lit(0), F.lit(1))
    c = cells.select("row", "col", F.explode(off).alias("j")).select("*", F.explode(off).alias("i"))
    return c.select((F.col("row") + F.col("j")).alias("row"), (F.col("col") + F.col("i")).alias("col")).distinct()


def bridges(near: DataFrame, river: Column, deck: float, channel: float) -> DataFrame:
    """Cells (row, col) of a road's deck within a river's channel, from distances to lines (row, col, line, d); ``river`` tells rivers from roads."""
    over, under = F.bool_or(~river & (F.col("d") <= deck)), F.bool_or(river & (F.col("d") <= channel))
    return near.groupBy("row", "col").agg(over.alias("_over"), under.alias("_under")).filter("_over and _under").select("row", "col")


def in_frame(tiles: DataFrame, points: DataFrame, tags: list[str], pad: float = 0.02, size: float = 0.25) -> DataFrame:
    """Tiles (z, x, y) with ``tags``, those that a point (lon, lat, tag) within the tile's box and ``pad`` degrees around bears, in the order given; tiles without any are left out."""
    n = geo.tiles_across(F.col("z"))
    edge = lambda y: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))
    t = tiles.select("z", "x", "y").distinct()
    t = t.withColumns({"_w": F.col("x") / n * 360 - 180 - pad, "_e": (F.col("x") + 1) / n * 360 - 180 + pad, "_s": edge(F.col("y") + 1) - pad, "_n": edge(F.col("y")) + pad})
    q = points.select("tag", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon1"), F.col("lat").alias("_lat1"))
    j = box_join(t, q, size, ("_w", "_e", "_s", "_n"), ("_lon", "_lon1", "_lat", "_lat1"))
    seen = [F.when(F.bool_or(F.col("tag") == tag), tag) for tag in tags]
    return j.groupBy("z", "x", "y").agg(F.array_compact(F.array(*seen)).alias("tags"))


def near_lines(points: DataFrame, vertices: DataFrame, width: float, bin_size: float) -> DataFrame:
    """row, col, line and d: points (row, col, px, py) within ``width`` of a line's box of segments, with the least distance to each line."""
    from .polyline import along

    w = along()
    s = vertices.select("line", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).filter("x1 is not null")
    # segments beyond the points' own extent meet none of them; the extent is one row
    extent = points.agg(F.min("px").alias("_x0"), F.max("px").alias("_x1"), F.min("py").alias("_y0"), F.max("py").alias("_y1"))
    s = s.withColumns({"bx0": F.least("x0", "x1") - width, "bx1": F.greatest("x0", "x1") + width, "by0": F.least("y0", "y1") - width, "by1": F.greatest("y0", "y1") + width})
    s = s.join(F.broadcast(extent), (F.col("bx0") <= F.col("_x1")) & (F.col("bx1") >= F.col("_x0")) & (F.col("by0") <= F.col("_y1")) & (F.col("by1") >= F.col("_y0")))
    # boxes are cut to the extent, which keeps every pair and the bins few
    s = s.withColumns({"bx0": F.greatest("bx0", "_x0"), "bx1": F.least("bx1", "_x1"), "by0": F.greatest("by0", "_y0"), "by1": F.least("by1", "_y1")}).drop("_x0", "_x1", "_y0", "_y1")
    q = points.withColumns({"qx": F.col("px"), "qy": F.col("py")})
    j = box_join(q, s, bin_size, ("px", "qx", "py", "qy"), ("bx0", "bx1", "by0", "by1"))
    d = nearest_point_on(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return j.groupBy("row", "col", "line").agg(F.min(d).alias("d"))
