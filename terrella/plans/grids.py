"""Raster algebra on the cell grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar
from ..model import BIOMES, BLEND, DETAIL_HI, DETAIL_LO, DETAIL_Z, ELEVATION_STOPS, HILLSHADE_Z, OTHER_RELIEF, RIVER_TIER, lookup, rgb
from ..operators import raster
from .registry import query
from .scalars import h6, h_sql, ss_sql

SIZE = 1113.0  # metres across a cell
FLAT = math.sin(math.radians(45))


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


_NB = "cell c JOIN cell n ON n.row BETWEEN c.row - {h} AND c.row + {h} AND n.col BETWEEN c.col - {h} AND c.col + {h}"


@query("cell", "SELECT row, col, elev, biome FROM cell WHERE row BETWEEN 3 AND 20 AND col BETWEEN 10 AND 60")
def scan_window(p):
    return raster.window(p.cell, (3, 20), (10, 60)).select("row", "col", "elev", "biome")


@query("cell", f"SELECT c.row, c.col, round(avg(n.elev), 6) AS m FROM {_NB.format(h=1)} GROUP BY c.row, c.col")
def focal_mean(p):
    return raster.focal(p.cell, "elev", 1, m=F.round(F.avg("v"), 6))


@query("cell", f"SELECT c.row, c.col, min(n.water) = max(n.water) AS same FROM {_NB.format(h=1)} GROUP BY c.row, c.col")
def focal_homogeneous(p):
    return raster.focal(p.cell, "water", 1, same=F.min("v") == F.max("v"))


@query("cell", "SELECT CAST(floor(CAST(row AS DOUBLE) / 4) AS BIGINT) AS brow, CAST(floor(CAST(col AS DOUBLE) / 4) AS BIGINT) AS bcol, round(avg(elev), 6) AS mean FROM cell GROUP BY 1, 2")
def block_mean(p):
    return raster.block_mean(p.cell, "elev", 4).withColumn("mean", F.round("mean", 6))


@query("cell", f"SELECT c.row, c.col, round(greatest(least((avg(n.elev) - any_value(c.elev)) / 28, 1.0), 0.0), 6) AS valley FROM {_NB.format(h=1)} GROUP BY c.row, c.col")
def valleyness(p):
    own = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("v")))
    return raster.focal(p.cell, "elev", 1, valley=F.round(scalar.clamp((F.avg("v") - own) / 28, 0.0, 1.0), 6))


_DIST = f"""WITH d AS (SELECT c.row, c.col, sqrt(min(pow(n.row - c.row, 2) + pow(n.col - c.col, 2))) * {SIZE} AS d
  FROM cell c JOIN cell n ON n.row BETWEEN c.row - 3 AND c.row + 3 AND n.col BETWEEN c.col - 3 AND c.col + 3 AND n.water = 1 AND pow(n.row - c.row, 2) + pow(n.col - c.col, 2) <= 9 GROUP BY c.row, c.col)"""


def water_distance(p):
    return raster.nearest_distance(p.cell, scalar.water_is(F.col("water"), "OCEAN"), 3, SIZE)


@query("cell", _DIST + " SELECT c.row, c.col, round(d.d, 6) AS distance FROM cell c LEFT JOIN d ON c.row = d.row AND c.col = d.col")
def nearest_distance(p):
    return water_distance(p).select("row", "col", r(F.col("distance"), "distance"))


@query("cell", _DIST + f""" SELECT c.row, c.col, CASE WHEN c.water IN (1, 2) THEN round({ss_sql('coalesce(d.d, 5000.0)', '0', '2500')}, 6) ELSE 0.0 END AS deep FROM cell c LEFT JOIN d ON c.row = d.row AND c.col = d.col""")
def shelf_shade(p):
    """Depth shading by distance, where far from any shore is deep."""
    deep = scalar.smoothstep(F.coalesce("distance", F.lit(5000.0)), 0, 2500)
    return water_distance(p).select("row", "col", F.when(scalar.water_is(F.col("water"), "OCEAN", "LAKE"), F.round(deep, 6)).otherwise(0.0).alias("deep"))


def _horn_sql(z):
    v = f"greatest(n.elev, 0) * {z}"
    g = lambda a, b: f"sum({v} * {a} * CASE WHEN {b} = 0 THEN 2 ELSE 1 END) / (8 * {SIZE})"
    return f"SELECT c.row, c.col, any_value(c.elev) AS elev, CASE WHEN count(*) = 9 THEN {g('(n.col - c.col)', '(n.row - c.row)')} END AS gx, CASE WHEN count(*) = 9 THEN {g('(n.row - c.row)', '(n.col - c.col)')} END AS gy FROM {_NB.format(h=1)} GROUP BY c.row, c.col"


def _shade_sql(gx, gy):
    s, c = math.sin(math.radians(45)), math.cos(math.radians(45))
    east, north = math.sin(math.radians(315)), math.cos(math.radians(315))
    return f"coalesce(greatest(least(({s} - {c} * ({gx} * {east} - {gy} * {north})) / sqrt(1 + {gx} * {gx} + {gy} * {gy}), 1.0), 0.0), {s})"


def shaded(p, z):
    return raster.horn(p.cell, "elev", SIZE, z).withColumn("hs", raster.shade(F.col("gx"), F.col("gy")))


@query("cell", f"WITH g AS ({_horn_sql(HILLSHADE_Z)}) SELECT row, col, round({_shade_sql('gx', 'gy')}, 6) AS hs FROM g")
def hillshade(p):
    return shaded(p, HILLSHADE_Z).select("row", "col", r(F.col("hs"), "hs"))


@query("cell", f"""WITH a AS ({_horn_sql(HILLSHADE_Z)}), d AS ({_horn_sql(DETAIL_Z)})
SELECT a.row, a.col, round(greatest(least({_shade_sql('a.gx', 'a.gy')} * greatest(least({_shade_sql('d.gx', 'd.gy')} / {FLAT}, {DETAIL_HI}), {DETAIL_LO}), 1.0), 0.0), 6) AS hs FROM a JOIN d ON a.row = d.row AND a.col = d.col""")
def two_component_shade(p):
    """The anchor's light, modulated by the detail's within bounds; both gradients come from one pass, as they differ by a factor."""
    g = raster.horn(p.cell, "elev", SIZE, 1.0)
    light = lambda z: raster.shade(F.col("gx") * z, F.col("gy") * z)
    return g.select("row", "col", r(scalar.clamp(light(HILLSHADE_Z) * scalar.clamp(light(DETAIL_Z) / FLAT, DETAIL_LO, DETAIL_HI), 0.0, 1.0), "hs"))


_RELIEF = "CASE biome " + " ".join(f"WHEN {b[0]} THEN {b[3]}" for b in BIOMES if b[0] != 12) + f" ELSE {OTHER_RELIEF} END"


def relief():
    """Relief by biome; code 12 is left out of this query's table, so that the default shows."""
    return lookup({b[0]: b[3] for b in BIOMES if b[0] != 12}, F.col("biome"), F.lit(OTHER_RELIEF))


@query("cell", f"SELECT row, col, CAST({_RELIEF} AS INTEGER) AS relief FROM cell")
def reclass_lut(p):
    return p.cell.select("row", "col", relief().cast("int").alias("relief"))


@query("cell", f"""SELECT row, col, round(CASE WHEN elev > 40 AND water NOT IN (1, 2) AND d < 1 THEN 1.0 WHEN water IN (1, 2) THEN least(d, elev) ELSE d END, 3) AS elev
FROM (SELECT row, col, elev, water, elev + ({h_sql('col', 'row', '5')} - 0.5) * 2 * 6 * {_RELIEF} * 0.35 AS d FROM cell)""")
def microrelief_clamp(p):
    """Added relief never raises water above its anchor, and never sinks inland ground below 1 m."""
    d = F.col("elev") + (h6(F.col("col"), F.col("row"), 5) - 0.5) * 2 * 6 * relief() * 0.35
    wet = scalar.water_is(F.col("water"), "OCEAN", "LAKE")
    c = p.cell.withColumn("d", d)
    return c.select("row", "col", r(F.when((F.col("elev") > 40) & ~wet & (F.col("d") < 1), 1.0).when(wet, F.least("d", F.col("elev").cast("double"))).otherwise(F.col("d")), "elev", 3))


_STOPS = ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({rgb(c)[0]} AS DOUBLE), CAST({rgb(c)[1]} AS DOUBLE), CAST({rgb(c)[2]} AS DOUBLE))" for i, (x, c) in enumerate(ELEVATION_STOPS))


@query("cell", f"""WITH s AS (SELECT * FROM (VALUES {_STOPS}) v(i, x, r, g, b)), g AS (SELECT a.x AS x0, b.x AS x1, a.r AS r0, b.r AS r1, a.b AS b0, b.b AS b1 FROM s a JOIN s b ON b.i = a.i + 1),
q AS (SELECT row, col, CAST(greatest(least(elev, 6500), -1000) AS DOUBLE) AS e FROM cell)
SELECT row, col, round(min(r0 + (r1 - r0) * (e - x0) / (x1 - x0)), 4) AS r, round(min(b0 + (b1 - b0) * (e - x0) / (x1 - x0)), 4) AS b
FROM q JOIN g ON e >= x0 AND (e < x1 OR (x1 = 6500 AND e = 6500)) GROUP BY row, col""")
def color_ramp(p):
    band = lambda i: raster.ramp(F.col("elev"), [(x, rgb(c)[i]) for x, c in ELEVATION_STOPS])
    return p.cell.select("row", "col", r(band(0), "r", 4), r(band(2), "b", 4))


@query("cell", "SELECT row, col, " + ", ".join(f"CAST(CASE biome {' '.join(f'WHEN {b[0]} THEN {rgb(b[2])[i]}' for b in BIOMES if b[0] < 11)} ELSE 128 END AS INTEGER) AS {n}" for i, n in enumerate("rgb")) + " FROM cell")
def color_discrete(p):
    """Class colours; codes without one (here the last two) are grey."""
    return p.cell.select("row", "col", *[lookup({b[0]: rgb(b[2])[i] for b in BIOMES if b[0] < 11}, F.col("biome"), F.lit(128)).cast("int").alias(n) for i, n in enumerate("rgb")])


@query("", "SELECT DISTINCT x AS stop, r, g, b FROM (VALUES " + ", ".join(f"({x}, {rgb(c)[0]}, {rgb(c)[1]}, {rgb(c)[2]})" for x, c in ELEVATION_STOPS) + ") v(x, r, g, b)")
def hex_to_rgb(p):
    s = p.spark.createDataFrame(ELEVATION_STOPS, "stop int, color string")
    return s.select("stop", *[scalar.channel(F.col("color"), i).alias(n) for i, n in enumerate("rgb")])


@query("cell", _DIST + f""", g AS ({_horn_sql(HILLSHADE_Z)}), q AS (SELECT c.row, c.col, c.water, {_shade_sql('g.gx', 'g.gy')} AS hs, coalesce(d.d, 5000.0) AS dist FROM cell c JOIN g ON c.row = g.row AND c.col = g.col LEFT JOIN d ON c.row = d.row AND c.col = d.col)
SELECT row, col, round(CASE WHEN water IN (1, 2) THEN 124 + (38 - 124) * {ss_sql('dist', '0', '2500')} ELSE 200 * ({BLEND} + (1 - {BLEND}) * hs) END, 4) AS r FROM q""")
def water_paint(p):
    """Water takes its colour from depth, land from light; the class decides which, never the height."""
    hs = shaded(p, HILLSHADE_Z).select("row", "col", "hs")
    deep = scalar.smoothstep(F.coalesce("distance", F.lit(5000.0)), 0, 2500)
    land = 200 * (BLEND + (1 - BLEND) * F.col("hs"))
    return water_distance(p).join(hs, ["row", "col"]).select("row", "col", r(F.when(scalar.water_is(F.col("water"), "OCEAN", "LAKE"), 124 + (38 - 124) * deep).otherwise(land), "r", 4))


_PTS = "pts AS (SELECT event_id AS id, CAST(event_id % 120 AS DOUBLE) + value / 1000 - floor(value / 1000) AS x, CAST(event_id % 9 AS DOUBLE) + value / 7 - floor(value / 7) AS y FROM events)"


def sample_points(p):
    f = lambda d: F.col("value") / d - F.floor(F.col("value") / d)
    return p.events.select(F.col("event_id").alias("id"), ((F.col("event_id") % 120).cast("double") + f(1000)).alias("x"), ((F.col("event_id") % 9).cast("double") + f(7)).alias("y"))


_BIL = """c4 AS (SELECT id, floor(y) + j AS row, floor(x) + i AS col, (CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w
  FROM pts, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))"""


@query("cell", f"WITH {_PTS}, {_BIL}, v AS (SELECT id, sum(w * elev) / sum(w) AS v FROM c4 JOIN cell USING (row, col) WHERE w > 0 GROUP BY id) SELECT pts.id, round(v, 3) AS value FROM pts LEFT JOIN v USING (id)")
def resample_bilinear(p):
    return raster.at_bilinear(sample_points(p), p.cell, "elev").select("id", r(F.col("value"), "value", 3))


_WARP = f"""pts AS (SELECT row * 128 + col AS id, row, col, col + ({h_sql('floor(col / CAST(8 AS DOUBLE))', 'floor(row / CAST(8 AS DOUBLE))', '303')} - 0.5) * 1.8 AS x, row + ({h_sql('floor(col / CAST(8 AS DOUBLE))', 'floor(row / CAST(8 AS DOUBLE))', '404')} - 0.5) * 1.8 AS y FROM cell)"""


def warped(p):
    """Cells displaced by two position hashes, less than a cell."""
    bx, by = F.floor(F.col("col") / F.lit(8.0)), F.floor(F.col("row") / F.lit(8.0))
    return p.cell.select((F.col("row") * 128 + F.col("col")).alias("id"), F.col("row").alias("r0"), F.col("col").alias("c0"), (F.col("col") + (h6(bx, by, 303) - 0.5) * 1.8).alias("x"), (F.col("row") + (h6(bx, by, 404) - 0.5) * 1.8).alias("y"))


@query("cell", f"WITH {_WARP} SELECT pts.row, pts.col, c.biome FROM pts LEFT JOIN cell c ON c.row = floor(y + 0.5) AND c.col = floor(x + 0.5)")
def warp_sample_near(p):
    x = raster.at_nearest(warped(p), p.cell, "biome", name="biome")
    return x.select(F.col("r0").alias("row"), F.col("c0").alias("col"), "biome")


@query("cell", f"WITH {_WARP}, {_BIL}, v AS (SELECT id, sum(w * CASE WHEN c.water IN (1, 2) THEN 1.0 ELSE 0.0 END) / sum(w) AS v FROM c4 JOIN cell c USING (row, col) WHERE w > 0 GROUP BY id) SELECT pts.row, pts.col, round(v, 5) AS waterness, v >= 0.5 AS mask FROM pts LEFT JOIN v USING (id)")
def warp_sample_bilinear(p):
    """A warped shore: water share and the mask at half."""
    w = p.cell.select("row", "col", scalar.water_is(F.col("water"), "OCEAN", "LAKE").cast("double").alias("w"))
    x = raster.at_bilinear(warped(p), w, "w", name="waterness")
    return x.select(F.col("r0").alias("row"), F.col("c0").alias("col"), r(F.col("waterness"), "waterness", 5), (F.col("waterness") >= 0.5).alias("mask"))


_OWN = "CAST(floor(CAST(col AS DOUBLE) / 43) AS INTEGER) + 1"


@query("cell", f"SELECT row, col, CASE WHEN row % 5 = 0 OR {_OWN} = 2 THEN elev END AS value FROM cell WHERE col % 2 = 0")
def owner_clip(p):
    own = p.cell.filter("row % 5 <> 0").select("row", "col", (F.floor(F.col("col") / F.lit(43.0)) + 1).cast("int").alias("owner"))
    return raster.owner_clip(p.cell.filter("col % 2 = 0").select("row", "col", F.col("elev").alias("value")), own, 2)


@query("cell", """WITH s AS (SELECT row, col, 1 AS source, CASE WHEN water <> 0 THEN water END AS value FROM cell WHERE col < 90 UNION ALL SELECT row, col, 2, CASE WHEN fa % 3 <> 0 THEN CAST(fa % 5 AS INTEGER) END FROM cell WHERE col >= 40),
n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY CASE value WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 4 END, source) AS r FROM s WHERE value IS NOT NULL)
SELECT row, col, source, value FROM n WHERE r = 1""")
def mosaic_precedence(p):
    """Overlapping water sources: ocean over lake over river over stream over land."""
    a = p.cell.filter("col < 90").select("row", "col", F.lit(1).alias("source"), F.when(F.col("water") != 0, F.col("water")).alias("value"))
    b = p.cell.filter("col >= 40").select("row", "col", F.lit(2).alias("source"), F.when(F.col("fa") % 3 != 0, (F.col("fa") % 5).cast("int")).alias("value"))
    return raster.mosaic(a.unionByName(b), lookup({1: 0, 2: 1, 3: 2, 4: 3, 0: 4}, F.col("value"), F.lit(4)))


@query("cell", "SELECT CAST(7 AS INTEGER) AS z, CAST(floor(CAST(col AS DOUBLE) / 2) AS BIGINT) AS x, CAST(floor(CAST(row AS DOUBLE) / 2) AS BIGINT) AS y, round(avg(elev), 6) AS v, count(*) AS n FROM cell GROUP BY 2, 3")
def pyramid_rollup(p):
    """The next level up: the mean of each two by two."""
    half = lambda c: F.floor(F.col(c) / F.lit(2.0)).cast("long")
    return p.cell.groupBy(half("col").alias("x"), half("row").alias("y")).agg(F.round(F.avg("elev"), 6).alias("v"), F.count(F.lit(1)).alias("n")).select(F.lit(7).alias("z"), "x", "y", "v", "n")


@query("cell", "SELECT CAST(col / 2 AS BIGINT) AS x, CAST(row / 2 AS BIGINT) AS y, biome FROM cell WHERE row % 2 = 0 AND col % 2 = 0")
def pyramid_near(p):
    """Classes are not averaged: the first of each two by two."""
    return p.cell.filter("row % 2 = 0 and col % 2 = 0").select((F.col("col") / 2).cast("long").alias("x"), (F.col("row") / 2).cast("long").alias("y"), "biome")


_TIERS = f"""WITH t AS (SELECT row, col, CASE WHEN fa >= 1000000 THEN 'big' WHEN fa >= 700000 THEN 'med' WHEN fa >= 600000 THEN 'small' END AS tier FROM cell),
d AS (SELECT c.row, c.col, t.tier, sqrt(min(pow(t.row - c.row, 2) + pow(t.col - c.col, 2))) * 100 AS d FROM cell c JOIN t ON t.row BETWEEN c.row - 4 AND c.row + 4 AND t.col BETWEEN c.col - 4 AND c.col + 4
  AND pow(t.row - c.row, 2) + pow(t.col - c.col, 2) <= 16 AND t.tier IS NOT NULL GROUP BY c.row, c.col, t.tier),
w AS (SELECT c.row, c.col, max(CASE WHEN tier = 'big' THEN d END) AS big, max(CASE WHEN tier = 'med' THEN d END) AS med, max(CASE WHEN tier = 'small' THEN d END) AS small FROM cell c LEFT JOIN d ON c.row = d.row AND c.col = d.col GROUP BY c.row, c.col)"""


def tier_distances(p):
    """Distance to the nearest river cell of each tier, as columns: one send-out with the tier as a condition of the minimum."""
    tier = F.when(F.col("fa") >= 1000000, "big").when(F.col("fa") >= 700000, "med").when(F.col("fa") >= 600000, "small")
    off = F.sequence(F.lit(-4), F.lit(4))
    t = p.cell.select("row", "col", tier.alias("tier")).filter("tier is not null").withColumn("dr", F.explode(off)).withColumn("dc", F.explode(off))
    t = t.withColumn("d2", F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).filter("d2 <= 16")
    best = lambda n: (F.sqrt(F.min(F.when(F.col("tier") == n, F.col("d2")))) * 100).alias(n)
    d = t.groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(*map(best, RIVER_TIER))
    return p.cell.select("row", "col").join(d, ["row", "col"], "left")


@query("cell", _TIERS + " SELECT row, col, round(big, 5) AS big, round(med, 5) AS med, round(small, 5) AS small FROM w")
def tier_distance_pivot(p):
    return tier_distances(p).select("row", "col", *[r(F.col(t), t, 5) for t in RIVER_TIER])


def _w_sql(t):
    _, fp, wall, depth = RIVER_TIER[t]
    return f"coalesce({ss_sql(f'({fp + wall} - {t}) / {wall}', '0', '1')}, 0.0)", depth


@query("cell", _TIERS + " SELECT row, col, round(greatest(" + ", ".join(f"{_w_sql(t)[0]} * {_w_sql(t)[1]}" for t in RIVER_TIER) + "), 5) AS carve, round(greatest(" + ", ".join(_w_sql(t)[0] for t in RIVER_TIER) + "), 5) AS fpw FROM w")
def valley_profile(p):
    """Carve depth and floodplain weight: the greatest over tiers."""
    w = {t: F.coalesce(scalar.smoothstep((fp + wall - F.col(t)) / wall, 0, 1), F.lit(0.0)) for t, (_, fp, wall, _) in RIVER_TIER.items()}
    return tier_distances(p).select("row", "col", r(F.greatest(*[w[t] * RIVER_TIER[t][3] for t in w]), "carve", 5), r(F.greatest(*w.values()), "fpw", 5))
