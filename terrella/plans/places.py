"""Settlements, sacred sites and what is drawn of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..model import BIOMES, CAPACITY_REF, PLANT_MIX, lookup
from ..operators import joins, places
from .registry import query
from .scalars import h6, h_sql, ss_sql

_RADII = f"""radii AS (SELECT id, pop, lon, lat, is_port, 1 / cos(radians(lat)) AS infl, (30 + 5 * sqrt(greatest(pop, 30))) / cos(radians(lat)) AS rc,
  (400 + 2.5 * (30 + 5 * sqrt(greatest(pop, 30)))) / cos(radians(lat)) AS rf, pi() * {h_sql('id', '11')} AS ang FROM settlement)"""


def r(c, name, digits=4):
    return F.round(c, digits).alias(name)


@query("settlement", f"WITH {_RADII} SELECT id, round(rc, 4) AS rc, round(rf, 4) AS rf, round(ang, 4) AS ang FROM radii")
def settlement_radii(p):
    return places.radii(p.settlement).select("id", r(F.col("rc"), "rc"), r(F.col("rf"), "rf"), r(F.col("ang"), "ang"))


@query("sacred", "SELECT site_id, round((18 + 9 * tier) / cos(radians(lat)), 4) AS r FROM sacred")
def sacred_radius(p):
    return p.sacred.select("site_id", r((18 + 9 * F.col("tier")) * geo.inflation(F.col("lat")), "r"))


@query("settlement", f"""WITH {_RADII}, n AS (SELECT *, CAST(greatest(least(1 + floor(log10(greatest(pop, 30) + 1)), 6), 2) AS INTEGER) AS n FROM radii)
SELECT id, CAST(k AS INTEGER) AS k, round(2 * pi() * (k - 1 + 0.8 * {h_sql('id', 'k')}) / n, 4) AS angle, round(rf * (0.7 + 0.25 * {h_sql('id', 'k', '2')}), 3) AS len FROM n, unnest(range(1, n + 1)) t(k)""")
def radial_lanes(p):
    return places.lanes(places.radii(p.settlement)).select("id", "k", r(F.col("angle"), "angle"), r(F.col("length"), "len", 3))


_SITES = f"""WITH s AS (SELECT id, lon * 1000 AS x, lat * 1000 AS y, 300 + 5 * sqrt(greatest(pop, 30)) AS rc, 3000 + 25 * sqrt(greatest(pop, 30)) AS rf, round(pi() * {h_sql('id', '11')}, 6) AS ang FROM settlement),
c AS (SELECT row, col, CAST(col * 2000 AS DOUBLE) AS px, CAST(row * 2000 AS DOUBLE) AS py, water FROM cell),
d AS (SELECT c.row, c.col, c.water, s.id, s.ang, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS d, rc, rf FROM c JOIN s ON abs(px - x) <= rf AND abs(py - y) <= rf)"""


def near_settlements(p):
    """Cells within the clearing's box of a settlement, by bins."""
    root = F.sqrt(F.greatest(F.col("pop"), F.lit(30)))
    s = p.settlement.select("id", (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"), (300 + 5 * root).alias("rc"), (3000 + 25 * root).alias("rf"), F.round(math.pi * h6(F.col("id"), 11), 6).alias("ang"))
    c = p.cell.select("row", "col", (F.col("col") * 2000).cast("double").alias("px"), (F.col("row") * 2000).cast("double").alias("py"), "water")
    c = c.withColumns({"px1": F.col("px"), "py1": F.col("py")})
    return joins.disc_join(c, s, 8000.0, ("px", "px1", "py", "py1"), "x", "y", "rf").withColumn("d", F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)))


@query("settlement cell", _SITES + f""", f AS (SELECT *, round({ss_sql('(rc - d) / (0.45 * rc)', '0', '1')}, 6) AS u, round({ss_sql('(rf - d) / (0.35 * rf)', '0', '1')}, 6) AS f FROM d),
n AS (SELECT row, col, max(CASE WHEN water IN (1, 2) THEN 0.0 ELSE u END) AS u, max(CASE WHEN water IN (1, 2) THEN 0.0 ELSE f END) AS f FROM f GROUP BY row, col),
a AS (SELECT row, col, ang, row_number() OVER (PARTITION BY row, col ORDER BY f DESC, id) AS r FROM f)
SELECT n.row, n.col, round(u, 4) AS u, round(f, 4) AS f, round(ang, 3) AS ang FROM n JOIN a ON a.row = n.row AND a.col = n.col AND r = 1""")
def settlement_influence(p):
    """Urban and field weights: the greatest over settlements; the field's angle is that of the strongest one."""
    u, f = (F.round(scalar.smoothstep((F.col(a) - F.col("d")) / (share * F.col(a)), 0, 1), 6) for a, share in (("rc", 0.45), ("rf", 0.35)))
    x = near_settlements(p).withColumns({"u": u, "f": f})
    g = x.groupBy("row", "col").agg(F.first("water").alias("water"), F.max("u").alias("u"), F.max("f").alias("f"), F.max_by("ang", F.struct("f", -F.col("id"))).alias("ang"))
    dry = lambda c: F.when(scalar.water_is(F.col("water"), "OCEAN", "LAKE"), 0.0).otherwise(F.col(c))
    return g.select("row", "col", r(dry("u"), "u", 4), r(dry("f"), "f", 4), r(F.col("ang"), "ang", 3))


@query("sacred cell", f"""WITH s AS (SELECT site_id, tier, destroyed, lon * 1000 AS x, lat * 1000 AS y, CAST(2000 + 300 * tier AS DOUBLE) AS r FROM sacred),
d AS (SELECT row, col, site_id, tier, destroyed, r, sqrt(pow(col * 2000 - x, 2) + pow(row * 2000 - y, 2)) AS d FROM cell JOIN s ON abs(col * 2000 - x) <= 2.2 * r AND abs(row * 2000 - y) <= 2.2 * r)
SELECT row, col, round(max(CASE WHEN tier >= 4 THEN {ss_sql('(r - d) / (0.45 * r)', '0', '1')} ELSE 0.0 END), 5) AS clearing,
  round(max(CASE WHEN tier <= 3 AND NOT destroyed THEN {ss_sql('(1.9 * r - d) / (0.9 * r)', '0', '1')} ELSE 0.0 END), 5) AS grove FROM d GROUP BY row, col""")
def sacred_influence(p):
    """Greater sites clear the ground, lesser ones that stand keep a grove."""
    s = p.sacred.select("site_id", "tier", "destroyed", (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"), (2000 + 300 * F.col("tier")).cast("double").alias("r"))
    s = s.withColumn("reach", 2.2 * F.col("r"))
    c = p.cell.select("row", "col", (F.col("col") * 2000).cast("double").alias("px"), (F.col("row") * 2000).cast("double").alias("py")).withColumns({"px1": F.col("px"), "py1": F.col("py")})
    x = joins.disc_join(c, s, 8000.0, ("px", "px1", "py", "py1"), "x", "y", "reach").withColumn("d", F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)))
    rr, d = F.col("r"), F.col("d")
    clear = F.when(F.col("tier") >= 4, scalar.smoothstep((rr - d) / (0.45 * rr), 0, 1)).otherwise(0.0)
    grove = F.when((F.col("tier") <= 3) & ~F.col("destroyed"), scalar.smoothstep((1.9 * rr - d) / (0.9 * rr), 0, 1)).otherwise(0.0)
    return x.groupBy("row", "col").agg(r(F.max(clear), "clearing", 5), r(F.max(grove), "grove", 5))


_SEG = """WITH seg AS (SELECT line, seq, x / 300 AS x0, y / 900 AS y0, lead(x / 300) OVER w AS x1, lead(y / 900) OVER w AS y1 FROM vertex WINDOW w AS (PARTITION BY line ORDER BY seq)),
s AS (SELECT *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS l2 FROM seg WHERE x1 IS NOT NULL),
t AS (SELECT c.row, c.col, s.*, CASE WHEN l2 > 0 THEN greatest(least(((c.col - x0) * (x1 - x0) + (c.row - y0) * (y1 - y0)) / l2, 1.0), 0.0) ELSE 0.0 END AS t FROM cell c JOIN s
  ON c.col >= least(x0, x1) - {w} AND c.col <= greatest(x0, x1) + {w} AND c.row >= least(y0, y1) - {w} AND c.row <= greatest(y0, y1) + {w}),
m AS (SELECT row, col, line, min(sqrt(pow(col - x0 - t * (x1 - x0), 2) + pow(row - y0 - t * (y1 - y0), 2))) AS d FROM t GROUP BY row, col, line)"""


def line_distances(p, width):
    """Cells within ``width`` of a line, with the distance to it."""
    v = p.vertex.select("line", "seq", (F.col("x") / 300).alias("x"), (F.col("y") / 900).alias("y"))
    cells = p.cell.select("row", "col", F.col("col").cast("double").alias("px"), F.col("row").cast("double").alias("py"))
    return places.near_lines(cells, v, width, 8.0)


@query("cell vertex", _SEG.format(w=2) + " SELECT DISTINCT row, col FROM m WHERE d <= 1.5")
def line_mask(p):
    return line_distances(p, 2.0).filter("d <= 1.5").select("row", "col").distinct()


@query("cell vertex", _SEG.format(w=2) + """ SELECT c.row, c.col, coalesce(max(CASE WHEN line % 3 = 0 AND d <= 2 THEN 1 WHEN line % 3 <> 0 AND d <= 1 THEN 1 ELSE 0 END), 0) = 1 AS corridor
FROM cell c LEFT JOIN m ON c.row = m.row AND c.col = m.col GROUP BY c.row, c.col""")
def corridor_union(p):
    """Rivers take a wider corridor than roads; a cell is in it if either is near."""
    near = F.when((F.col("line") % 3 == 0) & (F.col("d") <= 2), True).when((F.col("line") % 3 != 0) & (F.col("d") <= 1), True).otherwise(False)
    m = line_distances(p, 2.0).groupBy("row", "col").agg(F.bool_or(near).alias("corridor"))
    return p.cell.select("row", "col").join(m, ["row", "col"], "left").withColumn("corridor", F.coalesce("corridor", F.lit(False)))


@query("cell", """SELECT row, col, CASE WHEN biome = 7 THEN 'wall' WHEN fa % 11 = 0 THEN 'bridge' WHEN fa % 7 = 0 THEN 'road' WHEN fa % 5 = 0 THEN 'river' WHEN fa % 3 = 0 THEN 'stream' ELSE 'ground' END AS paint FROM cell""")
def painters_order(p):
    """What is painted last shows: each cell's layers come as rows and the highest stays."""
    layers = {"ground": F.lit(True), "stream": F.col("fa") % 3 == 0, "river": F.col("fa") % 5 == 0, "road": F.col("fa") % 7 == 0, "bridge": F.col("fa") % 11 == 0, "wall": F.col("biome") == 7}
    rows = F.array(*[F.when(c, F.struct(F.lit(i).alias("order"), F.lit(n).alias("paint"))) for i, (n, c) in enumerate(layers.items())])
    return p.cell.select("row", "col", F.array_max(rows)["paint"].alias("paint"))


_CAP = "greatest(least((fa % 250) / 200e0, 1.0), 0.0)"


@query("cell", f"SELECT row, col, round(least(CASE biome {' '.join(f'WHEN {b[0]} THEN {b[4]}e0' for b in BIOMES)} ELSE 0.0 END * sqrt({_CAP}) * (1 - {ss_sql('elev', '1800', '2800')}), 1.0), 5) AS veg FROM cell")
def veg_cover(p):
    """Cover by biome, thinned by capacity and above the tree line."""
    cover = lookup({b[0]: b[4] for b in BIOMES}, F.col("biome"), F.lit(0.0))
    cap = scalar.clamp((F.col("fa") % 250) / CAPACITY_REF, 0.0, 1.0)
    veg = cover * F.sqrt(cap) * (1 - scalar.smoothstep(F.col("elev"), 1800, 2800))
    return p.cell.select("row", "col", r(F.least(veg, F.lit(1.0)), "veg", 5))


_MIX = [f"CASE biome {' '.join(f'WHEN {i} THEN {m[k]}e0' for i, m in enumerate(PLANT_MIX))} ELSE 0.0 END" for k in range(3)]


@query("cell", f"WITH q AS (SELECT row, col, {_MIX[0]} * (1 + elev % 3 + 3) AS b, {_MIX[1]} * (1 + fa % 3) AS s, {_MIX[2]} * (1 + water) AS t FROM cell) SELECT row, col, round(b / (b + s + t + 1e-6), 5) AS bloom, round(s / (b + s + t + 1e-6), 5) AS spreader FROM q")
def plant_mix(p):
    """Shares of the plant types in a biome, weighted by the moons (small integers stand for them), normalised."""
    mix = [lookup({i: m[k] for i, m in enumerate(PLANT_MIX)}, F.col("biome"), F.lit(0.0)) for k in range(3)]
    moons = [1 + F.col("elev") % 3 + 3, 1 + F.col("fa") % 3, 1 + F.col("water")]
    raw = [m * w for m, w in zip(mix, moons, strict=True)]
    total = raw[0] + raw[1] + raw[2] + 1e-6
    return p.cell.select("row", "col", r(raw[0] / total, "bloom", 5), r(raw[1] / total, "spreader", 5))


_LINE = "(1100 + 3300 * pow(greatest(cos(radians(row * 0.7e0)), 0.0), 2))"


@query("cell", f"SELECT row, col, CASE WHEN water IN (1, 2) THEN 0.0 ELSE round(greatest(pow(greatest(least((elev - {_LINE} + 300) / 500, 1.0), 0.0), 2) * (3 - 2 * greatest(least((elev - {_LINE} + 300) / 500, 1.0), 0.0)), CASE WHEN biome = 1 THEN 0.85 ELSE 0.0 END), 5) END AS snow FROM cell")
def snowline(p):
    """Snow above a line that falls with latitude; ice country is white anyway; water is not."""
    line = 1100 + 3300 * F.pow(F.greatest(F.cos(F.radians(F.col("row") * 0.7)), F.lit(0.0)), 2)
    snow = F.greatest(scalar.smoothstep(F.col("elev") - line + 300, 0, 500), F.when(F.col("biome") == 1, 0.85).otherwise(0.0))
    return p.cell.select("row", "col", F.when(scalar.water_is(F.col("water"), "OCEAN", "LAKE"), 0.0).otherwise(F.round(snow, 5)).alias("snow"))


_HALF = f"(bh * (0.6 + 0.9 * {h_sql('col', 'row', '61')}) + 0.35 * bh * {h_sql('col', 'row', '62')}) * (1 + 3.5 * {ss_sql('wn', '0.30', '0.50')})"


@query("cell", f"WITH q AS (SELECT row, col, CASE WHEN fa >= 500000 THEN 3.0 WHEN fa >= 50000 THEN 2.0 WHEN fa >= 25000 THEN 1.3 END * 9.5e0 / 2 AS bh, fa % 100 / 100e0 AS wn, elev % 40 AS d FROM cell) SELECT row, col, round({_HALF}, 4) AS half, abs(d) <= greatest({_HALF}, 0.4 * bh) AS channel FROM q WHERE bh IS NOT NULL")
def river_width(p):
    """A river breathes, frays and opens into its estuary."""
    px = 9.5
    width = F.when(F.col("fa") >= 500000, 3.0).when(F.col("fa") >= 50000, 2.0).when(F.col("fa") >= 25000, 1.3)
    c = p.cell.withColumns({"bh": width * px / 2, "wn": (F.col("fa") % 100) / F.lit(100.0)}).filter("bh is not null")
    h = lambda k: h6(F.col("col"), F.col("row"), k)
    half = (F.col("bh") * (0.6 + 0.9 * h(61)) + 0.35 * F.col("bh") * h(62)) * (1 + 3.5 * scalar.smoothstep(F.col("wn"), 0.30, 0.50))
    return c.select("row", "col", r(half, "half"), (F.abs(F.col("elev") % 40) <= F.greatest(half, 0.4 * F.col("bh"))).alias("channel"))


@query("cell vertex", _SEG.format(w=2) + " SELECT row, col FROM m GROUP BY row, col HAVING bool_or(line % 3 <> 0 AND d <= 1.5) AND bool_or(line % 3 = 0 AND d <= 1)")
def bridge_cells(p):
    """Every third line as a river; a road's deck is half as wide again as the channel it spans."""
    return places.bridges(line_distances(p, 2.0), F.col("line") % 3 == 0, 1.5, 1.0)


@query("settlement", f"""WITH {_RADII} SELECT id, CAST(k AS INTEGER) AS k, round(0.8 * rc * cos(2 * pi() * (k + 0.5 * {h_sql('id', '31')}) / 12), 3) AS dx, round(0.8 * rc * sin(2 * pi() * (k + 0.5 * {h_sql('id', '31')}) / 12), 3) AS dy
FROM radii, unnest(range(12)) t(k) WHERE pop >= 8000""")
def wall_towers(p):
    return places.towers(places.radii(p.settlement)).select("id", "k", r(F.col("dx"), "dx", 3), r(F.col("dy"), "dy", 3))


@query("settlement", f"""WITH {_RADII}, s AS (SELECT id, is_port, rc / 34 AS reach, CAST(floor(lon * 100) AS BIGINT) AS ci, CAST(floor(lat * 100) AS BIGINT) AS cj, 1 / infl AS cosl FROM radii),
g AS (SELECT id, ci + i AS i, cj + j AS j, sqrt(CAST(i * i + j * j AS DOUBLE)) / 4 AS d, cosl FROM s, unnest(range(-3, 4)) a(i), unnest(range(-3, 4)) b(j))
SELECT id, i, j, round(0.8 + 0.5 * {h_sql('i', 'j', '6')}, 7) AS tint FROM g WHERE {h_sql('i', 'j', '3')} < round(0.35 * pow(greatest(1 - d, 0.0), 2.2) * cosl + CASE WHEN d < 0.92 THEN 0.006 ELSE 0.0 END, 6)""")
def building_lattice(p):
    """Sites of a lattice around each settlement, kept by hash against density."""
    s = places.radii(p.settlement)
    off = F.sequence(F.lit(-3), F.lit(3))
    s = s.select("id", F.floor(F.col("lon") * 100).alias("ci"), F.floor(F.col("lat") * 100).alias("cj"), (1 / F.col("infl")).alias("cosl"), F.explode(off).alias("di")).select("*", F.explode(off).alias("dj"))
    s = s.withColumns({"i": F.col("ci") + F.col("di"), "j": F.col("cj") + F.col("dj"), "d": F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double")) / 4})
    keep = F.round(0.35 * F.pow(F.greatest(1 - F.col("d"), F.lit(0.0)), 2.2) * F.col("cosl") + F.when(F.col("d") < 0.92, 0.006).otherwise(0.0), 6)
    return s.filter(h6(F.col("i"), F.col("j"), 3) < keep).select("id", "i", "j", r(0.8 + 0.5 * h6(F.col("i"), F.col("j"), 6), "tint", 7))


@query("settlement", f"""WITH m AS (SELECT id, CAST(k AS INTEGER) AS k, CAST(s AS INTEGER) AS step FROM settlement, unnest(range(8)) a(k), unnest(range(1, 21)) b(s) WHERE is_port AND {h_sql('id * 8 + k', 's', '17')} >= 0.85),
f AS (SELECT id, k, min(step) AS step FROM m GROUP BY id, k), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step, k) AS r FROM f)
SELECT id, k, CAST(step * 12 AS INTEGER) AS metres, round(45 + 55 * {h_sql('id', '20')}, 3) AS len FROM n WHERE r = 1""")
def pier_first_hit(p):
    """A port's pier runs out on the bearing where water is first met (a hash stands for the water); the first bearing of equals."""
    k, s = F.sequence(F.lit(0), F.lit(7)), F.sequence(F.lit(1), F.lit(20))
    m = p.settlement.filter("is_port").select("id", F.explode(k).alias("k")).select("*", F.explode(s).alias("step"))
    m = m.filter(h6(F.col("id") * 8 + F.col("k"), F.col("step"), 17) >= 0.85)
    f = m.groupBy("id").agg(F.min(F.struct("step", "k")).alias("m"))
    return f.select("id", "m.k", (F.col("m.step") * 12).cast("int").alias("metres"), r(45 + 55 * h6(F.col("id"), 20), "len", 3))


_NUM = "CAST(substr(site_id, 2) AS BIGINT)"


@query("sacred", f"""WITH s AS (SELECT site_id, {_NUM} AS n, tier, destroyed, CAST(6 + 2 * (tier - 7) AS INTEGER) AS stones, (18 + 9 * tier) / cos(radians(lat)) AS r FROM sacred WHERE tier >= 7)
SELECT site_id, CAST(i AS INTEGER) AS i, round(0.6 * r * cos(2 * pi() * ({h_sql('n', '21')} + i / CAST(stones AS DOUBLE))), 3) AS dx, round(0.85 + 0.4 * {h_sql('n', '40 + i')}, 5) AS shade
FROM s, unnest(range(stones)) t(i) WHERE NOT destroyed OR {h_sql('n', '22 + i')} < 0.45""")
def stone_ring(p):
    """Rings of stones at the greatest sites; of a destroyed one fewer than half stand."""
    s = p.sacred.filter("tier >= 7").withColumn("n", F.substring("site_id", 2, 20).cast("long"))
    x = places.stones(s)
    return x.select("site_id", "i", r(F.col("dx"), "dx", 3), r(0.85 + 0.4 * h6(F.col("n"), 40 + F.col("i")), "shade", 5))


@query("cell", "SELECT DISTINCT row + j AS row, col + i AS col FROM cell, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE fa % 97 = 0")
def footprint_expand(p):
    """A building's footprint at deep zoom: its cell and the next ones right and below."""
    return places.footprint(p.cell.filter("fa % 97 = 0").select("row", "col"))
