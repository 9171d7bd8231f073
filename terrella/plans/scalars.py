"""Coordinates, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..model import MERC_R, ORIGIN, SETTLEMENT_BREAKS, WORLD_SEED
from .registry import query

PI = "pi()"
_TILE = f"""
WITH z AS (SELECT unnest([10, 12, 14]) AS z),
tile_req AS (
  SELECT id, CAST(z AS INTEGER) AS z, CAST(floor((lon + 180) / 360 * pow(2, z)) AS BIGINT) AS x,
    CAST(floor((1 - ln(tan(radians(greatest(least(lat, {geo.MAX_LAT}), -{geo.MAX_LAT}))) + 1 / cos(radians(greatest(least(lat, {geo.MAX_LAT}), -{geo.MAX_LAT})))) / {PI}) / 2 * pow(2, z)) AS BIGINT) AS y
  FROM settlement CROSS JOIN z)
"""


def tile_requests(p):
    """A tile at each of three zooms for each settlement."""
    s = p.settlement.select("id", "lon", "lat", F.explode(F.array(*map(F.lit, (10, 12, 14)))).alias("z"))
    t = geo.lonlat_tile(F.col("lon"), F.col("lat"), F.col("z"))
    return s.select("id", "z", t["x"].alias("x"), t["y"].alias("y"))


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("settlement", _TILE + "SELECT id, z, x, y FROM tile_req")
def lonlat_tile(p):
    return tile_requests(p)


@query("settlement", _TILE + "SELECT id, z, x, CAST(pow(2, z) AS BIGINT) - 1 - y AS y_south FROM tile_req")
def tms_flip(p):
    return tile_requests(p).select("id", "z", "x", geo.flip_row(F.col("y"), F.col("z")).alias("y_south"))


@query("settlement", _TILE + f"""SELECT id, z, round(x * (2 * {ORIGIN} / pow(2, z)) - {ORIGIN}, 3) AS xmin, round((x + 1) * (2 * {ORIGIN} / pow(2, z)) - {ORIGIN}, 3) AS xmax,
  round({ORIGIN} - (y + 1) * (2 * {ORIGIN} / pow(2, z)), 3) AS ymin, round({ORIGIN} - y * (2 * {ORIGIN} / pow(2, z)), 3) AS ymax FROM tile_req""")
def tile_extent(p):
    e = geo.tile_extent(F.col("z"), F.col("x"), F.col("y"))
    return tile_requests(p).select("id", "z", *[F.round(c, 3).alias(n) for n, c in e.items()])


@query("settlement", _TILE + f"""SELECT id, z, round(degrees((x * (2 * {ORIGIN} / pow(2, z)) - {ORIGIN}) / {MERC_R}) - 0.08, 6) AS xmin,
  round(degrees(2 * atan(exp(({ORIGIN} - y * (2 * {ORIGIN} / pow(2, z))) / {MERC_R})) - {PI} / 2) + 0.08, 6) AS ymax FROM tile_req""")
def tile_bbox_margin(p):
    b = geo.tile_bbox(F.col("z"), F.col("x"), F.col("y"))
    return tile_requests(p).select("id", "z", r6(b["xmin"], "xmin"), r6(b["ymax"], "ymax"))


@query("vertex", f"SELECT line, seq, round(degrees(x / {MERC_R}), 6) AS lon, round(degrees(2 * atan(exp(y / {MERC_R})) - {PI} / 2), 6) AS lat FROM vertex")
def merc_inverse(p):
    return p.vertex.select("line", "seq", r6(geo.merc_lon(F.col("x")), "lon"), r6(geo.merc_lat(F.col("y")), "lat"))


@query("settlement", f"SELECT id, round(radians(lon) * {MERC_R}, 3) AS x, round(ln(tan(radians(lat) / 2 + {PI} / 4)) * {MERC_R}, 3) AS y FROM settlement WHERE abs(lat) < 84.5")
def merc_forward(p):
    s = p.settlement.filter(scalar.mercator_range(F.col("lon"), F.col("lat")))
    return s.select("id", F.round(geo.lon_merc(F.col("lon")), 3).alias("x"), F.round(geo.lat_merc(F.col("lat")), 3).alias("y"))


@query("settlement sacred", """SELECT s.id, t.site_id, round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(t.lat - s.lat) / 2), 2)
  + cos(radians(s.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - s.lon) / 2), 2)))), 5) AS km
FROM settlement s JOIN sacred t ON s.id = CAST(substr(t.site_id, 2) AS BIGINT)""")
def haversine(p):
    t = p.sacred.select("site_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.substring("site_id", 2, 20).cast("long").alias("id"))
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return p.settlement.join(t, "id").select("id", "site_id", F.round(km, 5).alias("km"))


#: Literals with exponents are doubles in DuckDB, and the order of sums is the Column's.
_H = "(sin(127.1e0 * ({a}) + 311.7e0 * ({b}) + 74.7e0 * ({k}) + %re0) * 43758.5453e0)" % (0.618 * WORLD_SEED)


def h_sql(a, b="0", k="1"):
    """hash01 as DuckDB text, rounded to the digits that both engines share."""
    t = _H.format(a=a, b=b, k=k)
    return f"round({t} - floor({t}), 6)"


def h6(a, b=0.0, k=1.0):
    return F.round(scalar.hash01(a, b, k), 6)


@query("cell", f"SELECT row, col, {h_sql('col', 'row', '3')} AS h FROM cell")
def hash01(p):
    return p.cell.select("row", "col", h6(F.col("col"), F.col("row"), 3).alias("h"))


@query("sacred", "SELECT site_id, CAST(list_sum(list_transform(range(1, length(site_id) + 1), lambda i: unicode(site_id[i]) * i)) AS BIGINT) AS num FROM sacred")
def codepoint_hash(p):
    return p.sacred.select("site_id", scalar.codepoint_id(F.col("site_id")).alias("num"))


def ss_sql(x, e0, e1):
    t = f"greatest(least((({x}) - ({e0})) / CAST(({e1}) - ({e0}) AS DOUBLE), 1.0), 0.0)"
    return f"(pow({t}, 2) * (3 - 2 * {t}))"


@query("cell", f"SELECT row, col, round({ss_sql('elev', '1800', '2800')}, 6) AS s FROM cell")
def smoothstep(p):
    return p.cell.select("row", "col", r6(scalar.smoothstep(F.col("elev"), 1800, 2800), "s"))


@query("cell", "SELECT row, col, round(greatest(least((0.3 * (elev % 256) + 0.59 * (fa % 256) + 0.11 * (water * 50)) / 160, 1.2), 0.45), 6) AS lum FROM cell WHERE elev >= 0")
def luminance(p):
    c = p.cell.filter("elev >= 0")
    lum = scalar.luminance(F.col("elev") % 256, F.col("fa") % 256, F.col("water") * 50, 0.45, 1.2)
    return c.select("row", "col", scalar.rounded(lum, 6).alias("lum"))  # every second value is a tie at six digits


@query("settlement override", """SELECT s.id, coalesce(o.name, s.name) AS name, coalesce(o.population, CAST(s.pop AS DOUBLE)) AS population
FROM settlement s LEFT JOIN override o ON s.id = o.settlement_id""")
def coalesce_override(p):
    o = p.override.select(F.col("settlement_id").alias("id"), F.col("name").alias("new"), "population")
    return p.settlement.join(o, "id", "left").select("id", F.coalesce("new", "name").alias("name"), F.coalesce("population", F.col("pop").cast("double")).alias("population"))


@query("cell", """SELECT row, col, water = 1 AS ocean, water = 2 AS lake, water = 3 AS navigable, water = 4 AS stream, water <> 0 AS wet,
  water IN (1, 2, 3) AS blocks_roads, water IN (1, 3) OR (water = 2 AND fa >= 1000) AS trade FROM cell""")
def water_predicates(p):
    w = F.col("water")
    is_ = lambda *n: scalar.water_is(w, *n)
    return p.cell.select(
        "row", "col", is_("OCEAN").alias("ocean"), is_("LAKE").alias("lake"), is_("RIVER_NAV").alias("navigable"), is_("STREAM_MINOR").alias("stream"),
        is_("OCEAN", "LAKE", "RIVER_NAV", "STREAM_MINOR").alias("wet"), is_("OCEAN", "LAKE", "RIVER_NAV").alias("blocks_roads"),
        (is_("OCEAN", "RIVER_NAV") | (is_("LAKE") & (F.col("fa") >= 1000))).alias("trade"),
    )


@query("feature settlement", """WITH files AS (
  SELECT lower(regexp_replace(name, '[^a-z0-9]', '', 'g')) AS key, min(concat(name, '.jpg')) AS file FROM feature GROUP BY 1)
SELECT s.id, coalesce(s.inkarnate, f.file) AS inkarnate FROM settlement s LEFT JOIN files f ON lower(regexp_replace(s.name, '[^a-z0-9]', '', 'g')) = f.key""")
def name_match(p):
    """Images by normalised name, only where none is set; of several files the first by name."""
    key = scalar.normalised_name(F.col("name"))
    files = p.feature.groupBy(key.alias("key")).agg(F.min(F.concat("name", F.lit(".jpg"))).alias("file"))
    return p.settlement.withColumn("key", key).join(files, "key", "left").select("id", F.coalesce("inkarnate", "file").alias("inkarnate"))


@query("settlement", "SELECT id, z.z AS z, concat(regexp_replace(name, '[^a-z0-9]+', '-', 'g'), '_z', z.z) AS slug FROM settlement, (SELECT CAST(unnest([10, 12, 14]) AS INTEGER) AS z) z")
def slug_ids(p):
    s = p.settlement.select("id", "name", F.explode(F.array(*map(F.lit, (10, 12, 14)))).alias("z"))
    return s.select("id", "z", F.concat(scalar.slug(F.col("name")), F.lit("_z"), F.col("z").cast("string")).alias("slug"))


@query("", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(p):
    return p.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("settlement", """SELECT id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(floor(lon) AS BIGINT) + i AS cx, CAST(floor(lat) AS BIGINT) + j AS cy
FROM settlement, unnest(range(-1, 2)) a(i), unnest(range(-1, 2)) b(j)""")
def lattice_expand(p):
    """The cells around each point, as a lattice of offsets."""
    off = F.sequence(F.lit(-1), F.lit(1))
    s = p.settlement.select("id", "lon", "lat", F.explode(off).alias("i")).select("*", F.explode(off).alias("j"))
    return s.select("id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.floor("lon") + F.col("i")).cast("long").alias("cx"), (F.floor("lat") + F.col("j")).cast("long").alias("cy"))


@query("settlement", "SELECT id, CAST(CASE " + " ".join(f"WHEN pop >= {b} THEN {i}" for i, b in sorted(enumerate(SETTLEMENT_BREAKS, 2), reverse=True)) + " ELSE 1 END AS INTEGER) AS tier FROM settlement")
def settlement_tier(p):
    return p.settlement.select("id", scalar.settlement_tier(F.col("pop")).alias("tier"))


@query("node_edge", "SELECT src, dst, CASE WHEN flow >= 500000 THEN 'big' WHEN flow >= 50000 THEN 'med' WHEN flow >= 25000 THEN 'small' ELSE 'dropped' END AS tier FROM node_edge")
def flow_tier(p):
    return p.node_edge.select("src", "dst", scalar.flow_tier(F.col("flow")).alias("tier"))


@query("settlement", "SELECT id FROM settlement WHERE lon IS NOT NULL AND abs(lat) < 84.5")
def filter_mercator_range(p):
    return p.settlement.filter(scalar.mercator_range(F.col("lon"), F.col("lat"))).select("id")
