"""Polylines: windows over vertices, runs, ferries, flow networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import joins, network, polyline
from .registry import query
from .scalars import h6, h_sql

_W = "(PARTITION BY line ORDER BY seq)"
_S = f"""
WITH d AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER {_W}, 2) + pow(y - lag(y) OVER {_W}, 2)), 0.0) AS d FROM vertex),
arc AS (SELECT line, seq, x, y, wet, sum(d) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM d)
"""


def r(c, name, digits=3):
    return F.round(c, digits).alias(name)


@query("vertex", _S + "SELECT line, seq, round(s, 3) AS s FROM arc")
def arclength(p):
    return polyline.arclength(p.vertex).select("line", "seq", r(F.col("s"), "s"))


@query("vertex", _S + "SELECT line, seq, round(greatest(0.0, least(1.0, least(s, max(s) OVER (PARTITION BY line) - s) / 250)), 6) AS taper FROM arc")
def arclength_taper(p):
    return polyline.arclength(p.vertex).select("line", "seq", r(polyline.taper_by_length(F.col("s"), 250.0), "taper", 6))


@query("vertex", f"""WITH t AS (SELECT line, seq, coalesce(lead(x) OVER {_W}, x) - coalesce(lag(x) OVER {_W}, x) AS dx, coalesce(lead(y) OVER {_W}, y) - coalesce(lag(y) OVER {_W}, y) AS dy FROM vertex)
SELECT line, seq, round(CASE WHEN dx <> 0 OR dy <> 0 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0.0 END, 6) AS tx, round(CASE WHEN dx <> 0 OR dy <> 0 THEN dy / sqrt(dx * dx + dy * dy) ELSE 0.0 END, 6) AS ty FROM t""")
def tangent_normal(p):
    return polyline.tangents(p.vertex).select("line", "seq", r(F.col("tx"), "tx", 6), r(F.col("ty"), "ty", 6))


_RANK = "CAST(row_number() OVER (PARTITION BY line ORDER BY seq) - 1 AS DOUBLE) / greatest(count(*) OVER (PARTITION BY line) - 1, 1)"


@query("vertex", f"SELECT line, seq, round(least(1.0, least(t, 1 - t) / 0.12), 6) AS taper FROM (SELECT line, seq, {_RANK} AS t FROM vertex)")
def endpoint_taper(p):
    return p.vertex.select("line", "seq", r(polyline.taper_by_rank(0.12), "taper", 6))


@query("vertex", """SELECT line, seq, round(CASE WHEN count(*) OVER w = 7 THEN avg(y) OVER w ELSE 0.0 END, 4) AS m FROM vertex
WINDOW w AS (PARTITION BY line ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def moving_avg7(p):
    return p.vertex.select("line", "seq", r(polyline.centred_mean("y", 3, 0.0), "m", 4))


@query("vertex", _S + """, o AS (SELECT line, seq, s, max(s) OVER (PARTITION BY line) AS e, greatest(least(130 * sin(s / 1600) + 45 * sin(s / 420) + 14 * sin(s / 130), 220.0), -220.0) AS o FROM arc)
SELECT line, seq, round(o * greatest(0.0, least(1.0, least(s, e - s) / 180)), 4) AS o FROM o""")
def river_offsets(p):
    """Three bands of offsets, bounded, and less near the ends; sines stand for the noise fields."""
    s = F.col("s")
    bands = 130 * F.sin(s / 1600) + 45 * F.sin(s / 420) + 14 * F.sin(s / 130)
    return polyline.arclength(p.vertex).select("line", "seq", r(scalar.clamp(bands, -220.0, 220.0) * polyline.taper_by_length(s, 180.0), "o", 4))


@query("vertex", f"""WITH n AS (SELECT line, seq, x, y, lead(x) OVER {_W} AS nx, lead(y) OVER {_W} AS ny FROM vertex),
m AS (SELECT *, CAST(coalesce(greatest(ceil(sqrt(pow(nx - x, 2) + pow(ny - y, 2)) / 4000), 1), 1) AS INTEGER) AS n FROM n)
SELECT line, seq, CAST(k AS INTEGER) AS part, round(CASE WHEN nx IS NULL THEN x ELSE x + (nx - x) * (k / CAST(n AS DOUBLE)) END, 3) AS x, round(CASE WHEN nx IS NULL THEN y ELSE y + (ny - y) * (k / CAST(n AS DOUBLE)) END, 3) AS y
FROM m, unnest(range(n)) t(k)""")
def densify(p):
    d = polyline.densify(p.vertex, 4000.0)
    # some parts of the way from one whole vertex to another are ties at three digits
    return d.select("line", "seq", "part", scalar.rounded(F.col("x"), 3).alias("x"), scalar.rounded(F.col("y"), 3).alias("y"))


_RUNS = _S + f""", c AS (SELECT *, CASE WHEN wet = lag(wet) OVER {_W} THEN 0 ELSE 1 END AS ch FROM arc),
g AS (SELECT *, sum(ch) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM c),
runs AS (SELECT line, CAST(run AS BIGINT) AS run, any_value(wet) AS wet, min(seq) AS i0, max(seq) AS i1, min(s) AS s0, max(s) AS s1 FROM g GROUP BY line, run)
"""
_MERGED = _RUNS + """, long AS (SELECT * FROM runs WHERE wet AND s1 - s0 >= 1500),
a AS (SELECT *, CASE WHEN s0 - lag(s1) OVER (PARTITION BY line ORDER BY i0) < 90000 THEN 0 ELSE 1 END AS ap FROM long),
k AS (SELECT *, sum(ap) OVER (PARTITION BY line ORDER BY i0 ROWS UNBOUNDED PRECEDING) AS k FROM a),
crossing AS (SELECT line, CAST(k AS INTEGER) AS k, min(i0) AS i0, max(i1) AS i1, min(s0) AS s0, max(s1) AS s1 FROM k GROUP BY line, k)
"""


@query("vertex", _RUNS + "SELECT line, run, wet, i0, i1 FROM runs")
def runs_rle(p):
    return polyline.runs(polyline.arclength(p.vertex), "wet").select("line", "run", "wet", "i0", "i1")


@query("vertex", _RUNS + "SELECT line, run, i0, i1, round(s1 - s0, 3) AS len FROM runs WHERE wet AND s1 - s0 >= 1500")
def runs_min_length(p):
    x = polyline.runs(polyline.arclength(p.vertex), "wet").filter("wet and s1 - s0 >= 1500")
    return x.select("line", "run", "i0", "i1", r(F.col("s1") - F.col("s0"), "len"))


@query("vertex", _MERGED + "SELECT line, k, i0, i1, round(s0, 3) AS s0, round(s1, 3) AS s1 FROM crossing")
def runs_gap_merge(p):
    x = polyline.crossings(polyline.arclength(p.vertex), "wet", 1500.0, 90000.0)
    return x.select("line", "k", "i0", "i1", r(F.col("s0"), "s0"), r(F.col("s1"), "s1"))


@query("vertex", _MERGED + """, e AS (SELECT line, min(seq) AS lo, max(seq) AS hi FROM vertex GROUP BY line),
b AS (SELECT c.line, c.k, greatest(c.i0 - 1, e.lo) AS a, least(c.i1 + 1, e.hi) AS b, e.lo, e.hi FROM crossing c JOIN e USING (line)),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY line ORDER BY k), lo) AS prev, lead(b) OVER (PARTITION BY line ORDER BY k) IS NULL AS last FROM b),
parts AS (SELECT line, false AS ferry, prev AS i0, a AS i1 FROM q WHERE a > prev UNION ALL SELECT line, true, a, b FROM q UNION ALL SELECT line, false, b, hi FROM q WHERE last AND b < hi
  UNION ALL SELECT line, false, lo, hi FROM e WHERE line NOT IN (SELECT line FROM q)),
n AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY i0, i1) AS k FROM parts)
SELECT concat(line, CASE WHEN ferry THEN '_F' ELSE '_L' END, k) AS pk, line, ferry, i0, i1 FROM n WHERE i1 > i0""")
def ferry_pieces(p):
    x = polyline.ferry_pieces(polyline.arclength(p.vertex), "wet", 1500.0, 90000.0)
    pk = F.concat(F.col("line").cast("string"), F.when(F.col("ferry"), "_F").otherwise("_L"), F.col("k").cast("string"))
    return x.select(pk.alias("pk"), "line", "ferry", "i0", "i1")


@query("vertex", _S + """, q AS (SELECT line, seq, CAST(floor(s / 170) AS BIGINT) AS d FROM arc)
SELECT line, seq, ((d % 2) + 2) % 2 = 0 AND coalesce(((lead(d) OVER (PARTITION BY line ORDER BY seq) % 2) + 2) % 2 = 0, false) AS dash FROM q""")
def ferry_dash(p):
    """A segment is drawn if both ends fall in dashes of 170 m."""
    on = F.pmod(F.floor(F.col("s") / 170), F.lit(2)) == 0
    x = polyline.arclength(p.vertex).withColumn("on", on)
    return x.select("line", "seq", (F.col("on") & F.coalesce(F.lead("on").over(polyline.along()), F.lit(False))).alias("dash"))


_BEARING = f"""WITH b AS (SELECT line, seq, CAST(k AS INTEGER) AS k, {h_sql('round(x + 520 * cos(k * pi() / 4))', 'round(y + 520 * sin(k * pi() / 4))', '2')} AS w FROM vertex, unnest(range(8)) t(k)),
n AS (SELECT *, row_number() OVER (PARTITION BY line, seq ORDER BY w DESC, k) AS r FROM b)"""


@query("vertex", _BEARING + " SELECT line, seq, k, w FROM n WHERE r = 1")
def best_bearing(p):
    """Of eight bearings the most watery (a hash stands for the water share), the first of equals."""
    import math

    k = F.col("k")
    b = p.vertex.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    x, y = F.round(F.col("x") + 520 * F.cos(k * math.pi / 4)), F.round(F.col("y") + 520 * F.sin(k * math.pi / 4))
    return joins.first_per(b.withColumn("w", h6(x, y, 2)), ["line", "seq"], [F.desc("w"), k]).select("line", "seq", "k", "w")


@query("vertex", "SELECT line, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM vertex GROUP BY line")
def feature_bbox(p):
    return polyline.boxes(p.vertex)


_BOX = """WITH a AS (SELECT CAST(floor(x / 185) AS BIGINT) AS part, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM vertex GROUP BY 1),
t AS (SELECT event_id AS tile, CAST(event_id * 37 AS DOUBLE) - 400 AS x0, CAST(event_id * 37 AS DOUBLE) + 400 AS x1, value * 100 - 300 AS y0, value * 100 + 300 AS y1 FROM events)"""


@query("vertex", _BOX + " SELECT tile, part FROM a JOIN t ON xmin <= x1 AND xmax >= x0 AND ymin <= y1 AND ymax >= y0")
def bbox_overlap_join(p):
    """The box of each run of vertices against each tile's box."""
    part = F.floor(F.col("x") / 185).cast("long")
    a = p.vertex.groupBy(part.alias("part")).agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    x, y = (F.col("event_id") * 37).cast("double"), F.col("value") * 100
    t = p.events.select(F.col("event_id").alias("tile"), (x - 400).alias("x0"), (x + 400).alias("x1"), (y - 300).alias("y0"), (y + 300).alias("y1"))
    return joins.box_join(a, t, 2000.0, ("xmin", "xmax", "ymin", "ymax"), ("x0", "x1", "y0", "y1")).select("tile", "part")


@query("settlement sacred", """SELECT s.id, t.site_id FROM settlement s JOIN sacred t ON s.lon + 3 >= t.lon - tier AND s.lon - 3 <= t.lon + tier AND s.lat + 3 >= t.lat - tier AND s.lat - 3 <= t.lat + tier""")
def disc_overlap_join(p):
    lon, lat = F.col("lon"), F.col("lat")
    s = p.settlement.select("id", (lon - 3).alias("x0"), (lon + 3).alias("x1"), (lat - 3).alias("y0"), (lat + 3).alias("y1"))
    return joins.disc_join(s, p.sacred.select("site_id", lon, lat, "tier"), 12.0, ("x0", "x1", "y0", "y1"), "lon", "lat", "tier").select("id", "site_id")


@query("settlement sacred", """WITH c AS (SELECT t.site_id, s.id AS id, round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - t.lon) / 2), 2)))), 6) AS km
  FROM sacred t, settlement s WHERE t.tier >= 4), n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY km, id) AS r FROM c WHERE km > 30 AND km <= 2000)
SELECT site_id, id, round(km, 4) AS km FROM n WHERE r = 1""")
def nearest_within(p):
    """The nearest settlement of each greater site, not too near and not too far."""
    s = p.settlement.select("id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    sites = p.sacred.filter("tier >= 4").select("site_id", "lon", "lat")
    near = joins.nearest_in_rings(sites, s, "site_id", "id", (125.0, 500.0, 2000.0), ("lon", "lat"), ("lon2", "lat2"), least=30.0)
    return near.select("site_id", "id", F.round("km", 4).alias("km"))


@query("cell", """WITH o AS (SELECT * FROM (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)) v(k, dr, dc)),
n AS (SELECT c.row, c.col, c.fa, m.row AS to_row, m.col AS to_col, m.fa AS to_fa, row_number() OVER (PARTITION BY c.row, c.col ORDER BY m.fa DESC, k) AS r
  FROM cell c, o, cell m WHERE m.row = c.row + dr AND m.col = c.col + dc AND m.fa > c.fa)
SELECT row, col, fa, to_row, to_col, to_fa FROM n WHERE r = 1""")
def d8_downstream(p):
    return network.downstream(p.cell.select("row", "col", "fa"))


@query("node_edge", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM node_edge UNION ALL SELECT dst FROM node_edge) GROUP BY node")
def node_degree(p):
    return network.degrees(p.node_edge)


_EDGES = """edges AS (SELECT event_id AS edge, event_id AS src, event_id + CASE WHEN event_id % 5 = 3 THEN 1000000000 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS dst, CAST(floor(value * 1000) AS BIGINT) AS flow FROM events),
ends AS (SELECT edge, src AS node FROM edges UNION ALL SELECT edge, dst FROM edges),
link AS (SELECT min(edge) AS a, max(edge) AS b FROM ends GROUP BY node HAVING count(*) = 2 AND min(edge) <> max(edge)),
both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT edge, edge AS other FROM edges UNION SELECT reach.edge, both_.b FROM reach JOIN both_ ON reach.other = both_.a),
chain AS (SELECT edge, min(other) AS chain FROM reach GROUP BY edge)"""


def river_edges(p):
    """Every event as a segment to the next node, the next but one, or a mouth of its own."""
    e = F.col("event_id")
    return p.events.select(
        e.alias("edge"), e.alias("src"), (e + F.when(e % 5 == 3, 1000000000).when(e % 7 == 0, 2).otherwise(1)).alias("dst"), F.floor(F.col("value") * 1000).cast("long").alias("flow")
    )


@query("", "WITH RECURSIVE " + _EDGES + " SELECT edge, src, dst, chain FROM edges JOIN chain USING (edge)")
def chain_ids(p):
    """Segments chained through nodes of degree 2."""
    return network.chains(river_edges(p)).select("edge", "src", "dst", "chain")


@query("", "WITH RECURSIVE " + _EDGES + " SELECT chain, max(flow) AS max_flow, count(*) AS segments FROM edges JOIN chain USING (edge) GROUP BY chain")
def chain_max_flow(p):
    return network.chains(river_edges(p)).groupBy("chain").agg(F.max("flow").alias("max_flow"), F.count(F.lit(1)).alias("segments"))


@query("vertex", f"""WITH e AS (SELECT line, x, y, coalesce(lead(x) OVER {_W}, first(x) OVER {_W}) AS nx, coalesce(lead(y) OVER {_W}, first(y) OVER {_W}) AS ny FROM vertex),
o AS (SELECT line, min(x) AS ox, min(y) AS oy FROM vertex GROUP BY line),
q AS (SELECT line, ox, oy, x - ox AS x, y - oy AS y, nx - ox AS nx, ny - oy AS ny FROM e JOIN o USING (line)),
a AS (SELECT line, ox, oy, sum(x * ny - nx * y) AS a2, sum((x + nx) * (x * ny - nx * y)) AS cx, sum((y + ny) * (x * ny - nx * y)) AS cy FROM q GROUP BY line, ox, oy)
SELECT line, round(abs(a2) / 2, 0) AS area, round(ox + cx / (3 * a2), 0) AS x, round(oy + cy / (3 * a2), 0) AS y FROM a WHERE abs(a2) > 2000000""")
def centroid_label(p):
    """Area and centroid of the closed lines, but for those that cancel to nearly no area."""
    c = polyline.centroid(p.vertex).filter("area > 1000000")
    return c.select("line", r(F.col("area"), "area", 0), r(F.col("x"), "x", 0), r(F.col("y"), "y", 0))




@query("vertex", f"""WITH e AS (SELECT line, x, y, coalesce(lead(x) OVER {_W}, first(x) OVER {_W}) AS nx, coalesce(lead(y) OVER {_W}, first(y) OVER {_W}) AS ny FROM vertex),
pt AS (SELECT line, (min(x) + max(x)) / 2 + 1 AS px, (min(y) + max(y)) / 2 + 1 AS py FROM vertex GROUP BY line)
SELECT pt.line, sum(CASE WHEN (y > py) <> (ny > py) AND px < x + (py - y) / (CASE WHEN (y > py) <> (ny > py) THEN ny - y END) * (nx - x) THEN 1 ELSE 0 END) % 2 = 1 AS inside
FROM pt JOIN e ON pt.line = e.line GROUP BY pt.line""")
def point_in_poly(p):
    mid = lambda c: (F.min(c) + F.max(c)) / 2 + 1
    pts = p.vertex.groupBy("line").agg(mid("x").alias("px"), mid("y").alias("py"))
    return polyline.inside(pts, p.vertex).select("line", "inside")


@query("vertex cell", """WITH v AS (SELECT line, CAST(floor(x / 37) AS BIGINT) AS k FROM vertex)
SELECT line, round(avg(CASE WHEN c.water IN (1, 2) THEN 1.0 ELSE 0.0 END), 6) AS share FROM v JOIN cell c ON c.row = CAST(floor(CAST(k AS DOUBLE) / 128) AS BIGINT) AND c.col = k % 128 GROUP BY line""")
def wet_share(p):
    """The share of each line's samples that lie on open water."""
    k = F.floor(F.col("x") / 37).cast("long")
    v = p.vertex.select("line", F.floor(k / F.lit(128.0)).cast("long").alias("row"), (k % 128).alias("col"))
    wet = scalar.water_is(F.col("water"), "OCEAN", "LAKE").cast("double")
    return v.join(p.cell.select("row", "col", "water"), ["row", "col"]).groupBy("line").agg(F.round(F.avg(wet), 6).alias("share"))


@query("vertex", f"SELECT line, seq, abs(y - lag(y) OVER {_W}) > 3000 AS jump FROM vertex")
def gradient_break(p):
    """Where a line's profile jumps; unknown at its first vertex."""
    return p.vertex.select("line", "seq", (F.abs(F.col("y") - F.lag("y").over(Window.partitionBy("line").orderBy("seq"))) > 3000).alias("jump"))
