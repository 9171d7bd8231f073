"""Roads, rivers and ferries as shaped lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import registry
from ..functions import scalar
from ..operators import noise, shaping
from .fields import fbm_sql
from .registry import query

#: The driver's lines have vertices kilometres apart; they are cut as coarsely here.
STEP = 4000.0


def field(name, use=None, rung=None):
    f = registry.field(name)
    return noise.Fbm(registry.octaves(name, use), registry.wavelength(name, use, rung), registry.seed(name, rung), f.gain)


def field_sql(x, y, name, use=None, rung=None):
    return fbm_sql(x, y, registry.octaves(name, use), registry.wavelength(name, use, rung), registry.seed(name, rung), registry.field(name).gain)


def locate(x, y):
    """The cell of a place on a small world of 8 by 128 cells of 500 m that repeats."""
    return F.pmod(F.floor(y / 500), F.lit(8)).cast("long"), F.pmod(F.floor(x / 500), F.lit(128)).cast("long")


def _locate_at(x, y):
    """``locate`` for arrays."""
    return np.mod(np.floor(y / 500).astype(np.int64), 8), np.mod(np.floor(x / 500).astype(np.int64), 128)


locate.at = _locate_at


def cell_sql(v, n):
    return f"((CAST(floor(({v}) / 500) AS BIGINT) % {n}) + {n}) % {n}"


def out(df):
    return df.select("line", "seq", scalar.rounded(F.col("x"), 2).alias("x"), scalar.rounded(F.col("y"), 2).alias("y"))


_W = "(PARTITION BY line ORDER BY seq)"
_DENSE = f"""WITH n0 AS (SELECT line, seq, x, y, lead(x) OVER {_W} AS nx, lead(y) OVER {_W} AS ny FROM vertex),
n1 AS (SELECT *, CAST(coalesce(greatest(ceil(sqrt(pow(nx - x, 2) + pow(ny - y, 2)) / {STEP}), 1), 1) AS INTEGER) AS n FROM n0),
n2 AS (SELECT line, seq, k, CASE WHEN nx IS NULL THEN x ELSE x + (nx - x) * (k / CAST(n AS DOUBLE)) END AS x, CASE WHEN ny IS NULL THEN y ELSE y + (ny - y) * (k / CAST(n AS DOUBLE)) END AS y FROM n1, unnest(range(n)) t(k)),
dense AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY seq, k) AS seq, x, y FROM n2),
f0 AS (SELECT *, coalesce(lead(x) OVER {_W}, x) - coalesce(lag(x) OVER {_W}, x) AS dx, coalesce(lead(y) OVER {_W}, y) - coalesce(lag(y) OVER {_W}, y) AS dy,
  coalesce(sqrt(pow(x - lag(x) OVER {_W}, 2) + pow(y - lag(y) OVER {_W}, 2)), 0.0) AS d, count(*) OVER (PARTITION BY line) AS n FROM dense),
f1 AS (SELECT line, seq, x, y, n, sum(d) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s,
  CASE WHEN dx <> 0 OR dy <> 0 THEN -dy / sqrt(dx * dx + dy * dy) ELSE 0.0 END AS nx, CASE WHEN dx <> 0 OR dy <> 0 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0.0 END AS ny FROM f0),
framed AS (SELECT *, CASE WHEN n >= 3 THEN greatest(0.0, least(1.0, least(s, max(s) OVER (PARTITION BY line) - s) / {{taper}})) ELSE 0.0 END AS t FROM f1)"""


def _road_round(i):
    pull = f"-{shaping.ROAD_PULL} * ({field_sql('rx', 'ry', 'terrain', 'pull')} - {field_sql('lx', 'ly', 'terrain', 'pull')}) / {2 * shaping.ROAD_PROBE}"
    h = shaping.ROAD_PROBE
    return f"""b{i} AS MATERIALIZED (SELECT *, x + nx * (off - {h}) AS lx, y + ny * (off - {h}) AS ly, x + nx * (off + {h}) AS rx, y + ny * (off + {h}) AS ry FROM r{i - 1}),
p{i} AS MATERIALIZED (SELECT line, seq, x, y, nx, ny, t, off, {pull} AS pull FROM b{i}),
r{i} AS MATERIALIZED (SELECT line, seq, x, y, nx, ny, t, greatest(least(off + CASE WHEN count(*) OVER w = 7 THEN avg(pull) OVER w ELSE 0.0 END * t, {shaping.ROAD_BOUND}), -{shaping.ROAD_BOUND}) AS off FROM p{i}
  WINDOW w AS (PARTITION BY line ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""


_ROADS = _DENSE.format(taper=shaping.ROAD_TAPER) + ", r0 AS (SELECT line, seq, x, y, nx, ny, t, 0.0::DOUBLE AS off FROM framed), " + ", ".join(map(_road_round, range(1, shaping.ROAD_ROUNDS + 1)))
_ROADS += f""", o AS (SELECT line, seq, x, y, nx, ny, off + {shaping.ROAD_WIGGLE} * {field_sql('x', 'y', 'terrain', 'wiggle')} * t AS off FROM r{shaping.ROAD_ROUNDS})
SELECT line, seq, round(x + nx * off, 2) AS x, round(y + ny * off, 2) AS y FROM o"""


@query("vertex", _ROADS)
def shape_roads(p):
    """Every line as a road."""
    return out(shaping.roads(p.vertex.select("line", "seq", "x", "y"), field("terrain", "pull"), field("terrain", "wiggle"), STEP))


_A, _P = shaping.RIVER_REACH, shaping.RIVER_PROBE
_BANDS = " + ".join(f"{a} * {field_sql('x', 'y', 'river.meander', rung=i)}" for i, a in enumerate(registry.MEANDER_AMPLITUDE, 1))
_RIVERS = _DENSE.format(taper=shaping.RIVER_TAPER) + f""", q AS (SELECT *, x - nx * {_P} AS lx, y - ny * {_P} AS ly, x + nx * {_P} AS rx, y + ny * {_P} AS ry,
  {cell_sql(f'y - ny * {_A}', 8)} AS lrow, {cell_sql(f'x - nx * {_A}', 128)} AS lcol, {cell_sql(f'y + ny * {_A}', 8)} AS rrow, {cell_sql(f'x + nx * {_A}', 128)} AS rcol FROM framed),
g AS (SELECT q.*, coalesce((b.elev - a.elev) / {2 * _A}, 0.0) AS slope FROM q LEFT JOIN cell a ON a.row = lrow AND a.col = lcol LEFT JOIN cell b ON b.row = rrow AND b.col = rcol),
o AS (SELECT line, seq, x, y, nx, ny, t, {_BANDS} - {shaping.RIVER_PULL} * ({field_sql('rx', 'ry', 'terrain', 'pull')} - {field_sql('lx', 'ly', 'terrain', 'pull')}) / {2 * _P}
  - {shaping.RIVER_ANCHOR} * greatest(least(slope, {shaping.RIVER_SLOPE}), -{shaping.RIVER_SLOPE}) AS off FROM g),
c AS (SELECT *, greatest(least(off, {shaping.RIVER_BOUND}), -{shaping.RIVER_BOUND}) * t AS m FROM o)
SELECT line, seq, round(x + nx * m, 2) AS x, round(y + ny * m, 2) AS y FROM c"""


@query("vertex cell", _RIVERS)
def shape_rivers(p):
    """Every line as a river over the cells' ground."""
    bands = [(a, field("river.meander", rung=i)) for i, a in enumerate(registry.MEANDER_AMPLITUDE, 1)]
    return out(shaping.rivers(p.vertex.select("line", "seq", "x", "y"), bands, field("terrain", "pull"), p.cell, locate, STEP))


_PROBES = ", ".join(["(0, 0, 0e0, 0e0)"] + [f"({k}, {ring}, {ring * shaping.FERRY_PROBE * dx!r}e0, {ring * shaping.FERRY_PROBE * dy!r}e0)" for ring in (1, 2) for k, (dx, dy) in enumerate(shaping.BEARINGS)])
_STEPS = ", ".join(f"({k}, {dx!r}e0, {dy!r}e0)" for k, (dx, dy) in enumerate(shaping.BEARINGS))


def _ferry_round(i):
    return f"""q{i} AS MATERIALIZED (SELECT b.line, b.seq, k, ring, CAST(coalesce(w.wet, 0) AS INTEGER) AS wet FROM b{i - 1} b CROSS JOIN probes LEFT JOIN wet w ON w.row = {cell_sql('b.y + py', 8)} AND w.col = {cell_sql('b.x + px', 128)}),
s{i} AS MATERIALIZED (SELECT line, seq, arg_min(k, 100 * -sc + k) AS k FROM (SELECT line, seq, k, sum(wet) AS sc FROM q{i} WHERE ring > 0 GROUP BY line, seq, k) GROUP BY line, seq),
g{i} AS MATERIALIZED (SELECT line, seq, sum(CASE WHEN ring = 0 THEN wet ELSE 0 END) AS own, sum(CASE WHEN ring = 1 THEN wet ELSE 0 END) AS near FROM q{i} GROUP BY line, seq),
n{i} AS MATERIALIZED (SELECT b.line, b.seq, b.x, b.y, s.k, b.open AND (g.own = 0 OR g.near < {shaping.FERRY_WATER} * 8) AS open FROM b{i - 1} b JOIN s{i} s ON b.line = s.line AND b.seq = s.seq JOIN g{i} g ON b.line = g.line AND b.seq = g.seq),
b{i} AS MATERIALIZED (SELECT line, seq, CASE WHEN open THEN x + {shaping.FERRY_STEP} * dx ELSE x END AS x, CASE WHEN open THEN y + {shaping.FERRY_STEP} * dy ELSE y END AS y, open FROM n{i} JOIN steps USING (k))"""


_FERRIES = f"""WITH wet AS (SELECT row, col, CASE WHEN water IN (1, 2) THEN 1 ELSE 0 END AS wet FROM cell), probes(k, ring, px, py) AS (VALUES {_PROBES}), steps(k, dx, dy) AS (VALUES {_STEPS}),
b0 AS MATERIALIZED (SELECT line, seq, x, y, seq > min(seq) OVER l AND seq < max(seq) OVER l AS open FROM vertex WINDOW l AS (PARTITION BY line)), """
_FERRIES += ", ".join(map(_ferry_round, range(1, shaping.FERRY_ROUNDS + 1))) + f" SELECT line, seq, round(x, 2) AS x, round(y, 2) AS y FROM b{shaping.FERRY_ROUNDS}"


@query("vertex cell", _FERRIES)
def shape_ferries(p):
    """Every line as a ferry's."""
    water = p.cell.select("row", "col", scalar.water_is(F.col("water"), "OCEAN", "LAKE").alias("wet"))
    return out(shaping.ferries(p.vertex.select("line", "seq", "x", "y"), water, locate))
