"""Noise: octaves and ladders over the lattice backend, and the registry's own checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry
from ..functions import scalar
from ..model import WORLD_SEED
from ..operators import joins, noise
from .registry import query
from .scalars import _H, h6, h_sql


def noise_sql(x, y, stream):
    """The lattice noise of a derived table with columns x and y, as text."""
    x0, y0 = f"floor({x})", f"floor({y})"
    s = lambda c, c0: f"(({c}) - {c0}) * (({c}) - {c0}) * (3 - 2 * (({c}) - {c0}))"

    def h(i, j):
        t = _H.format(a=f"{x0} + {i}", b=f"{y0} + {j}", k=f"{float(stream)!r}e0")
        return f"({t} - floor({t}))"

    u, v = s(x, x0), s(y, y0)
    low, high = f"({h(0, 0)} + ({h(1, 0)} - {h(0, 0)}) * {u})", f"({h(0, 1)} + ({h(1, 1)} - {h(0, 1)}) * {u})"
    return f"(({low} + ({high} - {low}) * {v}) * 2 - 1)"


def fbm_sql(x, y, octaves, wl, stream, gain=0.5):
    terms = [f"{noise_sql(f'({x} * {2.0**o / wl!r}e0)', f'({y} * {2.0**o / wl!r}e0)', stream + o + 1)} * {gain**o!r}e0" for o in range(octaves)]
    return f"(({' + '.join(terms)}) / {sum(gain**o for o in range(octaves))!r}e0)"


_XY = "p AS (SELECT row, col, CAST(col * 977 AS DOUBLE) AS x, CAST(row * 1013 AS DOUBLE) AS y FROM cell)"


def places(p):
    return p.cell.select("row", "col", (F.col("col") * 977).cast("double").alias("x"), (F.col("row") * 1013).cast("double").alias("y"))


def fbm_of(name, n=None):
    f = registry.field(name)
    return noise.fbm(F.col("x"), F.col("y"), n or registry.octaves(name), registry.wavelength(name), registry.seed(name), f.gain)


@query("cell", f"WITH {_XY} SELECT row, col, round({fbm_sql('x', 'y', 3, 1500, WORLD_SEED + 101)}, 4) AS n FROM p")
def fbm_octave_sum(p):
    return places(p).select("row", "col", F.round(fbm_of("biome.warp.x"), 4).alias("n"))


@query("cell", f"WITH {_XY} SELECT row, col, abs({fbm_sql('x', 'y', 4, 2000, WORLD_SEED + 303)} * 1.875 - {fbm_sql('x', 'y', 3, 2000, WORLD_SEED + 303)} * 1.75) <= 0.125 + 1e-9 AS within FROM p")
def fbm_prefix_stable(p):
    """One octave more changes the sum by that octave alone: at most its weight."""
    with_, without = fbm_of("coast.warp.x", 4) * 1.875, fbm_of("coast.warp.x", 3) * 1.75
    return places(p).select("row", "col", (F.abs(with_ - without) <= 0.125 + 1e-9).alias("within"))


def _rung_sql(i):
    n = noise_sql(f"(x * {1 / registry.wavelength('drainage', rung=i)!r}e0)", f"(y * {1 / registry.wavelength('drainage', rung=i)!r}e0)", registry.seed("drainage", i))
    return f"{registry.DRAINAGE_WEIGHT[i - 1]}e0 * exp(-pow({n} / {registry.DRAINAGE_WIDTH[i - 1]}e0, 2))"


@query("cell", f"WITH {_XY} SELECT row, col, round(least({' + '.join(map(_rung_sql, range(1, 5)))}, 1.0), 4) AS inc FROM p")
def drainage_ladder(p):
    """Incision along the zero lines of four rungs, capped."""

    def rung(i):
        wl = registry.wavelength("drainage", rung=i)
        n = noise.lattice(F.col("x") * (1 / wl), F.col("y") * (1 / wl), registry.seed("drainage", i))
        return registry.DRAINAGE_WEIGHT[i - 1] * F.exp(-F.pow(n / registry.DRAINAGE_WIDTH[i - 1], 2))

    total = rung(1)
    for i in range(2, registry.DRAINAGE_COARSE + 1):
        total = total + rung(i)
    return places(p).select("row", "col", F.round(F.least(total, F.lit(1.0)), 4).alias("inc"))


def field_rows(p):
    rows = [(f.name, list(f.offsets), registry.octaves(f.name) if isinstance(f.octaves, int) else max(f.octaves.values()), f.gain) for f in registry.FIELDS.values()]
    return p.spark.createDataFrame(rows, "field string, offsets array<int>, octaves int, gain double")


_FIELDS = "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{f.name}', {list(f.offsets)}, {max(f.octaves.values()) if isinstance(f.octaves, dict) else f.octaves}, {f.gain}e0)" for f in registry.FIELDS.values()) + ") v(field, offsets, octaves, gain))"


@query("", f"WITH {_FIELDS} SELECT field, len(offsets) AS n, {WORLD_SEED} + list_min(offsets) AS seed, CAST(octaves AS INTEGER) AS octaves, CAST(gain AS DOUBLE) AS gain FROM f")
def registry_lookup(p):
    return field_rows(p).select("field", F.size("offsets").cast("long").alias("n"), (F.lit(WORLD_SEED) + F.array_min("offsets")).alias("seed"), "octaves", "gain")


@query("", f"WITH {_FIELDS}, o AS (SELECT field, unnest(offsets) AS o FROM f) SELECT count(*) AS offsets, count(DISTINCT o) AS owners, CAST(sum(CASE WHEN o < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM o")
def registry_audit(p):
    o = field_rows(p).select("field", F.explode("offsets").alias("o"))
    return o.agg(F.count(F.lit(1)).alias("offsets"), F.countDistinct("o").alias("owners"), F.count_if(F.col("o") < 0).alias("negative"))


@query("", f"WITH {_FIELDS}, o AS (SELECT unnest(offsets) AS o FROM f) SELECT CAST(g AS BIGINT) AS free FROM range(1, 1001) t(g) WHERE g NOT IN (SELECT o FROM o) ORDER BY g LIMIT 20")
def free_offsets(p):
    """The twenty lowest offsets without an owner."""
    used = field_rows(p).select(F.explode(F.col("offsets").cast("array<bigint>")).alias("free"))
    return p.spark.range(1, 1001).withColumnRenamed("id", "free").join(used, "free", "left_anti").orderBy("free").limit(20)


@query("", f"WITH {_FIELDS}, o AS (SELECT unnest(offsets) AS o FROM f), hit AS (SELECT doc_id, CAST(unnest(regexp_extract_all(text, '([0-9]{{2,3}})[a-z. ]', 1)) AS INTEGER) AS offset_ FROM documents) SELECT offset_, count(*) AS n FROM hit WHERE offset_ NOT IN (SELECT o FROM o) GROUP BY offset_")
def source_scan(p):
    """Numbers in sources that look like offsets but have no owner."""
    hit = p.documents.select(F.explode(F.regexp_extract_all("text", F.lit("([0-9]{2,3})[a-z. ]"), 1).cast("array<int>")).alias("offset_"))
    used = field_rows(p).select(F.explode("offsets").alias("offset_"))
    return hit.join(used, "offset_", "left_anti").groupBy("offset_").agg(F.count(F.lit(1)).alias("n"))


@query("cell", f"""WITH q AS (SELECT row, col, col * 0.37e0 AS x, row * 0.41e0 AS y FROM cell),
s AS (SELECT row, col, i, j, {h_sql('floor(x) + i', 'floor(y) + j', '3')} AS v, pow(floor(x) + i + {h_sql('floor(x) + i', 'floor(y) + j', '1')} - x, 2) + pow(floor(y) + j + {h_sql('floor(x) + i', 'floor(y) + j', '2')} - y, 2) AS d
  FROM q, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)), n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY round(d, 5), i, j) AS r FROM s)
SELECT row, col, v FROM n WHERE r = 1""")
def worley_cell(p):
    """The value of the nearest of the nine jittered sites around."""
    x, y = F.col("col") * 0.37, F.col("row") * 0.41
    off = F.array(*map(F.lit, (-1, 0, 1)))
    q = p.cell.select("row", "col", x.alias("x"), y.alias("y"), F.explode(off).alias("i")).select("*", F.explode(off).alias("j"))
    sx, sy = F.floor("x") + F.col("i"), F.floor("y") + F.col("j")
    d = F.pow(sx + h6(sx, sy, 1) - F.col("x"), 2) + F.pow(sy + h6(sx, sy, 2) - F.col("y"), 2)
    near = joins.first_per(q.withColumns({"d": F.round(d, 5), "v": h6(sx, sy, 3)}), ["row", "col"], [F.col("d"), F.col("i"), F.col("j")])
    return near.select("row", "col", "v")


@query()
def simplex_field(p):
    """The Arrow backend over the same grid; its contract is tested, its values are the library's own."""
    f = registry.field("veg.openness")
    n = noise.simplex_fbm(F.col("x"), F.col("y"), registry.octaves(f.name), registry.wavelength(f.name), registry.seed(f.name), f.gain)
    return places(p).select("row", "col", F.round(n, 9).alias("n"))


@query()
def fingerprint_digest(p):
    """A digest of every field at fixed places, by which a change of any field shows."""
    pts = p.spark.range(12).select("id", (F.col("id") * 104729.5 - 400000).alias("x"), (F.col("id") * 7919.25 - 90000).alias("y"))
    cols = []
    for f in registry.FIELDS.values():
        wl = max(f.wavelengths.values()) if isinstance(f.wavelengths, dict) else f.wavelengths[0]
        top = max(f.octaves.values()) if isinstance(f.octaves, dict) else f.octaves
        cols.append(noise.simplex_fbm(F.col("x"), F.col("y"), top, wl, registry.seed(f.name, 1), f.gain).alias(f.name.replace(".", "_")))
    vals = pts.select("id", *cols)
    text = lambda c: F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("id", F.format_string("%.9g", F.col(c)).alias("v")))), lambda s: s["v"]))
    wide = vals.agg(*[F.md5(text(c)).alias(c) for c in vals.columns[1:]])
    return wide.select(F.explode(F.create_map(*[x for c in wide.columns for x in (F.lit(c), F.col(c))])).alias("field", "digest"))


@query("cell", f"WITH q AS (SELECT row, col, {h_sql('col', 'row', '920')} AS v FROM cell) SELECT row, col, CAST(floor(4 * v) AS BIGINT) % 4 AS pal, round(0.30 * (0.62 + 0.38 * {h_sql('col', 'row', '2')}), 6) AS a FROM q")
def field_palette(p):
    """Field strips: one of four colours and an opacity by hash."""
    c = p.cell.withColumn("v", h6(F.col("col"), F.col("row"), 920))
    return c.select("row", "col", F.pmod(F.floor(4 * F.col("v")), F.lit(4)).alias("pal"), F.round(0.30 * (0.62 + 0.38 * h6(F.col("col"), F.col("row"), 2)), 6).alias("a"))


@query("cell", f"SELECT row, col, {h_sql('col', 'row', '7')} < CASE WHEN elev % 100 / 100e0 > 0.06 THEN 0.92 * (elev % 100 / 100e0) ELSE 0.0 END AS tree, round(greatest(4.2 + 3.4 * {h_sql('col', 'row', '10')}, 0.55 * 9.5), 3) AS crown FROM cell WHERE elev > 0")
def tree_lattice(p):
    """One candidate crown for each lattice cell, kept by canopy density."""
    c = p.cell.filter("elev > 0")
    canopy = (F.col("elev") % 100) / F.lit(100.0)
    h = lambda k: h6(F.col("col"), F.col("row"), k)
    keep = F.when(canopy > 0.06, 0.92 * canopy).otherwise(0.0)
    return c.select("row", "col", (h(7) < keep).alias("tree"), F.round(F.greatest(4.2 + 3.4 * h(10), F.lit(0.55 * 9.5)), 3).alias("crown"))


@query("cell", f"WITH q AS (SELECT row, col, 2 * {h_sql('col', 'row', '503')} - 1 AS n3, 2 * {h_sql('col', 'row', '504')} - 1 AS n4, water, fa % 100 / 100e0 AS v FROM cell) SELECT row, col, CASE WHEN water IN (1, 2) THEN 0.0 ELSE round(least((greatest(0.0, 1 - abs(n3) / 0.030) * 0.8 + greatest(0.0, 1 - abs(n4) / 0.024) * 0.55) * (pow(greatest(least((v - 0.25) / 0.35, 1.0), 0.0), 2) * (3 - 2 * greatest(least((v - 0.25) / 0.35, 1.0), 0.0))), 0.75), 4) END AS a FROM q")
def stream_alpha(p):
    """Streams run along the zero lines of two rungs, where ground is a valley."""
    h = lambda k: 2 * h6(F.col("col"), F.col("row"), k) - 1
    line = lambda n, w: F.greatest(F.lit(0.0), 1 - F.abs(n) / w)
    v = (F.col("fa") % 100) / F.lit(100.0)
    a = F.least((line(h(503), 0.030) * 0.8 + line(h(504), 0.024) * 0.55) * scalar.smoothstep(v, 0.25, 0.60), F.lit(0.75))
    return p.cell.select("row", "col", F.when(scalar.water_is(F.col("water"), "OCEAN", "LAKE"), 0.0).otherwise(F.round(a, 4)).alias("a"))
