"""Small hand-checked cases, and the contracts of noise and tiles."""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella import registry
from terrella.functions import geo, scalar
from terrella.operators import joins, network, noise, overrides, places, polyline, provenance, publish, raster, render, shaping
from terrella.sources import geojson, rasters, sinks, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_downstream_takes_the_first_of_equal_neighbours(spark):
    grid = [[1, 9, 1], [9, 5, 1], [1, 1, 1]]
    cells = spark.createDataFrame([(r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)], "row int, col int, fa int")
    got = {(r.row, r.col): (r.to_row, r.to_col) for r in network.downstream(cells).collect()}
    assert got[1, 1] == (0, 1)  # before (1, 0) in the fixed order
    assert (0, 1) not in got and (1, 0) not in got  # nothing is strictly greater
    assert got[2, 2] == (1, 1)
    assert all(k[0] < 2 or k in {(2, 0), (2, 1), (2, 2)} for k in got)


def ferry(spark, flags, step=1000.0):
    line = spark.createDataFrame([(1, i + 1, i * step, 0.0, f == "~") for i, f in enumerate(flags)], "line int, seq int, x double, y double, wet boolean")
    return polyline.ferry_pieces(polyline.arclength(line))


def test_ferries_drop_grazes_merge_near_crossings_and_keep_shores(spark):
    assert rows(ferry(spark, "..~~.."), "k", "ferry", "i0", "i1") == [(1, False, 1, 6)]  # 1000 m is a graze
    assert rows(ferry(spark, "..~~~.."), "k", "ferry", "i0", "i1") == [(1, False, 1, 2), (2, True, 2, 6), (3, False, 6, 7)]
    # two crossings 2 * 250 m apart are one
    assert rows(ferry(spark, "." + "~" * 8 + "." + "~" * 8 + ".", 250.0), "k", "ferry", "i0", "i1") == [(1, True, 1, 19)]
    assert rows(ferry(spark, "." + "~" * 8 + "..." + "~" * 8 + ".", 250.0), "ferry", "i0", "i1") == [(False, 10, 12), (True, 1, 10), (True, 12, 21)]
    assert rows(ferry(spark, "~~~~"), "k", "ferry", "i0", "i1") == [(1, True, 1, 4)]


def test_overrides_resolve_by_id_then_place_then_not_at_all(spark):
    canon = spark.createDataFrame([(1, 10.0, 10.0), (2, 20.0, 10.0), (3, 179.95, 0.0), (4, 50.0, 83.0)], "id long, lon double, lat double")
    asked = [
        (0, 1, 10.1, 10.0), (1, 1, 20.1, 10.0), (2, 99, 10.5, 10.0), (3, 99, 40.0, 40.0), (4, 2, None, None), (5, 99, None, None),
        (6, 99, -179.95, 0.0), (7, 99, 54.0, 83.0),
    ]
    o = spark.createDataFrame(asked, "key long, settlement_id long, lon double, lat double")
    got = {r.key: (r.match_id, r.how, r.warn) for r in overrides.resolve(o, canon).collect()}
    assert got == {
        0: (1, "id", False), 1: (2, "coords", False), 2: (1, "coords", True), 3: (None, "none", False), 4: (2, "id", False), 5: (None, "none", False),
        6: (3, "coords", False), 7: (4, "coords", True),
    }


def test_near_join_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    pts = lambda n: [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))), strict=True))]
    a = spark.createDataFrame(pts(150), "i int, lon double, lat double")
    b = spark.createDataFrame(pts(150), "j int, lon2 double, lat2 double")
    got = rows(joins.near_join(a, b, 700.0, ("lon", "lat"), ("lon2", "lat2")), "i", "j")
    want = rows(a.crossJoin(b).filter(geo.haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) <= 700.0), "i", "j")
    assert got == want and got


def test_box_join_gives_each_pair_once_and_plans_no_nested_loop(spark):
    rng = np.random.default_rng(3)
    box = lambda n: [(i, *map(float, (x, x + w, y, y + h))) for i, (x, w, y, h) in enumerate(rng.uniform((-50, 0, -50, 0), (50, 30, 50, 30), (n, 4)))]
    a = spark.createDataFrame(box(60), "i int, a0 double, a1 double, b0 double, b1 double")
    b = spark.createDataFrame(box(60), "j int, c0 double, c1 double, d0 double, d1 double")
    j = joins.box_join(a, b, 10.0, ("a0", "a1", "b0", "b1"), ("c0", "c1", "d0", "d1"))
    assert rows(j, "i", "j") == rows(a.crossJoin(b).filter("a0 <= c1 and a1 >= c0 and b0 <= d1 and b1 >= d0"), "i", "j")
    assert "NestedLoop" not in j._jdf.queryExecution().executedPlan().toString()


def test_ramp_clamps_and_interpolates(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (10.0,), (99.0,), (None,)], "x double")
    got = [r[0] for r in df.select(raster.ramp(F.col("x"), [(0, 10), (10, 20), (20, 50)])).collect()]
    assert got == [10.0, 10.0, 15.0, 20.0, 50.0, None]


def test_tiers_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(p,) for p in (0, 199, 200, 1999, 2000, 4999, 5000, 9999, 10000)] + [(None,)], "pop long")
    assert [r[0] for r in df.select(scalar.settlement_tier(F.col("pop"))).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, None]
    df = spark.createDataFrame([(f,) for f in (24999, 25000, 49999, 50000, 499999, 500000)], "f long")
    assert [r[0] for r in df.select(scalar.flow_tier(F.col("f"))).collect()] == ["dropped", "small", "small", "med", "med", "big"]


def test_null_passes_through_clamps(spark):
    df = spark.createDataFrame([(None, 1.0), (5.0, 1.0)], "a double, b double")
    assert rows(df.select(scalar.na_least(F.col("a"), F.col("b")).alias("x")).filter("x is not null"), "x") == [(1.0,)]
    assert df.select(scalar.smoothstep(F.col("a"), 0, 10)).first()[0] is None


def test_centroids_and_insides(spark):
    ring = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 2), (0, 2)])], "line int, seq int, x double, y double")
    assert rows(polyline.centroid(ring), "area", "x", "y") == [(8.0, 2.0, 1.0)]
    pts = spark.createDataFrame([(1, 1.0, 1.0), (1, 5.0, 1.0)], "line int, px double, py double")
    assert rows(polyline.inside(pts, ring), "px", "inside") == [(1.0, True), (5.0, False)]


def test_provenance_explains_itself(spark, tmp_path):
    assert provenance.why({"a": "1", "b": "2"}, {"b": "3", "c": "4"}) == "moved: b; added: c; gone: a"
    assert provenance.why({"a": "1"}, {"a": "1"}) == "" and provenance.why(None, {}) == "no stamp"
    assert provenance.code_digest("x = 1  # note\n") == provenance.code_digest("x   =  1")
    assert provenance.stamp({"a": "1", "b": "2"}) == provenance.stamp({"b": "2", "a": "1"})
    t, built = provenance.DerivedTable(spark, str(tmp_path / "t")), []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert [t.get({"src": v}, build).count() for v in ("1", "1", "2")] == [1, 1, 2] and len(built) == 2
    for f in (tmp_path / "t.stamp").glob("part-*"):
        f.write_text("no json")
    (tmp_path / "t.stamp").joinpath("._SUCCESS.crc").unlink(missing_ok=True)
    for f in (tmp_path / "t.stamp").glob(".*.crc"):
        f.unlink()
    assert t.get({"src": "2"}, build).count() == 3


def test_pages_lose_blocks_and_features_their_hidden(spark):
    df = spark.createDataFrame([("<a><script>x\ny</script>b</a>",)], "h string")
    assert df.select(publish.without_blocks(F.col("h"), "script")).first()[0] == "<a>b</a>"
    df = spark.createDataFrame([([(1, True), (2, None), (3, False)],)], "f array<struct<id: int, hidden: boolean>>")
    assert [x.id for x in df.select(publish.strip_hidden(F.col("f"))).first()[0]] == [2, 3]


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"feature_id": 4, "name": "Wood", "feature_type": "forest"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"feature_id": 8, "hidden": True}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 3]]}},
        {"type": "Feature", "properties": {"feature_id": 9}, "geometry": {"type": "Point", "coordinates": [5, 6]}},
    ]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    read = geojson.read_features(spark, str(tmp_path / "f.geojson")).orderBy("feature_id")
    got = read.collect()
    assert [(r.feature_id, r.geom_type, len(r.points), r.hidden) for r in got] == [(4, "POLYGON", 4, False), (8, "LINESTRING", 2, True), (9, "POINT", 1, False)]
    back = geojson.collection_rows(read, ["feature_id"]).collect()
    assert json.loads(back[1].value)["geometry"] == {"type": "LineString", "coordinates": [[0.0, 0.0], [2.0, 3.0]]}


def test_overrides_csv_reads_blanks_as_none(spark, tmp_path):
    head = "settlement_id,name,inkarnate,notes,population,lon,lat,phonology_seed\n"
    (tmp_path / "o.csv").write_text(head + '817,"Paingo","","",702,22.7,12.3,1049\n702,"  ",x.jpg,,NA,23.5,,1049\n')
    got = {r.settlement_id: r for r in tables.overrides_csv(spark, str(tmp_path / "o.csv")).collect()}
    assert got[817].population == 702.0 and got[817].inkarnate is None
    assert got[702].name is None and got[702].population is None and got[702].lat is None
    assert tables.relocations(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        tables.backfill(spark.range(1), {"x": "int"}, required=["x"])


def test_color_table(spark):
    stops = spark.createDataFrame([(10.0, "#010203"), (-5.0, "#ffffff00")], "stop double, color string")
    assert [r.value for r in sinks.color_table(stops).collect()] == ["nv 0 0 0 0", "-5.0 255 255 255 0", "10.0 1 2 3 255"]


def test_chunks_are_read_by_window(spark, tmp_path):
    cells = spark.range(40 * 40).selectExpr("id div 40 as row", "id % 40 as col", "cast(id as double) as v")
    rasters.write_chunks(raster.to_chunks(cells, "v", 8), str(tmp_path / "c"), "elev")
    got = rasters.read_window(spark, str(tmp_path / "c"), ["elev", "biome"], (3, 12), (30, 45), 8)
    assert rows(got, "row", "col", "value") == sorted((r, c, float(r * 40 + c)) for r in range(3, 13) for c in range(30, 40))


def test_registry_is_sound_and_accessors_are_strict():
    assert registry.audit() == [] and len(registry.FIELDS) == 31 and len(registry.used_offsets()) == 59
    assert registry.seed("drainage", 2) == 1789 + 502 and registry.octaves("terrain", "pull") == 4
    for bad in (lambda: registry.field("nope"), lambda: registry.seed("drainage"), lambda: registry.wavelength("terrain"), lambda: registry.seed("drainage", 99)):
        with pytest.raises((KeyError, ValueError, IndexError)):
            bad()
    assert all(a > b for a, b in zip(registry.field("drainage").wavelengths, registry.field("drainage").wavelengths[1:], strict=False))
    assert not set(registry.free_offsets()) & set(registry.used_offsets())


def test_noise_is_a_pure_function_of_place_with_stable_octaves():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(-1e6, 1e6, (2, 500))
    n = noise.simplex_fbm_at(x, y, 4, 900.0, 7)
    o = rng.permutation(500)
    assert (noise.simplex_fbm_at(x[o], y[o], 4, 900.0, 7) == n[o]).all() and np.abs(n).max() <= 1
    assert np.abs(noise.simplex_at(x + 1e-4, y, 7) - noise.simplex_at(x, y, 7)).max() < 1e-2  # continuous
    assert np.abs(n * 1.875 - noise.simplex_fbm_at(x, y, 3, 900.0, 7) * 1.75).max() <= 0.125 + 1e-9
    assert len(np.unique(noise.worley_at(x / 100, y / 100, 3))) > 300


@pytest.fixture(scope="module")
def world():
    r, c = np.mgrid[0:96, 0:96]
    return {"elev": 300 * np.sin(r / 9) + 250 * np.cos(c / 7), "water": (300 * np.sin(r / 9) + 250 * np.cos(c / 7) < 0).astype(float), "biome": ((r // 9 + c // 9) % 13).astype(float), "capacity": np.full(r.shape, 150.0)}


def test_neighbouring_tiles_agree_on_their_common_edge(world):
    a, b = (render.terrain(world, 8960, 17990, 12, x, 2049) for x in (2049, 2050))
    for k in ("anchor", "detail", "share", "biome"):
        assert np.allclose(a[k][:, -2 * render.PAD :], b[k][:, : 2 * render.PAD], equal_nan=True)
    pa, pb = render.paint(a), render.paint(b)
    step = np.abs(pa[:, -render.PAD - 1] - pb[:, render.PAD]).mean()
    inner = np.abs(np.diff(pa[:, render.PAD : -render.PAD], axis=1)).mean()
    assert step / max(1.0, inner) < 3


def test_relief_never_sinks_land_nor_raises_water(world):
    t = render.terrain(world, 8960, 17990, 12, 2049, 2049, amplitude=6.0)
    assert (t["detail"][t["mask"]] <= t["anchor"][t["mask"]] + 1e-9).all()
    inland = ~t["mask"] & (t["anchor"] > 40)
    assert (t["detail"][inland] >= 1).all()
    assert render.paint(t, "biome").shape == (276, 276, 3)


def test_png_bytes_are_valid_and_repeatable():
    pixels = (np.arange(256 * 256 * 3) % 251).astype(np.uint8).reshape(256, 256, 3)
    data = render.png(pixels)
    assert data == render.png(pixels) and data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        body += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(256, 1025)[:, 1:].reshape(256, 256, 4)
    assert (raw[:, :, :3] == pixels).all() and (raw[:, :, 3] == 255).all()


def test_distance_is_exact():
    rng = np.random.default_rng(1)
    t = rng.random((20, 30)) < 0.05
    want = np.array([[min(math.hypot(r - a, c - b) for a, b in zip(*np.nonzero(t), strict=True)) for c in range(30)] for r in range(20)])
    assert np.allclose(render.distance(t), want)
    assert np.isinf(render.distance(np.zeros((3, 3), bool))).all()


def test_requests_are_rendered_once(spark, sf, tmp_path):
    from terrella.plans import assembly
    from terrella.plans.proxies import Proxies
    from terrella.streaming import requests

    chunks = render.world_chunks(assembly.world(Proxies(spark, sf)))
    ask = lambda xs: spark.createDataFrame([(12, x, 2048) for x in xs], "z int, x long, y long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = str(tmp_path / "tiles")
    for xs in ([2048], [2048, 2049]):
        ask(xs)
        requests.serve(spark, str(tmp_path / "in"), chunks, store, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(store), "x", "y") == [(2048, 2048), (2049, 2048)]


def test_every_cell_of_the_grid_is_rendered(spark, sf):
    from terrella.plans import assembly, registry
    from terrella.plans.proxies import Proxies

    want = set()
    for row, col in rows(Proxies(spark, sf).cell, "row", "col"):
        for r in (row + 0.0001, row + 0.5, row + 0.9999):  # rows count down from the equator, columns up from the meridian
            for c in (col + 0.0001, col + 0.5, col + 0.9999):
                lat = math.radians(-0.01 * r)
                want.add((int((0.01 * c + 180) / 360 * 4096), int((1 - math.log(math.tan(lat) + 1 / math.cos(lat)) / math.pi) / 2 * 4096)))
    assert set(rows(assembly.tiles(Proxies(spark, sf)), "x", "y")) == want
    for name in ("render_tiles", "render_biome_tiles"):
        got = rows(registry.QUERIES[name](spark, sf), "x", "y")
        assert len(got) == len(want) and set(got) == want


def test_lowest_free_numbers(spark):
    from terrella.operators.overrides import free_numbers

    rows = spark.createDataFrame([(i,) for i in [1, 2, 4, 5, 6, 9, 1000, -3, None, 4]], "n long")
    assert [r.free for r in free_numbers(rows, "n", 5).collect()] == [3, 7, 8, 10, 11]
    assert [r.free for r in free_numbers(rows.limit(0), "n", 3).collect()] == [1, 2, 3]


def test_ranks_equal_a_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from terrella.operators.ranks import ranked

    rng = random.Random(4)
    rows = [(i, rng.choice("abc") if i % 9 else None, rng.choice([None, 0, -5, 7, 7, 100, 10**6, 3 * 10**9]) if i % 3 else rng.randint(-50, 5000)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    want = {r.id: (r.n, r.c) for r in df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "id")).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("c")).collect()}
    assert {r.id: (r.n, r.c) for r in ranked(df, "g", "v", "id", "n", total="c").collect()} == want


def test_nearest_in_rings_equals_one_search(spark):
    import random

    from terrella.operators import joins

    rng = random.Random(7)
    point = lambda: (rng.uniform(-180, 180), rng.uniform(-80, 80))
    a = spark.createDataFrame([(i, *point()) for i in range(60)], "k long, x double, y double")
    b = spark.createDataFrame([(i, *point()) for i in range(200)], "o long, x2 double, y2 double")
    from pyspark.sql import functions as F

    whole = joins.first_per(joins.near_join(a, b, 3000.0, ("x", "y"), ("x2", "y2")).filter("km > 100"), ["k"], [F.col("km"), F.col("o")])
    rings = joins.nearest_in_rings(a, b, "k", "o", (200.0, 900.0, 3000.0), ("x", "y"), ("x2", "y2"), least=100.0)
    want = {(r.k, r.o) for r in whole.collect()}
    assert want and {(r.k, r.o) for r in rings.collect()} == want


def test_chains_of_any_length_equal_plain_ones(spark):
    from terrella.operators import network

    edges = [(i, i, i + 1) for i in range(100)] + [(200 + i, 500, 600 + i) for i in range(3)] + [(300, 700, 701), (301, 702, 701), (302, 702, 700)] + [(400, 800, 800)]
    got = {r.edge: r.chain for r in network.chains(spark.createDataFrame(edges, "edge long, src long, dst long")).collect()}
    assert {got[i] for i in range(100)} == {0} and [got[200 + i] for i in range(3)] == [200, 201, 202]
    assert {got[i] for i in (300, 301, 302)} == {300} and got[400] == 400


LINES = [(1, i, 900.0 * i, 300.0 * math.sin(i)) for i in range(12)] + [(2, 0, 0.0, 5000.0), (2, 1, 50.0, 5000.0)] + [(3, i, 70.0 * i, 9000.0) for i in range(40)]


def field(name, use=None, rung=None):
    return lambda x, y: noise.fbm(x, y, registry.octaves(name, use), registry.wavelength(name, use, rung), registry.seed(name, rung))


def shape_of(df):
    lines = {}
    for r in sorted(df.collect(), key=lambda r: (r.line, r.seq)):
        lines.setdefault(r.line, []).append((r.x, r.y))
    return {k: np.array(v) for k, v in lines.items()}


def test_roads_bend_within_bounds_and_keep_their_ends(spark):
    raw = spark.createDataFrame(LINES, "line long, seq long, x double, y double")
    before = shape_of(shaping.densified(raw, shaping.ROAD_STEP))
    after = shape_of(shaping.roads(raw, field("terrain", "pull"), field("terrain", "wiggle")))
    for k, old in before.items():
        move = np.hypot(*(after[k] - old).T)
        assert np.hypot(*np.diff(old, axis=0).T).max() <= shaping.ROAD_STEP + 1e-6
        assert move[0] < 1e-9 and move[-1] < 1e-9 and move.max() <= shaping.ROAD_BOUND + shaping.ROAD_WIGGLE
    assert np.hypot(*(after[1] - before[1]).T).max() > 5 and np.allclose(after[2], before[2])  # two vertices: a road stays


def test_rivers_go_downhill_across_their_line(spark):
    """On a plane that falls to one side and without noise, a river steps to that side as far as its slope says, and no farther than the bound."""
    raw = spark.createDataFrame([r for r in LINES if r[0] == 3], "line long, seq long, x double, y double")
    flat = lambda x, y: F.lit(0.0)
    spot = lambda x, y: (F.floor(y / 100), F.floor(x / 100))

    def shaped(drop):
        cells = spark.createDataFrame([(r, c, -drop * r) for r in range(80, 100) for c in range(-5, 40)], "row long, col long, elev long")
        return shape_of(shaping.rivers(raw, [(10.0, flat)], flat, cells, spot))[3]

    rise = 4 * (91 - 88) / 240  # of the cells at 120 m on both sides
    gentle, steep = shaped(4), shaped(40)
    assert np.allclose(gentle[[0, -1], 1], 9000) and np.allclose(gentle[20], (1400, 9000 + shaping.RIVER_ANCHOR * rise))
    assert np.allclose(steep[20], (1400, 9000 + shaping.RIVER_BOUND))
    unknown = shape_of(shaping.rivers(raw, [(10.0, flat)], flat, spark.createDataFrame([], "row long, col long, elev long"), spot))[3]
    assert np.allclose(unknown[:, 1], 9000)


def test_ferries_leave_the_shore_and_rest_at_sea(spark):
    raw = spark.createDataFrame([(1, i, 1000.0 * i + 50, 50.0) for i in range(9)] + [(2, i, 1000.0 * i + 50, 5050.0) for i in range(9)], "line long, seq long, x double, y double")
    sea = spark.createDataFrame([(r, c, True) for r in range(3, 90) for c in range(-20, 110)], "row long, col long, wet boolean")
    got = shape_of(shaping.ferries(raw, sea, lambda x, y: (F.floor(y / 100), F.floor(x / 100))))
    assert tuple(got[1][0]) == (50, 50) and tuple(got[1][-1]) == (8050, 50)  # ports hold
    assert (got[1][1:-1, 1] > 300).all()  # on water, though east comes before north once both are all water
    assert (np.hypot(*(got[1] - [(1000 * i + 50, 50) for i in range(9)]).T) <= 5 * 260 + 1e-6).all()
    assert np.allclose(got[2][:, 1], 5050)


def test_overrides_by_part(spark):
    canon = spark.createDataFrame([(1, "a", 5, None, 0.0, 0.0), (2, "b", 6, "b.jpg", 1.0, 1.0)], "id long, name string, pop long, inkarnate string, lon double, lat double")
    found = spark.createDataFrame([(1, 1, "x", None, 7.0), (2, 1, None, "x.jpg", None), (3, 1, "y", None, None), (4, None, "z", "z", 1.0)], "key long, match_id long, name string, inkarnate string, population double")
    moved = spark.createDataFrame([(1, 2, 3.0, 4.0), (2, None, 9.0, 9.0)], "key long, match_id long, new_lon double, new_lat double")
    assert rows(overrides.apply(canon, found, moved), *canon.columns) == [(1, "y", 7, "x.jpg", 0.0, 0.0), (2, "b", 6, "b.jpg", 3.0, 4.0)]
    assert rows(overrides.applied(found, moved), "names", "links", "populations", "moves") == [(2, 1, 1, 1)]
    changes = spark.createDataFrame([(1, None), (3, "c")], "id long, name string")
    assert rows(overrides.upsert(canon.select("id", "name"), changes, "id"), "id", "name") == [(2, "b"), (3, "c")]


def test_render_stamps_decide_what_is_stale(spark, tmp_path):
    tiles = spark.createDataFrame([("old", 10.0), ("new", 30.0), ("unknown", None)], "tile string, made double")
    names = lambda b: [r.tile for r in provenance.stale(tiles, b).collect()]
    s = provenance.RenderStamp(spark, str(tmp_path / "render.stamp"))
    assert s.sync({"code": "1"}, 20.0) == (provenance.ADOPTED, "adopted") and names(provenance.ADOPTED) == []
    assert s.sync({"code": "1"}, 25.0) == (provenance.ADOPTED, "")
    assert s.sync({"code": "2"}, 20.0) == (20.0, "moved: code") and names(20.0) == ["old"]
    assert s.sync({"code": "2"}, 99.0) == (20.0, "")  # kept, not renewed
    assert s.invalidate({"code": "3"}, 40.0) == 40.0 and s.read()["components"] == {"code": "2"} and names(40.0) == ["old", "new"]
    assert s.adopt({"code": "3"}) == provenance.ADOPTED and s.sync({"code": "3"}, 50.0) == (provenance.ADOPTED, "")
    spark.createDataFrame([("no json",)], "value string").write.mode("overwrite").text(s.path)
    assert s.sync({"code": "3"}, 60.0) == (60.0, "unreadable") and names(None) == []
    first = provenance.RenderStamp(spark, str(tmp_path / "other.stamp"))
    assert first.sync({"code": "1"}, 70.0, adopt=False) == (70.0, "condemned")


def test_bridges_and_frames(spark):
    near = spark.createDataFrame([(0, 0, 3, 0.5), (0, 0, 4, 1.2), (0, 1, 3, 1.1), (0, 1, 4, 0.1), (0, 2, 4, 0.0)], "row long, col long, line long, d double")
    assert rows(places.bridges(near, F.col("line") % 3 == 0, 1.5, 1.0), "row", "col") == [(0, 0)]
    tiles = spark.createDataFrame([(10, 512, 511), (10, 512, 511), (10, 0, 0)], "z int, x long, y long")
    points = spark.createDataFrame([(0.1, 0.1, "b"), (-0.01, -0.01, "a"), (-0.03, 0.1, "c")], "lon double, lat double, tag string")
    assert rows(places.in_frame(tiles, points, ["a", "b", "c"]), "z", "x", "y", "tags") == [(10, 512, 511, ["a", "b"])]
