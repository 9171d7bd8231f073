"""Tiles: coarse chunks joined with a halo, one Arrow task for each tile, PNG bytes out.

Everything a tile shows is a function of world position, so neighbours agree: the grid is
padded, the window reaches eight coarse cells past the tile, and no step looks at the tile's own frame.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..functions import geo
from ..model import BIOMES, BLEND, DETAIL_HI, DETAIL_LO, DETAIL_Z, ELEVATION_STOPS, HILLSHADE_Z, MERC_R, ORIGIN, OTHER_RELIEF, rgb
from .noise import simplex_at, simplex_fbm_at

TILE, PAD, HALO, CELL = 256, 10, 8, 0.01
SIDE = 32  # cells across a chunk
LAYERS = ("elev", "water", "biome", "capacity")
DEEP = (38, 76, 128)
_FLAT = math.sin(math.radians(45))


def png(pixels: np.ndarray) -> bytes:
    """A (height, width, 3) array of bytes as an opaque RGBA PNG; the same bytes for the same pixels."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, 1 + 4 * w), np.uint8)
    rows[:, 1:] = np.concatenate([pixels, np.full((h, w, 1), 255, np.uint8)], axis=2).reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def chunk_keys(requests: DataFrame) -> DataFrame:
    """Each tile (z, x, y) asked for with the numbers of the chunks that its padded window touches."""
    r = requests.select("z", "x", "y").distinct()
    b = geo.tile_bbox(F.col("z"), F.col("x"), F.col("y"), HALO + 2, CELL)
    span = lambda lo, hi: F.sequence(F.floor(lo / (CELL * SIDE)), F.floor(hi / (CELL * SIDE)))
    return r.withColumn("chunk_row", F.explode(span(90 - b["ymax"], 90 - b["ymin"]))).withColumn("chunk_col", F.explode(span(b["xmin"] + 180, b["xmax"] + 180)))


def world_chunks(cells: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Cells (row from 90 N down, col from 180 W, and the layers) as chunks: the cells there are, with their places; all layers in one shuffle.

    With ``requests`` only cells of chunks that some tile touches are moved.
    """
    number = lambda c: F.floor(F.col(c) / F.lit(float(SIDE))).cast("long")
    at = (F.pmod(F.col("row"), F.lit(SIDE)) * SIDE + F.pmod(F.col("col"), F.lit(SIDE))).cast("int").alias("k")
    c = cells.select(number("row").alias("chunk_row"), number("col").alias("chunk_col"), F.struct(at, *[F.col(n).cast("float").alias(n) for n in LAYERS]).alias("c"))
    if requests is not None:
        c = c.join(chunk_keys(requests).select("chunk_row", "chunk_col").distinct(), ["chunk_row", "chunk_col"], "left_semi")
    return c.groupBy("chunk_row", "chunk_col").agg(F.collect_list("c").alias("cells"))


def tile_windows(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each tile with every chunk its padded window touches: an equi-join by chunk number."""
    return chunk_keys(requests).join(chunks, ["chunk_row", "chunk_col"], "left")


def _grid(z: int, x: int, y: int) -> tuple[np.ndarray, np.ndarray, float]:
    size = 2 * ORIGIN / 2**z
    px = size / TILE
    i = np.arange(-PAD, TILE + PAD) + 0.5
    # positions come from whole pixel numbers of the world, so that two tiles give a shared place the same number
    return (x * TILE + i) * px - ORIGIN, ORIGIN - (y * TILE + i) * px, px


def _sample(window: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bilinear samples of a window with gaps: missing corners drop out."""
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    total, weight = np.zeros(r.shape), np.zeros(r.shape)
    for dr in (0, 1):
        for dc in (0, 1):
            v = window[np.clip(r0 + dr, 0, window.shape[0] - 1), np.clip(c0 + dc, 0, window.shape[1] - 1)]
            w = np.where(dr, r - r0, 1 - (r - r0)) * np.where(dc, c - c0, 1 - (c - c0)) * ~np.isnan(v)
            total += np.where(w > 0, np.nan_to_num(v) * w, 0)
            weight += w
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


def _near(window: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return window[np.clip(np.rint(r).astype(int), 0, window.shape[0] - 1), np.clip(np.rint(c).astype(int), 0, window.shape[1] - 1)]


def _smooth(x: np.ndarray, e0: float, e1: float) -> np.ndarray:
    t = np.clip((x - e0) / (e1 - e0), 0, 1)
    return t * t * (3 - 2 * t)


def _light(e: np.ndarray, px: float, z: float) -> np.ndarray:
    """Horn's slopes and light from the north-west on a padded grid; flat light at its border."""
    v = np.maximum(e, 0) * z
    p = np.pad(v, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]) / (8 * px)
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]) / (8 * px)
    az = math.radians(315)
    return np.clip((_FLAT - _FLAT * (gx * math.sin(az) - gy * math.cos(az))) / np.sqrt(1 + gx * gx + gy * gy), 0, 1)


def distance(target: np.ndarray) -> np.ndarray:
    """Exact distance in pixels to the nearest true cell; infinite if there is none."""
    h, n = target.shape
    far = float(4 * (n + h))
    col = np.arange(n)
    left = np.maximum.accumulate(np.where(target, col, -far), axis=1)
    right = np.minimum.accumulate(np.where(target, col, far)[:, ::-1], axis=1)[:, ::-1]
    g = np.minimum(col - left, right - col) ** 2
    out = g.copy()
    for d in range(1, h):
        if d * d >= min(out.max(), far):  # rows farther off are no nearer to any cell
            break
        np.minimum(out[d:], g[:-d] + d * d, out=out[d:])
        np.minimum(out[:-d], g[d:] + d * d, out=out[:-d])
    return np.where(out >= far, np.inf, np.sqrt(out))


def _at(where: np.ndarray, f, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``f`` where it is asked for, 0 elsewhere."""
    out = np.zeros(x.shape)
    if where.any():
        out[where] = f(x[where], y[where])
    return out


def _fbm(name: str, x: np.ndarray, y: np.ndarray, use: str | None = None, where: np.ndarray | None = None) -> np.ndarray:
    f = registry.field(name)
    of = lambda a, b: simplex_fbm_at(a, b, registry.octaves(name, use), registry.wavelength(name, use), registry.seed(name), f.gain)
    return of(x.ravel(), y.ravel()).reshape(x.shape) if where is None else _at(where, of, x, y)


def _around(a: np.ndarray) -> np.ndarray:
    """True cells and the eight around each."""
    p = np.pad(a, 1)
    rows = p[:-2] | p[1:-1] | p[2:]
    return rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]


def _place(mx: np.ndarray, my: np.ndarray, top: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    return (90 - np.degrees(2 * np.arctan(np.exp(my / MERC_R)) - np.pi / 2)) / CELL - 0.5 - top, (np.degrees(mx / MERC_R) + 180) / CELL - 0.5 - left


def _share(window: dict[str, np.ndarray], top: int, left: int, mx: np.ndarray, my: np.ndarray) -> np.ndarray:
    """The share of water, along a warped coast."""
    wet = np.where(np.isnan(window["water"]), np.nan, np.isin(window["water"], (1, 2)).astype(float))
    wx, wy = 900 * _fbm("coast.warp.x", mx, my), 900 * _fbm("coast.warp.y", mx, my)
    return _sample(wet, *_place(mx + wx, my + wy, top, left))


def _biome(window: dict[str, np.ndarray], top: int, left: int, mx: np.ndarray, my: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The biome along warped borders; unwarped but where it is asked for."""
    bx, by = 900 * _fbm("biome.warp.x", mx, my, where=where), 900 * _fbm("biome.warp.y", mx, my, where=where)
    return _near(window["biome"], *_place(mx + bx, my + by, top, left))


def terrain(window: dict[str, np.ndarray], top: int, left: int, z: int, x: int, y: int, amplitude: float = 1.0, shown: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The tile's aligned fields: anchor and detailed elevation, water share and mask, biome, capacity.

    With ``shown``, pixels of the padded grid, what no land among these or beside one needs is left out; the colours of those shown stay the same.
    """
    mx, my, px = _grid(z, x, y)
    mx, my = np.meshgrid(mx, my)
    r, c = _place(mx, my, top, left)
    anchor = _sample(window["elev"], r, c)
    share = _share(window, top, left, mx, my)
    mask = share >= 0.5
    land = ~mask & ~np.isnan(anchor)
    near = np.ones(mask.shape, bool) if shown is None else _around(land & shown)
    biome = _biome(window, top, left, mx, my, near)
    capacity = _sample(window["capacity"], r, c)
    table = np.full(256, OTHER_RELIEF, float)
    for b in BIOMES:
        table[b[0]] = b[3]
    amp = table[np.nan_to_num(biome, nan=255).astype(int)]
    gy_, gx_ = np.gradient(np.nan_to_num(anchor), px)
    rough = 0.6 + np.clip(np.degrees(np.arctan(np.hypot(gx_, gy_))) / 30, 0, 1)
    hollow = np.clip((_sample(_box(window["elev"]), r, c) - anchor) / 28, 0, 1)
    inc, low = np.zeros(mx.shape), near & (hollow > 0) & (amp != 0)  # elsewhere nothing is cut in
    for i in range(1, (registry.DRAINAGE_ACTIVE if px <= 20 else registry.DRAINAGE_COARSE) + 1):
        f = 1 / registry.wavelength("drainage", rung=i)
        cut = lambda a, b, i=i, f=f: registry.DRAINAGE_WEIGHT[i - 1] * np.exp(-((simplex_at(a * f, b * f, registry.seed("drainage", i)) / registry.DRAINAGE_WIDTH[i - 1]) ** 2))
        inc += _at(low, cut, mx, my)
    relief = _fbm("terrain", mx, my, "relief", near & ~np.isnan(anchor) & (amp != 0))
    detail = anchor + amplitude * (relief * amp * rough * 0.35 - np.minimum(inc, 1) * hollow * amp * 0.65)
    detail = np.where(mask, np.minimum(detail, anchor), detail)
    detail = np.where(~mask & (anchor > 40) & (detail < 1), 1.0, detail)
    return {"mx": mx, "my": my, "anchor": anchor, "detail": detail, "share": share, "mask": mask, "biome": biome, "capacity": capacity, "px": px, "shown": land if shown is None else land & shown}


def biomes(window: dict[str, np.ndarray], top: int, left: int, z: int, x: int, y: int) -> dict[str, np.ndarray]:
    """Water mask and biome of a tile without its padding: all that the biome layer shows."""
    mx, my = np.meshgrid(*[v[PAD:-PAD] for v in _grid(z, x, y)[:2]])
    mask = _share(window, top, left, mx, my) >= 0.5
    return {"mask": mask, "biome": _biome(window, top, left, mx, my, ~mask)}


def _box(a: np.ndarray) -> np.ndarray:
    """Mean of each 3 x 3 neighbourhood, over the cells there are."""
    p = np.pad(a, 1, constant_values=np.nan)
    stack = np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)])
    n = (~np.isnan(stack)).sum(axis=0)
    return np.where(n > 0, np.nansum(stack, axis=0) / np.maximum(n, 1), np.nan)


def paint(t: dict[str, np.ndarray], layer: str = "elevation") -> np.ndarray:
    """(height, width, 3) colours of a padded grid."""
    biome = np.nan_to_num(t["biome"], nan=255).astype(int)
    if layer == "biome":
        table = np.full((256, 3), 128.0)
        for b in BIOMES:
            table[b[0]] = rgb(b[2])
        return table[np.where(t["mask"], 0, biome)]
    if layer != "elevation":
        raise ValueError(f"no layer {layer!r}")
    hs = np.clip(_light(t["anchor"], t["px"], HILLSHADE_Z) * np.clip(_light(t["detail"], t["px"], DETAIL_Z) / _FLAT, DETAIL_LO, DETAIL_HI), 0, 1)
    e = np.where(np.isnan(t["detail"]), ELEVATION_STOPS[0][0], t["detail"])
    e = np.where(~t["mask"] & (e < 1), 1.0, e)
    stops = np.array([s[0] for s in ELEVATION_STOPS], float)
    out = np.stack([np.interp(e, stops, [rgb(s[1])[i] for s in ELEVATION_STOPS]) for i in range(3)], axis=2) * (BLEND + (1 - BLEND) * np.nan_to_num(hs, nan=1.0))[:, :, None]
    out = _plants(out, t, biome)
    deep = _smooth(np.minimum(distance(~t["mask"]) * t["px"], 1e6), 0, 2500)
    shallow = np.array(rgb("#7caacd"), float)
    water = shallow + (np.array(DEEP, float) - shallow) * deep[:, :, None]
    out = np.where(t["mask"][:, :, None], water, out)
    return np.where(np.isnan(t["anchor"])[:, :, None], np.array(DEEP, float), out)


def _plants(out: np.ndarray, t: dict[str, np.ndarray], biome: np.ndarray) -> np.ndarray:
    """Canopy, meadow, sand and snow over the ground."""
    cover, canopy, meadow = np.zeros(256), np.zeros((256, 3)), np.zeros((256, 3))
    for b in BIOMES:
        cover[b[0]], canopy[b[0]], meadow[b[0]] = b[4], rgb(b[5]), rgb(b[6])
    e = np.nan_to_num(t["detail"], nan=-1e4)
    cap = np.sqrt(np.clip(np.nan_to_num(t["capacity"], nan=200.0) / 200, 0, 1))
    bare = cover[biome] * cap * (1 - _smooth(e, 1800, 2800))
    green = t["shown"] & (bare > 0)
    regional = _fbm("veg.regional", t["mx"], t["my"], where=green)
    open_ = _smooth(np.clip(0.5 + 0.5 * _fbm("veg.openness", t["mx"], t["my"], where=green) + 0.28 * regional, 0, 1), 0.36, 0.64)
    sand = _smooth(np.nan_to_num(t["share"]), 0.40, 0.47) * (1 - _smooth(e, 6, 14))
    veg = np.minimum(bare * (1 + 0.12 * regional), 1) * (1 - 0.9 * sand)
    lat = 2 * np.arctan(np.exp(t["my"] / MERC_R)) - np.pi / 2
    line = 1100 + 3300 * np.maximum(np.cos(lat), 0) ** 2
    rim = t["shown"] & (e - line > -300 - 540) & (e - line < 200 + 540)  # simplex noise stays within 3, so the rest is bare or white
    snow = np.maximum(_smooth(e + 180 * _fbm("veg.mottle2", t["mx"], t["my"], where=rim) - line, -300, 200), np.where(biome == 1, 0.85, 0))
    lum = np.clip((out * (0.3, 0.59, 0.11)).sum(axis=2) / 160, 0.45, 1.2)[:, :, None]
    a, m = (veg * open_ * (1 - _smooth(snow, 0.15, 0.55)))[:, :, None], (veg * (1 - open_) * 0.7 * (1 - _smooth(snow, 0.25, 0.7)))[:, :, None]
    out = out * (1 - a - m) + canopy[biome] * lum * a + meadow[biome] * lum * m
    for share, color in ((0.85 * sand, (213, 196, 158)), (snow, (237, 241, 247))):
        out = out * (1 - share[:, :, None]) + np.array(color, float) * lum * share[:, :, None]
    return np.clip(out, 0, 255)


def _window(cells: pa.ChunkedArray, rows: np.ndarray, cols: np.ndarray) -> tuple[dict[str, np.ndarray], int, int]:
    """Each layer of a tile's chunks as one array, with gaps where there is no cell."""
    top, left = int(rows.min()), int(cols.min())
    shape = ((int(rows.max()) - top + 1) * SIDE, (int(cols.max()) - left + 1) * SIDE)
    lists = cells.combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    place = lambda n: flat.field(n).to_numpy(zero_copy_only=False)
    k = place("k").astype(np.int64)
    r, c = np.repeat(rows - top, sizes) * SIDE + k // SIDE, np.repeat(cols - left, sizes) * SIDE + k % SIDE
    out = {n: np.full(shape, np.nan) for n in LAYERS}
    for n in LAYERS:
        out[n][r, c] = place(n)
    return out, top * SIDE, left * SIDE


def tile_pixels(window: dict[str, np.ndarray], top: int, left: int, z: int, x: int, y: int, layer: str) -> np.ndarray:
    """(256, 256, 3) colours of a tile: those of its padded grid without the padding, by as little noise as gives them."""
    if layer == "biome":
        return paint(biomes(window, top, left, z, x, y), layer)
    shown = np.zeros((TILE + 2 * PAD, TILE + 2 * PAD), bool)
    shown[PAD:-PAD, PAD:-PAD] = True
    return paint(terrain(window, top, left, z, x, y, shown=shown), layer)[PAD:-PAD, PAD:-PAD]


def _tile(layer: str):
    def run(key, table):
        z, x, y = (k.as_py() for k in key)
        window, top, left = _window(table.column("cells"), table.column("chunk_row").to_numpy(), table.column("chunk_col").to_numpy())
        colours = tile_pixels(window, top, left, z, x, y, layer)
        return pa.table({"z": pa.array([z], pa.int32()), "x": pa.array([x]), "y": pa.array([y]), "png": pa.array([png(np.rint(colours).astype(np.uint8))], pa.binary())})

    return run


def render(requests: DataFrame, chunks: DataFrame, layer: str = "elevation") -> DataFrame:
    """z, x, y and PNG bytes of each tile asked for.  A task holds one tile's window, whose size the zoom bounds."""
    w = tile_windows(requests, chunks).withColumns({"z": F.col("z").cast("int"), "x": F.col("x").cast("long"), "y": F.col("y").cast("long")})
    # windows are small and tiles dear, so the number of partitions is set and not merged by size
    w = w.repartition(int(w.sparkSession.conf.get("spark.sql.shuffle.partitions")), "z", "x", "y")
    return w.groupBy("z", "x", "y").applyInArrow(_tile(layer), "z int, x long, y long, png binary")
