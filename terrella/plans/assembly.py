"""Whole tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import render
from .registry import query


def world(p):
    """The cell grid laid down at the equator and the zero meridian, as the renderer's layers."""
    return p.cell.select((9000 + F.col("row")).alias("row"), (18000 + F.col("col")).alias("col"), "elev", "water", "biome", (F.col("fa") % 250).alias("capacity"))


def tiles(p, zoom: int = 12):
    """Every tile that a cell of the grid lies in or reaches into; cells past the projection's last latitude have none."""
    inset = 1e-9  # a cell that ends on a tile's edge does not reach into the next
    lat = lambda r: 90 - (r + 9000) * render.CELL
    z = F.lit(zoom)
    c = p.cell.select("row", "col").filter((lat(F.col("row") + 1) < geo.MAX_LAT) & (lat(F.col("row")) > -geo.MAX_LAT))
    first = geo.lonlat_tile(F.col("col") * render.CELL + inset, lat(F.col("row")) - inset, z)
    last = geo.lonlat_tile((F.col("col") + 1) * render.CELL - inset, lat(F.col("row") + 1) + inset, z)
    across = c.select(F.sequence(first["y"], last["y"]).alias("ys"), F.explode(F.sequence(first["x"], last["x"])).alias("x"))
    return across.select(z.alias("z"), "x", F.explode("ys").alias("y")).distinct()


@query()
def render_tiles(p):
    """All tiles of the elevation layer at zoom 12, as digests of their bytes."""
    wanted = tiles(p)
    t = render.render(wanted, render.world_chunks(world(p), wanted))
    return t.select("z", "x", "y", F.length("png").alias("n_bytes"), F.md5("png").alias("digest"))


@query()
def render_biome_tiles(p):
    """All tiles of the biome layer at zoom 12, as digests of their bytes."""
    wanted = tiles(p)
    t = render.render(wanted, render.world_chunks(world(p), wanted), "biome")
    return t.select("z", "x", "y", F.length("png").alias("n_bytes"), F.md5("png").alias("digest"))


@query("cell", "SELECT row, col, CAST(elev AS FLOAT) AS value FROM cell")
def chunk_round_trip(p):
    """Cells to dense chunks and back."""
    from ..operators import raster

    return raster.from_chunks(raster.to_chunks(p.cell, "elev", render.SIDE), render.SIDE)
