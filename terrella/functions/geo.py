"""Coordinates as Column expressions: web-mercator tiles, projections and great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MERC_R, ORIGIN

EARTH_KM = 6371.0
MAX_LAT = 85.05


def tiles_across(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def flip_row(y: Column, z: Column) -> Column:
    """A row counted from the south as one counted from the north, and back."""
    return tiles_across(z).cast("long") - 1 - y


def tile_extent(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """Bounds of a tile in metres; rows count from the north."""
    size = F.lit(2 * ORIGIN) / tiles_across(z)
    return {"xmin": x * size - ORIGIN, "xmax": (x + 1) * size - ORIGIN, "ymin": F.lit(ORIGIN) - (y + 1) * size, "ymax": F.lit(ORIGIN) - y * size}


def merc_lon(mx: Column) -> Column:
    return F.degrees(mx / MERC_R)


def merc_lat(my: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(my / MERC_R)) - math.pi / 2)


def lon_merc(lon: Column) -> Column:
    return F.radians(lon) * MERC_R


def lat_merc(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERC_R


def inflation(lat: Column) -> Column:
    """How many projected metres a metre on the ground takes at a latitude."""
    return 1 / F.cos(F.radians(lat))


def tile_bbox(z: Column, x: Column, y: Column, cells: int = 8, cell: float = 0.01) -> dict[str, Column]:
    """A tile's bounds in degrees, padded by coarse cells, so that windows see past its edges."""
    e, pad = tile_extent(z, x, y), cells * cell
    return {"xmin": merc_lon(e["xmin"]) - pad, "xmax": merc_lon(e["xmax"]) + pad, "ymin": merc_lat(e["ymin"]) - pad, "ymax": merc_lat(e["ymax"]) + pad}


def lonlat_tile(lon: Column, lat: Column, z: Column) -> dict[str, Column]:
    """The tile that holds a point; rows count from the north."""
    n = tiles_across(z)
    r = F.radians(F.greatest(F.least(lat, F.lit(MAX_LAT)), F.lit(-MAX_LAT)))
    return {"x": F.floor((lon + 180) / 360 * n).cast("long"), "y": F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n).cast("long")}


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
