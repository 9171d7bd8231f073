"""Domain tables.  The values are fixed: the data they describe was made with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The world's seed, zoom limits and mercator radius.
WORLD_SEED = 1789
NATIVE_MAX_Z, PROCEDURAL_MAX_Z = 8, 14
MERC_R = 6378137.0
ORIGIN = 20037508.342789244

# Water classes, their precedence and flow thresholds.
WATER_CLASS = {"LAND": 0, "OCEAN": 1, "LAKE": 2, "RIVER_NAV": 3, "STREAM_MINOR": 4}
WATER_PRECEDENCE = ["OCEAN", "LAKE", "RIVER_NAV", "STREAM_MINOR", "LAND"]
RIVER_FA, NAV_FA, LAKE_MIN_CELLS, DEEP_SEED = 1000, 10000, 1000, -200
MAP_RIVER_MIN_FA = 25000
RIVER_TIERS = [(500000, "big"), (50000, "med"), (25000, "small")]

# River drawing by tier (width px, floodplain half-width, valley wall width, carve depth).
RIVER_TIER = {"big": (3.0, 380.0, 700.0, 55.0), "med": (2.0, 140.0, 300.0, 26.0), "small": (1.3, 45.0, 120.0, 12.0)}

# Lower bounds of settlement tiers 2 to 5.
SETTLEMENT_BREAKS = [200, 2000, 5000, 10000]

# Biome codes 0 to 12 with name, colour, relief in metres, plant cover, canopy and meadow colours.
BIOMES = [
    (0, "Ocean", "#08519c", 0, 0.00, "#1f4a25", "#1f4a25"),
    (1, "Glacial/Arctic", "#f7fbff", 20, 0.00, "#7a8a6a", "#9aa888"),
    (2, "Taiga", "#2ca25f", 90, 0.66, "#2f4c2c", "#7d9456"),
    (3, "Desert", "#fee391", 60, 0.10, "#9a8a55", "#cdbb80"),
    (4, "Grassland", "#c7e9b4", 40, 0.38, "#6f8a44", "#a6b86c"),
    (5, "Temperate Forest", "#238b45", 80, 0.68, "#2c5a32", "#8fa85c"),
    (6, "Tropical Forest", "#00441b", 70, 0.74, "#1d4623", "#6f9447"),
    (7, "Mountainous", "#737373", 280, 0.22, "#56624a", "#8a906a"),
    (8, "Tundra", "#d0d1e6", 45, 0.26, "#6c7651", "#9aa074"),
    (9, "Savanna", "#e3e09a", 50, 0.45, "#5f7a3a", "#b9bf72"),
    (10, "Dry-Summer Scrub", "#aab98c", 85, 0.34, "#55613f", "#97a06e"),
    (11, "Steppe", "#dcecc0", 45, 0.26, "#74854d", "#b3bd80"),
    (12, "Cold Desert", "#e9e3c6", 55, 0.08, "#8a8a66", "#bdbb96"),
]
OTHER_RELIEF = 40
CAPACITY_REF = 200.0

# Shares of the plant types bloom, spreader and root in biomes 0 to 12.
PLANT_MIX = [
    (0.0, 0.0, 0.0), (0.0, 0.1, 0.9), (0.2, 0.3, 0.5), (0.2, 0.5, 0.3), (0.4, 0.4, 0.2), (0.5, 0.2, 0.3), (0.5, 0.3, 0.2),
    (0.3, 0.3, 0.4), (0.1, 0.2, 0.7), (0.5, 0.4, 0.1), (0.3, 0.2, 0.5), (0.3, 0.5, 0.2), (0.1, 0.4, 0.5),
]

# Colour factors of the plant types.
TYPE_MOD = {"bloom": (1.14, 1.06, 0.78), "spreader": (0.97, 1.07, 0.92), "root": (0.80, 0.84, 0.78)}

# Elevation stops in metres and their colours.
ELEVATION_STOPS = [
    (-1000, "#142a44"), (-750, "#1d3b58"), (-500, "#26506e"), (-300, "#33688a"), (-200, "#4179a3"), (-100, "#5089b5"), (-50, "#6499c5"), (-20, "#7caacd"), (-5, "#3a648c"),
    (0, "#9ba980"), (50, "#a3b478"), (100, "#a7bd6e"), (200, "#b1be64"), (300, "#b8b65a"), (500, "#beb058"), (700, "#c4ad5b"), (1000, "#c0a06a"),
    (1200, "#b6927a"), (1500, "#a98a80"), (2000, "#aa9388"), (2500, "#bda194"), (3000, "#d0b8a2"), (4000, "#dfcdb8"), (5000, "#ecdfc8"), (6500, "#f6ede0"),
]

# Vertical exaggeration of relief shading and its blend with colour.
HILLSHADE_Z, DETAIL_Z, DETAIL_LO, DETAIL_HI, BLEND = 60.0, 12.0, 0.55, 1.30, 0.55

# Feature types that an author can draw, and the geometry each must have.
FEATURE_GEOMETRY = {
    "road": "LINESTRING", "trail": "LINESTRING", "river": "LINESTRING", "forest": "POLYGON", "lake": "POLYGON",
    "mountain": "POLYGON", "region": "POLYGON", "label": "POINT", "poi": "POINT",
}


def rgb(color: str) -> tuple[int, int, int]:
    return int(color[1:3], 16), int(color[3:5], 16), int(color[5:7], 16)


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """A small fixed table as a literal map: no join, and visible to the optimizer."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)
