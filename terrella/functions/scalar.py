"""Scalar building blocks of procedural synthesis, as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RIVER_TIERS, SETTLEMENT_BREAKS, WATER_CLASS, WORLD_SEED


def fract(x: Column) -> Column:
    return x - F.floor(x).cast("double")


def hash01(a: Column, b: Column | float = 0.0, k: Column | float = 1.0) -> Column:
    """A position hash in [0, 1): a pure function of its arguments and the world's seed."""
    b, k = (F.lit(v) if not isinstance(v, Column) else v for v in (b, k))
    # fixed coefficients: places of everything drawn by hash depend on them
    return fract(F.sin(127.1 * a.cast("double") + 311.7 * b.cast("double") + 74.7 * k.cast("double") + 0.618 * WORLD_SEED) * 43758.5453)


def hash01_at(a: np.ndarray, b: np.ndarray, k: float) -> np.ndarray:
    """``hash01`` of arrays, in the same steps."""
    h = np.sin(127.1 * a + 311.7 * b + 74.7 * k + 0.618 * WORLD_SEED)
    h *= 43758.5453
    return h - np.floor(h)


def na_least(*cols: Column) -> Column:
    """The least, or null if any is null; the built-in one skips nulls."""
    return F.when(_all_there(cols), F.least(*cols))


def na_greatest(*cols: Column) -> Column:
    return F.when(_all_there(cols), F.greatest(*cols))


def _all_there(cols: tuple[Column, ...]) -> Column:
    out = cols[0].isNotNull()
    for c in cols[1:]:
        out = out & c.isNotNull()
    return out


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def smoothstep(x: Column, e0: float, e1: float) -> Column:
    t = clamp((x - e0) / (e1 - e0), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def luminance(r: Column, g: Column, b: Column, lo: float, hi: float, white: float = 160.0) -> Column:
    """Weights in whole hundredths: whole channels are summed without error and rounded once."""
    return clamp((30 * r + 59 * g + 11 * b) / F.lit(100.0) / F.lit(white), lo, hi)


def rounded(x: Column, digits: int) -> Column:
    """Halves away from zero after scaling, as SQL engines round doubles; the built-in one goes by the shortest decimal text, which differs at ties."""
    # nor does this go through decimals, as the built-in one does for every value
    v = x * 10.0**digits
    even = F.rint(v)
    return F.when(F.abs(v - even) == 0.5, v + F.signum(v) * 0.5).otherwise(even) / 10.0**digits


def channel(color: Column, band: int) -> Column:
    """One of the bands 0 to 3 of ``#rrggbb`` or ``#rrggbbaa`` as an integer."""
    return F.conv(F.substring(color, 2 + 2 * band, 2), 16, 10).cast("int")


def codepoint_id(s: Column) -> Column:
    """A number for an id that is none: each character's code times its place, summed."""
    codes = F.transform(F.split(s, ""), lambda c, i: F.ascii(c).cast("long") * (i + 1))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x)


def normalised_name(s: Column) -> Column:
    """Capitals are dropped before lowering: published matches depend on that order."""
    return F.lower(F.regexp_replace(s, "[^a-z0-9]", ""))


def slug(s: Column) -> Column:
    return F.regexp_replace(s, "[^a-z0-9]+", "-")


def water_is(water: Column, *names: str) -> Column:
    """Whether a water code is one of the classes named; false for null."""
    return F.coalesce(water.isin([WATER_CLASS[n] for n in names]), F.lit(False))


def settlement_tier(pop: Column) -> Column:
    """1 to 5 by left-closed bounds; null for no population."""
    out = F.lit(1)
    for i, low in enumerate(SETTLEMENT_BREAKS):
        out = F.when(pop >= low, F.lit(i + 2)).otherwise(out)
    return F.when(pop.isNotNull(), out)


def flow_tier(flow: Column) -> Column:
    out = F.when(flow >= RIVER_TIERS[0][0], F.lit(RIVER_TIERS[0][1]))
    for low, name in RIVER_TIERS[1:]:
        out = out.when(flow >= low, F.lit(name))
    return out.otherwise(F.when(flow.isNotNull(), F.lit("dropped")))


def mercator_range(lon: Column, lat: Column) -> Column:
    """Points that the projection can show."""
    return lon.isNotNull() & lat.isNotNull() & (F.abs(lat) < 84.5)
