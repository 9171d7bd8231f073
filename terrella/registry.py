"""The registry of noise fields: which random stream each field owns, at what wavelengths.

A field's stream is the world's seed plus its offset, so an offset must have one owner.
"""

from __future__ import annotations

from dataclasses import dataclass

from .model import WORLD_SEED


@dataclass(frozen=True)
class Field:
    name: str
    offsets: tuple[int, ...]
    wavelengths: dict[str, float] | tuple[float, ...]
    octaves: dict[str, int] | int
    gain: float
    used_by: str


def _one(name: str, offset: int, wl: float, octaves: int, used_by: str, gain: float = 0.5) -> Field:
    return Field(name, (offset,), (wl,), octaves, gain, used_by)


# Offsets, wavelengths in metres, octaves and gains of the world's fields.
FIELDS = {
    f.name: f
    for f in [
        Field("terrain", (0,), {"relief": 4000, "pull": 4000, "wiggle": 650}, {"relief": 6, "pull": 4, "wiggle": 3}, 0.5, "relief"),
        _one("coast.warp.x", 303, 2000, 4, "coastline"),
        _one("coast.warp.y", 404, 2000, 4, "coastline"),
        _one("biome.warp.x", 101, 1500, 3, "biomes"),
        _one("biome.warp.y", 202, 1500, 3, "biomes"),
        Field("drainage", tuple(range(501, 521)), (7000, 3000, 1300, 600, 280, 130), 1, 0.5, "relief"),
        Field("river.meander", tuple(range(41, 51)), (1600, 420, 130), 3, 0.5, "rivers"),
        _one("river.breathe", 61, 1300, 3, "rivers"),
        _one("river.ragged", 62, 170, 2, "rivers"),
        _one("river.sandbar", 64, 120, 2, "rivers"),
        _one("river.foam", 65, 45, 2, "rivers"),
        _one("path.settlement", 77, 260, 3, "paths"),
        _one("path.pilgrim", 88, 160, 3, "paths"),
        _one("veg.openwarp.x", 730, 1500, 3, "vegetation"),
        _one("veg.openwarp.y", 740, 1500, 3, "vegetation"),
        _one("veg.openness", 710, 3000, 6, "vegetation", 0.55),
        _one("veg.regional", 860, 26000, 2, "vegetation"),
        _one("veg.hue", 862, 42000, 2, "vegetation"),
        _one("veg.sheen", 863, 1600, 3, "vegetation"),
        _one("veg.brown", 864, 13000, 2, "vegetation"),
        _one("veg.mottle", 800, 140, 3, "vegetation"),
        _one("veg.mottle2", 820, 90, 3, "vegetation"),
        _one("veg.typesel", 760, 380, 4, "vegetation"),
        _one("veg.standmix", 815, 260, 3, "vegetation"),
        _one("veg.crownbump", 830, 58, 2, "vegetation"),
        _one("veg.crevasse", 825, 220, 1, "vegetation"),
        _one("settle.wobble1", 910, 1100, 3, "settlements"),
        _one("settle.wobble2", 911, 320, 2, "settlements"),
        _one("settle.fieldcells", 920, 130, 1, "settlements"),
        _one("settle.wallring", 930, 520, 2, "settlements"),
        _one("sacred.wobble", 850, 160, 2, "sacred sites"),
    ]
}
# Rungs of the two ladders.
DRAINAGE_WIDTH, DRAINAGE_WEIGHT = (0.14, 0.11, 0.09, 0.07, 0.06, 0.05), (1.00, 0.58, 0.28, 0.12, 0.06, 0.030)
DRAINAGE_COARSE, DRAINAGE_ACTIVE = 4, 6
MEANDER_AMPLITUDE = (130.0, 45.0, 14.0)


def field(name: str) -> Field:
    if name not in FIELDS:
        raise KeyError(f"no noise field {name!r}")
    return FIELDS[name]


def seed(name: str, rung: int | None = None) -> int:
    """The stream of a field; a ladder needs its rung (from 1)."""
    f = field(name)
    if len(f.offsets) > 1 and rung is None:
        raise ValueError(f"{name} is a ladder: name a rung")
    i = (rung or 1) - 1
    if not 0 <= i < len(f.offsets):
        raise IndexError(f"{name} has no rung {rung}")
    return WORLD_SEED + f.offsets[i]


def _by_use(values, use: str | None, name: str, what: str):
    if isinstance(values, dict):
        if use is None:
            raise ValueError(f"{name} has several {what}: name one of {sorted(values)}")
        return values[use]
    return values


def wavelength(name: str, use: str | None = None, rung: int | None = None) -> float:
    values = _by_use(field(name).wavelengths, use, name, "wavelengths")
    if not isinstance(values, tuple):
        return values
    if len(values) > 1 and rung is None:
        raise ValueError(f"{name} is a ladder: name a rung")
    return values[(rung or 1) - 1]


def octaves(name: str, use: str | None = None) -> int:
    return _by_use(field(name).octaves, use, name, "octave counts")


def used_offsets() -> list[int]:
    return sorted({o for f in FIELDS.values() for o in f.offsets})


def free_offsets(top: int = 1000, n: int = 20) -> list[int]:
    used = set(used_offsets())
    return [o for o in range(1, top + 1) if o not in used][:n]


def audit() -> list[str]:
    """What is wrong with the registry; empty if nothing."""
    out, owners = [], {}
    for f in FIELDS.values():
        wl = f.wavelengths.values() if isinstance(f.wavelengths, dict) else f.wavelengths
        if not f.offsets or not wl:
            out.append(f"{f.name}: offsets or wavelengths are missing")
        if min(f.offsets) < 0:
            out.append(f"{f.name}: negative offset")
        for o in f.offsets:
            owners.setdefault(o, []).append(f.name)
    return out + [f"offset {o} has several owners: {', '.join(n)}" for o, n in sorted(owners.items()) if len(n) > 1]


def octave_overlaps() -> list[tuple[str, str, int]]:
    """Fields whose octaves share a stream (octave o of a field uses its seed plus o); harmless at other wavelengths, but worth knowing."""
    at: dict[int, list[str]] = {}
    for f in FIELDS.values():
        top = max(f.octaves.values()) if isinstance(f.octaves, dict) else f.octaves
        for s in {o + k for o in f.offsets for k in range(1, top + 1)}:
            at.setdefault(s, []).append(f.name)
    return [(a, b, s) for s, names in sorted(at.items()) for a, b in zip(names, names[1:], strict=False)]
