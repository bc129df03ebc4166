"""Settings by sensor, and how they follow a cloud's density."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from math import inf, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sensor:
    vote_cell_m: float
    vote_radius: int
    vote_least_cells: int
    vote_most_z: float
    fill_rounds: int
    smooth_sigma: float
    ground_threshold_m: float
    slope_k: float
    cand_cell_m: float
    cand_dz_m: float
    gate: tuple[float, float]
    recover_voids: bool
    canopy_method: str
    canopy_thresholds: tuple[float, ...]
    structure: tuple[float, float, float, float]  # cell, least height, bin, cover from
    mad_floor: float = 0.05


# Settings of airborne, drone and terrestrial scans.
SENSORS = {
    "ALS": Sensor(1.00, 3, 6, 3.0, 80, 1.2, 0.30, 0.40, 2.0, 0.75, (0.05, 0.60), True, "pitfree", (0, 2, 5, 10, 15), (1.0, 2.0, 1.0, 2.0)),
    "ULS": Sensor(0.75, 4, 8, 2.8, 100, 1.0, 0.18, 0.30, 1.5, 0.60, (0.05, 0.60), True, "pitfree", (0, 1, 3, 6, 10, 15), (0.5, 1.5, 0.5, 2.0)),
    "TLS": Sensor(0.35, 4, 10, 2.6, 100, 0.8, 0.10, 0.25, 2.0, 0.20, (0.03, 0.30), False, "p99", (0, 2, 5, 10, 15), (0.25, 0.5, 0.25, 1.0)),
}
# Settings of the membrane through classified ground.
MEMBRANE = Sensor(0.50, 4, 6, 2.8, 60, 1.0, 0.12, 0.25, 0.0, 0.0, (0.05, 0.60), False, "", (), (0.0, 0.0, 0.0, 0.0))
# Upper bounds of points in an occupied cell, and of points a square metre, with the scale that each stands for.
BY_COUNT = {
    "ALS": ((10, 1.60), (25, 1.40), (60, 1.20), (160, 1.00), (350, 0.90), (inf, 0.82)),
    "ULS": ((20, 1.45), (50, 1.25), (120, 1.10), (300, 1.00), (700, 0.92), (inf, 0.86)),
    "TLS": ((40, 1.50), (100, 1.30), (250, 1.15), (700, 1.00), (1800, 0.92), (inf, 0.86)),
}
BY_DENSITY = {
    "ALS": ((5, 1.60), (15, 1.35), (40, 1.15), (120, 1.00), (250, 0.90), (inf, 0.82)),
    "ULS": ((10, 1.40), (30, 1.22), (90, 1.10), (220, 1.00), (500, 0.92), (inf, 0.86)),
    "TLS": ((25, 1.45), (80, 1.25), (200, 1.12), (600, 1.00), (1400, 0.92), (inf, 0.86)),
}
SCALE_BOUNDS = {"ALS": (0.80, 1.80), "ULS": (0.80, 1.60), "TLS": (0.80, 1.55)}
NUDGE_BOUNDS = {"ALS": (-0.10, 0.12), "ULS": (-0.08, 0.10), "TLS": (-0.08, 0.10)}
VOTE_CELL_BOUNDS = {"ALS": (0.75, 2.00), "ULS": (0.50, 1.50), "TLS": (0.25, 0.80)}
CAND_CELL_BOUNDS = {"ALS": (1.5, 4.0), "ULS": (1.0, 3.5), "TLS": (1.0, 3.0)}
NEIGHBOUR_BOUNDS = {"ALS": (4, 8), "ULS": (6, 10), "TLS": (8, 14)}
# How a tile's ratio to the whole (or its difference in occupancy) shifts the scale.
COUNT_NUDGES = (("<", 0.5, 0.10), ("<", 0.8, 0.05), (">", 2.5, -0.08), (">", 1.8, -0.05))
OCCUPANCY_NUDGES = (("<", -0.2, 0.05), ("<", -0.1, 0.025), (">", 0.2, -0.03), (">", 0.1, -0.015))
DENSITY_NUDGES = (("<", 0.5, 0.04), (">", 2.0, -0.03))


def _clip(v: float, bounds: tuple[float, float]) -> float:
    return min(max(v, bounds[0]), bounds[1])


def band(x: Column, bands: tuple[tuple[float, float], ...]) -> Column:
    """The scale of the first band whose upper bound x is below."""
    out = F.lit(bands[-1][1])
    for upper, scale in reversed(bands[:-1]):
        out = F.when(x < upper, scale).otherwise(out)
    return F.when(x.isNotNull(), out)


def _nudge(x: Column, rules: tuple[tuple[str, float, float], ...]) -> Column:
    out = F.lit(0.0)
    for sign, bound, shift in reversed(rules):
        out = F.when(x < bound if sign == "<" else x > bound, shift).otherwise(out)
    return F.coalesce(F.when(x.isNotNull(), out), F.lit(0.0))


def scale(sensor: str, count: Column, density: Column, tile_count: Column, tile_density: Column, tile_occupancy: Column, occupancy: Column) -> Column:
    """The factor of a tile: the whole's band, by points in a cell or else by density, shifted a little by how the tile differs."""
    base = F.coalesce(band(count, BY_COUNT[sensor]), band(density, BY_DENSITY[sensor]), F.lit(1.0))
    ratio = lambda a, b: F.try_divide(a, b)
    shift = _nudge(ratio(tile_count, count), COUNT_NUDGES) + _nudge(tile_occupancy - occupancy, OCCUPANCY_NUDGES) + _nudge(ratio(tile_density, density), DENSITY_NUDGES)
    lo, hi = NUDGE_BOUNDS[sensor]
    shift = F.greatest(F.lit(lo), F.least(F.lit(hi), shift))
    lo, hi = SCALE_BOUNDS[sensor]
    return F.greatest(F.lit(lo), F.least(F.lit(hi), base + shift))


def adapted(sensor: str, factor: float) -> Sensor:
    """The sensor's settings with cells scaled by factor and neighbours by its root, each within bounds."""
    s = SENSORS[sensor]
    near = _clip(round(s.vote_least_cells / sqrt(factor)), NEIGHBOUR_BOUNDS[sensor])
    return replace(s, vote_cell_m=_clip(s.vote_cell_m * factor, VOTE_CELL_BOUNDS[sensor]), cand_cell_m=_clip(s.cand_cell_m * factor, CAND_CELL_BOUNDS[sensor]), vote_least_cells=int(near))


def settings(sensor: str) -> Sensor:
    if sensor not in SENSORS:
        raise ValueError(f"unknown sensor {sensor!r}; there are {sorted(SENSORS)}")
    return SENSORS[sensor]


def as_dict(sensor: str) -> dict:
    return asdict(settings(sensor))
