"""Map projections: forward, inverse and scale as Column expressions, plus a registry."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from cartolith.params import TerrainParams

EARTH_RADIUS = 6_378_137.0
MERCATOR_MAX_LATITUDE = 85.05112877980659


def _wrap(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def _limit(lat: Column, bound: float) -> Column:
    return F.least(F.greatest(lat, F.lit(-bound)), F.lit(bound))


@dataclass(frozen=True)
class Projection:
    """A named pair of mappings between degrees and plane metres."""

    id: str
    forward: Callable[[Column, Column], tuple[Column, Column]]
    inverse: Callable[[Column, Column], tuple[Column, Column]]
    scale: Callable[[Column], Column]
    max_latitude: float
    forward_value: Callable[[float, float], tuple[float, float]]


def web_mercator() -> Projection:
    top = MERCATOR_MAX_LATITUDE

    def forward(lat, lon):
        north = F.ln(F.tan(F.radians(_limit(lat, top)) / 2.0 + math.pi / 4.0))
        return F.radians(_wrap(lon)) * EARTH_RADIUS, north * EARTH_RADIUS

    def inverse(east, north):
        lat = F.degrees(F.atan(F.exp(north / EARTH_RADIUS)) * 2.0 - math.pi / 2.0)
        return _limit(lat, 90.0), _wrap(F.degrees(east / EARTH_RADIUS))

    def value(lat, lon):
        lat = max(-top, min(top, lat))
        return (EARTH_RADIUS * math.radians((lon + 180.0) % 360.0 - 180.0),
                EARTH_RADIUS * math.log(math.tan(math.pi / 4.0 + math.radians(lat) / 2.0)))

    return Projection("web_mercator", forward, inverse,
                      lambda lat: F.lit(1.0) / F.cos(F.radians(_limit(lat, top))), top, value)


def equirectangular(standard_parallel: float = 0.0, name: str = "equirectangular") -> Projection:
    if not -89.0 <= standard_parallel <= 89.0:
        raise ValueError("standard parallel must be within -89..89")
    shrink = math.cos(math.radians(standard_parallel))

    def forward(lat, lon):
        return F.radians(_wrap(lon)) * EARTH_RADIUS * shrink, F.radians(_limit(lat, 90.0)) * EARTH_RADIUS

    def inverse(east, north):
        return (_limit(F.degrees(north / EARTH_RADIUS), 90.0),
                _wrap(F.degrees(east / (EARTH_RADIUS * shrink))))

    def value(lat, lon):
        return (EARTH_RADIUS * math.radians((lon + 180.0) % 360.0 - 180.0) * shrink,
                EARTH_RADIUS * math.radians(max(-90.0, min(90.0, lat))))

    return Projection(name, forward, inverse,
                      lambda lat: F.lit(shrink) / F.cos(F.radians(_limit(lat, 90.0))), 90.0, value)


_REGISTRY: dict[str, Callable[[TerrainParams], Projection]] = {
    "web_mercator": lambda params: web_mercator(),
    "equirectangular": lambda params: equirectangular(
        params.origin_lat if params.standard_parallel is None else params.standard_parallel),
    "plate_carree": lambda params: equirectangular(0.0, "plate_carree"),
}


def register_projection(name: str, factory: Callable[[TerrainParams], Projection]) -> None:
    """Make a projection available by a case-insensitive id."""
    _REGISTRY[name.strip().lower()] = factory


def projection_ids() -> list[str]:
    return sorted(_REGISTRY)


def projection_for(params: TerrainParams) -> Projection:
    try:
        return _REGISTRY[params.projection.strip().lower()](params)
    except KeyError:
        raise ValueError(f"unknown projection {params.projection!r}; known: {projection_ids()}") from None
