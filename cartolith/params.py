"""Parameters that change results, and the declared table schemas."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TerrainParams:
    """World scale, vertical scale and water settings of one terrain build."""

    blocks_per_km: float = 1.0
    origin_lat: float = 51.0
    origin_lon: float = 10.0
    projection: str = "equirectangular"
    standard_parallel: float | None = None  # the origin latitude when not given
    sea_level: int = 63
    min_y: int = -64
    max_y: int = 320
    vertical_exaggeration: float = 1.0
    meters_per_block: float = 1.0
    relief_curve_meters: float = 0.0
    fallback_elevation: float = 0.0
    bedrock_thickness: int = 8
    smoothing: float = 3.0
    detail: float = 0.0
    oceans: bool = True
    lakes: bool = True
    rivers: bool = True
    default_ocean_depth: float = 30.0
    min_visible_discharge: float = 1.0
    min_lake_depth: int = 3
    min_river_depth: int = 2
    min_ocean_depth: int = 6
    shore_blend: int = 4
    river_min_width_blocks: float = 1.0

    def __post_init__(self) -> None:
        checks = {
            "blocks_per_km must be positive": self.blocks_per_km > 0,
            "origin_lat must be within -90..90": -90 <= self.origin_lat <= 90,
            "min_y must be below max_y": self.min_y < self.max_y,
            "sea_level must lie strictly between min_y and max_y": self.min_y < self.sea_level < self.max_y,
            "vertical_exaggeration must be positive": self.vertical_exaggeration > 0,
            "meters_per_block must be positive": self.meters_per_block > 0,
            "bedrock_thickness must not be negative": self.bedrock_thickness >= 0,
            "relief_curve_meters must not be negative": self.relief_curve_meters >= 0,
            "smoothing must be at least 1": self.smoothing >= 1.0,
            "detail must be between 0 and 3": 0.0 <= self.detail <= 3.0,
            "default_ocean_depth must not be negative": self.default_ocean_depth >= 0,
            "min depths must be at least 1": min(self.min_lake_depth, self.min_river_depth, self.min_ocean_depth) >= 1,
            "shore_blend must be between 0 and 16": 0 <= self.shore_blend <= 16,
            "river_min_width_blocks must be between 1 and 8": 1.0 <= self.river_min_width_blocks <= 8.0,
        }
        failed = [message for message, ok in checks.items() if not ok]
        if failed:
            raise ValueError("; ".join(failed))

    @property
    def world_meters_per_block(self) -> float:
        """Horizontal metres covered by one grid column."""
        return 1000.0 / self.blocks_per_km


@dataclass(frozen=True)
class VerticalProfile:
    """Height range chosen for an area, with a stable fingerprint."""

    sea_level: int
    min_y: int
    max_y: int
    meters_per_block: float

    def __post_init__(self) -> None:
        if not self.min_y < self.sea_level < self.max_y:
            raise ValueError("sea level must lie strictly between min_y and max_y")
        if self.meters_per_block <= 0:
            raise ValueError("meters_per_block must be positive")
        if self.min_y < -2032 or self.max_y > 2032:
            raise ValueError("world heights reach from -2032 to 2032")
        if (self.max_y - self.min_y) % 16:
            raise ValueError("world height must be a multiple of 16")

    @property
    def canonical(self) -> str:
        return (f"seaLevel={self.sea_level};minY={self.min_y};maxY={self.max_y};"
                f"metersPerBlock={self.meters_per_block}")

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.canonical.encode()).hexdigest()


PLANET_PROFILE = VerticalProfile(0, -512, 512, 20.0)
REGIONAL_PROFILE = VerticalProfile(63, -64, 320, 1.0)


def profile_for_bounds(lat_span: float, lon_span: float) -> VerticalProfile:
    """Planet profile from 120 degrees of latitude by 240 of longitude, else regional."""
    return PLANET_PROFILE if lat_span >= 120.0 and lon_span >= 240.0 else REGIONAL_PROFILE


# Land-cover classes in stored ordinal order.
LANDCOVER_CLASSES = (
    "UNKNOWN", "TREE_COVER", "SHRUBLAND", "GRASSLAND", "CROPLAND", "BUILT_UP",
    "BARE_SPARSE", "SNOW_ICE", "PERMANENT_WATER", "HERBACEOUS_WETLAND", "MANGROVES",
    "MOSS_LICHEN",
)

RING_POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(RING_POINT))

_BBOX = "min_lat double, min_lon double, max_lat double, max_lon double"
_RINGS_DDL = "array<array<struct<lon:double,lat:double>>>"

# The vector store: one parquet table per entry.
VECTOR_SCHEMAS: dict[str, str] = {
    "countries": f"id int, iso_code string, iso_code_3 string, name string, {_BBOX}, rings {_RINGS_DDL}",
    "regions": f"id int, country_id int, name string, admin_level int, {_BBOX}, rings {_RINGS_DDL}",
    "cities": "id int, name string, ascii_name string, latitude double, longitude double, "
              "population bigint, country_id int, region_id int, capital boolean",
    "geographic_names": "id int, entity_type string, entity_id int, name string, language string",
    "water_bodies": f"id bigint, name string, water_type string, {_BBOX}, bed_depth_m double, "
                    f"surface_elevation_m double, discharge_cms double, is_line boolean, radius_deg double, "
                    f"rings {_RINGS_DDL}",
    "karst_areas": f"id bigint, {_BBOX}, rings {_RINGS_DDL}",
    "cave_entrances": "id bigint, latitude double, longitude double, name string",
    "data_tiles": "dataset string, lat_deg int, lon_deg int, file string, width int, height int, "
                  "encoding string, bytes bigint, checksum string",
    "cache_metadata": "cache_key string, prepared_at bigint, detail string",
    "town_geography": "town_uuid string, town_name string, latitude double, longitude double, "
                      "elevation double, country_id int, region_id int, updated_at bigint",
    "schema_version": "version int, applied_at bigint",
}
