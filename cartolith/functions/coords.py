"""Point, box, grid and tile-key arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from cartolith.functions.projections import Projection, projection_for
from cartolith.params import TerrainParams


def normalise_longitude(lon: Column) -> Column:
    """Wrap into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def clamp_latitude(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0))


def no_data(value: Column) -> Column:
    """NaN becomes NULL, so that comparisons never see it."""
    return F.when(~F.isnan(value), value)


def valid_point(lat: Column, lon: Column) -> Column:
    """True for finite WGS84 coordinates, false otherwise (also for NULL)."""
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(inside & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


# Boxes are four columns: min_lat, min_lon, max_lat, max_lon.

def box_columns(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + name) for name in ("min_lat", "min_lon", "max_lat", "max_lon"))


def box_contains(box, lat: Column, lon: Column) -> Column:
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def box_intersects(a, b) -> Column:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def box_expand(box, degrees: Column | float):
    """Grow by a margin; only latitude is clamped."""
    return (clamp_latitude(box[0] - degrees), box[1] - degrees,
            clamp_latitude(box[2] + degrees), box[3] + degrees)


def box_center(box) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0


def box_spans(box) -> tuple[Column, Column]:
    return box[2] - box[0], box[3] - box[1]


WORLD_BOX = (-90.0, -180.0, 90.0, 180.0)


class Grid:
    """Maps degrees to world-grid columns and back for one set of parameters."""

    def __init__(self, params: TerrainParams, projection: Projection | None = None):
        self.params = params
        self.projection = projection or projection_for(params)
        self.step = params.world_meters_per_block
        self.origin_east, self.origin_north = self.projection.forward_value(params.origin_lat, params.origin_lon)

    def to_grid(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Fractional x (east) and z (south)."""
        east, north = self.projection.forward(lat, lon)
        return (east - self.origin_east) / self.step, (F.lit(self.origin_north) - north) / self.step

    def to_geographic(self, x: Column, z: Column) -> tuple[Column, Column]:
        """Latitude and longitude of a grid position."""
        return self.projection.inverse(F.lit(self.origin_east) + x * self.step,
                                       F.lit(self.origin_north) - z * self.step)

    def chunk_bounds(self, cx: Column, cz: Column):
        """Box spanned by the north-west and south-east corners of a chunk."""
        x, z = cx * 16.0, cz * 16.0
        lat_a, lon_a = self.to_geographic(x, z)
        lat_b, lon_b = self.to_geographic(x + 16.0, z + 16.0)
        return (F.least(lat_a, lat_b), F.least(lon_a, lon_b), F.greatest(lat_a, lat_b), F.greatest(lon_a, lon_b))

    def ground_meters_per_block(self, lat: Column) -> Column:
        return self.step / self.projection.scale(lat)

    def planet_extent(self) -> "Extent":
        """Whole-planet grid extent, rounded inward; east edge is one turn from west."""
        p, proj = self.params, self.projection
        west = (proj.forward_value(p.origin_lat, -180.0)[0] - self.origin_east) / self.step
        turn = 2.0 * abs(proj.forward_value(p.origin_lat, -180.0)[0]) / self.step
        north = (self.origin_north - proj.forward_value(proj.max_latitude, p.origin_lon)[1]) / self.step
        south = (self.origin_north - proj.forward_value(-proj.max_latitude, p.origin_lon)[1]) / self.step
        return Extent(math.ceil(west), math.ceil(north), math.floor(west + turn) - 1, math.floor(south) - 1)


def block_of(value: Column) -> Column:
    return F.floor(value).cast("int")


def chunk_of(block: Column) -> Column:
    return F.shiftright(block, 4)


def local_of(block: Column) -> Column:
    return block.bitwiseAND(15)


class Extent:
    """Inclusive rectangle of grid columns (driver-side scalars)."""

    def __init__(self, min_x: int, min_z: int, max_x: int, max_z: int):
        if min_x > max_x or min_z > max_z:
            raise ValueError("empty extent")
        self.min_x, self.min_z, self.max_x, self.max_z = min_x, min_z, max_x, max_z

    def as_tuple(self) -> tuple[int, int, int, int]:
        return self.min_x, self.min_z, self.max_x, self.max_z

    @property
    def width(self) -> int:
        return self.max_x - self.min_x + 1

    @property
    def depth(self) -> int:
        return self.max_z - self.min_z + 1

    def scaled(self, factor: float) -> "Extent":
        if not (factor > 0 and math.isfinite(factor)):
            raise ValueError("factor must be positive")
        x0, z0 = math.ceil(self.min_x * factor), math.ceil(self.min_z * factor)
        x1 = math.floor((self.max_x + 1.0) * factor) - 1
        z1 = math.floor((self.max_z + 1.0) * factor) - 1
        return Extent(x0, z0, max(x0, x1), max(z0, z1))

    def contains(self, x: Column, z: Column) -> Column:
        return (x >= self.min_x) & (x < self.max_x + 1.0) & (z >= self.min_z) & (z < self.max_z + 1.0)

    def intersects_chunk(self, cx: Column, cz: Column) -> Column:
        return cx.between(self.min_x >> 4, self.max_x >> 4) & cz.between(self.min_z >> 4, self.max_z >> 4)

    @staticmethod
    def _clamped(value: Column, low: int, high: int, inset: float) -> Column:
        middle = (low + high + 1.0) / 2.0
        return F.least(F.greatest(value, F.lit(float(min(low + inset, middle)))),
                       F.lit(float(max(high + 1.0 - inset, middle))))

    def clamp_x(self, x: Column, inset: float) -> Column:
        return self._clamped(x, self.min_x, self.max_x, inset)

    def clamp_z(self, z: Column, inset: float) -> Column:
        return self._clamped(z, self.min_z, self.max_z, inset)


# One-degree tile keys.

def tile_lat(lat: Column) -> Column:
    return F.least(F.greatest(F.floor(lat), F.lit(-90)), F.lit(89)).cast("int")


def tile_lon(lon: Column) -> Column:
    return F.least(F.greatest(F.floor(lon), F.lit(-180)), F.lit(179)).cast("int")


def tile_stem(lat_deg: Column, lon_deg: Column) -> Column:
    """N50E008-style name of a tile."""
    return F.format_string(
        "%s%02d%s%03d",
        F.when(lat_deg < 0, "S").otherwise("N"), F.abs(lat_deg),
        F.when(lon_deg < 0, "W").otherwise("E"), F.abs(lon_deg))


TILE_NAME = r"^([NnSs])(\d{2})([EeWw])(\d{3})(?:\.\w+)?$"


def parse_tile_name(name: Column) -> tuple[Column, Column]:
    """Latitude and longitude degree of a tile name, NULL when it is not one."""
    def part(sign: int, digits: int, negative: str) -> Column:
        value = F.expr("int(null)")
        number = F.regexp_extract(name, TILE_NAME, digits)
        parsed = F.when(number != "", number.try_cast("int"))
        return F.when(F.upper(F.regexp_extract(name, TILE_NAME, sign)) == negative, -parsed).otherwise(
            F.coalesce(parsed, value))
    return part(1, 2, "S"), part(3, 4, "W")


def tile_box(lat_deg: Column, lon_deg: Column):
    return (lat_deg.cast("double"), lon_deg.cast("double"), lat_deg + 1.0, lon_deg + 1.0)


# Square spiral enumeration of chunks around a centre.

def spiral_cell(ordinal: Column) -> tuple[Column, Column]:
    """Offset (x, z) of the n-th cell of an outward square spiral."""
    ring = F.ceil((F.sqrt(ordinal + F.lit(1)) - 1.0) / 2.0)
    side = ring * 2
    offset = ordinal - (side - 1) * (side - 1)
    leg = F.when(ordinal == 0, -1).otherwise(F.least(F.floor(offset / F.greatest(side, F.lit(1))), F.lit(3)))
    along = offset - leg * side
    x = (F.when(leg == -1, 0).when(leg == 0, ring).when(leg == 1, ring - 1 - along)
         .when(leg == 2, -ring).otherwise(-ring + 1 + along))
    z = (F.when(leg == -1, 0).when(leg == 0, -ring + 1 + along).when(leg == 1, ring)
         .when(leg == 2, ring - 1 - along).otherwise(-ring))
    return x.cast("int"), z.cast("int")


def spiral_spec(center_x: int, center_z: int, radius: int) -> dict[str, int]:
    """Chunk bounds of a square area and how far the spiral must run to cover it."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    lo_x, hi_x = (center_x - radius) // 16, (center_x + radius) // 16
    lo_z, hi_z = (center_z - radius) // 16, (center_z + radius) // 16
    mid_x, mid_z = center_x // 16, center_z // 16
    ring = max(abs(lo_x - mid_x), abs(hi_x - mid_x), abs(lo_z - mid_z), abs(hi_z - mid_z))
    return {"min_cx": lo_x, "max_cx": hi_x, "min_cz": lo_z, "max_cz": hi_z, "center_cx": mid_x,
            "center_cz": mid_z, "chunks": (hi_x - lo_x + 1) * (hi_z - lo_z + 1),
            "ordinal_ceiling": (2 * ring + 1) ** 2}
