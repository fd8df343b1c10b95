"""Neighbourhood operators over grid columns.

Columns are grouped into square patches; each patch also receives copies of the columns
within reach of its border, so that one shuffle serves every neighbourhood of the patch and a
group never exceeds (patch + 2 * reach) squared rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cartolith.functions.noise import cell_smooth_np

PATCH = 64

# Fixed values of relief detail.
RELIEF_SALT = 0x52454C49454656
RIDGE_MEAN = 0.357


def with_halo(columns: DataFrame, reach: int, patch: int = PATCH) -> DataFrame:
    """List every column under its own patch and under those it borders on (``own`` tells)."""
    def patches(c: str):
        return F.sequence(F.floor((F.col(c) - reach) / patch).cast("int"),
                          F.floor((F.col(c) + reach) / patch).cast("int"))
    spread = columns.withColumn("_px", F.explode(patches("bx"))).withColumn("_pz", F.explode(patches("bz")))
    own = ((F.floor(F.col("bx") / patch) == F.col("_px")) & (F.floor(F.col("bz") / patch) == F.col("_pz")))
    return spread.withColumn("_own", own)


def map_patches(columns: DataFrame, needed: list[str], reach: int, kernel: Callable[["Patch"], dict],
                added: dict[str, str], patch: int = PATCH) -> DataFrame:
    """Run a numpy kernel per patch; it returns one 2-D array per added column.

    Whole rows travel through Arrow untouched, so nothing has to be joined back. Halo copies
    carry only what the kernel reads. Columns that are already listed under their patches
    (``_px``, ``_pz``, ``_own``) are taken as they lie.
    """
    listed = {"_px", "_pz", "_own"} <= set(columns.columns)
    fields = [f for f in columns.schema.fields if not (listed and f.name in ("_px", "_pz", "_own"))]
    names = [f.name for f in fields]
    kept = [c for c in names if c not in ("bx", "bz", *needed)]
    types = {"int": (pa.int32(), T.IntegerType()), "boolean": (pa.bool_(), T.BooleanType())}
    schema = T.StructType([*fields, *[T.StructField(n, types[kind][1]) for n, kind in added.items()]])

    def run(table: pa.Table) -> pa.Table:
        grid = Patch(table, needed, reach)
        results = kernel(grid)
        mask = table["_own"].to_numpy()
        own = table.filter(pa.array(mask)).select(names)
        for name, kind in added.items():
            values = results[name][grid.row, grid.col][mask]
            gaps = values == Patch.MISSING if values.dtype != bool else None
            own = own.append_column(name, pa.array(values, mask=gaps).cast(types[kind][0]))
        return own

    spread = columns if listed else with_halo(columns, reach, patch)
    light = spread.select("_px", "_pz", "_own", "bx", "bz", *needed, *[F.when(F.col("_own"), F.col(c)).alias(c) for c in kept])
    return light.groupBy("_px", "_pz").applyInArrow(run, schema)


class Patch:
    """Dense arrays of one patch; ``present`` is false where the area has no column."""

    MISSING = np.iinfo(np.int64).min

    def __init__(self, table: pa.Table, needed: list[str], reach: int):
        bx, bz = table["bx"].to_numpy().astype(np.int64), table["bz"].to_numpy().astype(np.int64)
        self.x0, self.z0, self.reach = bx.min() - reach, bz.min() - reach, reach
        self.col, self.row = bx - self.x0, bz - self.z0
        self.shape = (int(self.row.max()) + reach + 1, int(self.col.max()) + reach + 1)
        self.present = np.zeros(self.shape, dtype=bool)
        self.present[self.row, self.col] = True
        self._table = table

    def ints(self, name: str) -> np.ndarray:
        grid = np.full(self.shape, self.MISSING, dtype=np.int64)
        grid[self.row, self.col] = self._table[name].to_numpy()
        return grid

    def flags(self, name: str) -> np.ndarray:
        grid = np.zeros(self.shape, dtype=bool)
        grid[self.row, self.col] = self._table[name].to_numpy()
        return grid


def shifted(grid: np.ndarray, dz: int, dx: int, fill) -> np.ndarray:
    """Array whose cell (z, x) holds the value at (z + dz, x + dx)."""
    out = np.full_like(grid, fill)
    h, w = grid.shape
    z_to, z_from = slice(max(0, -dz), min(h, h - dz)), slice(max(0, dz), min(h, h + dz))
    x_to, x_from = slice(max(0, -dx), min(w, w - dx)), slice(max(0, dx), min(w, w + dx))
    out[z_to, x_to] = grid[z_from, x_from]
    return out


def others_within(flags: np.ndarray, reach: int):
    """Function of a distance up to ``reach``: is any other cell within it (Chebyshev) flagged?"""
    h, w = flags.shape
    sums = np.zeros((h + 2 * reach + 1, w + 2 * reach + 1), dtype=np.int32)
    sums[1:, 1:] = np.pad(flags, reach).cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)

    def within(d: int) -> np.ndarray:
        a, b = reach - d, reach + d + 1
        boxed = sums[b:b + h, b:b + w] - sums[a:a + h, b:b + w] - sums[b:b + h, a:a + w] + sums[a:a + h, a:a + w]
        return boxed > flags
    return within


def ring_offsets(d: int) -> list[tuple[int, int]]:
    """Offsets at Chebyshev distance d."""
    return [(dz, dx) for dz in range(-d, d + 1) for dx in range(-d, d + 1) if max(abs(dz), abs(dx)) == d]


def ring_maximum(grid: np.ndarray, d: int) -> np.ndarray:
    best = np.full_like(grid, Patch.MISSING)
    for dz, dx in ring_offsets(d):
        np.maximum(best, shifted(grid, dz, dx, Patch.MISSING), out=best)
    return best


def _half_up(values: np.ndarray) -> np.ndarray:
    return np.floor(values + 0.5).astype(np.int64)


def relief_noise_np(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Three octaves, the middle one ridged, clipped to [-1, 1]."""
    broad = cell_smooth_np(x, z, 14, RELIEF_SALT) * 2.0 - 1.0
    ridge = (RIDGE_MEAN - np.abs(cell_smooth_np(x, z, 7, RELIEF_SALT + 1) * 2.0 - 1.0)) * 2.0
    fine = cell_smooth_np(x, z, 3, RELIEF_SALT + 2) * 2.0 - 1.0
    return np.clip(0.55 * broad + 0.3 * ridge + 0.15 * fine, -1.0, 1.0)


def _detail_grid(grid: Patch, y: np.ndarray, water: np.ndarray, detail: float, min_y: int, max_y: int) -> np.ndarray:
    east, west = shifted(y, 0, 1, Patch.MISSING), shifted(y, 0, -1, Patch.MISSING)
    south, north = shifted(y, 1, 0, Patch.MISSING), shifted(y, -1, 0, Patch.MISSING)
    whole = np.all([v != Patch.MISSING for v in (east, west, south, north)], axis=0) & grid.present & ~water
    zz, xx = np.nonzero(whole)
    slope = np.hypot((east - west)[zz, xx] * 0.5, (south - north)[zz, xx] * 0.5)
    amplitude = np.minimum(10.0, 1.5 + slope) * detail
    moved = _half_up(y[zz, xx] + amplitude * relief_noise_np(xx + grid.x0, zz + grid.z0))
    out = y.copy()
    out[zz, xx] = np.clip(moved, min_y, max_y)
    return out


def _shore_grid(grid: Patch, y: np.ndarray, water: np.ndarray, level: np.ndarray, reach: int) -> np.ndarray:
    water_level = np.where(water, level, Patch.MISSING)
    dry = others_within(grid.present & ~water, reach)
    out = y.copy()
    land = grid.present & ~water
    touching = ring_maximum(water_level, 1)
    raised = land & (touching != Patch.MISSING) & (y < touching)
    out[raised] = touching[raised]
    open_land, open_water = land & ~raised, water.copy()
    for d in range(1, reach + 1):
        fade = (d / (reach + 1)) ** 2
        near = ring_maximum(water_level, d)
        hit = open_land & (near != Patch.MISSING)
        over = y - (near + d)
        cut = hit & (over > 0)
        out[cut] = near[cut] + d + _half_up(over[cut] * fade)
        open_land &= ~hit
        hit = open_water & dry(d)  # nearer rings had none
        shelf = level - d
        over = shelf - y
        fill = hit & (over > 0)
        out[fill] = shelf[fill] - _half_up(over[fill] * fade)
        open_water &= ~hit
    return out


def shape_surface(columns: DataFrame, detail: float, reach: int, min_y: int, max_y: int,
                  patch: int = PATCH) -> DataFrame:
    """Relief detail on land, then banks and shelves along water.

    ``columns`` has bx, bz, surface_y, water_surface_y and water_type. A column's result
    needs its neighbours up to ``reach`` (plus one with detail); give the area that margin.
    """
    if detail <= 0 and reach <= 0:
        return columns

    def kernel(grid: Patch) -> dict:
        y, level, water = grid.ints("surface_y"), grid.ints("water_surface_y"), grid.flags("_wet")
        if detail > 0:
            y = _detail_grid(grid, y, water, detail, min_y, max_y)
        if reach > 0:
            y = _shore_grid(grid, y, water, level, reach)
        return {"_shaped": y}

    marked = columns.withColumn("_wet", F.col("water_type") != "NONE")
    made = map_patches(marked, ["surface_y", "water_surface_y", "_wet"], reach + 1, kernel, {"_shaped": "int"}, patch)
    return made.withColumn("surface_y", F.col("_shaped")).drop("_wet", "_shaped")


# Fixed values of the surroundings scan.
SURROUNDINGS_REACH = 6
RIPARIAN_DISTANCE = 3
WARM_BIOMES = ("TROPICAL_RAINFOREST", "TROPICAL_SEASONAL_FOREST", "SAVANNA", "MANGROVE", "DESERT", "WARM_OCEAN")


def surroundings(columns: DataFrame, reach: int = SURROUNDINGS_REACH, patch: int = PATCH) -> DataFrame:
    """Describe the ground around each column.

    Adds ``flat`` (eight dry neighbours of the same height), ``fresh_water_distance``
    (Chebyshev distance to a lake or river column, NULL beyond reach), ``fresh_water_at_level``
    (a side neighbour's fresh water stands at ground level) and ``warm`` (a warm zone within
    reach). The column itself does not count.
    """
    def kernel(grid: Patch) -> dict:
        y, level, wet = grid.ints("surface_y"), grid.ints("water_surface_y"), grid.flags("_wet")
        fresh, warm = grid.flags("_fresh"), grid.flags("_warm")
        flat = np.ones(grid.shape, dtype=bool)
        for dz, dx in ring_offsets(1):
            other = shifted(y, dz, dx, Patch.MISSING)
            flat &= (other == Patch.MISSING) | ((other == y) & ~shifted(wet, dz, dx, False))
        distance = np.full(grid.shape, Patch.MISSING, dtype=np.int64)
        near = others_within(fresh, reach)
        for d in range(reach, 0, -1):
            distance[near(d)] = d
        is_warm = others_within(warm, reach)(reach)
        at_level = np.zeros(grid.shape, dtype=bool)
        for dz, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            at_level |= (shifted(fresh, dz, dx, False) & (shifted(y, dz, dx, Patch.MISSING) < y)
                         & (y <= shifted(level, dz, dx, Patch.MISSING)))
        return {"flat": flat, "fresh_water_distance": distance, "fresh_water_at_level": at_level, "warm": is_warm}

    marked = (columns.withColumn("_wet", F.col("water_type") != "NONE")
              .withColumn("_fresh", F.col("water_type").isin("LAKE", "RIVER"))
              .withColumn("_warm", F.col("biome").isin(*WARM_BIOMES)))
    made = map_patches(marked, ["surface_y", "water_surface_y", "_wet", "_fresh", "_warm"], reach, kernel,
                       {"flat": "boolean", "fresh_water_distance": "int", "fresh_water_at_level": "boolean",
                        "warm": "boolean"}, patch)
    return made.drop("_wet", "_fresh", "_warm")
