"""Ground materials of grid columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartolith.functions.noise import cell_draws

# Fixed values: (top, filler) per climate zone.
LAYERS = {
    "LAKE": ("SAND", "SAND"), "RIVER": ("SAND", "SAND"), "BEACH": ("SAND", "SAND"),
    "STONY_SHORE": ("STONE", "STONE"), "DESERT": ("SAND", "SANDSTONE"),
    "SEMI_DESERT": ("TERRACOTTA", "TERRACOTTA"), "SAVANNA": ("GRASS_BLOCK", "DIRT"),
    "GRASSLAND": ("GRASS_BLOCK", "DIRT"), "SHRUBLAND": ("GRASS_BLOCK", "DIRT"),
    "TEMPERATE_FOREST": ("GRASS_BLOCK", "DIRT"), "TEMPERATE_RAINFOREST": ("GRASS_BLOCK", "DIRT"),
    "BOREAL_FOREST": ("PODZOL", "DIRT"), "TROPICAL_RAINFOREST": ("GRASS_BLOCK", "DIRT"),
    "TROPICAL_SEASONAL_FOREST": ("GRASS_BLOCK", "DIRT"), "WETLAND": ("GRASS_BLOCK", "CLAY"),
    "MANGROVE": ("MUD", "MUD"), "TUNDRA": ("SNOW_BLOCK", "DIRT"),
    "MOUNTAIN_FOREST": ("GRASS_BLOCK", "DIRT"), "MOUNTAIN_MEADOW": ("GRASS_BLOCK", "DIRT"),
}
# Patchy zones as (upper bound of the draw, top, filler).
SEABED = ((0.45, "SAND", "SAND"), (0.75, "GRAVEL", "GRAVEL"), (0.90, "CLAY", "CLAY"), (1.0, "MUD", "MUD"))
ALPINE = ((0.50, "GRASS_BLOCK", "DIRT"), (0.65, "COARSE_DIRT", "DIRT"), (0.80, "STONE", "STONE"),
          (0.92, "GRAVEL", "STONE"), (1.0, "SNOW_BLOCK", "STONE"))
BARE_ROCK = ((0.55, "STONE", "STONE"), (0.75, "ANDESITE", "STONE"), (0.90, "GRAVEL", "STONE"),
             (1.0, "SNOW_BLOCK", "STONE"))
ICE_SHEET = ((0.10, "PACKED_ICE", "PACKED_ICE"), (1.0, "SNOW_BLOCK", "SNOW_BLOCK"))
JITTER_SHARE = 0.2
SEABED_SALT, SEABED_JITTER_SALT = 0x5EABED0000000001, 0x5EABED0000000002
ICE_SALT, MOUNTAIN_SALT = 0x1CE5A1700000003, 0x4D4F554E54000004
SEA_ZONES = ("OCEAN", "DEEP_OCEAN", "WARM_OCEAN", "FROZEN_OCEAN")


def _pick(draw: Column, steps) -> Column:
    chain = None
    for upper, top, filler in steps:
        layer = F.struct(F.lit(top).alias("top"), F.lit(filler).alias("filler"))
        chain = F.when(draw < upper, layer) if chain is None else chain.when(draw < upper, layer)
    return chain


def with_surface_materials(columns: DataFrame, biome: str = "biome") -> DataFrame:
    """Add ``top`` and ``filler`` to columns with bx, bz and a climate zone."""
    draws = cell_draws(F.col("bx"), F.col("bz"), {
        "sea_jitter": ("cell", 1, SEABED_JITTER_SALT), "sea_own": ("cell", 1, SEABED_SALT),
        "sea_patch": ("cell", 5, SEABED_SALT), "rock_jitter": ("cell", 1, MOUNTAIN_SALT + 1),
        "rock_own": ("cell", 1, MOUNTAIN_SALT), "rock_patch": ("cell", 4, MOUNTAIN_SALT), "ice": ("cell", 4, ICE_SALT)})
    d, zone = F.col("_d"), F.col(biome)
    sea = F.when(d["sea_jitter"] < JITTER_SHARE, d["sea_own"]).otherwise(d["sea_patch"])
    rock = F.when(d["rock_jitter"] < JITTER_SHARE, d["rock_own"]).otherwise(d["rock_patch"])
    pairs = [F.lit(v) for name, (top, filler) in LAYERS.items() for v in (name, f"{top}/{filler}")]
    plain = F.split(F.create_map(*pairs)[zone], "/")
    layer = (F.when(zone.isin(*SEA_ZONES), _pick(sea, SEABED)).when(zone == "GLACIER", _pick(d["ice"], ICE_SHEET))
             .when(zone == "ALPINE", _pick(rock, ALPINE)).when(zone == "BARE_ROCK", _pick(rock, BARE_ROCK))
             .otherwise(F.struct(plain[0].alias("top"), plain[1].alias("filler"))))
    return (columns.withColumn("_d", draws).withColumn("_l", layer)
            .select(*columns.columns, F.col("_l.top").alias("top"), F.col("_l.filler").alias("filler")))
