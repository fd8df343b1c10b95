"""Scores of what could stand where: vegetation, fields, sea life, sites, minerals, karst.

Random draws are replaced by hashes of the column and a salt, so that every row can be
scored on its own and always comes out the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cartolith.functions.noise import cell_draws, cell_hash_np, unit_np
from cartolith.operators.shapes import ShapeIndex, within_shapes
from cartolith.operators.shaping import RIPARIAN_DISTANCE

# Chances per column by land cover, and by climate zone where cover is unknown.
TREE_BY_COVER = {"TREE_COVER": 0.06, "MANGROVES": 0.08, "SHRUBLAND": 0.012, "HERBACEOUS_WETLAND": 0.02,
                 "GRASSLAND": 0.003, "CROPLAND": 0.003, "BUILT_UP": 0.003, "BARE_SPARSE": 0.0, "SNOW_ICE": 0.0,
                 "PERMANENT_WATER": 0.0, "MOSS_LICHEN": 0.0}
TREE_BY_BIOME = {"TEMPERATE_FOREST": 0.05, "TEMPERATE_RAINFOREST": 0.05, "BOREAL_FOREST": 0.05,
                 "TROPICAL_RAINFOREST": 0.05, "TROPICAL_SEASONAL_FOREST": 0.05, "MOUNTAIN_FOREST": 0.05,
                 "MANGROVE": 0.08, "WETLAND": 0.02, "SAVANNA": 0.012, "SHRUBLAND": 0.01, "GRASSLAND": 0.003,
                 "MOUNTAIN_MEADOW": 0.003, "SEMI_DESERT": 0.001}
RIPARIAN_TREES = {"TEMPERATE_FOREST": 0.04, "TEMPERATE_RAINFOREST": 0.04, "GRASSLAND": 0.04, "WETLAND": 0.04,
                  "MOUNTAIN_MEADOW": 0.04, "TROPICAL_RAINFOREST": 0.03, "TROPICAL_SEASONAL_FOREST": 0.03,
                  "SAVANNA": 0.03, "DESERT": 0.02, "SEMI_DESERT": 0.02, "SHRUBLAND": 0.02, "BOREAL_FOREST": 0.01,
                  "MOUNTAIN_FOREST": 0.01}
PLANTS = {"GRASSLAND": 0.40, "SAVANNA": 0.40, "MOUNTAIN_MEADOW": 0.40, "WETLAND": 0.35, "TEMPERATE_FOREST": 0.25,
          "TEMPERATE_RAINFOREST": 0.25, "TROPICAL_RAINFOREST": 0.25, "TROPICAL_SEASONAL_FOREST": 0.25,
          "MOUNTAIN_FOREST": 0.25, "BOREAL_FOREST": 0.18, "SHRUBLAND": 0.20, "SEMI_DESERT": 0.06, "DESERT": 0.03,
          "MANGROVE": 0.12, "TUNDRA": 0.04, "ALPINE": 0.12, "BEACH": 0.02}
REEDS = {"WETLAND": 0.45, "MANGROVE": 0.45, "TROPICAL_RAINFOREST": 0.40, "TROPICAL_SEASONAL_FOREST": 0.40,
         "SAVANNA": 0.40, "DESERT": 0.35, "SEMI_DESERT": 0.35, "TEMPERATE_FOREST": 0.30, "TEMPERATE_RAINFOREST": 0.30,
         "GRASSLAND": 0.30, "SHRUBLAND": 0.30, "BEACH": 0.30, "BOREAL_FOREST": 0.12, "MOUNTAIN_FOREST": 0.12,
         "MOUNTAIN_MEADOW": 0.12}
TREE_GROUND = ("GRASS_BLOCK", "DIRT", "PODZOL", "MUD", "COARSE_DIRT", "ROOTED_DIRT")
PLANT_GROUND = ("GRASS_BLOCK", "DIRT", "PODZOL", "MUD", "COARSE_DIRT")
DRY_ZONES = ("BEACH", "DESERT", "SEMI_DESERT")
ARABLE_ZONES = ("GRASSLAND", "SAVANNA", "TEMPERATE_FOREST", "TEMPERATE_RAINFOREST", "TROPICAL_SEASONAL_FOREST",
                "TROPICAL_RAINFOREST", "SHRUBLAND", "MOUNTAIN_MEADOW", "WETLAND", "BOREAL_FOREST", "MOUNTAIN_FOREST")
BANK_CLEARANCE = 2
BEACH_PALM_BONUS = 0.012
RIPARIAN_PLANTS = 0.45

# Salts of the fields.
WOODLAND_SALT, FIELD_SALT, TILLED_SALT = 0x574F4F44, 0x4649454C, 0x54494C4C
CORAL_SALT, KELP_SALT, KELP_GAP_SALT = 0x434F5241, 0x4B454C50, 0x4B474150
GROVE_SALT, BAMBOO_SALT, SUNFLOWER_SALT = 0x47524F56, 0x42414D42, 0x53554E46
SITE_SALT, KIND_SALT = 0x53495445, 0x4B494E44
FIELD_SIZE, CHANNEL_EVERY, MAX_KELP = 10, 5, 25
# Salts of this library's own rolls.
ROLL_SALT = 0x524F4C4C

# Tree groups per zone as (upper bound of the roll, label).
TREE_GROUPS = {
    "BOREAL_FOREST": ((0.25, "TALL_PINE"), (0.29, "FALLEN_LOG"), (0.6, "REDWOOD"), (0.92, "TALL_REDWOOD"), (1.0, "MEGA_PINE")),
    "MOUNTAIN_FOREST": ((0.15, "TALL_PINE"), (0.5, "REDWOOD"), (0.75, "TALL_REDWOOD"), (0.9, "TREE"), (1.0, "MEGA_REDWOOD")),
    "TEMPERATE_FOREST": ((0.04, "FALLEN_LOG"), (0.5, "TREE"), (0.72, "BIRCH"), (0.88, "BIG_TREE"), (1.0, "DARK_OAK")),
    "TEMPERATE_RAINFOREST": ((0.05, "FALLEN_LOG"), (0.45, "BIG_TREE"), (0.75, "DARK_OAK"), (0.9, "TREE"), (1.0, "AZALEA")),
    "TROPICAL_RAINFOREST": ((0.03, "FALLEN_LOG"), (0.4, "JUNGLE"), (0.6, "SMALL_JUNGLE"), (0.88, "COCOA_TREE"), (1.0, "JUNGLE_BUSH")),
    "TROPICAL_SEASONAL_FOREST": ((0.4, "SMALL_JUNGLE"), (0.55, "COCOA_TREE"), (0.8, "TREE"), (1.0, "JUNGLE_BUSH")),
    "SAVANNA": ((0.06, "BAOBAB"), (0.3, "SHRUB"), (1.0, "ACACIA")),
    "SHRUBLAND": ((0.15, "CYPRESS"), (0.3, "DEAD_TREE"), (0.7, "SHRUB"), (1.0, "JUNGLE_BUSH")),
    "SEMI_DESERT": ((1.0, "DEAD_TREE"),),
    "WETLAND": ((0.35, "WILLOW"), (1.0, "SWAMP")),
    "MANGROVE": ((0.7, "MANGROVE"), (1.0, "TALL_MANGROVE")),
    "GRASSLAND": ((0.75, "TREE"), (0.9, "BIRCH"), (1.0, "BIG_TREE")),
    "MOUNTAIN_MEADOW": ((0.8, "REDWOOD"), (1.0, "TREE")),
}
# Groves that replace the table above: (zone, from, to, groups).
GROVES = (("TEMPERATE_FOREST", 0.0, 0.15, ((0.6, "BIRCH"), (1.0, "TALL_BIRCH"))),
          ("TEMPERATE_FOREST", 0.15, 0.20, ((0.8, "CHERRY"), (1.0, "TREE"))))
WILLOW_BANKS = ("TEMPERATE_FOREST", "TEMPERATE_RAINFOREST", "GRASSLAND", "WETLAND", "MOUNTAIN_MEADOW")
# Ground cover per zone as (upper bound of the roll, label).
PLANT_GROUPS = {
    "SAVANNA": ((0.45, "SHORT_DRY_GRASS"), (0.7, "TALL_DRY_GRASS"), (0.9, "SHORT_GRASS"), (0.96, "BUSH"), (1.0, "DEAD_BUSH")),
    "SHRUBLAND": ((0.35, "SHORT_DRY_GRASS"), (0.55, "BUSH"), (0.7, "DEAD_BUSH"), (0.85, "SHORT_GRASS"), (0.93, "WILDFLOWERS"), (1.0, "TALL_DRY_GRASS")),
    "TEMPERATE_FOREST": ((0.45, "SHORT_GRASS"), (0.6, "FERN"), (0.7, "BUSH"), (0.8, "LEAF_LITTER"), (0.86, "TALL_GRASS"), (0.93, "FLOWER"), (0.96, "TALL_FLOWER"), (0.98, "ROSE_BUSH"), (1.0, "MUSHROOM")),
    "TEMPERATE_RAINFOREST": ((0.3, "FERN"), (0.45, "LARGE_FERN"), (0.6, "MOSS_CARPET"), (0.75, "SHORT_GRASS"), (0.85, "LEAF_LITTER"), (0.93, "MUSHROOM"), (0.97, "BUSH"), (1.0, "LILY_OF_THE_VALLEY")),
    "BOREAL_FOREST": ((0.4, "FERN"), (0.55, "LARGE_FERN"), (0.75, "SHORT_GRASS"), (0.85, "SWEET_BERRY_BUSH"), (0.92, "MOSS_CARPET"), (0.97, "MUSHROOM"), (1.0, "LEAF_LITTER")),
    "MOUNTAIN_FOREST": ((0.4, "FERN"), (0.55, "LARGE_FERN"), (0.75, "SHORT_GRASS"), (0.85, "SWEET_BERRY_BUSH"), (0.92, "MOSS_CARPET"), (0.97, "MUSHROOM"), (1.0, "LEAF_LITTER")),
    "TROPICAL_RAINFOREST": ((0.3, "FERN"), (0.45, "LARGE_FERN"), (0.6, "SHORT_GRASS"), (0.72, "MOSS_CARPET"), (0.8, "TALL_GRASS"), (0.86, "BUSH"), (0.9, "MELON"), (0.95, "BLUE_ORCHID"), (0.98, "BROWN_MUSHROOM"), (1.0, "TORCHFLOWER")),
    "TROPICAL_SEASONAL_FOREST": ((0.35, "SHORT_GRASS"), (0.55, "TALL_GRASS"), (0.7, "FERN"), (0.8, "SHORT_DRY_GRASS"), (0.9, "BUSH"), (0.96, "LEAF_LITTER"), (1.0, "WILDFLOWERS")),
    "WETLAND": ((0.3, "TALL_GRASS"), (0.5, "SHORT_GRASS"), (0.62, "FERN"), (0.72, "BLUE_ORCHID"), (0.8, "MOSS_CARPET"), (0.88, "FIREFLY_BUSH"), (0.94, "BROWN_MUSHROOM"), (1.0, "LARGE_FERN")),
    "MANGROVE": ((0.5, "MOSS_CARPET"), (0.8, "MANGROVE_PROPAGULE"), (1.0, "SHORT_GRASS")),
    "DESERT": ((0.15, "CACTUS"), (0.7, "DEAD_BUSH"), (1.0, "SHORT_DRY_GRASS")),
    "SEMI_DESERT": ((0.5, "DEAD_BUSH"), (0.85, "SHORT_DRY_GRASS"), (1.0, "TALL_DRY_GRASS")),
    "BEACH": ((0.7, "SHORT_DRY_GRASS"), (1.0, "DEAD_BUSH")),
    "ALPINE": ((0.75, "SHORT_GRASS"), (1.0, "FLOWER")),
}
# Site kinds per group of zones.
SITE_KINDS = (
    (("DESERT", "SEMI_DESERT"), ((0.7, "DESERT_RUIN"), (1.0, "CRYPT"))),
    (("TROPICAL_RAINFOREST", "TROPICAL_SEASONAL_FOREST", "MANGROVE"), ((0.75, "JUNGLE_SHRINE"), (1.0, "CRYPT"))),
    (("SAVANNA", "SHRUBLAND"), ((0.5, "CAMP"), (0.75, "WATCHTOWER"), (1.0, "CRYPT"))),
    (("GRASSLAND", "TEMPERATE_FOREST", "TEMPERATE_RAINFOREST", "WETLAND"), ((0.4, "WATCHTOWER"), (0.7, "CRYPT"), (1.0, "STONE_CIRCLE"))),
    (("BOREAL_FOREST",), ((0.4, "CAMP"), (0.7, "STONE_CIRCLE"), (1.0, "CRYPT"))),
    (("TUNDRA", "GLACIER"), ((0.7, "SNOW_SHELTER"), (1.0, "STONE_CIRCLE"))),
    (("MOUNTAIN_FOREST", "MOUNTAIN_MEADOW"), ((0.5, "MOUNTAIN_HUT"), (0.75, "WATCHTOWER"), (1.0, "CRYPT"))),
    (("ALPINE", "BARE_ROCK"), ((0.6, "MOUNTAIN_HUT"), (1.0, "CRYPT"))),
)
MAX_SITE_RELIEF = 6


def _value_of(key: Column, table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[key]


def _pick(roll: Column, steps) -> Column:
    chain = None
    for upper, label in steps:
        chain = F.when(roll < upper, label) if chain is None else chain.when(roll < upper, label)
    return chain


def _by_zone(zone: Column, roll: Column, table: dict) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, steps in table.items():
        chain = chain.when(zone == name, _pick(roll, steps))
    return chain


def tree_chance(biome: Column, cover: Column) -> Column:
    return F.coalesce(_value_of(cover, TREE_BY_COVER), _value_of(biome, TREE_BY_BIOME), F.lit(0.0))


def plant_chance(biome: Column, cover: Column) -> Column:
    by_zone = F.coalesce(_value_of(biome, PLANTS), F.lit(0.0))
    return (F.when(cover.isin("BARE_SPARSE", "SNOW_ICE", "PERMANENT_WATER"), 0.0)
            .when(cover.isin("GRASSLAND", "CROPLAND"), F.greatest(by_zone, F.lit(0.35)))
            .when(cover == "HERBACEOUS_WETLAND", F.greatest(by_zone, F.lit(0.30))).otherwise(by_zone))


def woodland_factor(broad: Column, fine: Column) -> Column:
    """Density field from two noise draws: clearings at 0.1, thickets at 1.9."""
    t = F.least(F.greatest((broad * 0.65 + fine * 0.35 - 0.3) / 0.4, F.lit(0.0)), F.lit(1.0))
    return t * t * (F.lit(3.0) - t * 2.0) * 1.8 + 0.1


def vegetation_scores(columns: DataFrame, density: float = 1.0, reed_density: float = 1.0) -> DataFrame:
    """Probabilities of a tree, a plant and reeds on land columns.

    Needs biome, landcover, top, and the surroundings flags; adds ``woodland``, ``tree_p``,
    ``plant_p``, ``reed_p``.
    """
    zone, cover, ground = F.col("biome"), F.col("landcover"), F.col("top")
    distance = F.coalesce("fresh_water_distance", F.lit(1_000_000))
    riparian = distance <= RIPARIAN_DISTANCE
    dry = (F.col("water_type") == "NONE")
    draws = cell_draws(F.col("bx"), F.col("bz"), {"broad": ("smooth", 96, WOODLAND_SALT), "fine": ("smooth", 28, WOODLAND_SALT + 1)})
    wood = columns.withColumn("_w", draws).withColumn("woodland", woodland_factor(F.col("_w.broad"), F.col("_w.fine")))
    chance = tree_chance(zone, cover) * density * F.col("woodland")
    chance = F.when((distance <= BANK_CLEARANCE) & (zone != "MANGROVE"), 0.0).otherwise(chance)
    chance = chance + F.when(riparian, F.coalesce(_value_of(zone, RIPARIAN_TREES), F.lit(0.0)) * density).otherwise(0.0)
    chance = chance + F.when((zone == "BEACH") & F.col("warm"), BEACH_PALM_BONUS * density).otherwise(0.0)
    rooted = ground.isin(*TREE_GROUND) | (zone.isin(*DRY_ZONES) & ground.isin("SAND", "TERRACOTTA"))
    plants = plant_chance(zone, cover) * density
    plants = F.when(riparian, F.greatest(plants, F.lit(RIPARIAN_PLANTS * density))).otherwise(plants)
    reeds = F.coalesce(_value_of(zone, REEDS), F.lit(0.0))
    reedy = F.col("fresh_water_at_level") & (ground.isin("SAND", *PLANT_GROUND))
    return (wood.withColumn("tree_p", F.when(dry & rooted, chance).otherwise(0.0))
            .withColumn("plant_p", F.when(dry, plants).otherwise(0.0))
            .withColumn("reed_p", F.when(dry & reedy, reeds * density * reed_density).otherwise(0.0)).drop("_w"))


def species_groups(columns: DataFrame) -> DataFrame:
    """Label the tree and plant group that would grow on each column (``tree_group``, ``plant_group``)."""
    zone = F.col("biome")
    draws = cell_draws(F.col("bx"), F.col("bz"), {"tree": ("cell", 1, ROLL_SALT), "plant": ("cell", 1, ROLL_SALT + 1),
                                                  "grove": ("cell", 48, GROVE_SALT), "bamboo": ("cell", 24, BAMBOO_SALT),
                                                  "sun": ("cell", 20, SUNFLOWER_SALT)})
    d = F.col("_d")
    riparian = F.coalesce(F.col("fresh_water_distance") <= RIPARIAN_DISTANCE, F.lit(False))
    tree = F.when(riparian & zone.isin(*WILLOW_BANKS) & (d["tree"] < 0.6), "WILLOW")
    tree = tree.when(riparian & zone.isin("DESERT", "SEMI_DESERT"), "PALM").when((zone == "BEACH") & F.col("warm"), "PALM")
    for name, low, high, steps in GROVES:
        tree = tree.when((zone == name) & (d["grove"] >= low) & (d["grove"] < high), _pick(d["tree"], steps))
    tree = tree.otherwise(_by_zone(zone, d["tree"], TREE_GROUPS))
    plant = (F.when((zone == "TROPICAL_RAINFOREST") & (d["bamboo"] < 0.10) & (d["plant"] < 0.5), "BAMBOO")
             .when((zone == "TEMPERATE_FOREST") & d["grove"].between(0.15, 0.1999999999) & (d["plant"] < 0.3), "PINK_PETALS")
             .when((zone == "GRASSLAND") & (d["sun"] < 0.05), F.when(d["plant"] < 0.5, "SUNFLOWER").otherwise("SHORT_GRASS"))
             .otherwise(_by_zone(zone, d["plant"], PLANT_GROUPS)))
    return columns.withColumn("_d", draws).withColumn("tree_group", tree).withColumn("plant_group", plant).drop("_d")


def _field_draws(x: Column, z: Column) -> Column:
    """Struct of a field's id bits and its two uniform draws, plus the column's own roll."""
    schema = T.StructType([T.StructField("low", T.IntegerType()), T.StructField("kind", T.DoubleType()),
                           T.StructField("tilled", T.DoubleType()), T.StructField("roll", T.DoubleType())])

    @F.pandas_udf(schema)
    def draw(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ax, bz = a.to_numpy(), b.to_numpy()
        field = cell_hash_np(ax // FIELD_SIZE, bz // FIELD_SIZE, FIELD_SALT)
        tilled = unit_np(cell_hash_np(ax // FIELD_SIZE, bz // FIELD_SIZE, TILLED_SALT))
        roll = unit_np(cell_hash_np(ax, bz, ROLL_SALT + 2))
        return pd.DataFrame({"low": (field & np.uint64(0xFFF)).astype(np.int32), "kind": unit_np(field),
                             "tilled": tilled, "roll": roll})
    return draw(x.cast("bigint"), z.cast("bigint"))


def cropland_plan(columns: DataFrame, share: float = 0.04) -> DataFrame:
    """What grows on flat arable cropland: ``field`` is a crop, a channel, a gap or NULL (not farmed)."""
    d, zone = F.col("_f"), F.col("biome")
    arable = (F.col("flat") & (F.col("landcover") == "CROPLAND") & zone.isin(*ARABLE_ZONES) & (F.col("water_type") == "NONE")
              & F.col("top").isin("GRASS_BLOCK", "DIRT", "PODZOL"))
    across = F.when(d["low"] % 2 == 0, F.pmod("bz", F.lit(FIELD_SIZE))).otherwise(F.pmod("bx", F.lit(FIELD_SIZE)))
    warm = zone.isin("SAVANNA", "TROPICAL_RAINFOREST", "TROPICAL_SEASONAL_FOREST")
    fruit = F.when(warm & (d["kind"] < 0.16), "MELON").otherwise("PUMPKIN")
    crop = _pick(d["kind"], ((0.55, "WHEAT"), (0.72, "POTATOES"), (0.88, "CARROTS"), (1.01, "BEETROOTS")))
    planned = (F.when(~arable | (F.lit(share < 1.0) & (d["tilled"] >= share)) | (d["kind"] < 0.12), F.lit(None))
               .when(across % CHANNEL_EVERY == CHANNEL_EVERY // 2, "CHANNEL")
               .when((d["kind"] < 0.20) & (d["roll"] < 0.5), F.concat(fruit, F.lit("_STEM")))
               .when((d["kind"] < 0.20) & (d["roll"] < 0.72), fruit).when(d["kind"] < 0.20, "GAP")
               .when(d["roll"] < 0.92, crop).otherwise("GAP"))
    return columns.withColumn("_f", _field_draws(F.col("bx"), F.col("bz"))).withColumn("field", planned).drop("_f")


def underwater_habitat(columns: DataFrame, density: float = 1.0, length_fraction: float = 1.0, max_height: int = 0) -> DataFrame:
    """Habitat of water columns: ``habitat`` label and ``kelp_height`` where kelp stands."""
    depth, zone, kind = F.col("water_surface_y") - F.col("surface_y"), F.col("biome"), F.col("water_type")
    draws = cell_draws(F.col("bx"), F.col("bz"), {"roll": ("cell", 1, ROLL_SALT + 3), "reef": ("smooth", 32, CORAL_SALT),
                                                  "forest": ("smooth", 40, KELP_SALT), "gap": ("cell", 1, KELP_GAP_SALT)})
    d = F.col("_d")
    roll = d["roll"]

    def kelp(chance: float) -> Column:
        return (depth >= 5) & (d["forest"] > 0.55) & (roll < 0.30 * chance)

    fresh = (F.when(zone == "FROZEN_OCEAN", "NONE").when((depth <= 3) & (roll < 0.07 * density), "LILY_PAD")
             .when((depth >= 2) & (roll < 0.22 * density), "SEAGRASS").otherwise("NONE"))
    reef = (F.when(roll < 0.35 * density, "CORAL").when(roll < 0.45 * density, "SEA_PICKLE")
            .when(roll < 0.65 * density, "SEAGRASS").otherwise("NONE"))
    warm = (F.when((depth <= 14) & (d["reef"] > 0.62), reef)
            .when((depth >= 2) & (roll < 0.18 * density), "SEAGRASS").otherwise("NONE"))
    mild = F.when(kelp(density), "KELP").when((depth >= 2) & (roll < 0.14 * density), "SEAGRASS").otherwise("NONE")
    deep = F.when(kelp(density * 0.6), "KELP").when((depth >= 2) & (roll < 0.04 * density), "SEAGRASS").otherwise("NONE")
    label = (F.when((kind == "NONE") | (depth < 1) | F.lit(density == 0.0), "NONE").when(kind.isin("LAKE", "RIVER"), fresh)
             .when(zone == "WARM_OCEAN", warm).when(zone == "OCEAN", mild).when(zone == "DEEP_OCEAN", deep).otherwise("NONE"))
    reach = F.greatest(F.lit(1), depth - 1 - F.floor(d["gap"] * 8.0).cast("int"))
    height = F.greatest(F.lit(1), F.least(F.lit(MAX_KELP), F.floor((reach + 1) / 2).cast("int")))
    kept = F.when(height <= 1, height).otherwise(
        F.least(F.greatest(F.ceil(height * length_fraction - 1e-9).cast("int"), F.lit(1)), height))
    kept = F.least(kept, F.lit(max_height)) if max_height > 0 else kept
    return (columns.withColumn("_d", draws).withColumn("habitat", label)
            .withColumn("kelp_height", F.when(F.col("habitat") == "KELP", kept)).drop("_d"))


def _site_draws(cx: Column, cz: Column, spacing: int, chance: float) -> Column:
    schema = T.StructType([T.StructField("is_site", T.BooleanType()), T.StructField("kind_roll", T.DoubleType())])

    @F.pandas_udf(schema)
    def draw(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, z = a.to_numpy(), b.to_numpy()
        sx, sz = x // spacing, z // spacing
        h = cell_hash_np(sx, sz, SITE_SALT)
        span = np.uint64(spacing - 2)
        ox = 1 + ((h >> np.uint64(8)) % span).astype(np.int64)
        oz = 1 + ((h >> np.uint64(24)) % span).astype(np.int64)
        chosen = (unit_np(h) < chance) & (x == sx * spacing + ox) & (z == sz * spacing + oz)
        return pd.DataFrame({"is_site": chosen, "kind_roll": unit_np(cell_hash_np(x, z, KIND_SALT))})
    return draw(cx.cast("bigint"), cz.cast("bigint"))


def site_chunks(chunks: DataFrame, spacing: int = 12, chance: float = 0.6) -> DataFrame:
    """At most one chunk per spacing-by-spacing square, never on its rim; adds ``kind_roll``."""
    if spacing < 3:
        raise ValueError("spacing must be at least 3 chunks")
    drawn = chunks.withColumn("_s", _site_draws(F.col("cx"), F.col("cz"), spacing, chance))
    return drawn.filter("_s.is_site").withColumn("kind_roll", F.col("_s.kind_roll")).drop("_s")


def site_kind(biome: Column, coast: Column, roll: Column) -> Column:
    chain = F.when(coast & biome.isin("BEACH", "STONY_SHORE"), "SHIPWRECK")
    for zones, steps in SITE_KINDS:
        chain = chain.when(biome.isin(*zones), _pick(roll, steps))
    return chain


def _chunk(terrain: DataFrame) -> list[Column]:
    """The chunk of a column; where the frame names it, it may be dealt by it."""
    if {"cx", "cz"} <= set(terrain.columns):
        return [F.col("cx"), F.col("cz")]
    return [F.shiftright("bx", 4).alias("cx"), F.shiftright("bz", 4).alias("cz")]


def chunk_centres(terrain: DataFrame) -> DataFrame:
    """Per chunk: climate of the land column nearest the middle, and whether sea touches it."""
    lx, lz = F.pmod("bx", F.lit(16)), F.pmod("bz", F.lit(16))
    distance = F.abs(lx - 8) + F.abs(lz - 8)
    land = F.col("water_type") == "NONE"
    order = F.struct(distance.alias("d"), lz.alias("z"), lx.alias("x"))
    return terrain.groupBy(*_chunk(terrain)).agg(
        F.min_by(F.when(land, F.col("biome")), F.when(land, order)).alias("land_biome"),
        F.bool_or(F.col("water_type") == "OCEAN").alias("coast"),
        F.min(F.when(land, distance)).alias("land_distance"))


def flattest_footprint(terrain: DataFrame, radii: DataFrame) -> DataFrame:
    """The flattest square of each chunk that fits a radius.

    ``radii`` has cx, cz, radius and wreck (wrecks need some water, at most half). Returns the
    centre (x, z in the chunk), its relief and floor height: the median, or one below the
    highest ground of a wreck. Footprints never leave the chunk, so a group is 256 columns.
    """
    size = 16

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros((size, size), dtype=np.int64)
        wet = np.zeros((size, size), dtype=bool)
        lx, lz = pdf["bx"].to_numpy() % size, pdf["bz"].to_numpy() % size
        y[lz, lx], wet[lz, lx] = pdf["surface_y"].to_numpy(), pdf["_wet"].to_numpy(dtype=bool)
        radius, wreck = int(pdf["radius"].iloc[0]), bool(pdf["wreck"].iloc[0])
        side = 2 * radius + 1
        if len(pdf) < size * size or size - 2 * radius - 2 < 1:
            return pd.DataFrame(columns=["cx", "cz", "x", "z", "relief", "floor_y"])
        ground = np.lib.stride_tricks.sliding_window_view(y, (side, side)).reshape(size - side + 1, size - side + 1, -1)
        water = np.lib.stride_tricks.sliding_window_view(wet, (side, side)).sum(axis=(2, 3))
        relief = ground.max(axis=2) - ground.min(axis=2)
        centre = np.arange(size - side + 1) + radius
        zz, xx = np.meshgrid(centre, centre, indexing="ij")
        fits = (np.minimum(zz, xx) >= radius + 1) & (np.maximum(zz, xx) <= size - radius - 2) & ~wet[zz, xx]
        fits &= ((water > 0) & (water <= side * side // 2)) if wreck else (water == 0) & (relief <= MAX_SITE_RELIEF)
        rows, cols = np.nonzero(fits)
        if rows.size == 0:
            return pd.DataFrame(columns=["cx", "cz", "x", "z", "relief", "floor_y"])
        off = np.abs(xx - 8) + np.abs(zz - 8)
        first = np.lexsort((cols, rows, off[rows, cols], relief[rows, cols]))[0]
        r, c = rows[first], cols[first]
        heights = np.sort(ground[r, c])
        floor = heights[-1] - 1 if wreck else heights[heights.size // 2]
        return pd.DataFrame([[key[0], key[1], xx[r, c], zz[r, c], relief[r, c], floor]],
                            columns=["cx", "cz", "x", "z", "relief", "floor_y"])

    keyed = (terrain.select("bx", "bz", "surface_y", (F.col("water_type") != "NONE").alias("_wet"),
                            *_chunk(terrain)).join(radii, ["cx", "cz"]))
    return keyed.groupBy("cx", "cz").applyInPandas(best, "cx int, cz int, x int, z int, relief int, floor_y int")


# Footprint radius per site kind.
SITE_RADII = {"DESERT_RUIN": 4, "JUNGLE_SHRINE": 4, "WATCHTOWER": 3, "CRYPT": 2, "CAMP": 4, "STONE_CIRCLE": 5,
              "SNOW_SHELTER": 3, "MOUNTAIN_HUT": 3, "SHIPWRECK": 4}


# Free blocks a kind needs above its floor, and below it for the deepest one.
SITE_HEADROOM = {"DESERT_RUIN": 3, "JUNGLE_SHRINE": 6, "WATCHTOWER": 4, "CRYPT": 6, "CAMP": 4, "STONE_CIRCLE": 4,
                 "SNOW_SHELTER": 4, "MOUNTAIN_HUT": 5, "SHIPWRECK": 5}
SITE_DEPTH = 11


def site_suitability(terrain: DataFrame, min_y: int, max_y: int, spacing: int = 12, chance: float = 0.6) -> DataFrame:
    """Candidate sites with their kind and flattest footprint; sites too near the world's floor or
    ceiling are left out."""
    centres = chunk_centres(terrain).filter("land_biome IS NOT NULL")
    sites = site_chunks(centres, spacing, chance).withColumn("kind", site_kind(F.col("land_biome"), F.col("coast"), F.col("kind_roll")))
    kinds = sites.filter("kind IS NOT NULL").select(
        "cx", "cz", "kind", "land_biome", _value_of(F.col("kind"), SITE_RADII).cast("int").alias("radius"),
        _value_of(F.col("kind"), SITE_HEADROOM).cast("int").alias("headroom"), (F.col("kind") == "SHIPWRECK").alias("wreck"))
    found = flattest_footprint(terrain, kinds.select("cx", "cz", "radius", "wreck"))
    placed = kinds.select("cx", "cz", "kind", "land_biome", "headroom").join(found, ["cx", "cz"])
    fits = (F.col("floor_y") - SITE_DEPTH - 2 > min_y) & (F.col("floor_y") + F.col("headroom") + 2 < max_y - 1)
    return placed.filter(fits).drop("headroom")


# Mineral bands as (name, mineral, vein size, count, lowest, highest, triangular, extends down).
BANDS = (("coal", "COAL", 17, 20.0, 0, 127, False, False), ("iron", "IRON", 9, 20.0, 0, 63, False, True),
         ("copper", "COPPER", 10, 6.0, 0, 96, False, False), ("gold", "GOLD", 9, 2.0, 0, 31, False, True),
         ("redstone", "REDSTONE", 8, 8.0, 0, 15, False, True), ("diamond", "DIAMOND", 8, 1.0, 0, 15, False, True),
         ("lapis", "LAPIS", 7, 1.0, 0, 30, True, True), ("granite", "GRANITE", 33, 10.0, 0, 79, False, True),
         ("diorite", "DIORITE", 33, 10.0, 0, 79, False, True), ("andesite", "ANDESITE", 33, 10.0, 0, 79, False, True),
         ("tuff", "TUFF", 33, 4.0, 0, 16, False, True), ("blackstone", "BLACKSTONE", 33, 2.0, 0, 12, False, True))
# Bands above the old ceiling, per 128 blocks, and through the whole height, per 256.
HIGH_BANDS = (("coal_high", "COAL", 17, 10.0), ("iron_high", "IRON", 9, 6.0))
WHOLE_BANDS = (("dirt", "DIRT", 33, 10.0), ("gravel", "GRAVEL", 33, 8.0))
EMERALD = ("emerald", "EMERALD", 1, 5.5, 4, 31)
EMERALD_MIN_METERS, OLD_SEA_LEVEL, OLD_CEILING = 1000.0, 63, 127


def mineral_bands(floor_y: int, sea_level: int, top_y: int, emerald_multiplier: float = 1.0) -> list[tuple]:
    """Bands shifted with the sea level and clipped to the world: (band, mineral, vein size,
    count per chunk, min_y, max_y, triangular, least elevation)."""
    shift, ceiling = sea_level - OLD_SEA_LEVEL, top_y - 1
    bands = []
    for name, mineral, size, count, low, high, triangular, deep in BANDS:
        lo, hi = max(floor_y, low + shift), min(ceiling, high + shift)
        if lo <= hi:
            bands.append((name, mineral, size, count, lo, hi, triangular, None))
        if deep and floor_y < low + shift:
            hi = min(low + shift - 1, ceiling)
            bands.append((f"{name}_deep", mineral, size, count / (high - low + 1) * (hi - floor_y + 1), floor_y, hi, False, None))
    for name, mineral, size, count in HIGH_BANDS:
        lo = max(floor_y, OLD_CEILING + shift + 1)
        if lo <= ceiling:
            bands.append((name, mineral, size, count * (ceiling - lo + 1) / 128.0, lo, ceiling, False, None))
    for name, mineral, size, count in WHOLE_BANDS:
        if floor_y <= ceiling:
            bands.append((name, mineral, size, count * (ceiling - floor_y + 1) / 256.0, floor_y, ceiling, False, None))
    name, mineral, size, count, low, high = EMERALD
    lo, hi = max(floor_y, low + shift), min(ceiling, high + shift)
    if emerald_multiplier > 0 and lo <= hi:
        bands.append((name, mineral, size, count * emerald_multiplier, lo, hi, False, EMERALD_MIN_METERS))
    return bands


def expected_minerals(terrain: DataFrame, floor_y: int, sea_level: int, top_y: int, multiplier: float = 1.0,
                      emerald_multiplier: float = 1.0) -> DataFrame:
    """Expected veins below each column's surface: one row per column and band that reach each other.

    A band's count is per chunk and spreads over its 256 columns and its height, evenly or, for
    triangular bands, as the sum of two even draws. The chunk (cx, cz) of a column is kept if it is there.
    """
    place = [c for c in ("cx", "cz", "bx", "bz") if c in terrain.columns]
    bands = F.array(*[F.struct(
        F.lit(b[0]).alias("band"), F.lit(b[1]).alias("mineral"), F.lit(b[3] * multiplier).alias("count"), F.lit(b[4]).alias("min_y"),
        F.lit(b[5]).alias("max_y"), F.lit(b[6]).alias("triangular"), F.lit(b[7]).cast("double").alias("least_m"))
        for b in mineral_bands(floor_y, sea_level, top_y, emerald_multiplier)])
    crossed = terrain.select(*place, "surface_y", "elevation_m", F.explode(bands).alias("b")).select("*", "b.*").drop("b")
    low = F.greatest(F.col("min_y"), F.lit(floor_y))
    high = F.least("max_y", "surface_y")
    span = F.col("max_y") - F.col("min_y")
    half = F.floor(span / 2)

    def ways(k: Column) -> Column:
        """Pairs (i, j) with i <= half, j <= span - half and i + j <= k."""
        def below(n: Column) -> Column:
            return F.when(n >= 0, (n + 1) * (n + 2) / 2.0).otherwise(0.0)
        return below(k) - below(k - half - 1) - below(k - (span - half) - 1) + below(k - span - 2)

    peaked = (ways(high - F.col("min_y")) - ways(low - F.col("min_y") - 1)) / ((half + 1) * (span - half + 1))
    share = F.when(F.col("triangular"), peaked).otherwise((high - low + 1) / (span + 1))
    high_enough = F.col("least_m").isNull() | (F.col("elevation_m") >= F.col("least_m"))
    return (crossed.filter((low <= high) & high_enough)
            .select(*place, "band", "mineral", (F.col("count") / 256.0 * share).alias("expected_veins")))


def chunk_count(expected: Column, roll: Column) -> Column:
    """Whole part plus one more with the probability of the fraction."""
    return (F.floor(expected) + F.when(roll < expected - F.floor(expected), 1).otherwise(0)).cast("int")


def _karst_hash(lat: Column, lon: Column, a_lat: Column, a_lon: Column) -> Column:
    """64-bit mix of an anchor position and the point's cell of a ten-thousandth degree."""
    @F.pandas_udf(T.LongType())
    def mix(y: pd.Series, x: pd.Series, ay: pd.Series, ax: pd.Series) -> pd.Series:
        u = np.uint64
        bits_y, bits_x = (np.ascontiguousarray(v.to_numpy(dtype=np.float64)).view(u) for v in (ay, ax))
        rotated = (bits_x << u(17)) | (bits_x >> u(47))
        cell_y, cell_x = (np.floor(v.to_numpy() * 10_000).astype(np.int64).view(u) for v in (y, x))
        with np.errstate(over="ignore"):
            h = bits_y ^ rotated ^ (cell_y << u(32)) ^ cell_x
            h = (h ^ (h >> u(33))) * u(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> u(33))) * u(0xC4CEB9FE1A85EC53)
        return pd.Series((h ^ (h >> u(33))).view(np.int64))
    return mix(lat, lon, a_lat, a_lon)


def karst_sites(terrain: DataFrame, karst: ShapeIndex, entrances: DataFrame | str, base_y: int, max_degrees: float = 0.05) -> DataFrame:
    """Dry karst columns that a hash selects (about one in 128), with the height of the cavity.

    The hash is anchored at the nearest known entrance, so that cavities gather around it. It comes first: only what it
    leaves is looked up among the shapes. ``entrances`` are rows, or the name of a column that lists them for each row (see
    :func:`~cartolith.operators.nearest.list_nearest`): columns of a chunk share one list and need no shuffle.
    """
    from cartolith.operators.nearest import nearest_listed, nearest_within_degrees
    dry = terrain.filter("water_type = 'NONE'")
    if isinstance(entrances, str):
        # a list of one: as a plain column it would be worked out for each mention, also below the filter on the hash
        near = dry.withColumn("_e", F.explode(F.array(nearest_listed(entrances, max_degrees)))).drop(entrances)
    else:
        near = nearest_within_degrees(dry, entrances, ["bx", "bz"], max_degrees, F.col("id"), ["lat", "lon"], "_e")
    h = _karst_hash(F.col("lat"), F.col("lon"), F.coalesce("_e.lat", "lat"), F.coalesce("_e.lon", "lon"))
    hashed = near.withColumn("_h", h).filter(F.col("_h").bitwiseAND(0x7F) == 0)
    depth = F.shiftrightunsigned("_h", 8).bitwiseAND(31).cast("int")
    y = F.greatest(F.lit(base_y + 8), F.least(F.col("surface_y") - 8, F.lit(base_y + 16) + depth))
    found = within_shapes(hashed, karst, ["bx", "bz"])
    return found.select("bx", "bz", "lat", "lon", "surface_y", F.col("_e").isNotNull().alias("anchored"), y.cast("int").alias("cavity_y"))
