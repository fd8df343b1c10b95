"""The terrain fact table: one row per grid column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cartolith.functions import climate
from cartolith.functions.coords import Grid
from cartolith.functions.noise import cell_smooth
from cartolith.functions.vertical import round_half_up, to_y
from cartolith.functions.water import place_water
from cartolith.operators.chunk_lookup import look_up
from cartolith.operators.raster import LandcoverIndex, elevation_at, footprint_mean, landcover_at
from cartolith.operators.shapes import ShapeIndex
from cartolith.operators.shaping import PATCH, shape_surface
from cartolith.operators.water import water_column, water_column_at
from cartolith.params import TerrainParams
from cartolith.session import spread

# Noise that varies water depth.
DEPTH_NOISE_CELL = 12
DEPTH_NOISE_SALT = 0xBED0DE9700000001

KEY = ["bx", "bz"]


@dataclass(frozen=True)
class TerrainSources:
    """Interchangeable inputs of the terrain build; anything may be missing.

    Without elevation every column uses the fallback height; without water shapes the sea
    starts below zero metres; without land cover every class is ``constant_landcover``.
    """

    dem: DataFrame | None = None
    water: ShapeIndex | None = None
    landcover: LandcoverIndex | None = None
    has_ocean: bool = False
    has_bathymetry: bool = False
    constant_landcover: str = "UNKNOWN"
    wander: bool = True


def _neighbours(margin: int) -> list[tuple[int, int]]:
    reach = (margin + 15) // 16
    return [(dx, dz) for dx in range(-reach, reach + 1) for dz in range(-reach, reach + 1)]


def _chunks_in_reach(chunks: DataFrame, margin: int) -> DataFrame:
    """Chunks with a column within the margin of an asked one: cx, cz and _n0.. (is the neighbour asked for)."""
    asked = chunks.select("cx", "cz").distinct()
    near = _neighbours(margin)
    # each chunk in reach learns which of its neighbours are asked for, so a column is made once whatever borders on it
    beside = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx, dz in near]))
    return (spread(asked.withColumn("_o", beside).select((F.col("cx") + F.col("_o.dx")).alias("cx"), (F.col("cz") + F.col("_o.dz")).alias("cz"), "_o"), "cx", "cz")
              .groupBy("cx", "cz").agg(*[F.bool_or((F.col("_o.dx") == dx) & (F.col("_o.dz") == dz)).alias(f"_n{i}") for i, (dx, dz) in enumerate(near)]))


def chunk_columns(chunks: DataFrame, margin: int = 0) -> DataFrame:
    """Columns of distinct chunks (cx, cz) plus a margin; ``own`` marks those asked for."""
    near, listed = _neighbours(margin), _chunks_in_reach(chunks, margin)
    span = F.sequence(F.lit(0), F.lit(15))
    within = F.lit(False)
    for i, (dx, dz) in enumerate(near):  # an asked chunk at (cx - dx, cz - dz)
        within = within | (F.col(f"_n{i}") & F.col("_x").between(-16 * dx - margin, -16 * dx + 15 + margin) & F.col("_z").between(-16 * dz - margin, -16 * dz + 15 + margin))
    return (listed.withColumn("_x", F.explode(span)).withColumn("_z", F.explode(span)).filter(within)
            .select((F.col("cx") * 16 + F.col("_x")).cast("int").alias("bx"), (F.col("cz") * 16 + F.col("_z")).cast("int").alias("bz"),
                    F.col(f"_n{near.index((0, 0))}").alias("own")))


def columns_by_chunk(chunks: DataFrame) -> DataFrame:
    """Columns of distinct chunks with their chunk (cx, cz), by which they are dealt: groups of a chunk need no shuffle.

    Other columns of the chunks, which must not repeat then, travel along.
    """
    span = F.sequence(F.lit(0), F.lit(15))
    rest = [c for c in chunks.columns if c not in ("cx", "cz")]
    dealt = spread(chunks if rest else chunks.select("cx", "cz").distinct(), "cx", "cz")
    return (dealt.withColumn("_x", F.explode(span)).withColumn("_z", F.explode(span))
            .select((F.col("cx") * 16 + F.col("_x")).cast("int").alias("bx"), (F.col("cz") * 16 + F.col("_z")).cast("int").alias("bz"), "cx", "cz", *rest))


def centre_boxes(chunks: DataFrame, params: TerrainParams) -> DataFrame:
    """Boxes around the centres of the columns of chunks (cx, cz); a chunk across 180 degrees has two."""
    def corner(at: float):
        return Grid(params).to_geographic(F.col("cx") * 16 + at, F.col("cz") * 16 + at)

    (north, west), (south, east) = corner(0.5), corner(15.5)
    ends = chunks.select("cx", "cz", north.alias("_n"), south.alias("_s"), west.alias("_w"), east.alias("_e"))

    def span(low, high):
        return F.struct(low.alias("min_lon"), high.alias("max_lon"))

    across = F.array(span(F.col("_w"), F.lit(180.0)), span(F.lit(-180.0), F.col("_e")))
    spans = F.explode(F.when(F.col("_w") > F.col("_e"), across).otherwise(F.array(span(F.col("_w"), F.col("_e")))))
    return ends.withColumn("_x", spans).select("cx", "cz", F.least("_n", "_s").alias("min_lat"), F.greatest("_n", "_s").alias("max_lat"), "_x.*")


def columns_by_patch(chunks: DataFrame, reach: int, patch: int = PATCH) -> DataFrame:
    """Columns of distinct chunks, listed and dealt like :func:`~cartolith.operators.shaping.with_halo` does.

    Only chunks are shuffled; :func:`~cartolith.operators.shaping.map_patches` takes the columns as they lie.
    """
    def touched(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) * 16 - reach) / patch).cast("int"), F.floor((F.col(c) * 16 + 15 + reach) / patch).cast("int")))

    def near(b: str, p: str):
        return F.col(b).between(F.col(p) * patch - reach, F.col(p) * patch + patch - 1 + reach)

    span = F.sequence(F.lit(0), F.lit(15))
    listed = spread(chunks.select("cx", "cz").distinct().withColumn("_px", touched("cx")).withColumn("_pz", touched("cz")), "_px", "_pz")
    columns = (listed.withColumn("_x", F.explode(span)).withColumn("_z", F.explode(span))
               .select((F.col("cx") * 16 + F.col("_x")).cast("int").alias("bx"), (F.col("cz") * 16 + F.col("_z")).cast("int").alias("bz"), "_px", "_pz")
               .filter(near("bx", "_px") & near("bz", "_pz")))
    own = (F.floor(F.col("bx") / patch) == F.col("_px")) & (F.floor(F.col("bz") / patch) == F.col("_pz"))
    return columns.withColumn("_own", own)


def place_columns(columns: DataFrame, params: TerrainParams) -> DataFrame:
    """Add the centre of each column and the box its elevation is averaged over."""
    grid = Grid(params)
    lat, lon = grid.to_geographic(F.col("bx") + 0.5, F.col("bz") + 0.5)
    box = grid.chunk_bounds(F.shiftright("bx", 4), F.shiftright("bz", 4))
    return (columns.withColumn("lat", lat).withColumn("lon", lon)
            .withColumn("lat_span", (box[2] - box[0]) / 16 * params.smoothing)
            .withColumn("lon_span", (box[3] - box[1]) / 16 * params.smoothing))


def sample_columns(placed: DataFrame, sources: TerrainSources, params: TerrainParams,
                   key: list[str] | None = None) -> DataFrame:
    """Terrain facts of columns that carry lat, lon, lat_span and lon_span.

    Order of decisions: averaged ground, water, ice sheet, land cover, climate, heights.
    """
    key = key or KEY
    if sources.dem is None:
        known = placed.withColumn("_raw", F.lit(None).cast("double"))
    else:
        known = footprint_mean(placed, sources.dem, key, "_raw")
    if sources.water is None:
        kind = F.when(F.col("_raw") < 0.0, "OCEAN").otherwise("NONE")
        known = known.withColumn("_found", F.struct(
            kind.alias("water_type"), F.when(kind == "OCEAN", 0.0).alias("surface_m"), F.lit(0.0).alias("bed_depth_m")))
    else:
        known = water_column_at(known, sources.water, key, sources.has_ocean, "_found", meters="_raw")
    if sources.landcover is None:
        known = known.withColumn("landcover", F.lit(sources.constant_landcover))
    else:
        known = landcover_at(known, sources.landcover, key)

    offsets = None
    if sources.wander:
        known = known.withColumn("_w", climate.wander(F.col("lat"), F.col("lon")))
        offsets = F.col("_w")
    row = F.when(F.col("lat_span") > 0, F.floor(F.col("lat") / F.col("lat_span")))
    col = F.when(F.col("lon_span") > 0, F.floor(F.col("lon") / F.col("lon_span")))
    draw = cell_smooth(F.coalesce(col, F.lit(0)), F.coalesce(row, F.lit(0)), DEPTH_NOISE_CELL, DEPTH_NOISE_SALT)
    known = known.withColumn("_draw", F.when(row.isNotNull() & col.isNotNull(), draw).otherwise(0.0))
    extra = [c for c in placed.columns if c not in (*key, "lat", "lon", "lat_span", "lon_span")]
    return _settled(known, sources, params, [*key, *extra], offsets)


def _settled(known: DataFrame, sources: TerrainSources, params: TerrainParams, kept: list[str], offsets: Column | None) -> DataFrame:
    """Terrain facts from ground (_raw), water (_found), land cover and draws; ``kept`` columns travel along."""
    settled = known.withColumn("_p", place_water(F.col("_raw"), F.col("_found"), params, sources.has_bathymetry))
    water = F.col("_p.water_type")
    ground = F.col("_p.meters")
    iced = F.when((water == "NONE") & climate.is_ice_sheet(F.col("lat")), climate.flatten_ice_sheet(ground)).otherwise(ground)
    settled = settled.withColumn("elevation_m", iced).withColumn("water_type", water)
    biome = climate.climate_biome(F.col("lat"), F.col("elevation_m"), F.col("water_type"), F.col("landcover"), offsets)

    wet = F.col("water_type") != "NONE"
    level = F.when(wet, to_y(F.col("_p.surface_m"), params)).otherwise(params.sea_level)
    least = (F.when(F.col("water_type") == "LAKE", params.min_lake_depth)
             .when(F.col("water_type") == "RIVER", params.min_river_depth)
             .when(F.col("water_type") == "OCEAN", params.min_ocean_depth).otherwise(0))
    heights = (settled.withColumn("biome", biome).withColumn("water_surface_y", level.cast("int"))
               .withColumn("_least", least)
               .withColumn("_y", to_y(F.col("elevation_m"), params)))
    deepest = F.col("water_surface_y") - F.greatest(
        F.lit(1), F.col("_least") + round_half_up(F.col("_draw") * F.col("_least")).cast("int"))
    surface = F.when(wet, F.least(F.col("_y"), deepest)).otherwise(F.col("_y"))
    return heights.select(*kept, "lat", "lon", "elevation_m", surface.alias("surface_y"), "water_type",
                          "water_surface_y", "landcover", "biome", F.col("_p.from_fallback").alias("from_fallback"))


def placed_chunks(chunks: DataFrame, params: TerrainParams, margin: int = 0) -> DataFrame:
    """Chunks (cx, cz) and those within a margin, with the places of their columns: lats by row, lons by column, spans of a box."""
    grid = Grid(params)
    at = F.sequence(F.lit(0), F.lit(15))
    lats = F.transform(at, lambda i: grid.to_geographic(F.col("cx") * 16 + 0.5, (F.col("cz") * 16 + i).cast("int") + 0.5)[0])
    lons = F.transform(at, lambda i: grid.to_geographic((F.col("cx") * 16 + i).cast("int") + 0.5, F.col("cz") * 16 + 0.5)[1])
    box = grid.chunk_bounds(F.col("cx"), F.col("cz"))
    flags = F.array(*[F.col(f"_n{i}") for i in range(len(_neighbours(margin)))])
    return _chunks_in_reach(chunks, margin).select("cx", "cz", flags.alias("near"), lats.alias("lats"), lons.alias("lons"),
                                                   ((box[2] - box[0]) / 16 * params.smoothing).alias("lat_span"), ((box[3] - box[1]) / 16 * params.smoothing).alias("lon_span"))


def chunk_spots(placed: DataFrame, size: float) -> DataFrame:
    """A spot (lat, lon) in each cell of ``size`` degrees that columns of placed chunks may lie in."""
    def cells(c: str):
        return F.explode(F.array_distinct(F.transform(c, lambda v: F.floor(v / size))))

    spots = placed.withColumn("_cy", cells("lats")).withColumn("_cx", cells("lons")).select("_cy", "_cx").distinct()
    return spots.select(F.least((F.col("_cy") + 0.5) * size, F.lit(90.0)).alias("lat"), F.least((F.col("_cx") + 0.5) * size, F.lit(180.0)).alias("lon"))


def sample_chunks(chunks: DataFrame, sources: TerrainSources, params: TerrainParams, margin: int = 0) -> DataFrame:
    """:func:`sample_columns` of the columns of whole chunks and of a margin (``own`` tells), looked up by chunk: columns are not shuffled.

    Chunks may be given as :func:`placed_chunks` makes them, which are read several times.
    """
    placed = chunks if "lats" in chunks.columns else placed_chunks(chunks, params, margin)
    facts = look_up(placed, sources.dem, sources.water, sources.landcover, sources.wander, _neighbours(margin), margin, DEPTH_NOISE_CELL, DEPTH_NOISE_SALT)
    if sources.water is None:
        kind = F.when(F.col("_raw") < 0.0, "OCEAN").otherwise("NONE")
        known = facts.withColumn("_found", F.struct(kind.alias("water_type"), F.when(kind == "OCEAN", 0.0).alias("surface_m"), F.lit(0.0).alias("bed_depth_m")))
    else:
        hit = F.when(F.col("_kind").isNotNull(), F.struct(F.col("_kind").alias("water_type"), F.col("_surface").alias("surface_elevation_m"), F.col("_bed").alias("bed_depth_m")))
        known = facts.withColumn("_found", water_column(hit, F.col("_raw"), sources.has_ocean))
        if sources.water.has_long:
            lasting = facts.where("_open")
            known = known.where("NOT _open").unionByName(water_column_at(lasting, sources.water, KEY, sources.has_ocean, "_found", meters="_raw"))
    if sources.landcover is None:
        known = known.withColumn("landcover", F.lit(sources.constant_landcover))
    return _settled(known, sources, params, [*KEY, "own"], F.col("_w") if sources.wander else None)


def terrain_margin(params: TerrainParams) -> int:
    """What the neighbourhood steps reach around a chunk."""
    return params.shore_blend + (2 if params.detail > 0 else 0)


def build_terrain(chunks: DataFrame, sources: TerrainSources, params: TerrainParams) -> DataFrame:
    """Finished terrain of whole chunks (cx, cz): sampled, detailed and shaped along shores.

    The area is widened by the reach of the neighbourhood steps and trimmed at the end, so a
    chunk comes out the same whatever is built around it.
    """
    sampled = sample_chunks(chunks, sources, params, terrain_margin(params))
    shaped = shape_surface(sampled, params.detail, params.shore_blend, params.min_y, params.max_y)
    return shaped.filter("own").drop("own")


def chunk_used_fallback(terrain: DataFrame) -> DataFrame:
    """Per chunk: does any column rest on the fallback elevation?"""
    return terrain.groupBy(F.shiftright("bx", 4).alias("cx"), F.shiftright("bz", 4).alias("cz")).agg(
        F.bool_or("from_fallback").alias("used_fallback"))


def write_terrain(terrain: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store terrain partitioned by regions of 32 by 32 chunks.

    Rows of a region are spread by chunk row, so that a single region is not a single task.
    """
    (terrain.withColumn("rx", F.shiftright("bx", 9)).withColumn("rz", F.shiftright("bz", 9))
     .repartition("rx", "rz", F.shiftright("bz", 4))
     .write.mode(mode).partitionBy("rx", "rz").parquet(path))


def column_layers(terrain: DataFrame, params: TerrainParams, filler_depth: int = 3) -> DataFrame:
    """Vertical intervals of each column: bedrock, stone, filler, top and water.

    ``terrain`` carries ``top`` and ``filler`` materials (see the surface palette). The ground
    never leaves the band between the bedrock and the ceiling. The chunk (cx, cz) of a column is kept if it is there.
    """
    base, ceiling = params.min_y, params.max_y - 1
    floor = base + params.bedrock_thickness

    def kept_in(y):
        return F.least(F.greatest(y, F.lit(floor)), F.lit(ceiling))

    surface = kept_in(F.col("surface_y"))
    water_to = F.when(F.col("water_type") != "NONE", kept_in(F.col("water_surface_y")))
    filler_from = F.greatest(surface - filler_depth, F.lit(floor))

    def layer(low, high, material):
        return F.struct(low.cast("int").alias("y_from"), high.cast("int").alias("y_to"), material.alias("material"))

    layers = F.array(layer(F.lit(base), F.lit(floor - 1), F.lit("BEDROCK")),
                     layer(F.lit(floor), filler_from - 1, F.lit("STONE")),
                     layer(filler_from, surface - 1, F.col("filler")), layer(surface, surface, F.col("top")),
                     layer(surface + 1, water_to, F.lit("WATER")))
    kept = F.filter(layers, lambda v: v["y_from"] <= v["y_to"])
    place = [c for c in ("cx", "cz", "bx", "bz") if c in terrain.columns]
    return terrain.select(*place, F.explode(kept).alias("_l")).select(*place, "_l.*")


def base_height(terrain: DataFrame) -> DataFrame:
    """Highest ground or water of each column."""
    top = F.when(F.col("water_type") != "NONE", F.greatest("surface_y", "water_surface_y")).otherwise(F.col("surface_y"))
    return terrain.select("bx", "bz", top.alias("base_height"))


def whereami(points: DataFrame, countries: ShapeIndex | None, regions: ShapeIndex | None, cities, dem: DataFrame | None,
             key: list[str]) -> DataFrame:
    """Answer "where am I" for every point: elevation, country, region and nearest city with
    its geodesic distance and direction. Inputs that are missing leave their columns NULL."""
    from cartolith.functions.geodesy import compass_point, initial_bearing, vincenty_m
    from cartolith.operators.nearest import nearest
    from cartolith.operators.shapes import locate

    found = points
    if dem is not None:
        found = elevation_at(found, dem)
    for shape_set, name in ((countries, "country"), (regions, "region")):
        if shape_set is not None:
            found = locate(found, shape_set, key, name)
    if cities is not None:
        found = nearest(found, cities, "city")
        there = (F.col("lat"), F.col("lon"), F.col("city.lat"), F.col("city.lon"))
        found = (found.withColumn("city_meters", F.when(F.col("city").isNotNull(), vincenty_m(*there)))
                 .withColumn("city_direction", compass_point(initial_bearing(*there))))
    return found
