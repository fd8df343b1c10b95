"""Registered scalar functions over every customer position or shipment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartolith.functions import climate, coords, geodesy, text, vertical, water
from cartolith.functions.coords import Grid
from cartolith.functions.projections import web_mercator
from cartolith.params import TerrainParams, profile_for_bounds
from cartolith.plans.derived import Tables, with_tables
from cartolith.plans.registry import registered

_P = with_tables("points")
RELIEF = TerrainParams(sea_level=0, min_y=-512, max_y=512, meters_per_block=20.0, relief_curve_meters=4000.0)


def _r(column, digits: int):
    return F.round(column, digits) + 0.0


@registered("normalise_longitude", _P + "SELECT id, round(((lon * 3 + 180) % 360 + 360) % 360 - 180, 6) + 0e0 AS lon FROM points")
def normalise_longitude(t: Tables) -> DataFrame:
    return t.points.select("id", _r(coords.normalise_longitude(F.col("lon") * 3), 6).alias("lon"))


@registered("valid_points", _P + """
SELECT id, greatest(least(lat * 1.2e0, 90), -90) AS lat, lat * 1.2e0 BETWEEN -90 AND 90 AND lon * 1.1e0 BETWEEN -180 AND 180 AS ok FROM points""")
def valid_points(t: Tables) -> DataFrame:
    lat, lon = F.col("lat") * 1.2, F.col("lon") * 1.1
    return t.points.select("id", coords.clamp_latitude(lat).alias("lat"), coords.valid_point(lat, lon).alias("ok"))


@registered("region_boxes", with_tables("regions") + """
SELECT id, (min_lat + max_lat) / 2 AS mid_lat, (min_lon + max_lon) / 2 AS mid_lon, max_lat - min_lat AS lat_span, max_lon - min_lon AS lon_span,
       greatest(min_lat - 10, -90) AS out_s, min_lon - 10 AS out_w, least(max_lat + 10, 90) AS out_n, max_lon + 10 AS out_e,
       min_lat <= 55 AND max_lat >= 45 AND min_lon <= 20 AND max_lon >= 5 AS meets, 51 BETWEEN min_lat AND max_lat AND 10 BETWEEN min_lon AND max_lon AS holds
FROM regions""")
def region_boxes(t: Tables) -> DataFrame:
    box = coords.box_columns()
    mid, span, out = coords.box_center(box), coords.box_spans(box), coords.box_expand(box, 10.0)
    target = tuple(F.lit(v) for v in (45.0, 5.0, 55.0, 20.0))
    return t.regions.select(
        "id", mid[0].alias("mid_lat"), mid[1].alias("mid_lon"), span[0].alias("lat_span"), span[1].alias("lon_span"),
        out[0].alias("out_s"), out[1].alias("out_w"), out[2].alias("out_n"), out[3].alias("out_e"),
        coords.box_intersects(box, target).alias("meets"), coords.box_contains(box, F.lit(51.0), F.lit(10.0)).alias("holds"))


_CLIP = "greatest(least(lat, 85.05112877980659e0), -85.05112877980659e0)"


@registered("web_mercator", _P + f"""
SELECT id, round(6378137e0 * radians(lon), 3) + 0e0 AS east, round(6378137e0 * ln(tan(radians({_CLIP}) / 2 + pi() / 4)), 3) + 0e0 AS north,
       round(1 / cos(radians({_CLIP})), 6) + 0e0 AS scale, round({_CLIP}, 6) + 0e0 AS back_lat, round(lon, 6) + 0e0 AS back_lon FROM points""")
def mercator(t: Tables) -> DataFrame:
    p = web_mercator()
    east, north = p.forward(F.col("lat"), F.col("lon"))
    back = p.inverse(east, north)
    return t.points.select("id", _r(east, 3).alias("east"), _r(north, 3).alias("north"), _r(p.scale(F.col("lat")), 6).alias("scale"),
                           _r(back[0], 6).alias("back_lat"), _r(back[1], 6).alias("back_lon"))


_EAST = "(radians(lon) - radians(10e0)) * 6378137e0 * cos(radians(51e0)) / 1000"
_SOUTH = "(radians(51e0) - radians(lat)) * 6378137e0 / 1000"


@registered("to_grid", _P + f"""
SELECT id, round({_EAST}, 4) + 0e0 AS x, round({_SOUTH}, 4) + 0e0 AS z, cast(floor({_EAST}) AS int) AS bx, cast(floor({_SOUTH}) AS int) AS bz,
       cast(floor({_EAST}) AS int) >> 4 AS cx, cast(floor({_SOUTH}) AS int) >> 4 AS cz, cast(floor({_EAST}) AS int) & 15 AS lx,
       round(lat, 6) + 0e0 AS back_lat, round(lon, 6) + 0e0 AS back_lon, round(1000 / (cos(radians(51e0)) / cos(radians(lat))), 4) + 0e0 AS ground_m
FROM points""")
def to_grid(t: Tables) -> DataFrame:
    grid = Grid(TerrainParams())
    x, z = grid.to_grid(F.col("lat"), F.col("lon"))
    back = grid.to_geographic(x, z)
    bx, bz = coords.block_of(x), coords.block_of(z)
    return t.points.select("id", _r(x, 4).alias("x"), _r(z, 4).alias("z"), bx.alias("bx"), bz.alias("bz"), coords.chunk_of(bx).alias("cx"),
                           coords.chunk_of(bz).alias("cz"), coords.local_of(bx).alias("lx"), _r(back[0], 6).alias("back_lat"),
                           _r(back[1], 6).alias("back_lon"), _r(grid.ground_meters_per_block(F.col("lat")), 4).alias("ground_m"))


@registered("chunk_bounds", _P + f"""
, c AS (SELECT id, cast(floor({_EAST}) AS int) >> 4 AS cx, cast(floor({_SOUTH}) AS int) >> 4 AS cz FROM points)
SELECT id, round(greatest(51 - degrees((cz * 16 + 16) * 1000 / 6378137e0), -90), 6) + 0e0 AS min_lat, round(least(51 - degrees(cz * 16 * 1000 / 6378137e0), 90), 6) + 0e0 AS max_lat
FROM c""")
def chunk_bounds(t: Tables) -> DataFrame:
    """Latitude bounds of each customer's chunk."""
    grid = Grid(TerrainParams())
    x, z = grid.to_grid(F.col("lat"), F.col("lon"))
    keyed = t.points.select("id", coords.chunk_of(coords.block_of(x)).alias("cx"), coords.chunk_of(coords.block_of(z)).alias("cz"))
    box = grid.chunk_bounds(F.col("cx"), F.col("cz"))
    return keyed.select("id", _r(box[0], 6).alias("min_lat"), _r(box[2], 6).alias("max_lat"))


@registered("extent_clamp", _P + """
SELECT id, greatest(least(lon * 120, 20036.5e0), -20036.5e0) AS x, greatest(least(lat * 130, 10017.5e0), -10017.5e0) AS z,
       lon * 120 >= -20037 AND lon * 120 < 20037 AND lat * 130 >= -10018e0 AND lat * 130 < 10018e0 AS inside FROM points""")
def extent_clamp(t: Tables) -> DataFrame:
    extent = Grid(TerrainParams(projection="plate_carree", origin_lat=0.0, origin_lon=0.0)).planet_extent()
    x, z = F.col("lon") * 120, F.col("lat") * 130
    return t.points.select("id", F.round(extent.clamp_x(x, 0.5), 6).alias("x"), F.round(extent.clamp_z(z, 0.5), 6).alias("z"), extent.contains(x, z).alias("inside"))


@registered("bearing", _P + """
, b AS (SELECT id, (degrees(atan2(sin(radians(10 - lon)) * cos(radians(51e0)), cos(radians(lat)) * sin(radians(51e0)) - sin(radians(lat)) * cos(radians(51e0)) * cos(radians(10 - lon)))) + 360) % 360 AS v FROM points)
SELECT id, round(v, 6) + 0e0 AS bearing, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][cast(floor(v / 22.5 + 0.5) AS int) % 16 + 1] AS direction FROM b""")
def bearing(t: Tables) -> DataFrame:
    v = geodesy.initial_bearing(F.col("lat"), F.col("lon"), F.lit(51.0), F.lit(10.0))
    return t.points.select("id", _r(v, 6).alias("bearing"), geodesy.compass_point(v).alias("direction"))


@registered("tile_keys", _P + """
, k AS (SELECT id, greatest(least(cast(floor(lat) AS int), 89), -90) AS lat_deg, greatest(least(cast(floor(lon) AS int), 179), -180) AS lon_deg FROM points)
SELECT id, lat_deg, lon_deg, printf('%s%02d%s%03d', CASE WHEN lat_deg < 0 THEN 'S' ELSE 'N' END, abs(lat_deg), CASE WHEN lon_deg < 0 THEN 'W' ELSE 'E' END, abs(lon_deg)) AS name,
       lat_deg AS parsed_lat, lon_deg AS parsed_lon FROM k""")
def tile_keys(t: Tables) -> DataFrame:
    keyed = t.points.select("id", coords.tile_lat(F.col("lat")).alias("lat_deg"), coords.tile_lon(F.col("lon")).alias("lon_deg"))
    named = keyed.withColumn("name", coords.tile_stem(F.col("lat_deg"), F.col("lon_deg")))
    back = coords.parse_tile_name(F.col("name"))
    return named.select("*", back[0].alias("parsed_lat"), back[1].alias("parsed_lon"))


def _knee(y: str, u: int, l: int) -> str:
    return (f"CASE WHEN {y} > {u} THEN {u} + 7 * (({y} - {u}) / ({y} - {u} + 7)) "
            f"WHEN {y} < {l} THEN {l} - 7 * (({l} - {y}) / ({l} - {y} + 7)) ELSE {y} END")


@registered("vertical_scale", f"""
WITH v AS (SELECT o_orderkey, (o_totalprice - 250000) / 20 AS m FROM orders), r AS (SELECT o_orderkey, m, 63 + m AS y,
  sign(m) * 4000 * ln(1 + abs(m) / 4000) / 20 AS y2 FROM v)
SELECT o_orderkey, cast(floor({_knee('y', 312, -56)} + 0.5) AS int) AS linear_y, cast(floor({_knee('y2', 504, -504)} + 0.5) AS int) AS curved_y,
       round(m, 4) + 0e0 AS back_m FROM r""")
def vertical_scale(t: Tables) -> DataFrame:
    linear = TerrainParams()
    rows = t.base("orders").select("o_orderkey", ((F.col("o_totalprice") - 250000) / 20).alias("m"))
    back = vertical.to_elevation(vertical.raw_y(F.col("m"), RELIEF), RELIEF)
    return rows.select("o_orderkey", vertical.to_y(F.col("m"), linear).alias("linear_y"), vertical.to_y(F.col("m"), RELIEF).alias("curved_y"),
                       _r(back, 4).alias("back_m"))


@registered("landcover_codes", """
SELECT l_orderkey, l_linenumber, CASE cast(l_quantity AS int) * 5 WHEN 10 THEN 'TREE_COVER' WHEN 20 THEN 'SHRUBLAND' WHEN 30 THEN 'GRASSLAND' WHEN 40 THEN 'CROPLAND'
 WHEN 50 THEN 'BUILT_UP' WHEN 60 THEN 'BARE_SPARSE' WHEN 70 THEN 'SNOW_ICE' WHEN 80 THEN 'PERMANENT_WATER' WHEN 90 THEN 'HERBACEOUS_WETLAND' WHEN 95 THEN 'MANGROVES'
 WHEN 100 THEN 'MOSS_LICHEN' ELSE 'UNKNOWN' END AS landcover FROM lineitem""")
def landcover_codes(t: Tables) -> DataFrame:
    return t.base("lineitem").select("l_orderkey", "l_linenumber", climate.landcover_from_code(F.col("l_quantity").cast("int") * 5).alias("landcover"))


def _line_sql(values) -> str:
    parts = []
    for i in range(1, len(values)):
        a, b = climate.LINE_LATITUDES[i - 1], climate.LINE_LATITUDES[i]
        parts.append(f"WHEN a <= {b} THEN {values[i - 1]} + (a - {a}) / {b - a}e0 * {values[i] - values[i - 1]}")
    return "CASE " + " ".join(parts) + f" ELSE {values[-1]} END"


@registered("tree_and_snow_lines", _P + f""", l AS (SELECT id, abs(lat) AS a FROM points)
SELECT id, round({_line_sql(climate.TREELINE_M)}, 4) + 0e0 AS treeline, round(greatest(300, {_line_sql(climate.SNOWLINE_M)}), 4) + 0e0 AS snowline FROM l""")
def tree_and_snow_lines(t: Tables) -> DataFrame:
    return t.points.select("id", _r(climate.treeline_m(F.col("lat")), 4).alias("treeline"), _r(climate.snowline_m(F.col("lat")), 4).alias("snowline"))


_BIOME_SQL = f"""
CASE WHEN water = 'RIVER' THEN 'RIVER'
 WHEN water = 'LAKE' THEN CASE WHEN a >= 66.5 THEN 'FROZEN_OCEAN' ELSE 'LAKE' END
 WHEN water = 'OCEAN' THEN CASE WHEN a >= 66.5 THEN 'FROZEN_OCEAN' WHEN m < -1000 THEN 'DEEP_OCEAN' WHEN a < 23.5 THEN 'WARM_OCEAN' ELSE 'OCEAN' END
 WHEN lat <= -60 OR cover = 'SNOW_ICE' THEN 'GLACIER'
 WHEN m <= 3 THEN CASE WHEN a >= 66.5 THEN 'STONY_SHORE' ELSE 'BEACH' END
 WHEN m > greatest(300, {_line_sql(climate.SNOWLINE_M)}) THEN 'GLACIER'
 WHEN a >= 66.5 THEN CASE WHEN cover = 'BARE_SPARSE' THEN 'BARE_ROCK' ELSE 'TUNDRA' END
 WHEN m > tree + 800 THEN 'BARE_ROCK' WHEN m > tree THEN 'ALPINE'
 WHEN cover = 'MANGROVES' THEN 'MANGROVE' WHEN cover = 'HERBACEOUS_WETLAND' THEN 'WETLAND' WHEN cover = 'SHRUBLAND' THEN 'SHRUBLAND'
 WHEN cover IN ('GRASSLAND', 'CROPLAND') THEN CASE WHEN mtn THEN 'MOUNTAIN_MEADOW' WHEN a < 23.5 THEN 'SAVANNA' ELSE 'GRASSLAND' END
 WHEN cover = 'MOSS_LICHEN' THEN 'TUNDRA' WHEN cover = 'BARE_SPARSE' THEN CASE WHEN a < 35 THEN 'DESERT' ELSE 'BARE_ROCK' END
 WHEN mtn THEN 'MOUNTAIN_FOREST' WHEN a >= 55 THEN 'BOREAL_FOREST' WHEN a >= 23.5 THEN 'TEMPERATE_FOREST'
 WHEN a < 10 THEN 'TROPICAL_RAINFOREST' ELSE 'TROPICAL_SEASONAL_FOREST' END"""
_CASES_SQL = f"""WITH c AS (
SELECT l.l_orderkey, l.l_linenumber, ((l_orderkey * 8 + l_linenumber) * 7919 % 170000) / 1e3 - 85e0 AS lat,
       abs(((l_orderkey * 8 + l_linenumber) * 7919 % 170000) / 1e3 - 85e0) AS a, (l.l_extendedprice - 20000) / 15 AS m,
       ['NONE', 'OCEAN', 'LAKE', 'RIVER'][greatest(l.l_linenumber - 3, 1)] AS water,
       ['UNKNOWN','TREE_COVER','SHRUBLAND','GRASSLAND','CROPLAND','BUILT_UP','BARE_SPARSE','SNOW_ICE','PERMANENT_WATER','HERBACEOUS_WETLAND','MANGROVES','MOSS_LICHEN'][cast(l.l_quantity AS int) % 12 + 1] AS cover
FROM lineitem l),
d AS (SELECT *, {_line_sql(climate.TREELINE_M)} AS tree FROM c), e AS (SELECT *, m > 800 AND m > tree - 1000 AS mtn FROM d),
f AS (SELECT *, {_BIOME_SQL} AS biome FROM e)"""


def _climate_cases(t: Tables) -> DataFrame:
    """Shipments as climate cases: price as height, quantity as cover, line number as water."""
    from cartolith.params import LANDCOVER_CLASSES
    waters = F.array(*[F.lit(v) for v in ("NONE", "OCEAN", "LAKE", "RIVER")])
    covers = F.array(*[F.lit(v) for v in LANDCOVER_CLASSES])
    base = t._sql("SELECT *, ((l_orderkey * 8 + l_linenumber) * 7919 % 170000) / 1e3 - 85e0 AS lat FROM {lineitem}", "lineitem")
    cases = base.select("l_orderkey", "l_linenumber", "lat", ((F.col("l_extendedprice") - 20000) / 15).alias("m"),
                        F.element_at(waters, F.greatest(F.col("l_linenumber") - 3, F.lit(1))).alias("water"),
                        F.element_at(covers, F.col("l_quantity").cast("int") % 12 + 1).alias("cover"))
    return cases.withColumn("biome", climate.climate_biome(F.col("lat"), F.col("m"), F.col("water"), F.col("cover")))


@registered("climate_biome", _CASES_SQL + " SELECT l_orderkey, l_linenumber, biome FROM f")
def climate_biome(t: Tables) -> DataFrame:
    return _climate_cases(t).select("l_orderkey", "l_linenumber", "biome")


def _output_sql() -> str:
    out = "CASE "
    for name, label in climate.PLAIN_OUTPUT.items():
        out += f"WHEN biome = '{name}' THEN '{label}' "
    for name, (limit, below, beyond) in climate.LATITUDE_OUTPUT.items():
        out += f"WHEN biome = '{name}' THEN CASE WHEN a >= {limit} THEN '{beyond}' ELSE '{below}' END "
    for name, (low, high) in climate.HEIGHT_OUTPUT.items():
        out += f"WHEN biome = '{name}' THEN CASE WHEN m > 2000 THEN '{high}' ELSE '{low}' END "
    for name, (warm, mild, cold) in climate.SEA_OUTPUT.items():
        out += f"WHEN biome = '{name}' THEN CASE WHEN a >= 60 THEN '{cold}' WHEN a < 40 THEN '{warm}' ELSE '{mild}' END "
    return out + "END"


@registered("output_biome", _CASES_SQL + f" SELECT l_orderkey, l_linenumber, {_output_sql()} AS label FROM f")
def output_biome(t: Tables) -> DataFrame:
    return _climate_cases(t).select("l_orderkey", "l_linenumber", climate.output_biome(F.col("biome"), F.col("m"), F.col("lat")).alias("label"))


@registered("ice_sheet", _P + """
SELECT p.id, lat <= -60 AS ice, CASE WHEN lat <= -60 THEN round(greatest(20, 40 + 0.03 * greatest(0, c_acctbal)), 4) ELSE c_acctbal END AS meters
FROM points p JOIN customer c ON c.c_custkey = p.id""")
def ice_sheet(t: Tables) -> DataFrame:
    rows = t.points.join(t.base("customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id")
    ice = climate.is_ice_sheet(F.col("lat"))
    return rows.select("id", ice.alias("ice"), F.when(ice, F.round(climate.flatten_ice_sheet(F.col("c_acctbal")), 4)).otherwise(F.col("c_acctbal")).alias("meters"))


@registered("river_widths", """
WITH q AS (SELECT o_orderkey, o_totalprice / 100 AS q, (o_orderkey % 170) - 85 AS lat FROM orders), w AS (SELECT *, greatest(200e0, 7.2 * sqrt(q)) AS width FROM q),
d AS (SELECT *, width / (greatest(0.01, abs(cos(radians(lat)))) * (2.0 * 111320e0)) AS prepared, 3 * (1 + 0.5 * log10(greatest(40, q) / 40e0)) AS shown FROM w)
SELECT o_orderkey, round(width, 4) + 0e0 AS width_m, round(least(greatest(width / 20, 1), 10), 4) + 0e0 AS bed_m, round(shown, 6) + 0e0 AS shown_blocks,
       round(greatest(0, shown * degrees(200 / 6378137e0) / 2 - prepared), 9) + 0e0 AS extra_deg FROM d""")
def river_widths(t: Tables) -> DataFrame:
    rows = t.base("orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("q"), ((F.col("o_orderkey") % 170) - 85).alias("lat"))
    width = water.river_width_m(F.col("q"), 5.0)
    extra = water.extra_radius_degrees(F.lit("RIVER"), F.col("q"), F.col("lat"), 3.0, 5.0)
    return rows.select("o_orderkey", _r(width, 4).alias("width_m"), _r(water.river_bed_depth_m(width), 4).alias("bed_m"),
                       _r(water.display_width_blocks(F.col("q"), 3.0), 6).alias("shown_blocks"), _r(extra, 9).alias("extra_deg"))


@registered("visible_rivers", with_tables("water") + """SELECT id FROM water WHERE water_type <> 'RIVER' OR discharge_cms >= 50""")
def visible_rivers(t: Tables) -> DataFrame:
    return t.water_bodies.filter(water.visible(F.col("water_type"), F.col("discharge_cms"), 50.0)).select("id")


_PLACED = """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN (o_totalprice - 250000) / 400 END AS raw, ['NONE', 'OCEAN', 'LAKE', 'RIVER'][o_orderkey % 4 + 1] AS found,
  CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN o_orderkey % 3 > 0 THEN o_custkey - 300e0 END WHEN 3 THEN CASE WHEN o_orderkey % 11 > 0 THEN (o_totalprice - 250000) / 400 END END AS surf,
  (o_orderkey % 7) * 2e0 AS bed FROM orders),
s AS (SELECT *, coalesce(raw, 0) AS ground, CASE WHEN found = 'RIVER' THEN coalesce(surf, coalesce(raw, 0)) ELSE surf END AS surface FROM c),
k AS (SELECT *, coalesce(found = 'LAKE' AND surface - raw > 0 AND surface - raw <= 1700, false) AS deep FROM s),
p AS (SELECT *, CASE WHEN deep OR (surface IS NOT NULL AND (found <> 'LAKE' OR raw IS NULL OR abs(surface - raw) <= bed + 250)) THEN found ELSE 'NONE' END AS placed FROM k)"""


@registered("place_water", _PLACED + """
SELECT o_orderkey, placed AS water_type, round(CASE WHEN placed IN ('RIVER', 'LAKE') THEN CASE WHEN deep THEN least(surface - bed, raw) ELSE surface - bed END ELSE ground END, 6) + 0e0 AS meters,
       raw IS NULL AS from_fallback FROM p""")
def place_water(t: Tables) -> DataFrame:
    """Orders as columns: price as ground, customer as lake level."""
    cases = t._sql("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN (o_totalprice - 250000) / 400 END AS raw,
        element_at(array('NONE', 'OCEAN', 'LAKE', 'RIVER'), cast(o_orderkey % 4 + 1 AS int)) AS found,
        CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN o_orderkey % 3 > 0 THEN o_custkey - 300e0 END
             WHEN 3 THEN CASE WHEN o_orderkey % 11 > 0 THEN (o_totalprice - 250000) / 400 END END AS surf,
        (o_orderkey % 7) * 2e0 AS bed FROM {orders}""", "orders")
    found = F.struct(F.col("found").alias("water_type"), F.col("surf").alias("surface_m"), F.col("bed").alias("bed_depth_m"))
    placed = water.place_water(F.col("raw"), found, TerrainParams(), has_bathymetry=True)
    return cases.withColumn("p", placed).select("o_orderkey", "p.water_type", _r(F.col("p.meters"), 6).alias("meters"), "p.from_fallback")


@registered("text_keys", """
SELECT p_partkey, nullif(trim(p_name), '') AS name, lower(trim(p_name)) AS key, CASE WHEN regexp_matches(upper(trim(substr(p_type, 1, p_size % 4))), '^[A-Z]{2}$')
 THEN upper(trim(substr(p_type, 1, p_size % 4))) END AS iso FROM part""")
def text_keys(t: Tables) -> DataFrame:
    code = F.substring("p_type", F.lit(1), F.col("p_size") % 4)
    return t.base("part").select("p_partkey", text.blank_to_null(F.col("p_name")).alias("name"), text.lookup_key(F.col("p_name")).alias("key"), text.iso_code(code).alias("iso"))


@registered("human_text", """
SELECT o_orderkey, CASE WHEN o_custkey * 3 + 0.7e0 >= 1000 THEN printf('%.1f km', (o_custkey * 3 + 0.7e0) / 1000e0) ELSE printf('%.0f m', o_custkey * 3 + 0.7e0) END AS distance FROM orders""")
def human_text(t: Tables) -> DataFrame:
    return t.base("orders").select("o_orderkey", text.distance_text(F.col("o_custkey") * 3 + 0.7).alias("distance"))


@registered("spiral_cells", """
WITH o AS (SELECT o_orderkey AS n, ceil((sqrt(o_orderkey + 1) - 1) / 2)::bigint AS r FROM orders), s AS (SELECT n, r, 2 * r AS side, n - (2 * r - 1) * (2 * r - 1) AS off FROM o)
SELECT n AS ordinal, cast(CASE WHEN n = 0 THEN 0 WHEN off < side THEN r WHEN off < side * 2 THEN r - 1 - (off - side) WHEN off < side * 3 THEN -r ELSE -r + 1 + (off - side * 3) END AS int) AS x,
       cast(CASE WHEN n = 0 THEN 0 WHEN off < side THEN -r + 1 + off WHEN off < side * 2 THEN r WHEN off < side * 3 THEN r - 1 - (off - side * 2) ELSE -r END AS int) AS z FROM s""")
def spiral_cells(t: Tables) -> DataFrame:
    x, z = coords.spiral_cell(F.col("o_orderkey"))
    return t.base("orders").select(F.col("o_orderkey").alias("ordinal"), x.alias("x"), z.alias("z"))


@registered("vertical_profile", with_tables("countries") + """
, s AS (SELECT n_regionkey, max(max_lat) - min(min_lat) AS a, max(max_lon) - min(min_lon) AS o FROM countries GROUP BY n_regionkey),
p AS (SELECT n_regionkey, CASE WHEN a >= 120 AND o >= 240 THEN 'seaLevel=0;minY=-512;maxY=512;metersPerBlock=20.0' ELSE 'seaLevel=63;minY=-64;maxY=320;metersPerBlock=1.0' END AS canonical FROM s)
SELECT n_regionkey, canonical, sha256(canonical) AS fingerprint FROM p""")
def vertical_profile(t: Tables) -> DataFrame:
    spans = t.countries.groupBy("n_regionkey").agg((F.max("max_lat") - F.min("min_lat")).alias("a"), (F.max("max_lon") - F.min("min_lon")).alias("o"))
    wide = (F.col("a") >= 120.0) & (F.col("o") >= 240.0)
    planet, local = profile_for_bounds(180, 360), profile_for_bounds(1, 1)
    canonical = F.when(wide, planet.canonical).otherwise(local.canonical)
    return spans.select("n_regionkey", canonical.alias("canonical"), F.sha2(canonical, 256).alias("fingerprint"))


@registered("cell_noise")
def cell_noise(t: Tables) -> DataFrame:
    """Hash draws and smooth noise of every shipment's column (64-bit wrapping: no SQL form)."""
    from cartolith.functions import noise
    cols = t.base("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - 1000).alias("x"), (F.col("l_suppkey") * 31 - F.col("l_orderkey")).alias("z"))
    return cols.select("l_orderkey", "l_linenumber", noise.cell_id(F.col("x"), F.col("z"), 10, 7).alias("cell_id"),
                       F.round(noise.cell_smooth(F.col("x"), F.col("z"), 24, 9), 12).alias("smooth"), F.round(noise.cell_at(F.col("x"), F.col("z"), 5), 12).alias("draw"))


@registered("geo_noise")
def geo_noise(t: Tables) -> DataFrame:
    """Two-octave noise over degrees at every customer (64-bit wrapping: no SQL form)."""
    from cartolith.functions import noise
    return t.points.select("id", F.round(noise.geo_noise(F.col("lat"), F.col("lon"), 0.3, 0x534E4F57), 12).alias("noise"))
