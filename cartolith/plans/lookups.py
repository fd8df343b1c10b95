"""Registered point lookups: shapes, places, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartolith.functions import geodesy
from cartolith.operators import nearest as near, raster, shapes
from cartolith.operators.shapes import ShapeSet, area_set, build_shape_index
from cartolith.operators.water import river_lines, water_column_at, water_shapes
from cartolith.params import TerrainParams
from cartolith.plans.derived import DEM_SIDE, Tables, with_tables
from cartolith.plans.geodesic_sql import geodesic_tables, recursive
from cartolith.plans.registry import registered
from cartolith.plans.terrain import whereami

WATER_PARAMS = TerrainParams(min_visible_discharge=20.0)

# Flat squared distance used to pick the nearest city.
_D2 = ("(c.lat - p.lat) * (c.lat - p.lat) + pow((((c.lon - p.lon + 180) % 360 + 360) % 360 - 180) * cos(radians(p.lat)), 2)")
_NEAREST = f"""nearest AS (
SELECT p.id AS pid, arg_min(c.id, struct_pack(d := {_D2}, a := -c.population, b := c.name, e := c.id)) AS city_id
FROM points p JOIN cities c ON true GROUP BY p.id)"""
_COUNTRY = "best AS (SELECT pid, min(cid) AS cid FROM country_hits GROUP BY pid)"


def _bilinear(points: str, key: str) -> str:
    """CTEs that interpolate the samples at points (key, lat, lon): bilinear(key, m)."""
    n = DEM_SIDE - 1
    return f"""
spot AS (SELECT {key}, greatest(least(cast(floor(lat) AS int), 89), -90) AS lat_deg, greatest(least(cast(floor(lon) AS int), 179), -180) AS lon_deg,
       lat, lon FROM {points}),
grid AS (SELECT *, least(greatest((lon - lon_deg) / (1e0 / {n}), 0), {n}) AS gx, least(greatest((lat_deg + 1e0 - lat) / (1e0 / {n}), 0), {n}) AS gy FROM spot),
corner AS (SELECT g.{key}, s.m, (1 - abs(g.gx - s.gx)) * (1 - abs(g.gy - s.gy)) AS w FROM grid g
           JOIN samples s ON s.lat_deg = g.lat_deg AND s.lon_deg = g.lon_deg AND abs(g.gx - s.gx) < 1 AND abs(g.gy - s.gy) < 1),
bilinear AS (SELECT {key}, CASE WHEN sum(CASE WHEN m IS NOT NULL THEN w ELSE 0 END) >= 0.5
             THEN sum(m * w) / sum(CASE WHEN m IS NOT NULL THEN w ELSE 0 END) END AS m FROM corner GROUP BY {key})"""


@registered("country_at", with_tables("country_hits") + f", {_COUNTRY} " + """
SELECT p.id, b.cid AS country_id, c.name AS country FROM points p
LEFT JOIN best b ON b.pid = p.id LEFT JOIN countries c ON c.id = b.cid""")
def country_at(t: Tables) -> DataFrame:
    found = shapes.locate(t.points, t.country_shapes, ["id"], "country")
    return found.select("id", F.col("country.id").alias("country_id"), F.col("country.name").alias("country"))


@registered("region_at", with_tables("points", "regions") + """
SELECT p.id, min(r.id) AS region_id FROM points p
LEFT JOIN regions r ON p.lat BETWEEN r.min_lat AND r.max_lat AND p.lon BETWEEN r.min_lon AND r.max_lon GROUP BY p.id""")
def region_at(t: Tables) -> DataFrame:
    found = shapes.locate(t.points, t.region_shapes, ["id"], "region")
    return found.select("id", F.col("region.id").alias("region_id"))


@registered("shipments_per_country", with_tables("line_points", "edges") + """
, hits AS (SELECT p.spot, e.id AS cid FROM line_points p JOIN edges e ON true GROUP BY p.spot, p.lat, p.lon, e.id
HAVING sum(CASE WHEN (e.y1 <= p.lat) <> (e.y2 <= p.lat)
            AND (CASE WHEN e.y2 > e.y1 THEN (p.lon - e.x1) * (e.y2 - e.y1) - (p.lat - e.y1) * (e.x2 - e.x1) < 0
                 ELSE (p.lon - e.x1) * (e.y2 - e.y1) - (p.lat - e.y1) * (e.x2 - e.x1) > 0 END) THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or((p.lon - e.x1) * (e.y2 - e.y1) - (p.lat - e.y1) * (e.x2 - e.x1) = 0
               AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))),
best AS (SELECT spot, min(cid) AS cid FROM hits GROUP BY ALL)
SELECT b.cid AS country_id, sum(p.shipments)::bigint AS shipments FROM line_points p LEFT JOIN best b USING (spot) GROUP BY b.cid""")
def shipments_per_country(t: Tables) -> DataFrame:
    """Order lines per country; lines at the same spot are counted before the lookup."""
    found = shapes.locate(t.line_points, t.country_shapes, ["spot"], "country")
    return found.groupBy(F.col("country.id").alias("country_id")).agg(F.sum("shipments").alias("shipments"))


@registered("features_in_bounds", with_tables("regions", "water") + """
SELECT r.id AS region_id, w.id AS water_id FROM regions r JOIN water w
ON r.min_lat <= w.max_lat AND r.max_lat >= w.min_lat AND r.min_lon <= w.max_lon AND r.max_lon >= w.min_lon""")
def features_in_bounds(t: Tables) -> DataFrame:
    water = t.water_bodies.withColumnRenamed("id", "water_id")
    return shapes.boxes_meeting(t.regions.withColumnRenamed("id", "region_id"), water, ["region_id"], ["water_id"])


_WATER_AT = """
hit AS (SELECT p.id AS pid, arg_min(struct_pack(k := w.water_type, s := w.surface_elevation_m, b := w.bed_depth_m),
        struct_pack(o := CASE w.water_type WHEN 'RIVER' THEN -3 WHEN 'LAKE' THEN -2 ELSE -1 END, i := w.id)) AS v
        FROM points p JOIN water w ON p.lat BETWEEN w.min_lat AND w.max_lat AND p.lon BETWEEN w.min_lon AND w.max_lon
        WHERE w.water_type <> 'RIVER' OR w.discharge_cms >= 20 GROUP BY p.id)"""


@registered("water_column_at", with_tables("points", "samples", "water") + "," + _bilinear("points", "id") + "," + _WATER_AT + """
SELECT p.id, coalesce(h.v.k, 'NONE') AS water_type,
       round(CASE coalesce(h.v.k, 'NONE') WHEN 'OCEAN' THEN 0 WHEN 'RIVER' THEN e.m WHEN 'LAKE' THEN h.v.s END, 6) + 0e0 AS surface_m,
       coalesce(h.v.b, 0) AS bed_depth_m
FROM points p LEFT JOIN hit h ON h.pid = p.id LEFT JOIN bilinear e ON e.id = p.id""")
def water_column(t: Tables) -> DataFrame:
    index = build_shape_index(water_shapes(t.water_bodies, WATER_PARAMS))
    found = water_column_at(raster.elevation_at(t.points, t.dem), index, ["id"], has_ocean=True)
    return found.select("id", F.col("water.water_type").alias("water_type"),
                        (F.round("water.surface_m", 6) + 0.0).alias("surface_m"), F.col("water.bed_depth_m").alias("bed_depth_m"))


@registered("sea_level_water", with_tables("points", "samples") + "," + _bilinear("points", "id") + """
SELECT p.id, CASE WHEN e.m < 0 THEN 'OCEAN' ELSE 'NONE' END AS water_type FROM points p LEFT JOIN bilinear e ON e.id = p.id""")
def sea_level_water(t: Tables) -> DataFrame:
    from cartolith.functions.water import sea_level_water as rule
    return raster.elevation_at(t.points, t.dem).select("id", rule(F.col("elevation_m")).alias("water_type"))


_RIVER_SQL = """
, len AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS l1, sqrt(pow(x3 - x2, 2) + pow(y3 - y2, 2)) AS l2 FROM rivers),
mids AS (SELECT *, (l1 * (y1 + y2) / 2 + l2 * (y2 + y3) / 2) / (l1 + l2) AS mid FROM len),
seg AS (SELECT id, x1, y1, x2, y2, discharge_cms, mid FROM mids
          UNION ALL SELECT id, x2, y2, x3, y3, discharge_cms, mid FROM mids),
wide AS (SELECT *, greatest(1000e0, 7.2 * sqrt(discharge_cms)) / (greatest(0.01, abs(cos(radians(mid)))) * (2.0 * 111320e0)) * 12 AS r FROM seg),
near AS (SELECT p.id AS pid, w.id AS wid, w.r,
         least(greatest(coalesce(((p.lon - x1) * (x2 - x1) + (p.lat - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 0), 1) AS u,
         x1, y1, x2, y2, p.lat, p.lon FROM points p JOIN wide w ON abs(p.lat - w.mid) <= 2 + w.r)
SELECT p.id, m.river_id FROM points p LEFT JOIN (
  SELECT pid, min(wid) AS river_id FROM near
  WHERE pow(lon - (x1 + (x2 - x1) * u), 2) + pow(lat - (y1 + (y2 - y1) * u), 2) <= r * r GROUP BY pid) m ON m.pid = p.id"""


@registered("river_within_reach", with_tables("points", "rivers") + _RIVER_SQL)
def river_within_reach(t: Tables) -> DataFrame:
    """Rivers drawn twelve times their width, so that sparse points meet some."""
    lines = river_lines(t.river_paths, WATER_PARAMS)
    found = ShapeSet(lines.select(F.col("id").alias("rank"), F.struct("id").alias("value"), "rings",
                                  (F.col("radius_deg") * 12.0).alias("radius")))
    return shapes.locate(t.points, build_shape_index(found), ["id"], "river").select("id", F.col("river.id").alias("river_id"))


_CLASSES = "['UNKNOWN','TREE_COVER','SHRUBLAND','GRASSLAND','CROPLAND','BUILT_UP','BARE_SPARSE','SNOW_ICE','PERMANENT_WATER','HERBACEOUS_WETLAND','MANGROVES','MOSS_LICHEN']"
LANDCOVER_SQL = f"""
grids AS (SELECT 0 AS late, printf('grid_%03d', id) AS file_name, id AS k, min_lat AS s, min_lon AS w, max_lat AS n, max_lon AS e, 12 AS wd, 8 AS ht FROM countries
          UNION ALL SELECT 1, printf('world_%03d', r_regionkey), r_regionkey, -90, -180, 90, 180, 36, 18 FROM region),
cover_hits AS (SELECT p.id, g.late, g.file_name,
         {_CLASSES}[(k * 7 + least(wd - 1, cast(trunc((lon - w) / (e - w) * wd) AS int)) * 3
                     + least(ht - 1, cast(trunc((n - lat) / (n - s) * ht) AS int)) * 5) % 12 + 1] AS cls
         FROM points p JOIN grids g ON p.lat BETWEEN g.s AND g.n AND p.lon BETWEEN g.w AND g.e
         AND (g.late = 1 OR (floor(p.lat) BETWEEN floor(g.s) AND ceil(g.n) - 1 AND floor(p.lon) BETWEEN floor(g.w) AND ceil(g.e) - 1))),
cover AS (SELECT id, arg_min(cls, struct_pack(a := late, b := file_name)) AS cls FROM cover_hits WHERE cls <> 'UNKNOWN' GROUP BY id)"""


@registered("landcover_at", with_tables("points", "countries") + "," + LANDCOVER_SQL + """
SELECT p.id, coalesce(c.cls, 'UNKNOWN') AS landcover FROM points p LEFT JOIN cover c ON c.id = p.id""")
def landcover_at(t: Tables) -> DataFrame:
    return raster.landcover_at(t.points, t.landcover, ["id"]).select("id", "landcover")


@registered("elevation_at", with_tables("points", "samples") + "," + _bilinear("points", "id") + """
SELECT p.id, round(b.m, 3) + 0e0 AS elevation_m FROM points p LEFT JOIN bilinear b ON b.id = p.id""")
def elevation_at(t: Tables) -> DataFrame:
    return raster.elevation_at(t.points, t.dem).select("id", (F.round("elevation_m", 3) + 0.0).alias("elevation_m"))


def footprint_sql(points: str, key: str, half: str) -> str:
    """CTE footprint(key, m) of mean samples in boxes of a half span around points."""
    n = DEM_SIDE - 1
    return f"""
box AS (SELECT {key}, greatest(lat - {half}, -90) AS s, least(lat + {half}, 90) AS n, lon - {half} AS w, lon + {half} AS e FROM {points}),
inside AS (SELECT b.{key}, avg(t.m) AS m FROM box b JOIN samples t ON t.lat_deg BETWEEN floor(b.s) AND floor(b.n) AND t.lon_deg BETWEEN floor(b.w) AND floor(b.e)
           AND t.gx < {n} AND t.gy < {n}
           AND t.gx >= ceil((b.w - t.lon_deg) / (1e0 / {n})) AND t.gx <= floor((b.e - t.lon_deg) / (1e0 / {n}))
           AND t.gy >= ceil((t.lat_deg + 1e0 - b.n) / (1e0 / {n})) AND t.gy <= floor((t.lat_deg + 1e0 - b.s) / (1e0 / {n}))
           GROUP BY b.{key}),
footprint AS (SELECT p.{key}, coalesce(i.m, b.m) AS m FROM {points} p LEFT JOIN inside i ON i.{key} = p.{key} LEFT JOIN bilinear b ON b.{key} = p.{key})"""


@registered("footprint_mean", with_tables("points", "samples") + "," + _bilinear("points", "id") + "," + footprint_sql("points", "id", "0.7e0") + """
SELECT id, round(m, 3) + 0e0 AS elevation_m FROM footprint""")
def footprint_mean(t: Tables) -> DataFrame:
    boxed = t.points.withColumn("lat_span", F.lit(1.4)).withColumn("lon_span", F.lit(1.4))
    return raster.footprint_mean(boxed, t.dem, ["id"]).select("id", (F.round("elevation_m", 3) + 0.0).alias("elevation_m"))


@registered("nearest_city", with_tables("points", "cities") + ", " + _NEAREST + """
SELECT n.pid AS id, n.city_id, c.name AS city FROM nearest n JOIN cities c ON c.id = n.city_id""")
def nearest_city(t: Tables) -> DataFrame:
    found = near.nearest(t.points, t.city_index, "city")
    return found.select("id", F.col("city.id").alias("city_id"), F.col("city.name").alias("city"))


# The iterated ellipsoidal distance has no SQL form; tests compare this with brute force.
@registered("cities_within")
def cities_within(t: Tables) -> DataFrame:
    found = near.places_within(t.points, t.cities, ["id"], 500.0, 5, t.city_rank, [F.col("id").alias("city_id")])
    return found.select("id", "city_id", F.round("meters", 3).alias("meters"), "position")


@registered("nearest_entrance", with_tables("points", "cities") + """
SELECT p.id, b.city_id AS entrance_id FROM points p LEFT JOIN (
  SELECT p.id AS pid, arg_min(c.id, struct_pack(d := (c.lat - p.lat) * (c.lat - p.lat) + (c.lon - p.lon) * (c.lon - p.lon), i := -c.id)) AS city_id
  FROM points p JOIN cities c ON (c.lat - p.lat) * (c.lat - p.lat) + (c.lon - p.lon) * (c.lon - p.lon) <= 2.5e0 * 2.5e0 GROUP BY p.id) b ON b.pid = p.id""")
def nearest_entrance(t: Tables) -> DataFrame:
    found = near.nearest_within_degrees(t.points, t.cities, ["id"], 2.5, F.col("id"), ["id"], "e")
    return found.select("id", F.col("e.id").alias("entrance_id"))


@registered("in_karst", with_tables("points", "water") + """
SELECT p.id FROM points p WHERE EXISTS (SELECT 1 FROM water w WHERE w.water_type = 'LAKE'
AND p.lat BETWEEN w.min_lat AND w.max_lat AND p.lon BETWEEN w.min_lon AND w.max_lon)""")
def in_karst(t: Tables) -> DataFrame:
    areas = t.water_bodies.filter("water_type = 'LAKE'")
    return shapes.within_shapes(t.points, build_shape_index(area_set(areas, F.col("id"), ["id"])), ["id"]).select("id")


@registered("whereami", with_tables("country_hits", "regions", "cities", "samples") + f", {_COUNTRY}, {_NEAREST}, " + _bilinear("points", "id") + """
, reg AS (SELECT p.id AS pid, min(r.id) AS rid FROM points p JOIN regions r ON p.lat BETWEEN r.min_lat AND r.max_lat AND p.lon BETWEEN r.min_lon AND r.max_lon GROUP BY p.id)
, aim AS (SELECT p.id, (degrees(atan2(sin(radians(c.lon - p.lon)) * cos(radians(c.lat)),
          cos(radians(p.lat)) * sin(radians(c.lat)) - sin(radians(p.lat)) * cos(radians(c.lat)) * cos(radians(c.lon - p.lon)))) + 360) % 360 AS b, c.id AS cid, c.name
          FROM points p JOIN nearest n ON n.pid = p.id JOIN cities c ON c.id = n.city_id)
SELECT p.id, round(p.lat, 6) + 0e0 AS lat, round(p.lon, 6) + 0e0 AS lon, round(e.m, 3) + 0e0 AS elevation_m, k.name AS country, r.rid AS region_id, a.cid AS city_id,
       ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][cast(floor(a.b / 22.5 + 0.5) AS int) % 16 + 1] AS city_direction
FROM points p LEFT JOIN best b ON b.pid = p.id LEFT JOIN countries k ON k.id = b.cid LEFT JOIN reg r ON r.pid = p.id
LEFT JOIN bilinear e ON e.id = p.id LEFT JOIN aim a ON a.id = p.id""")
def whereami_query(t: Tables) -> DataFrame:
    found = whereami(t.points, t.country_shapes, t.region_shapes, t.city_index, t.dem, ["id"])
    return found.select("id", (F.round("lat", 6) + 0.0).alias("lat"), (F.round("lon", 6) + 0.0).alias("lon"),
                        (F.round("elevation_m", 3) + 0.0).alias("elevation_m"), F.col("country.name").alias("country"),
                        F.col("region.id").alias("region_id"), F.col("city.id").alias("city_id"), "city_direction")


@registered("whereami_distance", recursive(with_tables("points", "cities") + f""", {_NEAREST}, {geodesic_tables(
    "SELECT p.id AS pid, p.lat AS lat1, p.lon AS lon1, c.lat AS lat2, c.lon AS lon2 FROM points p JOIN nearest n ON n.pid = p.id JOIN cities c ON c.id = n.city_id")}
SELECT p.id, round(g.meters, 3) + 0e0 AS city_meters FROM points p LEFT JOIN geodesic g ON g.pid = p.id"""))
def whereami_distance(t: Tables) -> DataFrame:
    """Ellipsoidal distance to the nearest city."""
    found = whereami(t.points, None, None, t.city_index, None, ["id"])
    return found.select("id", F.round("city_meters", 3).alias("city_meters"))


@registered("distance_to", with_tables("points", "cities") + """
SELECT p.id, c.id AS city_id,
  round(asin(least(1e0, sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))) * (2 * 6371008.8e0) / 1e3, 3) + 0e0 AS sphere_km
FROM customer k JOIN points p ON p.id = k.c_custkey JOIN cities c ON c.country_id = k.c_nationkey AND c.capital""")
def distance_to(t: Tables) -> DataFrame:
    """Every customer to the capital of their nation."""
    home = t.points.join(t.base("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("country_id")), "id")
    seat = t.cities.filter("capital").select("country_id", F.col("id").alias("city_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    sphere = geodesy.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return home.join(seat, "country_id").select("id", "city_id", (F.round(sphere / 1000.0, 3) + 0.0).alias("sphere_km"))


@registered("vincenty_to_capital", recursive(with_tables("points", "cities") + f""", {geodesic_tables("""
 SELECT p.id AS pid, p.lat AS lat1, p.lon AS lon1, c.lat AS lat2, c.lon AS lon2
 FROM customer k JOIN points p ON p.id = k.c_custkey JOIN cities c ON c.country_id = k.c_nationkey AND c.capital""")},
aimed AS (SELECT pid, (degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),
 cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360 AS b FROM pairs)
SELECT a.pid AS id, round(g.meters, 3) + 0e0 AS meters, round(a.b, 6) + 0e0 AS bearing,
 ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][cast(floor(a.b / 22.5 + 0.5) AS int) % 16 + 1] AS direction
FROM aimed a JOIN geodesic g ON g.pid = a.pid"""))
def vincenty_to_capital(t: Tables) -> DataFrame:
    """Ellipsoidal distance, bearing and direction."""
    home = t.points.join(t.base("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("country_id")), "id")
    seat = t.cities.filter("capital").select("country_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pair = home.join(seat, "country_id")
    there = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    bearing = geodesy.initial_bearing(*there)
    return pair.select("id", F.round(geodesy.vincenty_m(*there), 3).alias("meters"), F.round(bearing, 6).alias("bearing"),
                       geodesy.compass_point(bearing).alias("direction"))
