"""Registered queries over raster tiles, source manifests and data status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartolith.operators import raster, tiles
from cartolith.plans.derived import Tables, with_tables
from cartolith.plans.registry import registered

_CELLS = with_tables("samples")
_TILE = ", tile AS (SELECT lat_deg, lon_deg, count(*) AS n, count(*) - count(m) AS voids, bool_or(m IS NULL OR m <= 0) AS wet FROM samples GROUP BY 1, 2)"


@registered("dem_coverage", _CELLS + " SELECT min(lat_deg)::double AS min_lat, min(lon_deg)::double AS min_lon, max(lat_deg + 1)::double AS max_lat, max(lon_deg + 1)::double AS max_lon FROM dem_cells")
def dem_coverage(t: Tables) -> DataFrame:
    return raster.dem_coverage(t.dem_tiles)


@registered("tile_void_stats", _CELLS + _TILE + " SELECT lat_deg, lon_deg, n AS samples, voids, round(voids * 100.0 / n, 6)::double AS void_percent FROM tile")
def tile_void_stats(t: Tables) -> DataFrame:
    return raster.tile_void_stats(t.dem_tiles).withColumn("void_percent", F.round(F.col("void_percent").cast("double"), 6))


@registered("tile_bathymetry_flags", _CELLS + _TILE + " SELECT lat_deg, lon_deg, wet AS bathymetry FROM tile")
def tile_bathymetry_flags(t: Tables) -> DataFrame:
    return t.dem_tiles.select("lat_deg", "lon_deg", raster.tile_needs_bathymetry(F.col("samples")).alias("bathymetry"))


def _sea_tiles(t: Tables) -> DataFrame:
    """Coarser sea-floor tiles, one per supplier and customer cell."""
    cells = t._sql("""SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg FROM
        (SELECT lat, lon FROM {cities} UNION ALL SELECT lat, lon FROM {points}) c""", cities=t.cities, points=t.points)
    values = F.expr("flatten(transform(sequence(0, 4), gy -> transform(sequence(0, 4), gx -> cast(-10 * gy - gx - lat_deg % 7 - 100 AS double))))")
    return cells.select("lat_deg", "lon_deg", F.lit(5).alias("width"), F.lit(5).alias("height"), values.alias("samples"))


@registered("merge_bathymetry", with_tables("samples", "cities") + """
, sea AS (SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg FROM (SELECT lat, lon FROM cities UNION ALL SELECT lat, lon FROM points))
, mix AS (SELECT lat_deg, lon_deg, gx, gy, CASE WHEN m > 0 THEN m ELSE -10 * floor(gy * 4 / 8e0 + 0.5) - floor(gx * 4 / 8e0 + 0.5) - lat_deg % 7 - 100 END AS v FROM samples
  UNION ALL SELECT lat_deg, lon_deg, a.gx, b.gy, -10 * b.gy - a.gx - lat_deg % 7 - 100 FROM sea, range(5) a(gx), range(5) b(gy) WHERE (lat_deg, lon_deg) NOT IN (SELECT (lat_deg, lon_deg) FROM dem_cells))
, f AS (SELECT lat_deg, lon_deg, bool_or(m IS NULL OR m <= 0) AS wet FROM samples GROUP BY 1, 2)
SELECT mix.lat_deg, mix.lon_deg, count(*) AS samples, sum(v)::double AS total, coalesce(any_value(f.wet), true) AS bathymetry FROM mix LEFT JOIN f USING (lat_deg, lon_deg) GROUP BY 1, 2""")
def merge_bathymetry(t: Tables) -> DataFrame:
    merged = raster.merge_bathymetry(t.dem_tiles, _sea_tiles(t))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return merged.select("lat_deg", "lon_deg", F.size("samples").cast("bigint").alias("samples"), total.alias("total"), "bathymetry")


@registered("missing_tiles", with_tables("points", "cities") + """
, need AS (SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg FROM cities), have AS (SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg FROM points)
SELECT * FROM need EXCEPT SELECT * FROM have""")
def missing_tiles(t: Tables) -> DataFrame:
    return tiles.missing_tiles(tiles.required_tiles(t.cities), t.dem_tiles)


@registered("tile_coverage", with_tables("points", "cities") + """
, need AS (SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg FROM cities), have AS (SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg, true AS h FROM points)
SELECT count(*) AS required, count(h) AS covered, round(count(h) * 100.0 / count(*), 6)::double AS covered_percent FROM need LEFT JOIN have USING (lat_deg, lon_deg)""")
def tile_coverage(t: Tables) -> DataFrame:
    return tiles.tile_coverage(tiles.required_tiles(t.cities), t.dem_tiles).withColumn("covered_percent", F.round(F.col("covered_percent").cast("double"), 6))


_PLAN_BOXES = with_tables("water") + ", b AS (SELECT id AS box_id, min_lat, min_lon, max_lat, max_lon FROM water)"


def _boxes(t: Tables) -> DataFrame:
    return t.water_bodies.select(F.col("id").alias("box_id"), "min_lat", "min_lon", "max_lat", "max_lon")


_LABEL = "printf('%s%02d', CASE WHEN lat_deg < 0 THEN 'S' ELSE 'N' END, abs(lat_deg)), {mid}, printf('%s%03d', CASE WHEN lon_deg < 0 THEN 'W' ELSE 'E' END, abs(lon_deg))"


@registered("plan_dem", _PLAN_BOXES + """
, c AS (SELECT box_id, a.i AS lat_deg, o.i AS lon_deg FROM b, range(-90, 90) a(i), range(-180, 180) o(i) WHERE a.i >= floor(min_lat) AND a.i < max_lat AND o.i >= floor(min_lon) AND o.i < max_lon)
SELECT box_id, concat('Copernicus_DSM_COG_30_', """ + _LABEL.format(mid="'_00_'") + ", '_00_DEM.tif') AS file_name FROM c")
def plan_dem(t: Tables) -> DataFrame:
    return tiles.plan_dem(_boxes(t), "90").select("box_id", "file_name")


@registered("plan_bathymetry", _PLAN_BOXES + """
, c AS (SELECT box_id, a.i AS s, o.i AS w FROM b, range(-90, 91, 90) a(i), range(-180, 181, 90) o(i) WHERE a.i < 90 AND o.i < 180 AND a.i + 90 > floor(min_lat) AND a.i < max_lat AND o.i + 90 > floor(min_lon) AND o.i < max_lon)
SELECT box_id, printf('gebco_2024_n%.1f_s%.1f_w%.1f_e%.1f.tif', s + 90e0, s::double, w::double, w + 90e0) AS file_name FROM c""")
def plan_bathymetry(t: Tables) -> DataFrame:
    return tiles.plan_bathymetry(_boxes(t)).select("box_id", "file_name")


@registered("plan_landcover", _PLAN_BOXES + """
, c AS (SELECT box_id, a.i AS lat_deg, o.i AS lon_deg FROM b, range(-60, 84, 3) a(i), range(-180, 180, 3) o(i) WHERE a.i + 3 > floor(min_lat) AND a.i < max_lat AND o.i + 3 > floor(min_lon) AND o.i < max_lon)
SELECT box_id, concat('ESA_WorldCover_10m_2021_v200_', """ + _LABEL.format(mid="''") + ", '_Map.tif') AS file_name FROM c")
def plan_landcover(t: Tables) -> DataFrame:
    return tiles.plan_landcover(_boxes(t)).select("box_id", "file_name")


_STOCK = """
, have AS (SELECT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg, max(id) + 1000 AS bytes FROM points GROUP BY 1, 2)
, gone AS (SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg FROM cities)
, need AS (SELECT DISTINCT a.i AS lat_deg, o.i AS lon_deg FROM water, range(-90, 90) a(i), range(-180, 180) o(i) WHERE a.i >= floor(min_lat) AND a.i < max_lat AND o.i >= floor(min_lon) AND o.i < max_lon)"""


def _stock(t: Tables):
    """Customers' cells are there, cities' cells are known to have no source."""
    cell = lambda df: df.select(F.floor("lat").cast("int").alias("lat_deg"), F.floor("lon").cast("int").alias("lon_deg"), "id")
    name = F.concat(F.lit("Copernicus_DSM_COG_30_"), tiles._label(F.col("lat_deg"), "N", "S", 2), F.lit("_00_"),
                    tiles._label(F.col("lon_deg"), "E", "W", 3), F.lit("_00_DEM.tif"))
    have = cell(t.points).groupBy("lat_deg", "lon_deg").agg((F.max("id") + 1000).alias("bytes")).select(F.lit("dem").alias("dataset"), name.alias("file_name"), "bytes")
    gone = cell(t.cities).select("lat_deg", "lon_deg").distinct().select(F.lit("dem").alias("dataset"), name.alias("file_name"))
    return tiles.plan_dem(_boxes(t), "90"), have, gone


@registered("manifest_diff", with_tables("water", "points", "cities") + _STOCK + """
SELECT 'dem' AS dataset, concat('Copernicus_DSM_COG_30_', """ + _LABEL.format(mid="'_00_'") + """, '_00_DEM.tif') AS file_name FROM need
WHERE (lat_deg, lon_deg) NOT IN (SELECT (lat_deg, lon_deg) FROM have) AND (lat_deg, lon_deg) NOT IN (SELECT (lat_deg, lon_deg) FROM gone)""")
def manifest_diff(t: Tables) -> DataFrame:
    return tiles.manifest_diff(*_stock(t))


@registered("manifest_report", with_tables("water", "points", "cities") + _STOCK + """
, m AS (SELECT n.*, h.bytes, g.lat_deg IS NOT NULL AS gone FROM need n LEFT JOIN have h USING (lat_deg, lon_deg) LEFT JOIN gone g USING (lat_deg, lon_deg))
SELECT 'dem' AS dataset, count(*) AS planned, count(bytes) AS present, count(*) FILTER (bytes IS NULL AND gone) AS absent, count(*) FILTER (bytes IS NULL AND NOT gone) AS missing, sum(bytes)::bigint AS bytes_present FROM m""")
def manifest_report(t: Tables) -> DataFrame:
    return tiles.manifest_report(*_stock(t))


_AREAS = with_tables("points") + """
, x AS (SELECT id AS area_id, cast(floor(lon * 70) AS int) AS min_x, cast(floor(lat * 100) AS int) AS min_z, cast(floor(lon * 70) AS int) + cast(id % 900 AS int) AS max_x, cast(floor(lat * 100) AS int) + cast(id % 700 AS int) AS max_z FROM points)"""


def _areas(t: Tables) -> DataFrame:
    x, z = F.floor(F.col("lon") * 70).cast("int"), F.floor(F.col("lat") * 100).cast("int")
    return t.points.select(F.col("id").alias("area_id"), x.alias("min_x"), z.alias("min_z"), (x + (F.col("id") % 900).cast("int")).alias("max_x"),
                           (z + (F.col("id") % 700).cast("int")).alias("max_z"))


@registered("area_size", _AREAS + """
SELECT area_id, ((max_x >> 4) - (min_x >> 4) + 1)::bigint * ((max_z >> 4) - (min_z >> 4) + 1) AS chunks, ((max_x >> 9) - (min_x >> 9) + 1)::bigint * ((max_z >> 9) - (min_z >> 9) + 1) AS region_files,
((max_x >> 4) - (min_x >> 4) + 1)::bigint * ((max_z >> 4) - (min_z >> 4) + 1) * 15360 AS bytes FROM x""")
def area_size(t: Tables) -> DataFrame:
    return tiles.area_size(_areas(t)).select("area_id", "chunks", "region_files", "bytes")


@registered("area_plan", with_tables("points", "water") + _AREAS[len(with_tables("points")):] + """
, need AS (SELECT id AS area_id, a.i AS lat_deg, o.i AS lon_deg FROM water, range(-90, 90) a(i), range(-180, 180) o(i) WHERE a.i >= floor(min_lat) AND a.i < max_lat AND o.i >= floor(min_lon) AND o.i < max_lon)
, have AS (SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg, true AS h FROM points)
, s AS (SELECT area_id, count(*) AS tiles, count(h) AS tiles_present FROM need LEFT JOIN have USING (lat_deg, lon_deg) GROUP BY 1)
SELECT x.area_id, ((max_x >> 4) - (min_x >> 4) + 1)::bigint * ((max_z >> 4) - (min_z >> 4) + 1) AS chunks, s.tiles, s.tiles_present, round(s.tiles_present * 100.0 / s.tiles, 6)::double AS tiles_percent FROM x LEFT JOIN s USING (area_id)""")
def area_plan(t: Tables) -> DataFrame:
    need = tiles.plan_dem(_boxes(t)).select(F.col("box_id").alias("area_id"), "lat_deg", "lon_deg")
    return tiles.area_plan(_areas(t), need, t.dem_tiles).select("area_id", "chunks", "tiles", "tiles_present", F.round(F.col("tiles_percent").cast("double"), 6).alias("tiles_percent"))


@registered("data_status", with_tables("samples", "cities") + """
, have AS (SELECT lat_deg, lon_deg FROM dem_cells), ok AS (SELECT * FROM have WHERE (lat_deg + lon_deg) % 9 <> 4)
SELECT count(*) AS tiles, bool_or((lat_deg + lon_deg) % 2 = 0) AS has_bathymetry, printf('%d..%d N, %d..%d E', min(lat_deg), max(lat_deg) + 1, min(lon_deg), max(lon_deg) + 1) AS coverage,
 (SELECT count(*) FROM have) - count(*) AS corrupt,
 (SELECT count(*) FROM (SELECT DISTINCT cast(floor(lat) AS int) AS a, cast(floor(lon) AS int) AS o FROM cities) q WHERE (a, o) NOT IN (SELECT (lat_deg, lon_deg) FROM ok)) AS missing FROM ok""")
def data_status(t: Tables) -> DataFrame:
    """Tiles of which some are marked unreadable."""
    catalogue = t.dem_tiles.select("lat_deg", "lon_deg", F.lit(226).alias("bytes"), ((F.col("lat_deg") + F.col("lon_deg")) % 2 == 0).alias("bathymetry"),
                                   F.when((F.col("lat_deg") + F.col("lon_deg")) % 9 == 4, "wrong size").otherwise("ok").alias("status"))
    return tiles.data_status(catalogue, tiles.required_tiles(t.cities))


@registered("catalogue_summary", with_tables("samples") + """
SELECT count(*) FILTER ((lat_deg + lon_deg) % 9 <> 4) AS tiles, count(*) FILTER ((lat_deg + lon_deg) % 9 = 4) AS corrupt,
 bool_or((lat_deg + lon_deg) % 9 <> 4 AND (lat_deg + lon_deg) % 2 = 0) AS has_bathymetry, max(CASE WHEN (lat_deg + lon_deg) % 9 <> 4 THEN 226 + lat_deg END) AS largest_tile_bytes FROM dem_cells""")
def catalogue_summary(t: Tables) -> DataFrame:
    catalogue = t.dem_tiles.select("lat_deg", "lon_deg", (F.lit(226) + F.col("lat_deg")).alias("bytes"), ((F.col("lat_deg") + F.col("lon_deg")) % 2 == 0).alias("bathymetry"),
                                   F.when((F.col("lat_deg") + F.col("lon_deg")) % 9 == 4, "wrong size").otherwise("ok").alias("status"))
    return tiles.catalogue_summary(catalogue)


@registered("dataset_fingerprint", """SELECT sha256(string_agg(concat('order/', cast(o_orderkey AS varchar), '.bin=', cast(o_custkey AS varchar), chr(0)), '' ORDER BY concat('order/', cast(o_orderkey AS varchar), '.bin=', cast(o_custkey AS varchar), chr(0)))) AS fingerprint FROM orders""")
def dataset_fingerprint(t: Tables) -> DataFrame:
    files = t.base("orders").select(F.concat(F.lit("file:/data/order/"), F.col("o_orderkey").cast("string"), F.lit(".bin")).alias("path"), F.col("o_custkey").alias("length"))
    return tiles.dataset_fingerprint(files, "/data")


@registered("tree_fingerprint", """
WITH e AS (SELECT concat('order/', cast(o_orderkey AS varchar), '.bin=', cast(o_custkey AS varchar), chr(0)) AS part FROM orders),
n AS (SELECT part, row_number() OVER (ORDER BY part) AS n FROM e),
l1 AS (SELECT (n - 1) // 1024 + 1 AS n, sha256(string_agg(part, '' ORDER BY n)) AS part FROM n GROUP BY 1),
l2 AS (SELECT (n - 1) // 1024 + 1 AS n, sha256(string_agg(part, '' ORDER BY n)) AS part FROM l1 GROUP BY 1),
l3 AS (SELECT sha256(string_agg(part, '' ORDER BY n)) AS part FROM l2)
SELECT (SELECT count(*) FROM e) AS files, CASE WHEN (SELECT count(*) FROM l1) = 1 THEN (SELECT min(part) FROM l1) WHEN (SELECT count(*) FROM l2) = 1 THEN (SELECT min(part) FROM l2)
 ELSE (SELECT part FROM l3) END AS fingerprint""")
def tree_fingerprint(t: Tables) -> DataFrame:
    files = t.base("orders").select(F.concat(F.lit("file:/data/order/"), F.col("o_orderkey").cast("string"), F.lit(".bin")).alias("path"), F.col("o_custkey").alias("length"))
    return tiles.tree_fingerprint(files, "/data")


@registered("transcode", _CELLS + """
SELECT lat_deg, lon_deg, CASE WHEN lat_deg % 3 = 0 THEN 'float32' ELSE 'int16' END AS encoding, count(*) AS sample_count, count(*) - count(m) AS void_count,
 CASE WHEN lat_deg % 3 <> 0 AND max(abs(floor(m * 20.3e0 + 0.5))) > 32767 THEN 'value outside 16 bits' END AS reject_reason, round(sum(CASE WHEN lat_deg % 3 = 0 THEN m * 20.3e0 ELSE floor(m * 20.3e0 + 0.5) END) / 100, 0) + 0e0 AS hundreds FROM samples GROUP BY 1, 2""")
def transcode(t: Tables) -> DataFrame:
    scaled = t.dem_tiles.withColumn("samples", F.transform("samples", lambda v: v * 20.3)).withColumn("fractional", F.col("lat_deg") % 3 == 0)
    coded = tiles.transcode(scaled, "int16")
    total = F.aggregate(F.filter("samples", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    return coded.select("lat_deg", "lon_deg", "encoding", F.col("sample_count").cast("bigint").alias("sample_count"), F.col("void_count").cast("bigint").alias("void_count"),
                        "reject_reason", (F.round(total / 100, 0) + 0.0).alias("hundreds"))


@registered("skip_existing", with_tables("points", "cities") + """
SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg FROM points WHERE (cast(floor(lat) AS int), cast(floor(lon) AS int)) NOT IN (SELECT (cast(floor(lat) AS int), cast(floor(lon) AS int)) FROM cities)""")
def skip_existing(t: Tables) -> DataFrame:
    return tiles.skip_existing(t.dem_tiles, tiles.required_tiles(t.cities), ["lat_deg", "lon_deg"]).select("lat_deg", "lon_deg")


# Rasters to slice: one per supplier, twelve by ten pixels of a quarter degree.
_RASTERS = """SELECT s_suppkey AS raster_id, (s_suppkey * 53 % 340) - 170 + (s_suppkey % 4) * 0.25e0 AS west, (s_suppkey * 37 % 150) - 70 + (s_suppkey % 3) * 0.25e0 AS north FROM {supplier}"""
_PIXELS = "CASE WHEN (raster_id + px * 3 + py * 7) % 13 > 0 THEN cast((raster_id * 31 + px * 17 + py * 5) % 3000 - 400 AS double) END"


def _rasters(t: Tables):
    rasters = t._sql(_RASTERS, "supplier").select("raster_id", "west", "north", F.lit(0.25).alias("pixel_lat"), F.lit(0.25).alias("pixel_lon"),
                                                  F.lit(12).alias("width"), F.lit(10).alias("height"))
    pixels = (rasters.select("raster_id").withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(9)))))
    return rasters, pixels.withColumn("meters", F.expr(_PIXELS)).withColumn("code", F.expr("cast((raster_id + px + py * 2) % 12 * 10 AS int)"))


@registered("slice_raster", f"WITH r AS ({_RASTERS.replace('{supplier}', 'supplier')})" + f"""
, c AS (SELECT raster_id, west, north, a.i AS lat_deg, o.i AS lon_deg, gy.i AS gy, gx.i AS gx FROM r, range(-90, 90) a(i), range(-180, 180) o(i), range(5) gy(i), range(5) gx(i)
  WHERE a.i BETWEEN floor(north - 2.5) AND ceil(north) - 1 AND o.i BETWEEN floor(west) AND ceil(west + 3) - 1)
, p AS (SELECT *, cast(floor((lon_deg + gx / 4e0 - west) / 0.25) AS int) AS x, cast(floor((north - (lat_deg + 1 - gy / 4e0)) / 0.25) AS int) AS y FROM c)
, q AS (SELECT raster_id, lat_deg, lon_deg, gx, gy, CASE WHEN x = 12 THEN 11 ELSE x END AS px, CASE WHEN y = 10 THEN 9 ELSE y END AS py FROM p)
SELECT raster_id, lat_deg::int AS lat_deg, lon_deg::int AS lon_deg, gx::int AS gx, gy::int AS gy, CASE WHEN px BETWEEN 0 AND 11 AND py BETWEEN 0 AND 9 THEN {_PIXELS} END AS meters FROM q""")
def slice_raster(t: Tables) -> DataFrame:
    rasters, pixels = _rasters(t)
    return raster.slice_raster_to_cells(rasters, pixels.drop("code")).select("raster_id", "lat_deg", "lon_deg", "gx", "gy", "meters")


@registered("downsample_landcover", f"WITH r AS ({_RASTERS.replace('{supplier}', 'supplier')})" + """
, c AS (SELECT raster_id, a.i AS lat_deg, o.i AS lon_deg, cast(floor((o.i - west) / 0.25 + 0.5) AS int) AS wx, cast(floor((north - (a.i + 1)) / 0.25 + 0.5) AS int) AS wy FROM r, range(-90, 90) a(i), range(-180, 180) o(i)
  WHERE a.i BETWEEN floor(north - 2.5) AND ceil(north) - 1 AND o.i BETWEEN floor(west) AND ceil(west + 3) - 1)
SELECT raster_id, lat_deg::int AS lat_deg, lon_deg::int AS lon_deg, gx.i::int AS gx, gy.i::int AS gy,
 CASE (raster_id + (wx // 2 + gx.i) * 2 + (wy // 2 + gy.i) * 4) % 12 * 10 WHEN 10 THEN 'TREE_COVER' WHEN 20 THEN 'SHRUBLAND' WHEN 30 THEN 'GRASSLAND' WHEN 40 THEN 'CROPLAND' WHEN 50 THEN 'BUILT_UP'
 WHEN 60 THEN 'BARE_SPARSE' WHEN 70 THEN 'SNOW_ICE' WHEN 80 THEN 'PERMANENT_WATER' WHEN 90 THEN 'HERBACEOUS_WETLAND' WHEN 100 THEN 'MOSS_LICHEN' ELSE 'UNKNOWN' END AS landcover
FROM c, range(2) gx(i), range(2) gy(i) WHERE wx >= 0 AND wy >= 0 AND wx + 4 <= 12 AND wy + 4 <= 10""")
def downsample_landcover(t: Tables) -> DataFrame:
    rasters, pixels = _rasters(t)
    return raster.downsample_landcover(rasters.withColumnRenamed("pixel_lat", "pixel"), pixels.drop("meters"), 2)
