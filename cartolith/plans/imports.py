"""Registered imports: file contents are made from the tables by Spark and decoded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartolith.operators.shapes import ring_area
from cartolith.plans.derived import Tables, with_tables
from cartolith.plans.registry import registered
from cartolith.sources import importers, rasters, vectors
from cartolith.functions.coords import tile_stem


def _hex16(value: Column) -> Column:
    """Two big-endian bytes in hex."""
    return F.lpad(F.hex(F.pmod(value, F.lit(65536)).cast("bigint")), 4, "0")


def _hex32(value: Column) -> Column:
    return F.lpad(F.hex(F.pmod(value.cast("bigint"), F.lit(1 << 32))), 8, "0")


def _samples16(t: Tables) -> DataFrame:
    values = F.transform("samples", lambda v: F.coalesce(v, F.lit(-32768.0)).cast("bigint"))
    return t.dem_tiles.withColumn("_hex", F.array_join(F.transform(values, _hex16), ""))


_STATS = with_tables("samples") + """
SELECT lat_deg, lon_deg, 9 AS width, 'ok' AS status, count(m) AS known, sum(m)::double AS total FROM samples GROUP BY 1, 2"""


def _stats(tiles: DataFrame) -> DataFrame:
    known = F.filter("samples", lambda v: v.isNotNull())
    return tiles.select("lat_deg", "lon_deg", "width", "status", F.size(known).cast("bigint").alias("known"),
                        F.aggregate(known, F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"))


@registered("read_hgt", _STATS)
def read_hgt(t: Tables) -> DataFrame:
    files = _samples16(t).select(F.concat(F.lit("/dem/"), tile_stem(F.col("lat_deg"), F.col("lon_deg")), F.lit(".hgt")).alias("path"),
                                 F.unhex("_hex").alias("content"))
    return _stats(rasters.decode_hgt(files))


def _dem_files(t: Tables) -> DataFrame:
    """Prepared files; one cell in nine has a damaged size, one in seven a wrong name."""
    head = F.concat(F.lit("5446444D"), _hex16(F.lit(2)), _hex16(F.lit(1)), _hex32(F.lit(9)), _hex32(F.lit(9)), _hex32(F.col("lat_deg")),
                    _hex32(F.col("lon_deg")), _hex32(F.lit(-32768)), _hex32(F.lit(1)), _hex32(F.lit(1)),
                    F.when((F.col("lat_deg") + F.col("lon_deg")) % 2 == 0, "01").otherwise("00"), F.lit("00" * 27))
    odd = F.pmod(F.col("lat_deg") + F.col("lon_deg"), F.lit(9)) == 4
    lost = F.pmod(F.col("lat_deg") * 3 + F.col("lon_deg"), F.lit(7)) == 2
    name = tile_stem(F.when(lost, -F.col("lat_deg") - 1).otherwise(F.col("lat_deg")), F.col("lon_deg"))
    return _samples16(t).select(F.concat(F.lit("/dem/"), name, F.lit(".tfdem")).alias("path"),
                                F.unhex(F.concat(head, "_hex", F.when(odd, "0000").otherwise(""))).alias("content"))


_STATUS = "CASE WHEN ((lat_deg * 3 + lon_deg) % 7 + 7) % 7 = 2 THEN 'name and header disagree' WHEN ((lat_deg + lon_deg) % 9 + 9) % 9 = 4 THEN 'wrong size' ELSE 'ok' END"


@registered("read_dem_tiles", with_tables("samples") + f"""
SELECT lat_deg, lon_deg, 9 AS width, {_STATUS} AS status, CASE WHEN {_STATUS} = 'ok' THEN count(m) ELSE -1 END AS known, CASE WHEN {_STATUS} = 'ok' THEN sum(m) END::double AS total FROM samples GROUP BY 1, 2""")
def read_dem_tiles(t: Tables) -> DataFrame:
    stats = _stats(rasters.decode_dem_tiles(_dem_files(t)))
    return stats.withColumn("known", F.coalesce(F.when(F.col("status") == "ok", F.col("known")), F.lit(-1)))


@registered("tile_catalogue", with_tables("samples") + f"""
SELECT {_STATUS} AS status, count(*) AS tiles, count(*) FILTER ((lat_deg + lon_deg) % 2 = 0) AS with_bathymetry FROM dem_cells GROUP BY 1""")
def tile_catalogue(t: Tables) -> DataFrame:
    rows = rasters.decode_headers(_dem_files(t))
    return rows.groupBy("status").agg(F.count("*").alias("tiles"), F.count_if("bathymetry").alias("with_bathymetry"))


@registered("read_landcover_grids", with_tables("countries") + """
SELECT printf('grid_%03d', id) AS file_name, 12 AS width, 8 AS height, (SELECT count(*) FROM range(8) y(y), range(12) x(x) WHERE (id * 7 + x * 3 + y * 5) % 12 = 4) AS cropland FROM countries""")
def read_landcover_grids(t: Tables) -> DataFrame:
    def double_hex(value: Column) -> Column:
        # whole degrees: sign, exponent and mantissa follow from the magnitude
        size = F.abs(value)
        power = F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))).cast("int")
        mantissa = ((size / F.pow(F.lit(2.0), power) - 1.0) * float(1 << 52)).cast("bigint")
        bits = F.lpad(F.hex(power + 1023 + F.when(value < 0, 2048).otherwise(0)), 3, "0")
        return F.when(size > 0, F.concat(bits, F.lpad(F.hex(mantissa), 13, "0"))).otherwise("0" * 16)

    grids = t.landcover_tiles.filter(F.col("file_name").startswith("grid"))
    names = F.array(*[F.lit(c) for c in rasters.LANDCOVER_CLASSES])
    cells = F.array_join(F.transform("classes", lambda c: F.lpad(F.hex(F.array_position(names, c) - 1), 2, "0")), "")
    text = F.concat(F.lit("54464C43"), F.lit("0001"), *[double_hex(F.col(c)) for c in ("south", "west", "north", "east")],
                    _hex32(F.col("width")), _hex32(F.col("height")), cells)
    files = grids.select(F.concat(F.lit("/cover/"), "file_name").alias("path"), F.unhex(text).alias("content"))
    rows = rasters.decode_landcover_grids(files)
    crop = F.size(F.filter("classes", lambda c: c == "CROPLAND"))
    return rows.select("file_name", "width", "height", crop.cast("bigint").alias("cropland"))


@registered("read_ascii_grid", """
SELECT concat('s', cast(s_suppkey AS varchar)) AS file_name, cast(s_suppkey % 150 - 70 AS double) AS south, s_suppkey % 300 - 150.25e0 AS west, 'ok' AS status,
 (SELECT count(*) FROM range(6) i(i) WHERE ((s_suppkey + i) % 12) * 10 = 10 AND ((s_suppkey + i) % 12) * 10 <> 110) AS trees FROM supplier WHERE s_suppkey % 5 > 0
UNION ALL SELECT concat('s', cast(s_suppkey AS varchar)), cast(s_suppkey % 150 - 70 AS double), s_suppkey % 300 - 150.25e0, 'too few pixels', -1 FROM supplier WHERE s_suppkey % 5 = 0""")
def read_ascii_grid(t: Tables) -> DataFrame:
    """One small grid text per supplier; every fifth lacks pixels."""
    k = F.col("s_suppkey")
    cells = F.transform(F.sequence(F.lit(0), F.when(k % 5 == 0, 4).otherwise(5)), lambda i: (((k + i) % 12) * 10).cast("string"))
    text = F.concat(F.lit("ncols 3\nnrows 2\nxllcenter "), (k % 300 - 150).cast("string"), F.lit("\nyllcorner "), (k % 150 - 70).cast("string"),
                    F.lit("\ncellsize 0.5\nNODATA_value 110\n"), F.array_join(cells, " "), F.lit("\n"))
    rows = rasters.parse_ascii_grids(t.base("supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("file_name"), text.alias("value")))
    trees = F.coalesce(F.size(F.filter("classes", lambda c: c == "TREE_COVER")), F.lit(-1))
    return rows.select("file_name", "south", "west", "status", F.when(F.col("status") == "ok", trees).otherwise(-1).cast("bigint").alias("trees"))


def _ring_text(x: Column, y: Column, closed: Column) -> Column:
    def spot(a, b):
        return F.format_string("[%d,%d]", (x + a).cast("int"), (y + b).cast("int"))
    return F.concat(F.lit("["), F.concat_ws(",", spot(0, 0), spot(2, 0), spot(2, 1), spot(0, 1), F.when(closed, spot(0, 0))), F.lit("]"))


def _features(t: Tables) -> DataFrame:
    """Water and boundary features as parsed documents, one per part, in six dialects."""
    k, x, y = F.col("p_partkey"), F.col("p_size") * 3, F.col("p_size") - 20
    ring = _ring_text(x, y, k % 11 > 0)
    line = F.format_string("[[%d,%d],[%d,%d]]", (x).cast("int"), y.cast("int"), (x + 1).cast("int"), (y + 1).cast("int"))
    dialect = k % 6
    props = (F.when(dialect == 0, F.create_map(F.lit("water_type"), F.lit("lake"), F.lit("Elevation"), F.col("p_size").cast("string"), F.lit("Depth_avg"), F.lit("-1")))
             .when(dialect == 1, F.create_map(F.lit("DIS_AV_CMS"), F.col("p_retailprice").cast("string")))
             .when(dialect == 2, F.create_map(F.lit("featurecla"), F.lit("Alkaline Lake"), F.lit("name"), F.lit("  ")))
             .when(dialect == 3, F.create_map(F.lit("featurecla"), F.lit("ocean"), F.lit("type"), F.lit("Canal")))
             .when(dialect == 4, F.create_map(F.lit("NAME"), F.col("p_name"), F.lit("ISO_A2"), F.lit("-99"), F.lit("WB_A2"), F.lit("xk")))
             .otherwise(F.create_map(F.lit("boundary_type"), F.lit("region"), F.lit("name"), F.col("p_name"), F.lit("country_iso_code"), F.lit("CA"), F.lit("admin_level"), F.col("p_size").cast("string"))))
    geometry = F.when(dialect == 1, F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))).otherwise(
        F.struct(F.lit("Polygon").alias("type"), F.concat(F.lit("["), ring, F.lit("]")).alias("coordinates")))
    rows = t.base("part").select(F.lit("parts").alias("file"), k.alias("ordinal"), F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")).alias("feature"))
    return vectors.decode_features(rows)


@registered("water_features", """
WITH f AS (SELECT p_partkey AS ordinal, p_partkey % 6 AS d, p_partkey % 11 > 0 OR p_partkey % 6 = 1 AS closed, p_size, p_retailprice AS q FROM part)
SELECT ordinal, d = 0 AS strict, CASE d WHEN 0 THEN 'LAKE' WHEN 1 THEN 'RIVER' WHEN 2 THEN 'LAKE' WHEN 3 THEN 'OCEAN' END AS water_type,
 CASE WHEN NOT closed THEN 'open or short ring' WHEN d = 3 THEN 'made by people' WHEN d > 3 THEN 'unknown water type' END AS reject_reason,
 CASE d WHEN 0 THEN p_size::double WHEN 3 THEN 0e0 END AS surface_elevation_m, round(CASE d WHEN 1 THEN least(greatest(greatest(1000e0, 7.2 * sqrt(q)) / 20, 1), 10) ELSE 0 END, 6) + 0e0 AS bed_depth_m,
 CASE d WHEN 1 THEN q ELSE 0 END AS discharge_cms FROM f""")
def water_features(t: Tables) -> DataFrame:
    rows = vectors.water_features(_features(t))
    return rows.select("ordinal", "strict", "water_type", "reject_reason", "surface_elevation_m", (F.round("bed_depth_m", 6) + 0.0).alias("bed_depth_m"),
                       F.when(F.col("water_type") == "RIVER", F.col("discharge_cms")).otherwise(0.0).alias("discharge_cms"))


@registered("boundary_identity", """
WITH f AS (SELECT p_partkey AS ordinal, p_partkey % 6 AS d, p_partkey % 11 > 0 OR p_partkey % 6 = 1 AS closed, p_size, p_name FROM part)
SELECT ordinal, d = 5 AS strict, CASE d WHEN 4 THEN 'COUNTRY' WHEN 5 THEN 'REGION' END AS kind, CASE WHEN d >= 4 THEN p_name END AS name, CASE d WHEN 4 THEN 'XK' END AS iso_code, CASE d WHEN 5 THEN 'CA' END AS country_iso_code,
 CASE WHEN NOT closed THEN 'open or short ring' WHEN d < 4 THEN 'unidentified' WHEN d = 5 AND p_size > 10 THEN 'region needs name, country and level' END AS reject_reason FROM f""")
def boundary_identity(t: Tables) -> DataFrame:
    rows = vectors.boundary_identity(_features(t))
    kind = F.col("kind")
    return rows.select("ordinal", "strict", "kind", F.when(kind.isNotNull(), F.col("name")).alias("name"), "iso_code", "country_iso_code", "reject_reason")


@registered("import_counts", """
WITH f AS (SELECT p_partkey % 6 AS d, p_partkey % 11 > 0 OR p_partkey % 6 = 1 AS closed FROM part),
r AS (SELECT d, CASE WHEN NOT closed THEN 'open or short ring' WHEN d = 3 THEN 'made by people' WHEN d > 3 THEN 'unknown water type' ELSE '' END AS reason FROM f)
SELECT 'parts' AS file, CASE WHEN reason = '' THEN 'imported' WHEN d = 0 THEN 'failed' ELSE 'skipped' END AS outcome, reason, count(*) AS features FROM r GROUP BY 1, 2, 3""")
def import_counts(t: Tables) -> DataFrame:
    return vectors.import_counts(vectors.water_features(_features(t)))


@registered("require_recognised", """
WITH f AS (SELECT p_partkey % 6 AS d, p_partkey % 11 > 0 OR p_partkey % 6 = 1 AS closed FROM part)
SELECT 'parts' AS file, count(*) AS features, count(*) FILTER (closed AND d < 3) AS imported FROM f""")
def require_recognised(t: Tables) -> DataFrame:
    return vectors.require_recognised(vectors.water_features(_features(t)))


@registered("import_countries", """
SELECT cast(row_number() OVER (ORDER BY o) AS int) AS id, iso_code, name FROM (
 SELECT min(n_nationkey) AS o, concat('Q', chr(cast(65 + n_nationkey % 9 AS int))) AS iso_code, arg_min(n_name, n_nationkey) AS name FROM nation GROUP BY 2)""")
def import_countries(t: Tables) -> DataFrame:
    """Repeated codes keep their first feature; ids follow source order."""
    k = F.col("n_nationkey")
    props = F.create_map(F.lit("NAME"), F.col("n_name"), F.lit("ISO_A2"), F.concat(F.lit("Q"), F.char(F.lit(65) + k % 9)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.concat(F.lit("["), _ring_text(k * 3, k, F.lit(True)), F.lit("]")).alias("coordinates"))
    rows = t.base("nation").select(F.lit("nations").alias("file"), k.alias("ordinal"), F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")).alias("feature"))
    return vectors.import_countries(vectors.boundary_identity(vectors.decode_features(rows)))[0].select("id", "iso_code", "name")


@registered("read_geonames", """
SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 13 > 0 THEN c_name END AS name, c_custkey % 5 = 0 AS capital, CASE WHEN c_custkey % 17 > 0 THEN cast(c_custkey * 10 AS bigint) END AS population,
 CASE WHEN c_custkey % 19 = 0 THEN 'bad latitude' WHEN c_custkey % 17 = 0 THEN 'bad population' WHEN c_custkey % 13 = 0 THEN 'no name' END AS reject_reason
FROM customer WHERE c_custkey % 23 > 0""")
def read_geonames(t: Tables) -> DataFrame:
    """One gazetteer line per customer; some are comments, some are broken."""
    k = F.col("c_custkey")
    fields = [k.cast("string"), F.when(k % 13 > 0, F.col("c_name")).otherwise(" "), F.lit(""), F.lit("a,b"), F.when(k % 19 > 0, (k % 90).cast("string")).otherwise("north"),
              (k % 180).cast("string"), F.lit("P"), F.when(k % 5 == 0, "PPLC").otherwise("PPL"), F.lit("DE"), *[F.lit("")] * 5,
              F.when(k % 17 > 0, (k * 10).cast("string")).otherwise("-5"), *[F.lit("")] * 4]
    line = F.concat(F.when(k % 23 == 0, "#").otherwise(""), F.concat_ws("\t", *fields))
    rows = vectors.parse_geonames(t.base("customer").select(F.lit("f").alias("file"), k.alias("ordinal"), line.alias("value")))
    return rows.select("ordinal", "name", "capital", F.when(F.col("population") >= 0, F.col("population")).alias("population"), "reject_reason")


@registered("tile_inventory", with_tables("samples") + f"SELECT 'dem' AS dataset, lat_deg, lon_deg, 9 AS width, 9 AS height, 'int16' AS encoding, 226::bigint AS bytes FROM dem_cells WHERE {_STATUS} = 'ok'")
def tile_inventory(t: Tables) -> DataFrame:
    return rasters.tile_inventory(rasters.decode_dem_tiles(_dem_files(t)), "dem").select("dataset", "lat_deg", "lon_deg", "width", "height", "encoding", "bytes")


def _collection(t: Tables, table: str, file: str, key: str, props: Column, kind: Column, coordinates: Column) -> DataFrame:
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return vectors.decode_features(t.base(table).select(F.lit(file).alias("file"), F.col(key).alias("ordinal"), feature.alias("feature")))


def _karst_features(t: Tables) -> DataFrame:
    """Areas of one part and of two, a line, an open ring and one beyond the pole."""
    k, d = F.col("p_partkey"), F.col("p_partkey") % 6
    x, y = k % 300 - 150, k % 140 - 70
    ring, beyond = _ring_text(x, y, d != 3), _ring_text(x, y + 200, F.lit(True))
    coordinates = (F.when(d == 1, F.concat(F.lit("[["), ring, F.lit("],["), _ring_text(x + 10, y, F.lit(True)), F.lit("]]"))).when(d == 2, ring)
                   .when(d == 4, F.concat(F.lit("["), beyond, F.lit("]"))).otherwise(F.concat(F.lit("["), ring, F.lit("]"))))
    kind = F.when(d == 1, "MultiPolygon").when(d == 2, "LineString").otherwise("Polygon")
    return _collection(t, "part", "karst", "p_partkey", F.create_map(F.lit("rock"), F.lit("limestone")), kind, coordinates)


_KARST = """WITH f AS (SELECT p_partkey AS k, p_partkey % 6 AS d, p_partkey % 300 - 150 AS x, p_partkey % 140 - 70 AS y FROM part),
p AS (SELECT k, d, y, unnest(CASE WHEN d = 1 THEN [x, x + 10] ELSE [x] END) AS x FROM f WHERE d IN (0, 1, 5))"""


def _karst_rows(rows: DataFrame) -> DataFrame:
    areas = F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda a, v: a + F.abs(v))
    return importers.rows_for("karst_areas", rows.where("reject_reason IS NULL")).select("id", "min_lat", "min_lon", "max_lat", "max_lon", areas.alias("ring_areas"))


@registered("import_karst_features", _KARST + """
SELECT cast(row_number() OVER (ORDER BY k) AS bigint) AS id, min(y) + 0e0 AS min_lat, min(x) + 0e0 AS min_lon, min(y) + 1e0 AS max_lat, max(x) + 2e0 AS max_lon, count(*) * 2e0 AS ring_areas FROM p GROUP BY k""")
def import_karst_features(t: Tables) -> DataFrame:
    return _karst_rows(importers.karst_features(_karst_features(t)))


@registered("import_karst_features_clipped", _KARST + """
SELECT cast(row_number() OVER (ORDER BY k) AS bigint) AS id, min(y) + 0e0 AS min_lat, min(greatest(x, 0)) + 0e0 AS min_lon, min(y) + 1e0 AS max_lat, max(least(x + 2, 51)) + 0e0 AS max_lon,
 sum(least(x + 2, 51) - greatest(x, 0)) + 0e0 AS ring_areas FROM p WHERE x < 51 AND x + 2 > 0 AND y >= 0 AND y < 40 GROUP BY k""")
def import_karst_features_clipped(t: Tables) -> DataFrame:
    return _karst_rows(importers.karst_features(_karst_features(t), (0.0, 0.0, 40.0, 51.0)))


@registered("import_karst_features_rejects", """
SELECT CASE p_partkey % 6 WHEN 2 THEN 'not an area' WHEN 3 THEN 'open or short ring' ELSE 'invalid position' END AS reason, count(*) AS features FROM part WHERE p_partkey % 6 IN (2, 3, 4) GROUP BY 1""")
def import_karst_features_rejects(t: Tables) -> DataFrame:
    rows = importers.karst_features(_karst_features(t)).where("reject_reason IS NOT NULL")
    return rows.groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("features"))


_ENTRANCES = """WITH e AS (SELECT c_custkey AS k, c_custkey % 360 - 180 AS lon, c_custkey % 181 - 90 AS lat, CASE WHEN c_custkey % 3 > 0 THEN c_name WHEN c_custkey % 9 = 0 THEN ' ' END AS name FROM customer
 WHERE c_custkey % 4 > 0 AND c_custkey % 7 > 0 AND c_custkey % 11 > 0 AND c_custkey % 13 > 0)"""


def _entrances(t: Tables) -> DataFrame:
    """Entrances by customer, among peaks, lines, points beyond the pole and points of one number."""
    k = F.col("c_custkey")
    lon, lat = k % 360 - 180, F.when(k % 11 == 0, 95).otherwise(k % 181 - 90)
    spot = F.format_string("[%d,%d]", lon.cast("int"), lat.cast("int"))
    name = F.when(k % 3 > 0, F.col("c_name")).when(k % 9 == 0, " ")
    props = F.map_filter(F.create_map(F.lit("natural"), F.when(k % 4 > 0, "cave_entrance").otherwise("peak"), F.lit("name"), name), lambda _, v: v.isNotNull())
    line = k % 7 == 0
    return _collection(t, "customer", "entrances", "c_custkey", props, F.when(line, "LineString").otherwise("Point"),
                       F.when(line, F.concat(F.lit("["), spot, F.lit(","), spot, F.lit("]"))).when(k % 13 == 0, "[5]").otherwise(spot))


@registered("import_entrances", _ENTRANCES + """
SELECT cast(row_number() OVER (ORDER BY k) AS bigint) AS id, cast(lat AS double) AS latitude, cast(lon AS double) AS longitude, name FROM e""")
def import_entrances(t: Tables) -> DataFrame:
    return importers.rows_for("cave_entrances", importers.cave_entrances(_entrances(t)).where("reject_reason IS NULL"))


@registered("import_entrances_clipped", _ENTRANCES + """
SELECT cast(row_number() OVER (ORDER BY k) AS bigint) AS id, cast(lat AS double) AS latitude, cast(lon AS double) AS longitude, name FROM e WHERE lat BETWEEN -20 AND 35 AND lon BETWEEN -100 AND 20""")
def import_entrances_clipped(t: Tables) -> DataFrame:
    rows = importers.cave_entrances(_entrances(t), (-20.0, -100.0, 35.0, 20.0)).where("reject_reason IS NULL")
    return importers.rows_for("cave_entrances", rows)


def _codes(t: Tables) -> DataFrame:
    return t.base("nation").select(F.concat(F.lit("C"), F.char(F.lit(65) + F.col("n_nationkey"))).alias("iso_code"), F.col("n_nationkey").cast("int").alias("id"))


_CITY_LINES = """WITH k AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN concat('plain ', cast(c_custkey AS varchar)) END AS ascii_name, c_custkey % 90 + 0e0 AS latitude, c_custkey % 180 + 0e0 AS longitude,
 cast(c_custkey * 10 AS bigint) AS population, CASE WHEN c_custkey % 29 > 0 THEN cast(c_nationkey AS int) END AS country_id, c_custkey % 5 = 0 AS capital, concat('other ', cast(c_custkey % 7 AS varchar)) AS alias FROM customer
 WHERE c_custkey % 23 > 0 AND c_custkey % 19 > 0 AND c_custkey % 17 > 0 AND c_custkey % 13 > 0)"""


def _cities(t: Tables, box=None) -> DataFrame:
    """One gazetteer line per customer with its nation's code; some codes are unknown, some lines are comments or broken."""
    k = F.col("c_custkey")
    plain, alias = F.when(k % 4 > 0, F.concat(F.lit("plain "), k.cast("string"))).otherwise(" "), F.concat(F.lit("other "), (k % 7).cast("string"))
    iso = F.when(k % 29 > 0, F.concat(F.lit("C"), F.char(F.lit(65) + F.col("c_nationkey")))).otherwise("zz")
    fields = [k.cast("string"), F.when(k % 13 > 0, F.col("c_name")).otherwise(" "), plain, F.concat(alias, F.lit(", ,"), F.trim(plain), F.lit(","), alias),
              F.when(k % 19 > 0, (k % 90).cast("string")).otherwise("north"), (k % 180).cast("string"), F.lit("P"), F.when(k % 5 == 0, "PPLC").otherwise("PPL"), iso,
              *[F.lit("")] * 5, F.when(k % 17 > 0, (k * 10).cast("string")).otherwise("-5"), *[F.lit("")] * 4]
    line = F.concat(F.when(k % 23 == 0, "#").otherwise(""), F.concat_ws("\t", *fields))
    rows = vectors.parse_geonames(t.base("customer").select(F.lit("f").alias("file"), k.alias("ordinal"), line.alias("value")))
    return importers.cities(rows, _codes(t), box)


@registered("import_cities", _CITY_LINES + """
SELECT cast(row_number() OVER (ORDER BY k) AS int) AS id, name, ascii_name, latitude, longitude, population, country_id, cast(NULL AS int) AS region_id, capital FROM k""")
def import_cities(t: Tables) -> DataFrame:
    return importers.numbered_cities(_cities(t).where("reject_reason IS NULL"))[0]


@registered("import_city_names", _CITY_LINES + """,
n AS (SELECT row_number() OVER (ORDER BY k) AS entity_id, ascii_name, alias FROM k),
a AS (SELECT entity_id, 0 AS place, ascii_name AS name FROM n WHERE ascii_name IS NOT NULL UNION ALL SELECT entity_id, 1, alias FROM n)
SELECT cast(row_number() OVER (ORDER BY entity_id, place) AS int) AS id, 'city' AS entity_type, cast(entity_id AS int) AS entity_id, name, cast(NULL AS varchar) AS language FROM a""")
def import_city_names(t: Tables) -> DataFrame:
    return importers.numbered_cities(_cities(t).where("reject_reason IS NULL"))[1]


@registered("import_cities_rejects", """
WITH k AS (SELECT c_custkey AS k, c_custkey % 90 BETWEEN 10 AND 60 AND c_custkey % 180 BETWEEN 20 AND 120 AS inside FROM customer WHERE c_custkey % 23 > 0),
r AS (SELECT CASE WHEN k % 19 = 0 THEN 'bad latitude' WHEN NOT inside THEN 'outside the box' WHEN k % 17 = 0 THEN 'bad population' WHEN k % 13 = 0 THEN 'no name' END AS reason FROM k)
SELECT reason, reason <> 'outside the box' AS strict, count(*) AS rows FROM r WHERE reason IS NOT NULL GROUP BY 1, 2""")
def import_cities_rejects(t: Tables) -> DataFrame:
    rows = _cities(t, (10.0, 20.0, 60.0, 120.0)).where("reject_reason IS NOT NULL")
    return rows.groupBy(F.col("reject_reason").alias("reason"), "strict").agg(F.count("*").alias("rows"))


def _regions(t: Tables) -> DataFrame:
    """A region per supplier, native or published, some of unknown countries, among countries."""
    k = F.col("s_suppkey")
    code = F.when(k % 7 > 0, F.concat(F.lit("C"), F.char(F.lit(65) + F.col("s_nationkey")))).otherwise("ZZ")
    props = (F.when(k % 3 == 0, F.create_map(F.lit("boundary_type"), F.lit("region"), F.lit("name"), F.col("s_name"), F.lit("country_iso_code"), code, F.lit("admin_level"), (k % 4 + 1).cast("string")))
             .when(k % 3 == 1, F.create_map(F.lit("admin"), F.lit("somewhere"), F.lit("name"), F.col("s_name"), F.lit("iso_a2"), code))
             .otherwise(F.create_map(F.lit("NAME"), F.col("s_name"), F.lit("ISO_A2"), code)))
    rows = _collection(t, "supplier", "regions", "s_suppkey", props, F.lit("Polygon"), F.concat(F.lit("["), _ring_text(k % 300 - 150, k % 140 - 70, F.lit(True)), F.lit("]")))
    return importers.regions(vectors.boundary_identity(rows), _codes(t))


@registered("import_regions", """
SELECT cast(row_number() OVER (ORDER BY s_suppkey) AS int) AS id, cast(s_nationkey AS int) AS country_id, s_name AS name, cast(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 4 + 1 ELSE 1 END AS int) AS admin_level,
 s_suppkey % 140 - 70e0 AS min_lat, s_suppkey % 300 - 150e0 AS min_lon, s_suppkey % 140 - 69e0 AS max_lat, s_suppkey % 300 - 148e0 AS max_lon FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 7 > 0""")
def import_regions(t: Tables) -> DataFrame:
    return importers.rows_for("regions", _regions(t).where("reject_reason IS NULL")).drop("rings")


@registered("import_regions_rejects", """
SELECT s_suppkey % 3 = 0 AS strict, CASE WHEN s_suppkey % 3 = 0 THEN 'error: unknown country' ELSE 'skipped: unknown country' END AS reason, count(*) AS regions FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 7 = 0 GROUP BY 1, 2""")
def import_regions_rejects(t: Tables) -> DataFrame:
    rows = _regions(t).where("reject_reason IS NOT NULL")
    return rows.groupBy("strict", F.col("reject_reason").alias("reason")).agg(F.count("*").alias("regions"))
