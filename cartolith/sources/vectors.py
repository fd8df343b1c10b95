"""Vector files as tables: feature collections, gazetteers and attribute dialects.

Normalisers split their input into accepted rows and rejected rows with a reason. Rejected
rows of native sources are errors; those of published sources are skipped and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartolith.functions import water as fw
from cartolith.functions.text import blank_to_null
from cartolith.operators.ordering import first_per_key, with_global_row_number
from cartolith.operators.shapes import cut_at_antimeridian, line_center_lat, ring_area, rings_box

_FEATURE = "struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"
_POSITIONS = {"LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>",
              "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>",
              "Point": "array<double>"}
# Attributes tried in order.
COUNTRY_CODES = ("ISO_A2", "ISO_A2_EH", "WB_A2", "FIPS_10")
COUNTRY_NAMES = ("NAME", "NAME_EN", "ADMIN", "SOVEREIGNT")
REGION_CODES = ("iso_a2", "adm0_a2")
REGION_NAMES = ("name", "name_en", "woe_name")
KIND_KEYS = ("featurecla", "fclass", "FCLASS", "waterway", "type")
MADE_BY_PEOPLE = ("canal", "reservoir")
LAKE_CLASSES = ("lake", "alkaline lake", "playa")
GAZETTEER_COLUMNS = ("geoname_id", "name", "ascii_name", "alternate_names", "latitude", "longitude", "feature_class",
                     "feature_code", "iso_code", "cc2", "admin1", "admin2", "admin3", "admin4", "population",
                     "elevation", "dem", "timezone", "modified")


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of a collection (one document per file) or of feature-per-line files.

    Returns file, ordinal, properties, geometry_type, rings, lat, lon and reject_reason.
    """
    if lines:
        raw = spark.read.schema("type string, properties map<string,string>, "
                                "geometry struct<type:string, coordinates:string>").json(path)
        features = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"),
                              F.struct("type", "properties", "geometry").alias("feature"))
    else:
        raw = spark.read.schema(f"type string, features array<{_FEATURE}>").option("multiLine", "true").json(path)
        checked = raw.select(F.col("_metadata.file_path").alias("file"), F.when(
            (F.col("type") == "FeatureCollection") & F.col("features").isNotNull(), F.col("features")).otherwise(
            F.raise_error(F.concat(F.lit("not a feature collection: "), F.col("_metadata.file_path"))).cast(f"array<{_FEATURE}>"))
            .alias("features"))
        features = checked.select("file", F.posexplode("features").alias("ordinal", "feature"))
    return decode_features(features)


def _points(positions: Column) -> Column:
    return F.transform(positions, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))


def decode_features(features: DataFrame) -> DataFrame:
    """Typed geometry of features (file, ordinal, feature) with a reason where it is not usable."""
    kind, text = F.col("feature.geometry.type"), F.col("feature.geometry.coordinates")

    def parsed(name: str) -> Column:
        return F.from_json(F.when(kind == name, text), _POSITIONS[name])

    rings = F.coalesce(
        F.transform(parsed("Polygon"), _points), F.transform(F.flatten(parsed("MultiPolygon")), _points),
        F.when(kind == "LineString", F.array(_points(parsed("LineString")))),
        F.transform(parsed("MultiLineString"), _points))
    spot = parsed("Point")
    table = features.select("file", "ordinal", F.col("feature.properties").alias("properties"), kind.alias("geometry_type"),
                            # one row each: a filter on the reason would otherwise be pushed below and parse the text again wherever it is named
                            F.explode(F.array(rings)).alias("rings"), F.get(spot, F.lit(1)).alias("lat"), F.get(spot, F.lit(0)).alias("lon"))
    area = F.col("geometry_type").isin("Polygon", "MultiPolygon")
    line = F.col("geometry_type").isin("LineString", "MultiLineString")
    in_range = F.forall(F.flatten("rings"), lambda p: F.coalesce(p["lat"].between(-90, 90) & p["lon"].between(-180, 180), F.lit(False)))
    closed = F.forall("rings", lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)))
    long_enough = F.forall("rings", lambda r: F.size(r) >= 2)
    good_point = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    no = F.lit(False)
    reason = (F.when(~F.coalesce(F.col("geometry_type").isin(*_POSITIONS), no), "unsupported geometry")
              .when((F.col("geometry_type") == "Point") & ~good_point, "invalid position")
              .when((area | line) & (F.coalesce(F.size("rings"), F.lit(0)) < 1), "empty geometry")
              .when((area | line) & ~F.coalesce(in_range, no), "invalid position")
              .when(area & ~F.coalesce(closed, no), "open or short ring")
              .when(line & ~F.coalesce(long_enough, no), "short line")
              .when(area & (F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda a, v: a + v) == 0.0), "zero area"))
    return table.select("*", F.explode(F.array(reason)).alias("reject_reason"))


def _first_code(props: Column, keys) -> Column:
    def code(key: str) -> Column:
        value = F.upper(F.trim(props[key]))
        return F.when(value.rlike("^[A-Z]{2}$"), value)
    return F.coalesce(*[code(k) for k in keys])


def _first_text(props: Column, keys) -> Column:
    return F.coalesce(*[blank_to_null(props[k]) for k in keys])


def boundary_identity(features: DataFrame) -> DataFrame:
    """Who a boundary belongs to: kind, name, iso_code, country_iso_code, admin_level, strict, reject_reason."""
    p = F.col("properties")
    strict = p["boundary_type"].isNotNull()
    native_kind = F.upper(F.trim(p["boundary_type"]))
    published_region = p["admin"].isNotNull() & p["name"].isNotNull()
    region_code, region_name = _first_code(p, REGION_CODES), _first_text(p, REGION_NAMES)
    code, name = _first_code(p, COUNTRY_CODES), _first_text(p, COUNTRY_NAMES)
    kind = (F.when(strict, native_kind).when(published_region, F.when(region_code.isNotNull() & region_name.isNotNull(), "REGION"))
            .when(code.isNotNull() & name.isNotNull(), "COUNTRY"))
    level = F.coalesce(p["admin_level"].try_cast("int"), F.lit(1))
    out = features.withColumn("strict", strict).withColumn("kind", kind).select(
        *features.columns, "strict", "kind",
        F.when(strict, blank_to_null(p["name"])).when(F.col("kind") == "REGION", region_name).otherwise(name).alias("name"),
        F.when(F.col("kind") == "COUNTRY", F.when(strict, blank_to_null(p["iso_code"])).otherwise(code)).alias("iso_code"),
        F.when(F.col("kind") == "REGION", F.when(strict, blank_to_null(p["country_iso_code"])).otherwise(region_code)).alias("country_iso_code"),
        F.when(strict, level).otherwise(1).alias("admin_level"))
    def two(column: str) -> Column:
        return F.coalesce(F.col(column).rlike("^[A-Z]{2}$"), F.lit(False))
    problem = (F.when(F.col("kind").isNull(), "unidentified")
               .when(F.col("strict") & ~F.col("kind").isin("COUNTRY", "REGION"), "boundary_type must be COUNTRY or REGION")
               .when((F.col("kind") == "COUNTRY") & (F.col("name").isNull() | ~two("iso_code")), "country needs name and code")
               .when((F.col("kind") == "REGION") & (F.col("name").isNull() | ~two("country_iso_code")
                                                    | ~F.col("admin_level").between(1, 10)), "region needs name, country and level"))
    return out.withColumn("reject_reason", F.coalesce("reject_reason", problem))


def water_type(props: Column) -> Column:
    """Type from the native attribute, a discharge, or a published feature class; NULL when unknown."""
    native = F.upper(F.trim(props["water_type"]))
    river = props["DIS_AV_CMS"].isNotNull() | props["dis_av_cms"].isNotNull()
    published = F.lower(F.trim(props["featurecla"]))
    return (F.when(props["water_type"].isNotNull(), F.when(native.isin("OCEAN", "LAKE", "RIVER"), native))
            .when(river, "RIVER").when(published.isin(*LAKE_CLASSES), "LAKE").when(published == "ocean", "OCEAN"))


def made_by_people(props: Column) -> Column:
    """Canals and reservoirs, whatever attribute says so."""
    values = F.array(*[F.lower(F.trim(props[k])) for k in KIND_KEYS])
    return F.exists(values, lambda v: F.coalesce(v.contains(MADE_BY_PEOPLE[0]) | v.contains(MADE_BY_PEOPLE[1]), F.lit(False)))


def water_features(features: DataFrame, blocks_per_km: float = 1.0) -> DataFrame:
    """Water bodies from decoded features; unusable ones keep a reject_reason."""
    p = F.col("properties")
    kind = water_type(p)
    discharge = F.coalesce(p["DIS_AV_CMS"].try_cast("double"), p["dis_av_cms"].try_cast("double"), F.lit(0.0))
    width = fw.river_width_m(discharge, blocks_per_km)
    line = F.col("geometry_type").isin("LineString", "MultiLineString")
    # cut first: radius and box are those of the pieces
    typed = features.withColumn("rings", F.when(line, cut_at_antimeridian(F.col("rings"))).otherwise(F.col("rings"))).withColumn(
        "water_type", kind).withColumn("strict", p["water_type"].isNotNull())
    reason = (F.when(made_by_people(p), "made by people").when(F.col("water_type").isNull(), "unknown water type")
              .when((F.col("water_type") == "RIVER") != line, "geometry does not fit the type"))
    south, west, north, east = rings_box(F.col("rings"))
    return typed.withColumn("reject_reason", F.coalesce("reject_reason", reason)).select(
        "file", "ordinal", "strict", "reject_reason", blank_to_null(p["name"]).alias("name"), "water_type",
        south.alias("min_lat"), west.alias("min_lon"), north.alias("max_lat"), east.alias("max_lon"),
        fw.bed_depth_m(F.col("water_type"), p, width).alias("bed_depth_m"),
        fw.surface_elevation_m(F.col("water_type"), p).alias("surface_elevation_m"),
        F.when(F.col("water_type") == "RIVER", discharge).otherwise(0.0).alias("discharge_cms"), line.alias("is_line"),
        F.when(line, fw.river_radius_degrees(width, line_center_lat(F.col("rings")))).alias("radius_deg"), "rings")


def split_rejects(df: DataFrame, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; with ``fail_fast`` a rejected strict row stops the job."""
    if fail_fast:
        message = F.concat(F.lit("invalid native feature: "), F.col("reject_reason"))
        # not a coalesce: with a reason that is never null the filter below would be decided without a look at the guard
        guard = F.when(F.col("strict") & F.col("reject_reason").isNotNull(), F.raise_error(message).cast("string"))
        df = df.withColumn("reject_reason", guard.otherwise(F.col("reject_reason")))
    return df.filter("reject_reason IS NULL").drop("reject_reason"), df.filter("reject_reason IS NOT NULL")


def import_counts(df: DataFrame) -> DataFrame:
    """Rows per file, outcome and reason."""
    outcome = F.when(F.col("reject_reason").isNull(), "imported").when(F.col("strict"), "failed").otherwise("skipped")
    return df.groupBy("file", outcome.alias("outcome"), F.coalesce("reject_reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("features"))


def require_recognised(df: DataFrame) -> DataFrame:
    """One row per file; stops the job when nothing in a file could be recognised."""
    counts = df.groupBy("file").agg(F.count("*").alias("features"), F.count_if(F.col("reject_reason").isNull()).alias("imported"))
    message = F.concat(F.lit("no recognised feature in "), F.col("file"))
    checked = F.when((F.col("imported") == 0) & (F.col("features") > 0), F.raise_error(message).cast("bigint")).otherwise(F.col("imported"))
    return counts.select("file", "features", checked.alias("imported"))


def assign_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Number rows in source order, first row first."""
    return with_global_row_number(df, [F.col(c) for c in order], "id")


def import_countries(identified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Countries with ids, the first of each code winning, and the repeated rest."""
    countries = identified.filter("reject_reason IS NULL AND kind = 'COUNTRY'")
    first = first_per_key(countries, ["iso_code"], [F.col("file"), F.col("ordinal")])
    repeated = countries.join(first.select("file", "ordinal"), ["file", "ordinal"], "left_anti").withColumn(
        "reject_reason", F.lit("repeated code"))
    south, west, north, east = rings_box(F.col("rings"))
    kept = assign_ids(first, ["file", "ordinal"]).select(
        F.col("id").cast("int").alias("id"), "iso_code", "name", south.alias("min_lat"), west.alias("min_lon"),
        north.alias("max_lat"), east.alias("max_lon"), "rings")
    return kept, repeated


def read_geonames(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer rows with a reject_reason; blank lines and comments are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"), "value")
    return parse_geonames(lines)


def parse_geonames(lines: DataFrame) -> DataFrame:
    """Typed rows from tab-separated lines (file, ordinal, value)."""
    used = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    fields = F.split("value", "\t", -1)
    named = used.select("file", "ordinal", F.size(fields).alias("_n"),
                        *[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(GAZETTEER_COLUMNS)])
    lat, lon, people = (F.trim(F.col(c)).try_cast(t) for c, t in (("latitude", "double"), ("longitude", "double"), ("population", "bigint")))
    typed = named.select("file", "ordinal", "_n", blank_to_null(F.col("name")).alias("name"), blank_to_null(F.col("ascii_name")).alias("ascii_name"),
                         "alternate_names", lat.alias("lat"), lon.alias("lon"), (F.col("feature_code") == "PPLC").alias("capital"),
                         "iso_code", people.alias("population"))
    no = F.lit(False)
    reason = (F.when(F.col("_n") < 15, "fewer than 15 columns").when(~F.coalesce(F.col("lat").between(-90, 90), no), "bad latitude")
              .when(~F.coalesce(F.col("lon").between(-180, 180), no), "bad longitude")
              .when(~F.coalesce(F.col("population") >= 0, no), "bad population").when(F.col("name").isNull(), "no name"))
    return typed.withColumn("strict", F.lit(True)).withColumn("reject_reason", reason).drop("_n")
