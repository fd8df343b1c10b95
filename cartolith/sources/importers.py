"""Shapefile records and collection features as rows of the vector store, and the store itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartolith.functions import water as fw
from cartolith.functions.text import blank_to_null
from cartolith.operators.clip import clip_rings
from cartolith.operators.gazetteer import alternate_names, cities_to_countries, regions_to_countries
from cartolith.operators.shapes import cut_at_antimeridian, line_center_lat, ring_area, rings_box
from cartolith.operators.tiles import write_table_if_free
from cartolith.params import VECTOR_SCHEMAS
from cartolith.session import materialise
from cartolith.sources.shapefile import AREA_TYPES, LINE_TYPES
from cartolith.sources.vectors import MADE_BY_PEOPLE, assign_ids

Box = tuple[float, float, float, float]


def _in_range(parts: Column) -> Column:
    return F.forall(F.flatten(parts), lambda p: F.coalesce(p["lat"].between(-90, 90) & p["lon"].between(-180, 180), F.lit(False)))


def _with_box(rows: DataFrame) -> DataFrame:
    south, west, north, east = rings_box(F.col("rings"))
    return rows.withColumns({"min_lat": south, "min_lon": west, "max_lat": north, "max_lon": east})


def rivers(records: DataFrame, blocks_per_km: float = 1.0, box: Box | None = None) -> DataFrame:
    """River reaches of shapefile records, with a reject_reason where one is not used.

    * a reach any of whose attributes speaks of a canal or a reservoir is left out, whatever its shape
    * records that are no lines, are malformed or leave the globe are ``strict``: an import fails on them, see ``split_rejects``
    * lines are cut at 180 degrees before width and radius are worked out; a missing or unreadable discharge is 0
    * with ``box`` (south, west, north, east) reaches outside it are left out
    """
    values = F.transform(F.map_values("attributes"), F.lower)
    made = F.exists(values, lambda v: v.contains(MADE_BY_PEOPLE[0]) | v.contains(MADE_BY_PEOPLE[1]))
    discharge = F.coalesce(F.try_element_at("attributes", F.lit("DIS_AV_CMS")).try_cast("double"), F.lit(0.0))
    width = fw.river_width_m(discharge, blocks_per_km)
    strict = (F.when(~F.col("shape_type").isin(*LINE_TYPES), "not a line").when(F.col("status") != "ok", F.col("status"))
              .when(~_in_range(F.col("parts")), "invalid position"))
    rows = _with_box(records.withColumn("rings", F.when(strict.isNull(), cut_at_antimeridian(F.col("parts")))))
    outside = F.lit(False)
    if box:
        south, west, north, east = box

        def meets(piece: Column) -> Column:  # piece by piece: the box of a line over 180 degrees spans the globe
            a, b, c, d = rings_box(F.array(piece))
            return (a <= north) & (c >= south) & (b <= east) & (d >= west)
        outside = ~F.coalesce(F.exists("rings", meets), F.lit(True))
    reason = F.when(made, "made by people").otherwise(F.coalesce(strict, F.when(outside, "outside the box")))
    return rows.select(
        "file", "ordinal", (~made & strict.isNotNull()).alias("strict"), reason.alias("reject_reason"),
        blank_to_null(F.try_element_at("attributes", F.lit("NAME"))).alias("name"), F.lit("RIVER").alias("water_type"), "min_lat", "min_lon", "max_lat", "max_lon",
        fw.river_bed_depth_m(width).alias("bed_depth_m"), F.lit(None).cast("double").alias("surface_elevation_m"), discharge.alias("discharge_cms"),
        F.lit(True).alias("is_line"), fw.river_radius_degrees(width, line_center_lat(F.col("rings"))).alias("radius_deg"), "rings")


def polygons(parts: Column, roles: Column) -> Column:
    """Shells with the holes that follow them; holes before the first shell belong to nothing and are dropped."""
    at = F.filter(F.transform(roles, lambda r, i: F.when(r == "shell", i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(roles)))
    return F.when(F.size(at) > 0, F.zip_with(at, ends, lambda a, b: F.slice(parts, a + 1, b - a))).otherwise(F.slice(F.array(parts), 1, 0))


def karst(records: DataFrame, box: Box | None = None) -> DataFrame:
    """Karst areas of shapefile records: rings of every polygon, shell first, with a reject_reason where one is not used.

    * records of other types are passed over: an archive may hold more layers than the one asked for
    * malformed records and those that leave the globe are ``strict``
    * areas without a shell or without area are left out; with ``box`` areas are cut to it, and what has no area inside is left out
    """
    area = F.col("shape_type").isin(*AREA_TYPES)
    strict = F.when(area & (F.col("status") != "ok"), F.col("status")).when(area & ~_in_range(F.col("parts")), "invalid position")
    rings = F.flatten(polygons(F.col("parts"), F.col("part_roles")))
    rows = records.withColumn("rings", rings).withColumn("shells", F.size("rings"))
    if box:
        rows = rows.withColumn("rings", clip_rings(F.col("rings"), box))
    whole = F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda a, v: a + F.abs(v))
    reason = F.when(~area, "not an area").otherwise(F.coalesce(strict, F.when(F.col("shells") == 0, "no shell").when(
        whole == 0.0, F.when(F.lit(box is not None), "outside the box").otherwise("zero area"))))
    return _with_box(rows).select("file", "ordinal", strict.isNotNull().alias("strict"), reason.alias("reject_reason"), "min_lat", "min_lon", "max_lat", "max_lon", "rings")


def karst_features(features: DataFrame, box: Box | None = None) -> DataFrame:
    """Karst areas of decoded collection features, with a reject_reason where one is not used.

    * features that are no polygons, and those whose geometry could not be used, are left out; none of them is ``strict``
    * with ``box`` (south, west, north, east) areas are cut to it, and what has no area inside is left out
    """
    area = F.coalesce(F.col("geometry_type").isin("Polygon", "MultiPolygon"), F.lit(False))
    bad = F.when(~area, "not an area").otherwise(F.col("reject_reason"))
    rows = features.select("file", "ordinal", bad.alias("bad"), F.when(bad.isNull(), F.col("rings")).alias("rings"))
    rows = rows.withColumn("rings", F.coalesce("rings", F.array().cast(features.schema["rings"].dataType)))
    if box:
        rows = rows.withColumn("rings", clip_rings(F.col("rings"), box))
    whole = F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda a, v: a + F.abs(v))
    reason = F.coalesce("bad", F.when(whole == 0.0, "outside the box" if box else "zero area"))
    return _with_box(rows).select("file", "ordinal", F.lit(False).alias("strict"), reason.alias("reject_reason"), "min_lat", "min_lon", "max_lat", "max_lon", "rings")


def cave_entrances(features: DataFrame, box: Box | None = None) -> DataFrame:
    """Cave entrances of decoded collection features, with a reject_reason where one is not used.

    An entrance is a point tagged natural=cave_entrance; its name stays as it is. The edge of ``box`` belongs to it.
    """
    tagged = F.coalesce(F.try_element_at("properties", F.lit("natural")) == "cave_entrance", F.lit(False))
    reason = (F.when(~tagged, "not a cave entrance").when(~F.coalesce(F.col("geometry_type") == "Point", F.lit(False)), "not a point")
              .otherwise(F.col("reject_reason")))
    if box:
        south, west, north, east = box
        reason = F.coalesce(reason, F.when(~(F.col("lat").between(south, north) & F.col("lon").between(west, east)), "outside the box"))
    return features.select("file", "ordinal", F.lit(False).alias("strict"), reason.alias("reject_reason"), F.col("lat").alias("latitude"),
                           F.col("lon").alias("longitude"), F.try_element_at("properties", F.lit("name")).alias("name"))


def regions(identified: DataFrame, countries: DataFrame, box: Box | None = None) -> DataFrame:
    """Regions of identified boundary features with their country_id, with a reject_reason where one is not used.

    Features that are no usable regions are left out of the result. A region of an unknown country is rejected; from a native
    source that is ``strict``. With ``box`` regions whose own box does not meet it are rejected.
    """
    found = _with_box(identified.where("kind = 'REGION' AND reject_reason IS NULL").drop("reject_reason"))
    kept, lost = regions_to_countries(found, countries)
    outside = F.lit(None).cast("string")
    if box:
        south, west, north, east = box
        meets = (F.col("min_lat") <= north) & (F.col("max_lat") >= south) & (F.col("min_lon") <= east) & (F.col("max_lon") >= west)
        outside = F.when(~meets, "outside the box")
    columns = ["file", "ordinal", "strict", "reject_reason", "country_id", "name", "admin_level", "min_lat", "min_lon", "max_lat", "max_lon", "rings"]
    lost = lost.withColumns({"country_id": F.lit(None).cast("int"), "reject_reason": F.coalesce(outside, "reject_reason")})
    return kept.withColumn("reject_reason", outside).select(*columns).unionByName(lost.select(*columns))


def cities(rows: DataFrame, countries: DataFrame, box: Box | None = None) -> DataFrame:
    """Gazetteer rows as cities with their country_id, with a reject_reason where one is not used.

    * a code that no country has leaves country_id empty
    * with ``box`` rows outside it are passed over whatever else is wrong with them, but for columns and coordinates
    """
    reason, strict = F.col("reject_reason"), F.col("strict")
    if box:
        south, west, north, east = box
        placed = ~F.coalesce(reason.isin("fewer than 15 columns", "bad latitude", "bad longitude"), F.lit(False))
        outside = F.coalesce(placed & ~(F.col("lat").between(south, north) & F.col("lon").between(west, east)), F.lit(False))
        reason, strict = F.when(outside, "outside the box").otherwise(reason), strict & ~outside
    return cities_to_countries(rows.withColumns({"strict": strict, "reject_reason": reason}), countries).select(
        "file", "ordinal", "strict", "reject_reason", "name", "ascii_name", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        "population", "country_id", F.lit(None).cast("int").alias("region_id"), "capital", "alternate_names")


def numbered_cities(accepted: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the cities table and of the table of their names, from accepted cities; ids follow source order.

    Names are the plain form and the listed ones, distinct; all of them unless ``most`` is given.
    """
    numbered = materialise(assign_ids(accepted, ["file", "ordinal"]), "cities")  # both tables take the same ids
    names = assign_ids(alternate_names(numbered, most=most), ["entity_id", "position"]).withColumn("language", F.lit(None).cast("string"))
    return rows_for("cities", numbered, numbered=False), rows_for("geographic_names", names, numbered=False)


def rows_for(table: str, accepted: DataFrame, numbered: bool = True) -> DataFrame:
    """Accepted rows in the columns and types of a table of the vector store, with ids in source order."""
    schema = accepted.sparkSession.createDataFrame([], VECTOR_SCHEMAS[table]).schema
    if numbered:
        accepted = assign_ids(accepted, ["file", "ordinal"])
    return accepted.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def store(rows: DataFrame, table: str, folder: str, sources: DataFrame | None = None, replace: bool = False) -> None:
    """Write one table of the vector store; an occupied one is refused unless it is to be replaced.

    ``sources`` are the imported records (file): their number by file is kept as the table's provenance.
    """
    base = folder.rstrip("/")
    write_table_if_free(rows, f"{base}/{table}", replace)
    if sources is not None:
        detail = sources.groupBy("file").agg(F.count("*").alias("records")).select(
            F.concat(F.lit(f"{table}:"), "file").alias("cache_key"), F.unix_timestamp().cast("bigint").alias("prepared_at"),
            F.to_json(F.struct("file", "records")).alias("detail"))
        write_table_if_free(rows_for("cache_metadata", detail, numbered=False), f"{base}/cache_metadata/{table}", replace)
