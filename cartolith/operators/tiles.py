"""Tile catalogues, source manifests, area sizing and data status."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from cartolith.functions.coords import Extent, Grid, tile_lat, tile_lon
from cartolith.operators.ordering import with_global_row_number
from cartolith.session import materialise

# How published source tiles are named and laid out.
DEM_RESOLUTIONS = {"30": 10, "90": 30}
LANDCOVER_STEP, LANDCOVER_SOUTH, LANDCOVER_NORTH = 3, -60, 84
BATHYMETRY_STEP = 90
BYTES_PER_CHUNK = 15 * 1024


def _steps(low: Column, high: Column, step: int, first: int, last: int) -> Column:
    """Multiples of step from floor(low) while below high, within [first, last]."""
    begin = F.floor(F.floor(low) / step) * step
    end = F.ceil(high / step) * step - step
    begin, end = F.greatest(begin, F.lit(first)).cast("int"), F.least(end, F.lit(last)).cast("int")
    return F.explode(F.when(begin <= end, F.sequence(begin, end, F.lit(step))))


def _label(value: Column, positive: str, negative: str, digits: int) -> Column:
    return F.format_string(f"%s%0{digits}d", F.when(value < 0, negative).otherwise(positive), F.abs(value))


def plan_dem(boxes: DataFrame, resolution: str = "90") -> DataFrame:
    """Elevation source tiles of each box: one per degree cell."""
    code = DEM_RESOLUTIONS[resolution]
    cells = (boxes.withColumn("lat_deg", _steps(F.col("min_lat"), F.col("max_lat"), 1, -90, 89))
             .withColumn("lon_deg", _steps(F.col("min_lon"), F.col("max_lon"), 1, -180, 179)))
    name = F.concat(F.lit(f"Copernicus_DSM_COG_{code}_"), _label(F.col("lat_deg"), "N", "S", 2), F.lit("_00_"),
                    _label(F.col("lon_deg"), "E", "W", 3), F.lit("_00_DEM.tif"))
    return cells.select("box_id", F.lit("dem").alias("dataset"), "lat_deg", "lon_deg", name.alias("file_name"))


def plan_bathymetry(boxes: DataFrame) -> DataFrame:
    """Sea-floor source tiles: quadrants of ninety degrees."""
    step = BATHYMETRY_STEP
    cells = (boxes.withColumn("lat_deg", _steps(F.col("min_lat"), F.col("max_lat"), step, -90, 0))
             .withColumn("lon_deg", _steps(F.col("min_lon"), F.col("max_lon"), step, -180, 90)))
    edges = [(F.col("lat_deg") + step), F.col("lat_deg"), F.col("lon_deg"), (F.col("lon_deg") + step)]
    name = F.format_string("gebco_2024_n%d.0_s%d.0_w%d.0_e%d.0.tif", *edges)
    return cells.select("box_id", F.lit("bathymetry").alias("dataset"), "lat_deg", "lon_deg", name.alias("file_name"))


def plan_landcover(boxes: DataFrame) -> DataFrame:
    """Land-cover source tiles: three degrees, published from 60 S to 84 N."""
    step = LANDCOVER_STEP
    cells = (boxes.withColumn("lat_deg", _steps(F.col("min_lat"), F.col("max_lat"), step, LANDCOVER_SOUTH, LANDCOVER_NORTH - step))
             .withColumn("lon_deg", _steps(F.col("min_lon"), F.col("max_lon"), step, -180, 177)))
    name = F.concat(F.lit("ESA_WorldCover_10m_2021_v200_"), _label(F.col("lat_deg"), "N", "S", 2),
                    _label(F.col("lon_deg"), "E", "W", 3), F.lit("_Map.tif"))
    return cells.select("box_id", F.lit("landcover").alias("dataset"), "lat_deg", "lon_deg", name.alias("file_name"))


def manifest_diff(planned: DataFrame, present: DataFrame, absent: DataFrame) -> DataFrame:
    """Planned files that are neither there nor known not to exist."""
    key = ["dataset", "file_name"]
    return (planned.select(*key).distinct().join(present.select(*key), key, "left_anti")
            .join(absent.select(*key), key, "left_anti"))


def manifest_report(planned: DataFrame, present: DataFrame, absent: DataFrame) -> DataFrame:
    """Per dataset: files planned, present with their bytes, known absent, still missing."""
    key = ["dataset", "file_name"]
    wanted = planned.select(*key).distinct()
    marked = (wanted.join(present.groupBy(*key).agg(F.max("bytes").alias("bytes")), key, "left")
              .join(absent.select(*key).distinct().withColumn("gone", F.lit(True)), key, "left"))
    have = F.col("bytes").isNotNull()
    gone = ~have & F.coalesce("gone", F.lit(False))
    return marked.groupBy("dataset").agg(
        F.count("*").alias("planned"), F.count_if(have).alias("present"), F.count_if(gone).alias("absent"),
        F.count_if(~have & ~gone).alias("missing"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_present"))


def skip_existing(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def required_tiles(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct degree cells under a set of points."""
    return points.select(tile_lat(F.col(lat)).alias("lat_deg"), tile_lon(F.col(lon)).alias("lon_deg")).distinct()


def missing_tiles(required: DataFrame, catalog: DataFrame) -> DataFrame:
    return required.join(catalog.select("lat_deg", "lon_deg"), ["lat_deg", "lon_deg"], "left_anti")


def tile_coverage(required: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: tiles required, covered and the covered share."""
    have = catalog.select("lat_deg", "lon_deg").distinct().withColumn("_have", F.lit(True))
    marked = required.join(have, ["lat_deg", "lon_deg"], "left")
    return marked.agg(F.count("*").alias("required"), F.count_if(F.col("_have")).alias("covered")).withColumn(
        "covered_percent", F.when(F.col("required") > 0, F.col("covered") * 100.0 / F.col("required")).otherwise(100.0))


def area_size(extents: DataFrame) -> DataFrame:
    """Chunks, region files of 32 by 32 chunks and estimated bytes of block extents."""
    def count(shift: int) -> Column:
        wide = F.shiftright("max_x", shift) - F.shiftright("min_x", shift) + 1
        deep = F.shiftright("max_z", shift) - F.shiftright("min_z", shift) + 1
        return wide.cast("bigint") * deep
    return extents.withColumn("chunks", count(4)).withColumn("region_files", count(9)).withColumn(
        "bytes", F.col("chunks") * BYTES_PER_CHUNK)


def area_plan(extents: DataFrame, required: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sizing of each extent (area_id) with the share of its tiles that are there."""
    have = catalog.select("lat_deg", "lon_deg").distinct().withColumn("_have", F.lit(True))
    shares = (required.join(have, ["lat_deg", "lon_deg"], "left").groupBy("area_id")
              .agg(F.count("*").alias("tiles"), F.count_if(F.col("_have")).alias("tiles_present")))
    return (area_size(extents).join(shares, "area_id", "left")
            .withColumn("tiles_percent", F.when(F.col("tiles") > 0, F.col("tiles_present") * 100.0 / F.col("tiles"))))


def dataset_fingerprint(files: DataFrame, root: str) -> DataFrame:
    """SHA-256 over the sorted relative paths and sizes of a folder's files.

    The digest is sequential by definition; it sees only names and sizes, never contents.
    """
    relative = F.regexp_replace("path", rf"^(file:)?/*\Q{root.strip('/')}\E/", "")
    entry = F.concat(relative, F.lit("="), F.col("length").cast("string"), F.lit("\0"))
    return files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ""), 256).alias("fingerprint"))


def tree_fingerprint(files: DataFrame, root: str, fan_in: int = 1024) -> DataFrame:
    """(files, fingerprint) of a folder's files as the root of a hash tree over the sorted relative paths.

    Leaves are SHA-256 digests of ``fan_in`` entries ``path=size`` in path order, every further level those of ``fan_in``
    digests below it, until one is left. A task sees ``fan_in`` entries of a group at most, however many files there are.
    Equal entries count as often as they stand there; no files give the digest of an empty text.
    """
    relative = F.regexp_replace("path", rf"^(file:)?/*\Q{root.strip('/')}\E/", "")
    entries = files.select(F.concat(relative, F.lit("="), F.col("length").cast("string"), F.lit("\0")).alias("part"))
    level = with_global_row_number(entries, [F.col("part")], "n")
    count = total = level.count()
    if not total:
        return files.sparkSession.createDataFrame([(0, hashlib.sha256(b"").hexdigest())], "files long, fingerprint string")
    while True:
        group = F.floor((F.col("n") - 1) / fan_in).cast("bigint") + 1
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"])
        level = materialise(level.groupBy(group.alias("g")).agg(F.sha2(F.array_join(ordered, ""), 256).alias("part"))
                            .withColumnRenamed("g", "n"), "tree-level")
        count = -(-count // fan_in)
        if count == 1:
            return level.select(F.lit(total).cast("bigint").alias("files"), F.col("part").alias("fingerprint"))


def catalogue_summary(catalogue: DataFrame) -> DataFrame:
    """One row over a tile catalogue with status: usable and corrupt counts, bathymetry, largest tile."""
    usable = F.col("status") == "ok"
    return catalogue.agg(F.count_if(usable).alias("tiles"), F.count_if(~usable).alias("corrupt"),
                         F.coalesce(F.bool_or(usable & F.col("bathymetry")), F.lit(False)).alias("has_bathymetry"),
                         F.coalesce(F.max(F.when(usable, F.col("bytes"))), F.lit(0)).alias("largest_tile_bytes"))


def data_status(catalogue: DataFrame, required: DataFrame) -> DataFrame:
    """One-row report: tiles, bathymetry, coverage text, corrupt files, missing tiles."""
    usable = catalogue.filter("status = 'ok'")
    summary = catalogue_summary(catalogue).crossJoin(F.broadcast(
        usable.agg(F.min("lat_deg").alias("s"), F.min("lon_deg").alias("w"),
                   (F.max("lat_deg") + 1).alias("n"), (F.max("lon_deg") + 1).alias("e"))))
    missing = missing_tiles(required, usable).agg(F.count("*").alias("missing"))
    text = F.format_string("%d..%d N, %d..%d E", "s", "n", "w", "e")
    return summary.crossJoin(F.broadcast(missing)).select(
        "tiles", "has_bathymetry", F.when(F.col("tiles") > 0, text).otherwise("none").alias("coverage"), "corrupt", "missing")


def transcode(tiles: DataFrame, encoding: str) -> DataFrame:
    """Encode sample arrays: whole metres in 16 bits, or single precision.

    Tiles whose source is fractional (``fractional``) are always stored in single precision. Values that do not
    fit 16 bits reject the tile.
    """
    wanted = F.when(F.col("fractional"), "float32").otherwise(encoding)
    whole = F.transform("samples", lambda v: F.floor(v + 0.5))
    fits = F.forall(whole, lambda v: v.isNull() | v.between(-32767, 32767))
    voids = F.size(F.filter("samples", lambda v: v.isNull()))
    return (tiles.withColumn("encoding", wanted)
            .withColumn("reject_reason", F.when((F.col("encoding") == "int16") & ~fits, "value outside 16 bits"))
            .withColumn("sample_count", F.size("samples")).withColumn("void_count", voids)
            .withColumn("samples", F.when(F.col("encoding") == "int16", whole.cast("array<float>"))
                        .otherwise(F.col("samples").cast("array<float>"))))


def write_tiles(tiles: DataFrame, path: str, replace: bool = False) -> None:
    """Store tiles partitioned by degree cell; existing cells are kept unless replaced."""
    spark = tiles.sparkSession
    if not replace:
        try:
            tiles = skip_existing(tiles, spark.read.parquet(path), ["lat_deg", "lon_deg"])
        except Exception as error:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
    (tiles.repartition("lat_deg", "lon_deg").write.mode("overwrite" if replace else "append")
     .option("partitionOverwriteMode", "dynamic").partitionBy("lat_deg", "lon_deg").parquet(path))


def write_table_if_free(df: DataFrame, path: str, replace: bool = False) -> None:
    """Vector tables refuse an occupied target unless told to replace it."""
    df.write.mode("overwrite" if replace else "errorifexists").option("partitionOverwriteMode", "static").parquet(path)
