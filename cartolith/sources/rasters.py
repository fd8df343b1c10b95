"""Raster files as tables. Each file is decoded by the task that reads it; files that cannot be
decoded come out as rows with a status instead of failing the job."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartolith.functions.climate import landcover_from_code
from cartolith.params import LANDCOVER_CLASSES

# Headers of the prepared files, big-endian throughout.
DEM_MAGIC, DEM_HEADER_BYTES = 0x5446444D, 64
LANDCOVER_MAGIC, LANDCOVER_HEADER = 0x54464C43, ">iHddddii"
INT16_VOID = -32768
# Input bytes decoded before their rows are handed on.
OUTPUT_BYTES = 4 * 1024 * 1024

TILE_SCHEMA = ("path string, bytes bigint, lat_deg int, lon_deg int, width int, height int, encoding string, "
               "bathymetry boolean, status string, samples array<float>")
GRID_SCHEMA = ("file_name string, bytes bigint, south double, west double, north double, east double, width int, "
               "height int, status string, classes array<string>")

_STEM = re.compile(r"^([NS])(\d{2})([EW])(\d{3})$", re.IGNORECASE)


def _files(spark: SparkSession, folder: str, pattern: str, content: bool = True) -> DataFrame:
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(folder))
    return files.select("path", "length", "content") if content else files.select("path", "length")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names and sizes of a folder's files; contents are not read."""
    return _files(spark, folder, "*", content=False)


def _cell_of(path: str) -> tuple[int, int] | None:
    match = _STEM.match(path.rsplit("/", 1)[-1].split(".", 1)[0])
    if not match:
        return None
    lat, lon = int(match[2]), int(match[4])
    return -lat if match[1].upper() == "S" else lat, -lon if match[3].upper() == "W" else lon


def _bad(path: str, size: int, status: str, **known) -> dict:
    return {"path": path, "bytes": size, "status": status, **known}


def _metres(values: np.ndarray, void: np.ndarray) -> list:
    return np.where(void, None, values.astype(object)).tolist() if void.any() else values.tolist()


def _decode_hgt(path: str, data: bytes) -> dict:
    """Square grid of big-endian 16-bit metres; the name tells the cell."""
    size = len(data)
    cell = _cell_of(path)
    side = int(round((size // 2) ** 0.5))
    if cell is None:
        return _bad(path, size, "unrecognised name")
    if size % 2 or side * side * 2 != size or side < 2:
        return _bad(path, size, "not a square grid")
    raw = np.frombuffer(data, ">i2")
    return {"path": path, "bytes": size, "lat_deg": cell[0], "lon_deg": cell[1], "width": side, "height": side,
            "encoding": "int16", "bathymetry": False, "status": "ok",
            "samples": _metres(raw.astype(np.float32), raw == INT16_VOID)}


def _dem_header(path: str, size: int, head: bytes) -> dict:
    if len(head) < DEM_HEADER_BYTES:
        return _bad(path, size, "truncated header")
    magic, version, encoding, width, height, south, west, void, num, den = struct.unpack(">iHHiiiiiii", head[:36])
    if magic != DEM_MAGIC:
        return _bad(path, size, "wrong magic")
    if (version not in (1, 2) or encoding not in (1, 2) or width < 2 or height < 2 or not -90 <= south <= 89
            or not -180 <= west <= 179 or den == 0):
        return _bad(path, size, "invalid header")
    cell = _cell_of(path)
    found = {"lat_deg": south, "lon_deg": west, "width": width, "height": height, "encoding": ("int16", "float32")[encoding - 1],
             "bathymetry": encoding == 2 if version == 1 else bool(head[36] & 1)}
    if cell is None:
        return _bad(path, size, "unrecognised name", **found)
    if cell != (south, west):
        return _bad(path, size, "name and header disagree", **found)
    if size != DEM_HEADER_BYTES + width * height * 2 * encoding:
        return _bad(path, size, "wrong size", **found)
    return {"path": path, "bytes": size, "status": "ok", "_void": void, "_scale": (num, den), **found}


def _decode_dem(path: str, data: bytes) -> dict:
    row = _dem_header(path, len(data), data[:DEM_HEADER_BYTES])
    if row["status"] != "ok":
        return row
    num, den = row.pop("_scale")
    void_raw = row.pop("_void")
    if row["encoding"] == "int16":
        raw = np.frombuffer(data, ">i2", offset=DEM_HEADER_BYTES)
        void = raw == np.int32(void_raw).astype(np.int16)
    else:
        raw = np.frombuffer(data, ">f4", offset=DEM_HEADER_BYTES)
        void = np.isnan(raw)
    row["samples"] = _metres((raw.astype(np.float64) * num / den).astype(np.float32), void)
    return row


def _decode_grid(path: str, data: bytes) -> dict:
    name, size = path.rsplit("/", 1)[-1], len(data)
    length = struct.calcsize(LANDCOVER_HEADER)
    row = {"file_name": name, "bytes": size}
    if size < length:
        return {**row, "status": "truncated"}
    magic, version, south, west, north, east, width, height = struct.unpack(LANDCOVER_HEADER, data[:length])
    if magic != LANDCOVER_MAGIC or version != 1:
        return {**row, "status": "not a land-cover grid"}
    if (not np.isfinite([south, west, north, east]).all() or south < -90 or north > 90 or west < -180 or east > 180
            or south >= north or west >= east or width < 1 or height < 1):
        return {**row, "status": "invalid header"}
    row |= {"south": south, "west": west, "north": north, "east": east, "width": width, "height": height}
    cells = np.frombuffer(data, np.uint8, offset=length)
    if cells.size != width * height:
        return {**row, "status": "truncated" if cells.size < width * height else "trailing data"}
    if (cells >= len(LANDCOVER_CLASSES)).any():
        return {**row, "status": "unknown class"}
    return {**row, "status": "ok", "classes": np.array(LANDCOVER_CLASSES)[cells].tolist()}


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    columns = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows).reindex(columns=columns).astype(object).where(lambda v: v.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows.append(decode(path, bytes(data)))
                size += len(data)
                if size > OUTPUT_BYTES:  # large tiles leave one by one, small ones together
                    yield frame(rows)
                    rows, size = [], 0
        if rows:
            yield frame(rows)
    return files.mapInPandas(run, schema)


def decode_hgt(files: DataFrame) -> DataFrame:
    """Tile rows from .hgt contents (path, content)."""
    return _decoded(files, _decode_hgt, TILE_SCHEMA)


def decode_dem_tiles(files: DataFrame) -> DataFrame:
    """Tile rows from prepared elevation contents (path, content)."""
    return _decoded(files, _decode_dem, TILE_SCHEMA)


def decode_landcover_grids(files: DataFrame) -> DataFrame:
    """Grid rows from prepared land-cover contents (path, content)."""
    return _decoded(files, _decode_grid, GRID_SCHEMA)


def _decode_header(path: str, data: bytes) -> dict:
    row = _dem_header(path, len(data), data[:DEM_HEADER_BYTES])
    row.pop("_void", None)
    row.pop("_scale", None)
    return row


def decode_headers(files: DataFrame) -> DataFrame:
    """Tile rows without samples."""
    return _decoded(files, _decode_header, TILE_SCHEMA.rsplit(", ", 1)[0])


def read_hgt(spark: SparkSession, folder: str) -> DataFrame:
    """Tile rows of a folder of .hgt files."""
    return decode_hgt(_files(spark, folder, "*.hgt"))


def read_dem_tiles(spark: SparkSession, folder: str, pattern: str = "*.tfdem") -> DataFrame:
    """Tile rows of a folder of prepared elevation files."""
    return decode_dem_tiles(_files(spark, folder, pattern))


def tile_catalogue(spark: SparkSession, folder: str, pattern: str = "*.tfdem") -> DataFrame:
    """What each prepared elevation file holds, without its samples, ordered by cell."""
    return decode_headers(_files(spark, folder, pattern)).orderBy("lat_deg", "lon_deg", "path")


def read_landcover_grids(spark: SparkSession, folder: str, pattern: str = "*.tflc") -> DataFrame:
    """Grid rows of a folder of prepared land-cover files."""
    return decode_landcover_grids(_files(spark, folder, pattern))


def tile_inventory(tiles: DataFrame, dataset: str) -> DataFrame:
    """Provenance rows of decoded tiles, one per dataset and cell: of several files the first by path."""
    usable = tiles.filter("status = 'ok'")
    first = usable.groupBy("lat_deg", "lon_deg").agg(F.min("path").alias("path"))
    return (usable.join(first, ["lat_deg", "lon_deg", "path"], "left_semi")
            .select(F.lit(dataset).alias("dataset"), "lat_deg", "lon_deg", F.element_at(F.split("path", "/"), -1).alias("file"),
                    "width", "height", "encoding", "bytes", F.sha2(F.to_json("samples"), 256).alias("checksum")))


def parse_ascii_grids(texts: DataFrame) -> DataFrame:
    """Arc/Info ASCII grids (file_name, value) as land-cover grid rows, all in expressions."""
    def header(name: str) -> Column:
        found = F.regexp_extract("value", rf"(?im)^\s*{name}\s+(\S+)\s*$", 1)
        return F.when(found != "", found).try_cast("double")

    body = F.regexp_replace("value", r"(?im)^\s*[a-z_]+\s+\S+\s*$", "")
    numbers = F.transform(F.filter(F.split(body, r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))
    cell, void = header("cellsize"), header("nodata_value")
    west = F.coalesce(header("xllcorner"), header("xllcenter") - cell / 2.0)
    south = F.coalesce(header("yllcorner"), header("yllcenter") - cell / 2.0)
    raw = texts.select("file_name", header("ncols").alias("_w"), header("nrows").alias("_h"), cell.alias("_c"),
                       void.alias("_v"), west.alias("west"), south.alias("south"), numbers.alias("_n"))
    whole = (F.col("_w") >= 1) & (F.col("_w") == F.floor("_w")) & (F.col("_h") >= 1) & (F.col("_h") == F.floor("_h"))
    status = (F.when(~F.coalesce(whole, F.lit(False)), "bad dimensions").when(~F.coalesce(F.col("_c") > 0, F.lit(False)), "bad cellsize")
              .when(F.col("west").isNull() | F.col("south").isNull(), "missing corner")
              .when(F.size("_n") < F.col("_w") * F.col("_h"), "too few pixels")
              .when(F.size("_n") > F.col("_w") * F.col("_h"), "too many pixels")
              .when(F.exists("_n", lambda v: v.isNull()), "not a number").otherwise("ok"))

    def decoded(v: Column) -> Column:
        code = F.when((v == F.floor(v)) & (v != F.coalesce(F.col("_v"), F.lit(float("nan")))) & (F.abs(v) < 1000), v.cast("int"))
        return landcover_from_code(F.coalesce(code, F.lit(-1)))

    return raw.withColumn("status", status).select(
        "file_name", "south", "west", (F.col("south") + F.col("_h") * F.col("_c")).alias("north"),
        (F.col("west") + F.col("_w") * F.col("_c")).alias("east"), F.col("_w").try_cast("int").alias("width"),
        F.col("_h").try_cast("int").alias("height"), "status",
        F.when(F.col("status") == "ok", F.transform("_n", decoded)).alias("classes"))


def read_ascii_grid(spark: SparkSession, folder: str) -> DataFrame:
    texts = spark.read.text(folder, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), "value")
    return parse_ascii_grids(texts)
