"""Shapefiles as a Spark data source: record ranges are read in parallel.

``spark.dataSource.register(ShapefileSource)`` once, then
``spark.read.format("shapefile").load("/data/rivers.shp")``. The index file beside it gives the
record offsets, so every task reads only its own byte range; attributes come from the table
file by record number. That needs a path that Python can open on every node.

:func:`read_shapefiles` asks for nothing but Spark's own file access: shape, index and table files
are read as binary files, cut into ranges of records where they are read, and decoded after a shuffle.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Record types that hold lines and areas.
LINE_TYPES, AREA_TYPES = (3, 13), (5, 15, 25)
RECORDS_PER_TASK = 20_000
SCHEMA = ("rec_no int, shape_type int, status string, attributes map<string,string>, "
          "parts array<array<struct<lon:double,lat:double>>>, part_roles array<string>")


@dataclass
class RecordRange(InputPartition):
    first: int
    last: int


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def _part_role(points: np.ndarray) -> str:
    """Clockwise rings are shells, others are holes of the shell before them."""
    x, y = points[:, 0], points[:, 1]
    return "shell" if float(np.sum((x[1:] - x[:-1]) * (y[1:] + y[:-1]))) > 0 else "hole"


def decode_record(content: bytes) -> tuple[int, str, list, list]:
    """Type, status, parts and part roles of one record's content."""
    kind = struct.unpack_from("<i", content)[0]
    if kind not in LINE_TYPES + AREA_TYPES:
        return kind, "empty" if kind == 0 else "unsupported type", [], []
    part_count, point_count = struct.unpack_from("<ii", content, 36)
    starts = np.frombuffer(content, "<i4", part_count, 44).tolist() + [point_count]
    points = np.frombuffer(content, "<f8", point_count * 2, 44 + 4 * part_count).reshape(-1, 2)
    parts, roles, broken = [], [], 0
    for begin, end in zip(starts, starts[1:]):
        part = points[begin:end]
        if kind in AREA_TYPES and len(part) > 2 and (part[0] != part[-1]).any():
            part = np.vstack([part, part[:1]])
        if len(part) >= (4 if kind in AREA_TYPES else 2):
            parts.append([(float(x), float(y)) for x, y in part])
            roles.append(_part_role(part) if kind in AREA_TYPES else "line")
        else:
            broken += 1
    status = f"malformed parts: {broken}" if broken else "ok" if parts else "empty"
    return kind, status, parts, roles


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = _local(path), per_task
        self.stem = os.path.splitext(self.path)[0]

    def _count(self) -> int:
        return (os.path.getsize(self.stem + ".shx") - 100) // 8

    def partitions(self):
        count = self._count()
        return [RecordRange(i, min(i + self.per_task, count)) for i in range(0, count, self.per_task)] or [RecordRange(0, 0)]

    def _table(self, part: RecordRange) -> Iterator[dict]:
        """Attributes of the records, blank values left out."""
        if not os.path.exists(self.stem + ".dbf"):
            raise FileNotFoundError(f"{self.stem}.dbf: filters on attributes would let every record through without it")
        with open(self.stem + ".dbf", "rb") as table:
            head = table.read(32)
            if struct.unpack_from("<I", head, 4)[0] != self._count():
                raise ValueError(f"{self.stem}.dbf and its index disagree on the number of records")
            start, size = struct.unpack_from("<HH", head, 8)
            raw = table.read(start - 33)
            fields = [(raw[i:i + 11].split(b"\0")[0].decode("ascii", "replace"), raw[i + 16]) for i in range(0, len(raw) - 31, 32)]
            table.seek(start + part.first * size)
            for _ in range(part.first, part.last):
                row, at, values = table.read(size), 1, {}
                for name, length in fields:
                    text = row[at:at + length].decode("utf-8", "replace").strip()
                    at += length
                    if text:
                        values[name] = text
                yield values

    def read(self, partition: RecordRange):
        if partition.first == partition.last:
            return
        with open(self.stem + ".shx", "rb") as index, open(self.path, "rb") as shapes:
            index.seek(100 + partition.first * 8)
            spans = np.frombuffer(index.read((partition.last - partition.first) * 8), ">i4").reshape(-1, 2) * 2
            for number, ((offset, length), values) in enumerate(zip(spans.tolist(), self._table(partition)), partition.first):
                shapes.seek(offset + 8)
                kind, status, parts, roles = decode_record(shapes.read(length))
                yield number, kind, status, values, parts, roles


class ShapefileSource(DataSource):
    """Line and area records of one shapefile."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("recordsPerTask", RECORDS_PER_TASK)))


# through Spark's file access ---------------------------------------------------------------------------------------------


def _big(content: Column, at) -> Column:
    """The unsigned number in four bytes, highest first, from the 1-based byte ``at``."""
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")


def _little(content: Column, at: int, size: int) -> Column:
    digits = [F.hex(F.substring(content, at + i, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


# Files are dealt out by stretches of this many bytes; the head of a table is shorter.
STRETCH = 1 << 20


def _stems(files: DataFrame, ending: str) -> DataFrame:
    """Whole files of an ending as pieces (file, at, content) of one stretch each, cut where they are read."""
    whole = files.where(F.lower("path").endswith(ending)).select(F.expr("substring(path, 1, length(path) - 4)").alias("file"), "content")
    stretches = F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("content"), F.lit(1)) - 1) / STRETCH).cast("int"))
    return whole.withColumn("_i", F.explode(stretches)).select(
        "file", (F.col("_i").cast("long") * STRETCH).alias("at"), F.substring("content", F.col("_i") * STRETCH + 1, F.lit(STRETCH)).alias("content"))


def _cut(pieces: DataFrame, wanted: DataFrame, out: str) -> DataFrame:
    """``wanted`` (file, first, lo, hi) with the bytes from ``lo`` to before ``hi``, fewer where the pieces end.

    Both sides meet by file and stretch; only what is wanted goes on to its range.
    """
    def stretches(low, high) -> Column:
        return F.explode(F.sequence(F.floor(low / STRETCH), F.floor((F.greatest(high, low + 1) - 1) / STRETCH)))

    end = F.col("at") + F.octet_length("content")
    held = pieces.select("file", "at", "content", stretches(F.col("at"), end).alias("_s"))
    met = wanted.select("file", "first", "lo", "hi", stretches(F.col("lo"), F.col("hi")).alias("_s")).join(held, ["file", "_s"])
    low, high = F.greatest("lo", "at"), F.least("hi", end)
    part = F.substring("content", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    # a piece over several stretches meets a range in the first of those they share
    parts = met.where((low < high) & (F.floor(low / STRETCH) == F.col("_s"))).select("file", "first", F.struct("at", part.alias("part")).alias("_p"))
    joined = F.aggregate(F.sort_array("_ps"), F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["part"]))
    bytes_of = parts.groupBy("file", "first").agg(F.collect_list("_p").alias("_ps")).select("file", "first", joined.alias(out))
    return wanted.join(bytes_of, ["file", "first"], "left").withColumn(out, F.coalesce(out, F.lit(b"").cast("binary")))


def record_ranges(shapes: DataFrame, index: DataFrame, per_task: int) -> DataFrame:
    """(file, records, first, last, begin, stop, spans): ranges of records with their bytes in the shape file, from the index files."""
    sizes = index.groupBy("file").agg(F.max(F.col("at") + F.octet_length("content")).alias("size"))
    counted = sizes.withColumn("records", F.floor((F.col("size") - 100) / 8).cast("long")).where("records > 0").join(shapes.select("file").distinct(), "file", "left_semi")
    # ranges are dealt out before they are many
    ranges = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(per_task).cast("long")))).select(
        "file", "records", "first", F.least(F.col("first") + per_task, F.col("records")).alias("last"))
    cut = _cut(index, ranges.withColumns({"lo": 100 + 8 * F.col("first"), "hi": 100 + 8 * F.col("last")}).select("file", "first", "lo", "hi"), "spans")
    spans, tail = F.col("spans"), F.octet_length("spans") - 7
    return (cut.select("file", "first", (F.floor((F.col("hi") - 100) / 8)).alias("last"), (2 * _big(spans, 1)).alias("begin"), (2 * (_big(spans, tail) + _big(spans, tail + 4)) + 8).alias("stop"), "spans")
            .join(counted.select("file", "records"), "file"))


def _columns(field_bytes: bytes) -> list[tuple[str, int]]:
    return [(field_bytes[i:i + 11].split(b"\0")[0].decode("latin-1").strip(), field_bytes[i + 16])
            for i in range(0, len(field_bytes) - 31, 32)]


def _decode_range(file: str, first: int, spans: bytes, begin: int, body: bytes, fields: bytes, size: int, table: bytes) -> pa.RecordBatch:
    """All records of a range; points are taken over from the file's bytes without a Python object each."""
    places = (np.frombuffer(spans, ">i4").reshape(-1, 2).astype(np.int64) * 2)
    kinds, states, roles, points, part_sizes, parts_of = [], [], [], [], [], []
    for offset, length in places.tolist():
        content = body[offset + 8 - begin:offset + 8 - begin + length]
        if len(content) != length or length < 4:
            raise ValueError(f"{file}.shp ends inside a record")
        kind = struct.unpack_from("<i", content)[0]
        found, own, broken = 0, [], 0
        if kind in LINE_TYPES + AREA_TYPES:
            count, total = struct.unpack_from("<ii", content, 36) if length >= 44 else (0, 0)
            if count < 1 or total < 2 or 44 + 4 * count + 16 * total > length:
                broken = max(1, count)
            else:
                starts = [*np.frombuffer(content, "<i4", count, 44).tolist(), total]
                every = np.frombuffer(content, "<f8", total * 2, 44 + 4 * count).reshape(-1, 2)
                for a, b in zip(starts, starts[1:]):
                    part = every[max(a, 0):b]
                    if kind in AREA_TYPES and len(part) > 2 and (part[0] != part[-1]).any():
                        part = np.vstack([part, part[:1]])
                    if a < 0 or b > total or len(part) < (4 if kind in AREA_TYPES else 2):
                        broken += 1
                        continue
                    points.append(part)
                    part_sizes.append(len(part))
                    own.append(_part_role(part) if kind in AREA_TYPES else "line")
                    found += 1
        kinds.append(kind)
        states.append("empty" if kind == 0 else "unsupported type" if kind not in LINE_TYPES + AREA_TYPES
                      else f"malformed parts: {broken}" if broken else "ok" if found else "empty")
        roles.append(own)
        parts_of.append(found)
    flat = np.concatenate(points) if points else np.zeros((0, 2))
    spots = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)], ["lon", "lat"])
    rings = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *part_sizes]).astype(np.int32)), spots)
    parts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *parts_of]).astype(np.int32)), rings)
    named = _columns(fields)
    values = []
    for k in range(len(places)):
        row, at, own = table[k * size:(k + 1) * size], 1, []
        if len(row) != size:
            raise ValueError(f"{file}.dbf and its index disagree on the number of records")
        for name, width in named:
            text = row[at:at + width].decode("latin-1").strip(" \0")
            at += width
            if text:
                own.append((name, text))
        values.append(own)
    n = len(places)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array(kinds, pa.int32()), pa.array(states, pa.string()),
         pa.array(values, pa.map_(pa.string(), pa.string())), parts, pa.array(roles, pa.list_(pa.string()))],
        ["file", "ordinal", "shape_type", "status", "attributes", "parts", "part_roles"])


def _decode_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _decode_range(*(c[row].as_py() for c in batch.columns))


RECORDS = ("file string, ordinal long, shape_type int, status string, attributes map<string,string>, "
           "parts array<array<struct<lon:double,lat:double>>>, part_roles array<string>")


def decode_shapefiles(files: DataFrame, per_task: int = RECORDS_PER_TASK) -> DataFrame:
    """Records (RECORDS) of shape files given as (path, content) rows with their index and table files.

    Files are cut into stretches where they are read, see :func:`decode_pieces`.
    """
    return decode_pieces(*[_stems(files, ending) for ending in (".shp", ".shx", ".dbf")], per_task)


def decode_pieces(shapes: DataFrame, index: DataFrame, tables: DataFrame, per_task: int = RECORDS_PER_TASK) -> DataFrame:
    """Records (RECORDS) of shape, index and table files given as pieces (file, at, content): bytes of a file from ``at`` on.

    Ranges of ``per_task`` records are put together from the pieces they touch, never whole files. The head of a table lies
    in its first piece. A shape without an index is not seen; one without a table, or with a table of another length, is an
    error. Files without records give none.
    """
    ranges = record_ranges(shapes, index, per_task)
    bodies = _cut(shapes, ranges.select("file", "first", F.col("begin").alias("lo"), F.col("stop").alias("hi")), "body").select("file", "first", "body")
    content = F.col("content")
    heads = tables.where("at = 0").select("file", _little(content, 9, 2).alias("start"), _little(content, 11, 2).alias("size"), _little(content, 5, 4).alias("rows"), content.alias("_head"))
    heads = heads.select("file", "start", "size", "rows", F.substring("_head", 33, (F.col("start") - 33).cast("int")).alias("fields"))
    same = F.when(F.col("rows") == F.col("records"), F.col("size")).otherwise(
        F.raise_error(F.concat("file", F.lit(".dbf and its index disagree on the number of records"))).cast("long"))
    sized = ranges.select("file", "records", "first", "last").join(heads, "file").select("file", "first", "last", "fields", "start", same.alias("size"))
    wanted = sized.select("file", "first", (F.col("start") + F.col("first") * F.col("size")).alias("lo"), (F.col("start") + F.col("last") * F.col("size")).alias("hi"))
    rows = sized.join(_cut(tables, wanted, "table").select("file", "first", "table"), ["file", "first"]).select("file", "first", "fields", "size", "table")
    whole = ranges.join(bodies, ["file", "first"]).join(rows, ["file", "first"], "left")
    size = F.coalesce("size", F.raise_error(F.concat("file", F.lit(".dbf: filters on attributes would let every record through without it"))).cast("long"))
    return whole.select("file", "first", "spans", "begin", "body", "fields", size.alias("size"), "table").mapInArrow(_decode_ranges, RECORDS)


def read_shapefiles(spark: SparkSession, path: str, per_task: int = RECORDS_PER_TASK) -> DataFrame:
    """Records of all shape files of a folder, or of those a pattern without its ending names, on any path Spark can open.

    A file is read by one task and cut into stretches there; files of up to 2 GB, as the format and Spark's binary files allow.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,shx,dbf,SHP,SHX,DBF}").load(path)
    return decode_shapefiles(files.select("path", "content"), per_task)
