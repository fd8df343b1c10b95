"""Registered imports of shapefiles: Spark builds the three files of every nation from the tables, and reads them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartolith.functions.geodesy import METERS_PER_DEGREE
from cartolith.functions.water import RIVER_WIDTH_FACTOR
from cartolith.operators.ordering import with_global_row_number
from cartolith.operators.shapes import ring_area
from cartolith.plans.derived import Tables
from cartolith.plans.registry import registered
from cartolith.session import materialise, spread
from cartolith.sources import importers
from cartolith.sources.shapefile import decode_pieces

RECORDS_PER_PIECE = 1024


def _once(value: Column, of) -> Column:
    """``of`` a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), of)[0]


def _swapped(digits: Column, size: int) -> Column:
    """Hex digits of ``size`` bytes with the lowest byte first."""
    return _once(digits, lambda d: F.concat(*[F.substring(d, 2 * i + 1, 2) for i in reversed(range(size))]))


def _int(value, big: bool = False, size: int = 4) -> Column:
    digits = F.lpad(F.hex(F.lit(value).cast("bigint")), 2 * size, "0")
    return digits if big else _swapped(digits, size)


def _double(value: Column) -> Column:
    """A whole number as eight bytes: sign, exponent and mantissa follow from the magnitude."""
    size = F.abs(value)
    power = F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))).cast("int")
    mantissa = ((size / F.pow(F.lit(2.0), power) - 1.0) * float(1 << 52)).cast("bigint")
    bits = F.shiftleft((power + 1023).cast("bigint"), 52).bitwiseOR(mantissa).bitwiseOR(F.when(value < 0, -(1 << 63)).otherwise(0))
    return _int(F.when(size > 0, bits).otherwise(0), size=8)


def _shape(kind: Column, parts: Column) -> Column:
    """Content of a record from parts of [x, y] points."""
    def content(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.size(p))
        starts = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.aggregate(F.slice(sizes, 1, i - 1), F.lit(0), lambda a, v: a + v))
        points = F.transform(F.flatten(parts), lambda p: F.concat(_double(p[0]), _double(p[1])))
        return F.concat(_int(kind), F.lit("00" * 32), _int(F.size(parts)), _int(F.size(F.flatten(parts))),
                        F.array_join(F.transform(starts, lambda s: _int(s)), ""), F.array_join(points, ""))

    return _once(parts, content)


def _files(rows: DataFrame, shape: Column, fields: dict[str, tuple[Column, int]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces (file, at, content) of shape, index and table files with a record per row (file, k), in the order of k.

    ``fields`` gives text and width of each column. A piece holds about a thousand records, however long its file is.
    """
    numbered = with_global_row_number(rows, [F.col("file"), F.col("k")], "n")
    first = numbered.groupBy("file").agg(F.min("n").alias("_first"), F.count("*").alias("records"))
    number = F.col("n") - F.col("_first")
    row = F.concat(F.lit("20"), *[F.hex(F.rpad(F.coalesce(text, F.lit("")), n, " ").cast("binary")) for text, n in fields.values()])
    dealt = spread(numbered.join(first, "file").select(*rows.columns, "records", number.alias("number"), F.floor(number / RECORDS_PER_PIECE).alias("piece")), "file", "piece")
    # texts are made once, as lists of one; length and order are taken of what is there
    placed = dealt.select("file", "records", "number", "piece", F.explode(F.array(F.struct(shape.alias("shape"), row.alias("row")))).alias("_t")).select("file", "records", "number", "piece", "_t.*")
    words = F.length("shape") / 4
    before = F.sum(words + 4).over(Window.partitionBy("file", "piece").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    within = placed.select("file", "piece", "records", F.struct("number", F.coalesce(before, F.lit(0.0)).cast("bigint").alias("at"), words.cast("bigint").alias("words"), "shape", "row").alias("r"))
    each = within.groupBy("file", "piece", "records").agg(F.sort_array(F.collect_list("r")).alias("each"))

    def text(of) -> Column:
        return F.array_join(F.transform("each", of), "")

    built = materialise(each.select(
        "file", "piece", "records", F.unhex(text(lambda r: F.concat(_int(r["number"] + 1, True), _int(r["words"], True), r["shape"]))).alias("shp"),
        F.transform("each", lambda r: F.struct(r["at"].alias("at"), r["words"].alias("words"))).alias("spans"), F.unhex(text(lambda r: r["row"])).alias("dbf")), "shapefiles")
    # a row for a thousand records: where the pieces begin
    lengths = built.select("file", "piece", F.octet_length("shp").cast("bigint").alias("length"))
    starts = lengths.select("file", "piece", F.coalesce(F.sum("length").over(Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    begun = F.col("piece") == 0
    size = 1 + sum(n for _, n in fields.values())
    head = F.concat(F.lit("03180101"), _int(F.col("records")), _int(32 + 32 * len(fields) + 1, size=2), _int(size, size=2), F.lit("00" * 20),
                    *[F.lit((c.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([n]) + b"\0" * 15).hex()) for c, (_, n) in fields.items()], F.lit("0d"))
    blank = F.unhex(F.lit("00" * 100))

    def pieces(frame: DataFrame, lead: Column, length: int, offset: Column, content: Column) -> DataFrame:
        return frame.select("file", F.when(begun, 0).otherwise(length + offset).cast("bigint").alias("at"), F.when(begun, F.concat(lead, content)).otherwise(content).alias("content"))

    placed_pieces = built.join(starts, ["file", "piece"])
    span = F.unhex(F.array_join(F.transform("spans", lambda s: F.concat(_int(((F.col("start") / 2 + 50).cast("bigint") + s["at"]), True), _int(s["words"], True))), ""))
    return (pieces(placed_pieces, blank, 100, F.col("start"), F.col("shp")),
            pieces(placed_pieces, blank, 100, F.col("piece") * (8 * RECORDS_PER_PIECE), span),
            pieces(built, F.unhex(head), 33 + 32 * len(fields), F.col("piece") * (size * RECORDS_PER_PIECE), F.col("dbf")))


def _point(x, y) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def _rivers(t: Tables) -> DataFrame:
    """A reach of two parts per supplier; one in ten crosses 180 degrees, some are canals, some are points."""
    k = F.col("k")
    over = k % 10 == 0
    x, y = F.when(over, 179).otherwise(k * 7 % 340 - 170), k % 120 - 60
    parts = F.array(F.array(_point(x, y), _point(F.when(over, -179).otherwise(x + 1), F.when(over, y + 2).otherwise(y + 1))), F.array(_point(x, y), _point(x, y - 1)))
    dot = F.concat(_int(1), _double(x.cast("double")), _double(y.cast("double")))
    rows = t.base("supplier").select(F.concat(F.lit("/rivers/n"), F.col("s_nationkey").cast("string")).alias("file"), F.col("s_suppkey").alias("k"))
    fields = {"NAME": (F.when(k % 3 > 0, F.concat(F.lit("reach "), k.cast("string"))), 20), "KIND": (F.when(k % 11 == 0, "Ship CANAL"), 12),
              "DIS_AV_CMS": (F.when(k % 5 > 0, (k * 37 % 5000).cast("string")).otherwise("n/a"), 10)}
    return decode_pieces(*_files(rows, F.when(k % 7 == 3, dot).otherwise(_shape(F.lit(3), parts)), fields), per_task=7)


@registered("import_rivers", f"""
WITH s AS (SELECT concat('/rivers/n', cast(s_nationkey AS varchar)) AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ordinal,
 s_suppkey AS k, s_suppkey % 10 = 0 AS over, CASE WHEN s_suppkey % 5 > 0 THEN cast(s_suppkey * 37 % 5000 AS double) ELSE 0e0 END AS q,
 CASE WHEN s_suppkey % 10 = 0 THEN 179 ELSE s_suppkey * 7 % 340 - 170 END AS x, s_suppkey % 120 - 60 AS y FROM supplier),
r AS (SELECT *, greatest(1000e0, {RIVER_WIDTH_FACTOR} * sqrt(q)) AS width,
 CASE WHEN over THEN (sqrt(2e0) * (2 * y + 2) + y - 0.5e0) / (2 * sqrt(2e0) + 1) ELSE (sqrt(2e0) * (y + 0.5e0) + y - 0.5e0) / (sqrt(2e0) + 1) END AS middle FROM s WHERE k % 7 <> 3 AND k % 11 > 0)
SELECT cast(row_number() OVER (ORDER BY file, ordinal) AS bigint) AS id, CASE WHEN k % 3 > 0 THEN concat('reach ', cast(k AS varchar)) END AS name, 'RIVER' AS water_type,
 cast(y - 1 AS double) AS min_lat, CASE WHEN over THEN -180e0 ELSE cast(x AS double) END AS min_lon, cast(CASE WHEN over THEN y + 2 ELSE y + 1 END AS double) AS max_lat,
 CASE WHEN over THEN 180e0 ELSE x + 1e0 END AS max_lon, round(least(greatest(width / 20, 1), 10), 6) AS bed_depth_m, cast(NULL AS double) AS surface_elevation_m, q AS discharge_cms, true AS is_line,
 round(width / (greatest(0.01e0, abs(cos(radians(middle)))) * 2 * {METERS_PER_DEGREE}), 9) AS radius_deg,
 CASE WHEN over THEN printf('179,%d 180,%d|-180,%d -179,%d|179,%d 179,%d', y, y + 1, y + 1, y + 2, y, y - 1)
 ELSE printf('%d,%d %d,%d|%d,%d %d,%d', x, y, x + 1, y + 1, x, y, x, y - 1) END AS lines FROM r""")
def import_rivers(t: Tables) -> DataFrame:
    read = importers.rivers(_rivers(t))
    accepted = importers.rows_for("water_bodies", read.where("reject_reason IS NULL"))
    text = F.array_join(F.transform("rings", lambda r: F.array_join(F.transform(r, lambda p: F.concat(p["lon"].cast("int").cast("string"), F.lit(","), p["lat"].cast("int").cast("string"))), " ")), "|")
    return accepted.select("id", "name", "water_type", "min_lat", "min_lon", "max_lat", "max_lon", F.round("bed_depth_m", 6).alias("bed_depth_m"), "surface_elevation_m", "discharge_cms",
                           "is_line", F.round("radius_deg", 9).alias("radius_deg"), text.alias("lines"))


@registered("import_rivers_rejects", """
SELECT concat('/rivers/n', cast(s_nationkey AS varchar)) AS file, s_suppkey % 11 > 0 AS strict, CASE WHEN s_suppkey % 11 = 0 THEN 'made by people' ELSE 'not a line' END AS reason, count(*) AS records
FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 7 = 3 GROUP BY 1, 2, 3""")
def import_rivers_rejects(t: Tables) -> DataFrame:
    rejected = importers.rivers(_rivers(t)).where("reject_reason IS NOT NULL")
    return rejected.groupBy("file", "strict", F.col("reject_reason").alias("reason")).agg(F.count("*").alias("records"))


def _ring(x: Column, y: Column, side: int, clockwise: bool, closed: Column | bool = True) -> Column:
    corners = [(0, 0), (0, side), (side, side), (side, 0)]
    points = F.array(*[_point(x + a, y + b) for a, b in (corners if clockwise else [corners[0], *reversed(corners[1:])])])
    return F.when(F.lit(closed), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def _karst(t: Tables) -> DataFrame:
    """Areas by part: with and without holes, open shells, holes before any shell, holes alone, two shells, lines."""
    k = F.col("k")
    x, y, d = k % 300 - 150, k % 140 - 70, k % 7
    shell, hole, other = _ring(x, y, 6, True, d != 2), _ring(x + 1, y + 1, 2, False), _ring(x + 10, y, 3, True)
    parts = (F.when(d == 0, F.array(hole)).when(d == 3, F.array(hole, shell, hole)).when(d == 4, F.array(shell, hole, other)).when(d == 5, F.array(shell))
             .otherwise(F.array(shell, hole)))
    rows = t.base("part").select(F.concat(F.lit("/karst/"), (F.col("p_partkey") % 5).cast("string")).alias("file"), F.col("p_partkey").alias("k"))
    return decode_pieces(*_files(rows, _shape(F.when(d == 1, 3).otherwise(5), parts), {"TYPE": (F.lit("x"), 4)}), per_task=50)


_KARST = """WITH p AS (SELECT concat('/karst/', cast(p_partkey % 5 AS varchar)) AS file, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1 AS ordinal,
 p_partkey % 7 AS d, p_partkey % 300 - 150 AS x, p_partkey % 140 - 70 AS y FROM part)"""


@registered("import_karst", _KARST + """
SELECT cast(row_number() OVER (ORDER BY file, ordinal) AS bigint) AS id, cast(y AS double) AS min_lat, cast(x AS double) AS min_lon, y + 6e0 AS max_lat,
 CASE WHEN d = 4 THEN x + 13e0 ELSE x + 6e0 END AS max_lon, CASE d WHEN 5 THEN '5' WHEN 4 THEN '5 5 5' ELSE '5 5' END AS points, CASE d WHEN 5 THEN 36e0 WHEN 4 THEN 49e0 ELSE 40e0 END AS ring_areas
FROM p WHERE d > 1""")
def import_karst(t: Tables) -> DataFrame:
    accepted = importers.rows_for("karst_areas", importers.karst(_karst(t)).where("reject_reason IS NULL"))
    areas = F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda a, v: a + F.abs(v))
    return accepted.select("id", "min_lat", "min_lon", "max_lat", "max_lon", F.array_join(F.transform("rings", lambda r: F.size(r).cast("string")), " ").alias("points"), areas.alias("ring_areas"))


@registered("import_karst_clipped", _KARST + """
SELECT file, cast(ordinal AS bigint) AS ordinal, greatest(y, 0) + 0e0 AS min_lat, greatest(x, 0) + 0e0 AS min_lon, least(y + 6, 40) + 0e0 AS max_lat, least(CASE WHEN d = 4 AND least(y + 3, 40) > greatest(y, 0) AND x + 10 < 50 THEN x + 13 ELSE x + 6 END, 50) + 0e0 AS max_lon
FROM p WHERE d > 1 AND d <> 4 AND x < 50 AND x + 6 > 0 AND y < 40 AND y + 6 > 0""")
def import_karst_clipped(t: Tables) -> DataFrame:
    """Areas of one shell cut to a box."""
    rows = importers.karst(_karst(t).where("size(filter(part_roles, r -> r = 'shell')) < 2"), (0.0, 0.0, 40.0, 50.0)).where("reject_reason IS NULL")
    return rows.select("file", "ordinal", "min_lat", "min_lon", "max_lat", "max_lon")
