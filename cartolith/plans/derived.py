"""Geographic tables derived from the order tables, row by row.

The order tables hold no geography, so positions, shapes and rasters are computed from their
keys and amounts. Every derived table grows with the table it comes from. The texts in
``SQL`` say the same in plain SQL, as common table expressions for the SQL counterparts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartolith.operators.nearest import NearestIndex, build_nearest_index
from cartolith.operators.raster import LandcoverIndex, build_landcover_index, dem_blocks, landcover_blocks
from cartolith.operators.shapes import ShapeIndex, area_set, box_ring, build_shape_index
from cartolith.params import LANDCOVER_CLASSES
from cartolith.session import planning_session, spread

# Tables of few and small files whose rows become shapes, pixels and columns.
FANNED_OUT = ("customer", "supplier", "part")
# Expressions that read the same in both dialects.
LAT = "(({k}) * 7919 % 170000) / 1e3 - 85e0"
LON = "(({k}) * 104729 % 360000) / 1e3 - 180e0"
POINTS = f"SELECT c_custkey AS id, {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} AS lon FROM {{customer}}"
LINE_KEY = "l_orderkey * 8 + l_linenumber"
# Shipments: one point per order line, lines at the same spot counted together.
LINE_POINTS = (f"SELECT spot, {LAT.format(k='spot')} AS lat, {LON.format(k='spot')} AS lon, count(*) AS shipments "
               "FROM (SELECT l_orderkey * 8 + l_linenumber AS spot FROM {lineitem}) l GROUP BY spot")
NATION_BOXES = """
SELECT n_nationkey AS id, concat('C', chr(cast(65 + n_nationkey AS int))) AS iso_code, n_name AS name, n_regionkey,
       -85e0 + 34 * cast(floor(n_nationkey / 5e0) AS int) AS min_lat, -180e0 + 72 * (n_nationkey % 5) AS min_lon,
       -51e0 + 34 * cast(floor(n_nationkey / 5e0) AS int) AS max_lat, -108e0 + 72 * (n_nationkey % 5) AS max_lon
FROM {nation}"""
CITIES = f"""
SELECT c.*, id = min(id) OVER (PARTITION BY country_id) AS capital FROM (
  SELECT s_suppkey * 2 AS id, s_name AS name, {LAT.format(k='s_suppkey * 2')} AS lat, {LON.format(k='s_suppkey * 2')} AS lon,
         cast(floor(abs(s_acctbal) * 100) AS bigint) AS population, s_nationkey AS country_id FROM {{supplier}}
  UNION ALL
  SELECT p_partkey * 2 + 1, concat(p_name, ' ', cast(p_partkey AS string)), {LAT.format(k='p_partkey * 2 + 1')},
         {LON.format(k='p_partkey * 2 + 1')}, cast(floor((p_retailprice - 900) * 1e4) AS bigint),
         cast(p_partkey % 25 AS int) FROM {{part}}) c"""
# Raster tiles: one per degree cell that holds a customer; 9 x 9 samples, some without data.
DEM_SIDE = 9
SAMPLE = "cast(((lat_deg + 90) * 31 + (lon_deg + 180) * 17 + gx * 37 + gy * 53) % 1900 - 500 AS double)"
SAMPLE_VOID = "((lat_deg + 90) + (lon_deg + 180) * 3 + gx * 5 + gy * 7) % 23 = 0"
DEM_CELLS = """
SELECT DISTINCT cast(floor(lat) AS int) AS lat_deg, cast(floor(lon) AS int) AS lon_deg FROM {points}"""
WATER = f"""
SELECT id, CASE kind WHEN 0 THEN 'RIVER' WHEN 1 THEN 'LAKE' ELSE 'OCEAN' END AS water_type,
       greatest(lat - half, -90e0) AS min_lat, greatest(lon - half, -180e0) AS min_lon,
       least(lat + half, 90e0) AS max_lat, least(lon + half, 180e0) AS max_lon,
       CASE WHEN kind = 1 AND p_size % 5 > 0 THEN 100e0 + p_size END AS surface_elevation_m,
       p_size / 10e0 AS bed_depth_m, p_retailprice - 900 AS discharge_cms
FROM (SELECT p_partkey AS id, p_size, p_retailprice, p_size % 3 AS kind, 0.25 + p_size / 4e1 AS half,
             {LAT.format(k='p_partkey * 3 + 1')} AS lat, {LON.format(k='p_partkey * 3 + 1')} AS lon FROM {{part}}) w"""
RIVERS = f"""
SELECT s_suppkey + 1000000000 AS id, lat AS y1, lon AS x1, lat + 1.5e0 AS y2, least(lon + 2e0, 180e0) AS x2,
       lat + 2.5e0 AS y3, greatest(lon - 1e0, -180e0) AS x3, 10 + abs(s_acctbal) AS discharge_cms
FROM (SELECT s_suppkey, s_acctbal, {LAT.format(k='s_suppkey * 5 + 2')} AS lat, {LON.format(k='s_suppkey * 5 + 2')} AS lon
      FROM {{supplier}}) r"""
POSITIONS = f"""
SELECT event_id, ts, user_id, event_type, value, {LAT.format(k='event_id * 3')} AS lat, {LON.format(k='event_id * 3')} AS lon
FROM {{events}}"""


def _duck(text: str) -> str:
    """Fill table names for the SQL counterpart, where tables are views of the same name."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "points")
    return text.format(**{n: n for n in names}).replace("AS string", "AS varchar")


_CORNERS = """
SELECT id, 0 AS ring, i, CASE WHEN i IN (0, 4) THEN min_lon - (CASE WHEN id % 5 > 0 THEN 2 ELSE 0 END)
                              WHEN i = 2 THEN max_lon - 20 ELSE max_lon END AS x,
       CASE WHEN i < 2 THEN min_lat WHEN i = 2 THEN min_lat + 17 ELSE max_lat END AS y
FROM countries, range(5) t(i)
UNION ALL
SELECT id, 1, i, min_lon + 24 + (CASE i WHEN 0 THEN -6 WHEN 2 THEN 6 ELSE 0 END),
       min_lat + 17 + (CASE i WHEN 1 THEN -6 WHEN 3 THEN 6 ELSE 0 END)
FROM countries, range(4) t(i) WHERE id % 2 = 1"""
_EDGES = """
SELECT id, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
       coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
FROM corners WINDOW w AS (PARTITION BY id, ring ORDER BY i)"""

SQL = {
    "points": _duck(POINTS),
    "line_points": _duck(LINE_POINTS),
    "countries": _duck(NATION_BOXES),
    "corners": _CORNERS,
    "edges": _EDGES,
    "regions": """
SELECT id * 4 + q AS id, id AS country_id, concat(name, '-', cast(q AS varchar)) AS name,
       min_lat + 17 * (q // 2) AS min_lat, min_lon + 36 * (q % 2) AS min_lon,
       min_lat + 17 * (q // 2) + 17 AS max_lat, min_lon + 36 * (q % 2) + 36 AS max_lon
FROM countries, range(4) t(q)""",
    "cities": _duck(CITIES),
    "dem_cells": _duck(DEM_CELLS),
    "samples": f"""
SELECT lat_deg, lon_deg, gx, gy, CASE WHEN NOT ({SAMPLE_VOID}) THEN {SAMPLE} END AS m
FROM dem_cells, range({DEM_SIDE}) a(gx), range({DEM_SIDE}) b(gy)""",
    "water": _duck(WATER),
    "rivers": _duck(RIVERS),
    "positions": _duck(POSITIONS),
    # covering test of country shapes, borders included
    "country_hits": """
SELECT p.id AS pid, e.id AS cid FROM points p JOIN edges e ON true
GROUP BY p.id, e.id
HAVING sum(CASE WHEN (e.y1 <= p.lat) <> (e.y2 <= p.lat)
                 AND (CASE WHEN e.y2 > e.y1 THEN (p.lon - e.x1) * (e.y2 - e.y1) - (p.lat - e.y1) * (e.x2 - e.x1) < 0
                      ELSE (p.lon - e.x1) * (e.y2 - e.y1) - (p.lat - e.y1) * (e.x2 - e.x1) > 0 END) THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or((p.lon - e.x1) * (e.y2 - e.y1) - (p.lat - e.y1) * (e.x2 - e.x1) = 0
               AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
               AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))""",
}


def with_tables(*names: str) -> str:
    """WITH clause of derived tables, in the order in which they build on each other."""
    needs = {"corners": ["countries"], "edges": ["corners"], "regions": ["countries"], "dem_cells": ["points"],
             "samples": ["dem_cells"], "country_hits": ["points", "edges"]}
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in needs.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)
    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name]})" for name in ordered) + "\n"


class Tables:
    """Base and derived frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = planning_session(spark), sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in FANNED_OUT else table

    def _sql(self, text: str, *names: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **{n: self.base(n) for n in names}, **frames)

    @cached_property
    def points(self) -> DataFrame:
        return self._sql(POINTS, "customer")

    @cached_property
    def line_points(self) -> DataFrame:
        return self._sql(LINE_POINTS, "lineitem")

    @cached_property
    def countries(self) -> DataFrame:
        boxes = self._sql(NATION_BOXES, "nation")
        west = F.col("min_lon") - F.when(F.col("id") % 5 > 0, 2).otherwise(0)
        mid = F.col("min_lat") + 17

        def ring(*corners):
            return F.array(*[F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")) for x, y in corners])

        shell = ring((west, F.col("min_lat")), (F.col("max_lon"), F.col("min_lat")), (F.col("max_lon") - 20, mid),
                     (F.col("max_lon"), F.col("max_lat")), (west, F.col("max_lat")), (west, F.col("min_lat")))
        cx = F.col("min_lon") + 24
        hole = ring((cx - 6, mid), (cx, mid - 6), (cx + 6, mid), (cx, mid + 6), (cx - 6, mid))
        return boxes.withColumn("rings", F.when(F.col("id") % 2 == 1, F.array(shell, hole)).otherwise(F.array(shell)))

    @cached_property
    def regions(self) -> DataFrame:
        q = F.col("q")
        south = F.col("c.min_lat") + 17 * F.floor(q / 2)
        west = F.col("c.min_lon") + 36 * (q % 2)
        boxes = (self._sql(NATION_BOXES, "nation").alias("c").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
                 .select((F.col("c.id") * 4 + q).alias("id"), F.col("c.id").alias("country_id"),
                         F.concat("c.name", F.lit("-"), q.cast("string")).alias("name"), south.alias("min_lat"),
                         west.alias("min_lon"), (south + 17).alias("max_lat"), (west + 36).alias("max_lon")))
        return boxes.withColumn("rings", F.array(box_ring(*[F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")])))

    @cached_property
    def cities(self) -> DataFrame:
        return self._sql(CITIES, "supplier", "part")

    @cached_property
    def dem_tiles(self) -> DataFrame:
        cells = self._sql(DEM_CELLS, points=self.points)
        span = f"sequence(0, {DEM_SIDE - 1})"
        text = f"flatten(transform({span}, gy -> transform({span}, gx -> CASE WHEN NOT ({SAMPLE_VOID}) THEN {SAMPLE} END)))"
        return cells.select("lat_deg", "lon_deg", F.lit(DEM_SIDE).alias("width"), F.lit(DEM_SIDE).alias("height"),
                            F.expr(text).alias("samples"))

    @cached_property
    def dem(self) -> DataFrame:
        return dem_blocks(self.dem_tiles)

    @cached_property
    def country_shapes(self) -> ShapeIndex:
        return build_shape_index(area_set(self.countries, F.col("id"), ["id", "iso_code", "name"]))

    @cached_property
    def region_shapes(self) -> ShapeIndex:
        return build_shape_index(area_set(self.regions, F.col("id"), ["id", "name"]))

    @cached_property
    def city_rank(self):
        return F.struct((-F.col("population")).alias("p"), F.col("name").alias("n"), F.col("id").alias("i"))

    @cached_property
    def city_index(self) -> NearestIndex:
        return build_nearest_index(self.cities, self.city_rank, ["id", "name", "lat", "lon"])

    @cached_property
    def water_bodies(self) -> DataFrame:
        boxes = self._sql(WATER, "part")
        return boxes.withColumn("rings", F.array(box_ring(*[F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]))) \
                    .withColumn("is_line", F.lit(False)).withColumn("radius_deg", F.lit(None).cast("double"))

    @cached_property
    def river_paths(self) -> DataFrame:
        path = F.array(*[F.struct(F.col(f"x{i}").alias("lon"), F.col(f"y{i}").alias("lat")) for i in (1, 2, 3)])
        return self._sql(RIVERS, "supplier").select("id", F.lit("RIVER").alias("water_type"), "discharge_cms",
                                                    F.array(path).alias("rings"))

    @cached_property
    def landcover_tiles(self) -> DataFrame:
        """One grid per nation, plus one coarse world grid per region."""
        local = self._sql(NATION_BOXES, "nation").select(
            F.format_string("grid_%03d", F.col("id")).alias("file_name"), F.col("id").alias("_k"), "min_lat", "min_lon",
            "max_lat", "max_lon", F.lit(12).alias("width"), F.lit(8).alias("height"))
        world = self.base("region").select(
            F.format_string("world_%03d", F.col("r_regionkey")).alias("file_name"), F.col("r_regionkey").alias("_k"),
            F.lit(-90.0).alias("min_lat"), F.lit(-180.0).alias("min_lon"), F.lit(90.0).alias("max_lat"),
            F.lit(180.0).alias("max_lon"), F.lit(36).alias("width"), F.lit(18).alias("height"))
        names = F.array(*[F.lit(c) for c in LANDCOVER_CLASSES])
        classes = F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.transform(
            F.sequence(F.lit(0), F.col("width") - 1),
            lambda x: F.element_at(names, ((F.col("_k") * 7 + x * 3 + y * 5) % 12 + 1).cast("int")))))
        return local.unionByName(world).select(
            "file_name", F.col("min_lat").alias("south"), F.col("min_lon").alias("west"), F.col("max_lat").alias("north"),
            F.col("max_lon").alias("east"), "width", "height", classes.alias("classes"))

    @cached_property
    def landcover(self) -> LandcoverIndex:
        return build_landcover_index(landcover_blocks(self.landcover_tiles))

    @cached_property
    def positions(self) -> DataFrame:
        return self._sql(POSITIONS, "events")
