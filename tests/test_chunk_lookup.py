"""Facts of columns looked up by chunk; every column used to be joined and shuffled to samples, cells and grids."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cartolith.operators.raster import build_landcover_index, dem_blocks, landcover_blocks
from cartolith.operators.shapes import ShapeSet, box_ring, build_shape_index
from cartolith.params import LANDCOVER_CLASSES
from cartolith.plans import terrain as tp, worlds
from cartolith.plans.derived import Tables

VALUE = "struct<id:int,water_type:string,surface_elevation_m:double,bed_depth_m:double>"


def world(spark, max_listed: int) -> tp.TerrainSources:
    """Tiles of two sizes in several blocks with voids, areas with a hole, lines, settled cells, and grids in turn with unknown classes."""
    def tile(y, x, w, h):
        return (y, x, w, h, [None if (i * 7 + y + x) % 11 == 0 else float((i * 37 + y * 31 + x * 17) % 1900 - 500) for i in range(w * h)])

    tiles = [tile(y, x, *((9, 9) if (x + y) % 2 else (70, 40))) for y in (50, 51) for x in (8, 9, 10, -180, 179) if (y, x) != (51, 9)]
    dem = dem_blocks(spark.createDataFrame(tiles, "lat_deg int, lon_deg int, width int, height int, samples array<double>"), 16)
    ring = "array<array<struct<lon:double,lat:double>>>"
    rows = [(1, (1, "LAKE", 90.0, 3.0), [[(9.9, 50.8), (10.4, 51.1), (10.2, 50.6), (9.9, 50.8)], [(10.1, 50.8), (10.2, 50.8), (10.2, 50.9), (10.1, 50.8)]], None),
            (2, (2, "RIVER", None, 2.0), [[(9.6, 50.7), (10.5, 51.0), (10.6, 51.2)]], 0.02), (4, (4, "LAKE", None, 5.0), [[(9.0, 50.0), (12.0, 50.0), (12.0, 52.0), (9.0, 52.0), (9.0, 50.0)]], None),
            (9, (9, "OCEAN", None, 0.0), [[(-180.0, 40.0), (180.0, 40.0), (180.0, 60.0), (-180.0, 60.0), (-180.0, 40.0)]], None)]
    shapes = spark.createDataFrame(rows, f"rank int, value {VALUE}, rings {ring}, radius double")
    names = [LANDCOVER_CLASSES[i] for i in range(len(LANDCOVER_CLASSES))]
    grids = [("a", 50.0, 9.0, 51.0, 11.0, 30, 20), ("b", 50.5, 9.5, 52.0, 10.5, 12, 9), ("w", -90.0, -180.0, 90.0, 180.0, 144, 72)]
    made = [(*g, [names[(i * 5 + n) % 4 * (i % 3)] for i in range(g[5] * g[6])]) for n, g in enumerate(grids)]
    cover = spark.createDataFrame(made, "file_name string, south double, west double, north double, east double, width int, height int, classes array<string>")
    return tp.TerrainSources(dem, build_shape_index(ShapeSet(shapes, 0.25), max_listed), build_landcover_index(landcover_blocks(cover, 16)), True, True)


@pytest.mark.parametrize("max_listed,margin,smoothing", [(1024, 0, 2.9), (3, 6, 2.9), (1024, 20, 40.0)])
def test_columns_looked_up_by_chunk_equal_those_joined(spark, max_listed, margin, smoothing):
    params, sources = replace(worlds.PARAMS, smoothing=smoothing), world(spark, max_listed)
    assert sources.water.has_long == (max_listed < 1024)
    edge = int((180.0 - 10.0) * 3.141592653589793 / 180 * 6378137.0 * 0.6293203910498374 / 1000.0) >> 4
    chunks = spark.createDataFrame([(0, 0), (1, 1), (-4, 2), (-3, 0), (edge, 1), (edge, 40), (2, -2), (0, 0)], "cx int, cz int")
    told = tp.sample_chunks(chunks, sources, params, margin)
    plain = tp.sample_columns(tp.place_columns(tp.chunk_columns(chunks, margin), params), sources, params)
    near = [c if t != "double" else F.round(c, 9).alias(c) for c, t in plain.dtypes]
    a, b = ({tuple(r) for r in frame.select(*near).collect()} for frame in (told.select(*plain.columns), plain))
    assert a == b and len(a) >= 7 * 256
    kinds = {r[plain.columns.index("water_type")] for r in a}
    assert {"LAKE", "RIVER", "OCEAN"} <= kinds | ({"LAKE"} if smoothing > 3 else set()) and len({r[plain.columns.index("landcover")] for r in a}) > 2
    bare = tp.TerrainSources(wander=False)
    assert {tuple(r) for r in tp.sample_chunks(chunks, bare, params).collect()} == {tuple(r) for r in tp.sample_columns(tp.place_columns(tp.chunk_columns(chunks), params), bare, params).collect()}


def test_columns_are_made_above_all_joins(spark):
    frame = worlds.terrain_columns(Tables(spark, "/root/testdata/sf0.001"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Join" not in above and "Exchange" not in above and "Join" in plan
