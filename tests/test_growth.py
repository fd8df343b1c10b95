"""Steps whose work used to grow with more than their input, or to be done twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.operators import shapes, shaping, suitability
from cartolith.operators.shapes import area_set, build_shape_index, locate
from cartolith.plans import terrain as tp, worlds
from cartolith.plans.derived import Tables

RING = "array<array<struct<lon:double,lat:double>>>"


def box(south, west, north, east):
    south, west, north, east = map(float, (south, west, north, east))
    return [[(west, south), (east, south), (east, north), (west, north), (west, south)]]


def test_karst_columns_are_looked_up_once(spark):
    areas = spark.createDataFrame([(1, box(0, 0, 3, 3))], f"id int, rings {RING}")
    index = build_shape_index(area_set(areas, F.col("id"), ["id"]))
    ground = spark.range(4000).select((F.col("id") % 64).cast("int").alias("bx"), F.floor(F.col("id") / 64).cast("int").alias("bz"), F.lit(70).alias("surface_y"),
                                      F.lit("NONE").alias("water_type"), (F.col("id") % 64 / 16).alias("lat"), (F.col("id") / 1000).alias("lon"))
    entrances = spark.createDataFrame([(1, 1.0, 1.0)], "id int, lat double, lon double")
    found = suitability.karst_sites(ground, index, entrances, -56, 0.5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [cx#") == 1  # the cells of the shapes
    rows = found.collect()
    assert rows and all(r.lat <= 3 and r.lon <= 3 for r in rows)


def test_lists_end_with_the_shape_that_fills_the_cell(spark):
    """Shapes behind one that fills a cell can never win there, so they are not listed."""
    rim = [(i, box(0.2, 0.2, 0.7, 0.7)) for i in (1, *range(3, 40))]
    areas = spark.createDataFrame([*rim, (2, box(-1, -1, 3, 3))], f"id int, rings {RING}")
    index = build_shape_index(area_set(areas, F.col("id"), ["id"]))
    listed = index.cells.filter("cx = 0 AND cy = 0").first().listed
    assert [c["rank"] for c in listed] == [1, 2]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.1, 0.1), (3, 5.0, 5.0)], "id int, lat double, lon double")
    assert {r.id: r.hit and r.hit.id for r in locate(points, index, ["id"], "hit").collect()} == {1: 1, 2: 2, 3: None}


def test_a_settled_cell_is_listed_once(spark):
    """Many line pieces behind an area that fills a cell used to give that cell a second row."""
    area = spark.createDataFrame([(1, box(-1, -1, 3, 3), None)], f"rank int, rings {RING}, radius double")
    path = [[(0.1 + i / 100, 0.5) for i in range(40)]]
    lines = spark.createDataFrame([(2, path, 0.01)], f"rank int, rings {RING}, radius double")
    every = area.unionByName(lines).withColumn("value", F.struct("rank"))
    index = build_shape_index(shapes.ShapeSet(every), max_listed=8)
    assert index.cells.filter("cx = 0 AND cy = 0").count() == 1
    points = spark.createDataFrame([(1, 0.5, 0.2)], "id int, lat double, lon double")
    assert [r.hit["rank"] for r in locate(points, index, ["id"], "hit").collect()] == [1]


@pytest.mark.parametrize("build", [worlds.expected_minerals, worlds.column_layers, worlds.chunk_centres, worlds.shore_shaping, worlds.relief_detail,
                                   worlds.surroundings, worlds.vegetation_scores, worlds.species_groups, worlds.cropland_plan])
def test_chunks_are_shuffled_and_not_their_columns(spark, build):
    plan = build(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.index("REPARTITION_BY_NUM")].count("Exchange") == 1  # no exchange stands above that of the chunks


@pytest.mark.parametrize("reach", [1, 6])
def test_columns_dealt_by_patch_have_their_halo(spark, reach):
    chunks = spark.createDataFrame([(0, 0), (1, 0), (3, 3), (4, 4), (-1, -1), (-5, 2), (0, 0)], "cx int, cz int")
    dealt = tp.columns_by_patch(chunks, reach)
    plain = shaping.with_halo(tp.chunk_columns(chunks).drop("own"), reach).select(*dealt.columns)
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty() and dealt.filter("_own").count() == 6 * 256


def test_others_within_counts_no_cell_for_itself():
    flags = np.random.default_rng(5).random((23, 31)) < 0.03
    within = shaping.others_within(flags, 6)
    for d in range(1, 7):
        want = np.zeros_like(flags)
        for ring in range(1, d + 1):
            for dz, dx in shaping.ring_offsets(ring):
                want |= shaping.shifted(flags, dz, dx, False)
        assert (within(d) == want).all()


def test_a_filter_on_the_reason_parses_no_text_again(spark):
    from cartolith.plans import imports
    rejects = imports.import_karst_features_rejects(Tables(spark, "/root/testdata/sf0.001"))
    plan = rejects._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan and "from_json" not in plan[plan.index("Repartition"):]  # not below the step that spreads the parts


def test_an_index_for_points_holds_their_cells_alone(spark):
    """Columns lie in a few of the cells that water covers; the others used to be worked out too."""
    areas = spark.createDataFrame([(1, box(-40, -40, 40, 40)), (2, box(5.2, 5.2, 5.7, 5.7)), (3, box(-8, 4.9, 12, 5.4))], f"id int, rings {RING}")
    points = spark.createDataFrame([(i, 5.0 + i / 7, 5.05 + i / 9) for i in range(9)] + [(9, 90.5, 0.0), (10, 60.0, 60.0)], "id int, lat double, lon double")
    bodies = area_set(areas, -F.col("id"), ["id"])
    every, own = build_shape_index(bodies), build_shape_index(bodies, points=points)
    assert own.cells.count() <= 4 < every.cells.count()
    want = {r.id: r.hit and r.hit.id for r in locate(points, every, ["id"], "hit").collect()}
    assert {r.id: r.hit and r.hit.id for r in locate(points, own, ["id"], "hit").collect()} == want and set(want.values()) == {1, 2, 3, None}


@pytest.mark.parametrize("most", [8, 0])
def test_grids_are_asked_in_turn_without_grouping(spark, monkeypatch, most):
    from cartolith.operators import raster
    monkeypatch.setattr(raster, "MAX_TURNS", most)  # 0: all grids at once, grouped by point
    grids = [("a", 0.0, 0.0, 2.0, 2.0, ["UNKNOWN", "FOREST", "UNKNOWN", "DESERT"]), ("b", 0.0, 0.0, 2.0, 2.0, ["DESERT", "UNKNOWN", "UNKNOWN", "FOREST"]), ("w", -90.0, -180.0, 90.0, 180.0, ["FOREST", "DESERT", "UNKNOWN", "UNKNOWN"])]
    names = dict(zip(("FOREST", "DESERT"), raster.LANDCOVER_CLASSES[1:3]))
    rows = [(f, s, w, n, e, 2, 2, [names.get(c, c) for c in classes]) for f, s, w, n, e, classes in grids]
    blocks = raster.landcover_blocks(spark.createDataFrame(rows, "file_name string, south double, west double, north double, east double, width int, height int, classes array<string>"))
    index = raster.build_landcover_index(blocks)
    assert index.turns == (2, 1) and not index.single
    spots = {1: (1.5, 0.5, "DESERT"), 2: (1.5, 1.5, "FOREST"), 3: (0.5, 0.5, "DESERT"), 4: (0.5, 1.5, "DESERT"), 5: (50.0, -50.0, "FOREST"), 6: (50.0, 50.0, "DESERT"), 7: (95.0, 0.0, "UNKNOWN")}
    points = spark.createDataFrame([(k, lat, lon) for k, (lat, lon, _) in spots.items()], "id int, lat double, lon double")
    found = raster.landcover_at(points, index, ["id"])
    assert {r.id: r.landcover for r in found.collect()} == {k: names.get(c, c) for k, (_, _, c) in spots.items()}
    assert ("Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()) == (most == 0)


def test_boxes_in_one_block_meet_no_others(spark):
    """Only boxes over several blocks or tiles are grouped by their key."""
    from cartolith.operators import raster
    tiles = spark.createDataFrame([(0, x, 9, 9, [float(i * (x + 1)) for i in range(81)]) for x in (0, 1)], "lat_deg int, lon_deg int, width int, height int, samples array<double>")
    points = spark.createDataFrame([(i, 0.03 + i % 30 / 31, i / 100, 0.2, 0.3) for i in range(190)] + [(900, 0.5, 0.5, 0.0, 0.0), (901, None, 0.5, 0.2, 0.2), (902, float("nan"), 0.5, 0.2, 0.2)],
                                   "id int, lat double, lon double, lat_span double, lon_span double")
    whole, parts = ({r.id: r.elevation_m for r in raster.footprint_mean(points, raster.dem_blocks(tiles, b), ["id"]).collect()} for b in (128, 3))
    assert whole == parts and len(whole) == 193
    plan = raster.footprint_mean(points, raster.dem_blocks(tiles), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Union" in plan[:plan.index("Aggregate")]


@pytest.mark.parametrize("margin", [1, 6, 20])
def test_columns_around_chunks_are_not_shuffled(spark, margin):
    asked = [(0, 0), (1, 0), (3, 3), (-2, 1), (0, 0)]
    columns = tp.chunk_columns(spark.createDataFrame(asked, "cx int, cz int"), margin)
    want = {}
    for cx, cz in asked:
        for bx in range(cx * 16 - margin, cx * 16 + 16 + margin):
            for bz in range(cz * 16 - margin, cz * 16 + 16 + margin):
                want[bx, bz] = want.get((bx, bz), False) or (bx >> 4, bz >> 4) == (cx, cz)
    rows = columns.collect()
    assert len(rows) == len(want) and {(r.bx, r.bz): r.own for r in rows} == want
    plan = columns._jdf.queryExecution().optimizedPlan().toString()
    assert plan[:plan.index("Aggregate")].count("Generate") == 2  # columns are made above all groups


def test_only_rings_across_the_box_are_cut(monkeypatch):
    """Every ring used to be cut point by point, though most lie outside the box or inside it."""
    import pyarrow as pa
    from cartolith.operators import clip
    rng = np.random.default_rng(7)
    rings, area = [], (-5.0, -10.0, 20.0, 30.0)
    for i in range(300):
        x, y, side = rng.integers(-60, 60), rng.integers(-40, 40), rng.integers(1, 9)
        ring = [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)][:5 if i % 7 else 4]
        rings.append([{"lon": float(a), "lat": float(b)} for a, b in ring][:2 if i % 31 == 0 else 5])
    value = pa.array([rings[i:i + i % 4] for i in range(0, 300, 3)] + [None, [], [[]]], pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))
    want = [None if row is None else [[tuple(p) for p in cut.tolist()] for cut in (clip._clip_ring(np.array([(p["lon"], p["lat"]) for p in r]).reshape(-1, 2), area) for r in row) if cut is not None]
            for row in value.to_pylist()]
    cuts, plain = [], clip._clip_ring
    monkeypatch.setattr(clip, "_clip_ring", lambda points, box: cuts.append(1) or plain(points, box))
    got = [None if row is None else [[(p["lon"], p["lat"]) for p in r] for r in row] for row in clip._clip_rings(value, area).to_pylist()]
    assert got == want and len(cuts) < sum(len(r or []) for r in value.to_pylist()) / 2
