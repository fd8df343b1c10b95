"""Shape lookups against brute force, and the plans they produce."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.operators import clip, quality, shapes
from cartolith.operators.nearest import build_nearest_index, nearest, nearest_within_degrees, places_within
from cartolith.functions.geodesy import vincenty_np
from cartolith.operators.shapes import ShapeSet, area_set, build_shape_index, locate
from cartolith.operators.water import water_column_at, water_shapes
from cartolith.params import TerrainParams

RING = "array<array<struct<lon:double,lat:double>>>"


def box(south, west, north, east):
    south, west, north, east = map(float, (south, west, north, east))
    return [[(west, south), (east, south), (east, north), (west, north), (west, south)]]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def star(rng, cx, cy, r, n=60):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = r * rng.uniform(0.4, 1.0, n)
    ring = [(float(cx + q * np.cos(a)), float(cy + q * np.sin(a))) for a, q in zip(angle, radius)]
    return ring + ring[:1]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def test_shared_border_goes_to_the_first(spark):
    areas = spark.createDataFrame([(1, "Alpha", box(0, 0, 1, 1)), (2, "Beta", box(0, 1, 1, 2))], f"id int, name string, rings {RING}")
    index = build_shape_index(area_set(areas, F.col("id"), ["name"]))
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, 1.5), (3, 0.5, 2.0), (4, 0.5, 2.1), (5, 95.0, 0.5), (6, None, 0.5), (7, 1.0, 0.0)], "id int, lat double, lon double")
    got = {r.id: r.c and r.c.name for r in locate(points, index, ["id"], "c").collect()}
    assert got == {1: "Alpha", 2: "Beta", 3: "Beta", 4: None, 5: None, 6: None, 7: "Alpha"}
    assert shapes.within_shapes(points, index, ["id"]).count() == 4


@pytest.mark.parametrize("max_listed", [1024, 3])
def test_stars_match_brute_force(spark, max_listed):
    """Overlapping stars with holes; the second run sends every border cell through the join."""
    rng = np.random.default_rng(7)
    areas = []
    for i in range(25):
        cx, cy, r = rng.uniform(-8, 8), rng.uniform(-8, 8), rng.uniform(1, 5)
        areas.append((i, [star(rng, cx, cy, r), star(rng, cx, cy, r / 4, 12)]))
    spots = [(i, float(rng.uniform(-12, 12)), float(rng.uniform(-12, 12))) for i in range(800)]
    spots += [(1000 + i, p[1], p[0]) for i, p in enumerate(areas[0][1][0][:20])]
    index = build_shape_index(area_set(spark.createDataFrame(areas, f"id int, rings {RING}"), F.col("id"), ["id"]), max_listed)
    assert index.has_long == (max_listed == 3)
    points = spark.createDataFrame(spots, "id int, lat double, lon double")
    got = {r.id: r.c and r.c.id for r in locate(points, index, ["id"], "c").collect()}
    assert len(got) == len(spots)
    for k, y, x in spots[:800]:
        want = next((i for i, rings in areas if inside(x, y, rings)), None)
        assert got[k] == want
    assert all(got[1000 + i] == 0 for i in range(20))
    hits = {tuple(r) for r in shapes.all_hits(points.filter("id < 800"), index, ["id"]).collect()}
    assert hits == {(k, i) for k, y, x in spots[:800] for i, rings in areas if inside(x, y, rings)}
    assert "CartesianProduct" not in plan_of(locate(points, index, ["id"], "c"))
    assert "NestedLoop" not in plan_of(locate(points, index, ["id"], "c"))


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(3)
    lines = [(i, [[(float(x), float(y)) for x, y in rng.uniform(-5, 5, (4, 2))]], float(rng.uniform(0.05, 0.4))) for i in range(12)]
    frame = spark.createDataFrame(lines, f"id int, rings {RING}, radius double")
    index = build_shape_index(ShapeSet(frame.select(F.col("id").alias("rank"), F.struct("id").alias("value"), "rings", "radius"), 0.5))
    spots = [(i, float(rng.uniform(-6, 6)), float(rng.uniform(-6, 6))) for i in range(500)]
    got = {r.id: r.c and r.c.id for r in locate(spark.createDataFrame(spots, "id int, lat double, lon double"), index, ["id"], "c").collect()}

    def gap(x, y, a, b):
        a, b, p = np.array(a), np.array(b), np.array((x, y))
        t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
        return np.hypot(*(p - a - t * (b - a)))
    for k, y, x in spots:
        want = next((i for i, paths, r in lines if any(gap(x, y, a, b) <= r for a, b in zip(paths[0], paths[0][1:]))), None)
        assert got[k] == want


def test_water_priority_and_sea_level(spark):
    schema = f"id bigint, water_type string, discharge_cms double, surface_elevation_m double, bed_depth_m double, is_line boolean, radius_deg double, rings {RING}"
    lake = [(1, "LAKE", 0.0, 372.0, 5.0, False, None, box(10, 20, 12, 22))]
    index = build_shape_index(water_shapes(spark.createDataFrame(lake, schema), TerrainParams()))
    points = spark.createDataFrame([(1, 13.0, 21.0, -40.0), (2, 13.0, 21.0, 5.0), (3, 13.0, 21.0, None), (4, 11.0, 21.0, -28.0)], "id int, lat double, lon double, elevation_m double")
    got = {r.id: r.water.water_type for r in water_column_at(points, index, ["id"], has_ocean=False).collect()}
    assert got == {1: "OCEAN", 2: "NONE", 3: "NONE", 4: "LAKE"}
    mixed = lake + [(2, "OCEAN", 0.0, None, 0.0, False, None, box(0, 0, 15, 30)), (3, "RIVER", 50.0, None, 2.0, True, 0.1, [[(19.0, 11.0), (25.0, 11.0)]])]
    index = build_shape_index(water_shapes(spark.createDataFrame(mixed, schema), TerrainParams()))
    points = spark.createDataFrame([(1, 11.05, 21.0, 3.0), (2, 11.5, 21.0, 3.0), (3, 5.0, 5.0, -4.0), (4, 16.0, 5.0, -4.0)], "id int, lat double, lon double, elevation_m double")
    got = {r.id: (r.water.water_type, r.water.surface_m) for r in water_column_at(points, index, ["id"], has_ocean=True).collect()}
    assert got == {1: ("RIVER", 3.0), 2: ("LAKE", 372.0), 3: ("OCEAN", 0.0), 4: ("NONE", None)}


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    # a third of all places crowd into one spot, some share a position exactly
    places = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), int(rng.integers(1, 9))) for i in range(300)]
    places += [(1000 + i, 48.0 + float(rng.normal(0, 1e-3)), 11.0 + float(rng.normal(0, 1e-3)), 5) for i in range(60)]
    places += [(2000 + i, 10.0, 10.0, i) for i in range(40)]
    frame = spark.createDataFrame(places, "id int, lat double, lon double, population int")
    index = build_nearest_index(frame, F.struct(-F.col("population"), F.col("id")), ["id"], leaf_places=16)
    spots = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(400)]
    spots += [(500 + i, 48.0 + float(rng.normal(0, 2e-3)), 11.0 + float(rng.normal(0, 2e-3))) for i in range(100)]
    spots += [(900, 10.0, 10.1), (901, 90.0, 0.0), (902, -90.0, 180.0), (903, 0.0, 180.0), (904, 0.0, -180.0)]
    points = spark.createDataFrame([*spots, (999, 95.0, 0.0)], "id int, lat double, lon double")
    got = {r.id: r.c and r.c.id for r in nearest(points, index, "c").collect()}
    assert len(got) == len(spots) + 1 and got[999] is None
    ids, lat, lon, people = (np.array(v) for v in zip(*places))
    for k, y, x in spots:
        d = (lat - y) ** 2 + ((((lon - x + 180) % 360) - 180) * np.cos(np.radians(y))) ** 2
        best = np.lexsort((ids, -people, d))[0]
        assert d[ids == got[k]][0] <= d[best] * (1 + 1e-12) + 1e-18
        if np.sum(d <= d[best] * (1 + 1e-9)) == 1:
            assert got[k] == ids[best]
    assert got[900] == 2039
    assert "NestedLoop" not in plan_of(nearest(points, index, "c"))


def test_places_within_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    places = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(600)]
    spots = [(i, float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180))) for i in range(80)] + [(90, 0.0, 179.99), (91, 89.5, 10.0)]
    points = spark.createDataFrame(spots, "id int, lat double, lon double")
    frame = spark.createDataFrame(places, "pid int, lat double, lon double")
    got = {}
    for r in places_within(points, frame, ["id"], 900.0, 3, F.col("pid"), [F.col("pid").alias("place")]).collect():
        got.setdefault(r.id, {})[r.position] = r.place
    ids, lat, lon = (np.array(v) for v in zip(*places))
    for k, y, x in spots:
        flat = (lat - y) ** 2 + ((((lon - x + 180) % 360) - 180) * np.cos(np.radians(y))) ** 2
        meters = vincenty_np(np.full(600, y), np.full(600, x), lat, lon)
        near = [i for i in np.argsort(meters) if meters[i] <= 900_000 and flat[i] <= (900 / 111.32 * 1.2) ** 2][:3]
        assert [got.get(k, {})[n] for n in sorted(got.get(k, {}))] == [int(ids[i]) for i in near]


def test_entrance_ties_go_to_the_last(spark):
    caves = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 10.2), (3, 10.0, 10.0)], "id int, lat double, lon double")
    points = spark.createDataFrame([(1, 10.0, 10.01), (2, 20.0, 20.0)], "k int, lat double, lon double")
    got = {r.k: r.e and r.e.id for r in nearest_within_degrees(points, caves, ["k"], 0.05, F.col("id"), ["id"], "e").collect()}
    assert got == {1: 3, 2: None}


def test_clip_and_area(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0, box(0, 0, 10, 10)), (2, 20.0, 20.0, 21.0, 21.0, box(20, 20, 21, 21))]
    frame = spark.createDataFrame(rows, f"id int, min_lat double, min_lon double, max_lat double, max_lon double, rings {RING}")
    cut = clip.clip_areas(frame, (0.0, 0.0, 10.0, 5.0)).select("id", F.aggregate(F.transform("rings", shapes.ring_area), F.lit(0.0), lambda a, v: a + v)).collect()
    assert [tuple(r) for r in cut] == [(1, 50.0)]


def test_geometry_checks(spark):
    rows = [(1, box(0, 0, 1, 1)), (2, [[(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]), (3, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]])]
    found = {r.entity: r.message for r in quality.invalid_geometry(spark.createDataFrame(rows, f"id int, rings {RING}")).collect()}
    assert found["3"] == "open ring" and "1" not in found and "2" in found
