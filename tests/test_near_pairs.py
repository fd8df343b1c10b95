"""The search for the closest places, which used to list every pair within the radius."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions.geodesy import vincenty_np
from cartolith.operators import near_pairs, suitability
from cartolith.operators.nearest import list_nearest, nearest_listed, nearest_within_degrees, places_within
from cartolith.operators.shapes import area_set, box_ring, build_shape_index
from cartolith.plans import terrain as tp, worlds
from cartolith.plans.derived import Tables


def crowd(seed: int, n: int) -> np.ndarray:
    """Positions over the globe, in a dense spot, at one position, by the pole and on both sides of 180 degrees."""
    r = np.random.default_rng(seed)
    parts = [np.column_stack([r.uniform(-89, 89, n), r.uniform(-180, 180, n)]), r.normal(0, 1e-4, (n, 2)) + 10.0, np.full((n // 4, 2), 10.0),
             np.column_stack([r.uniform(86, 90, n // 4), r.uniform(-180, 180, n // 4)]), np.column_stack([r.uniform(-1, 1, n // 4), r.choice([-179.9, 180.0, 179.5], n // 4)])]
    return np.concatenate(parts)


def frame(spark, at: np.ndarray):
    return spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(at)], "id int, lat double, lon double")


@pytest.mark.parametrize("limit,reach,extra", [(1, 3.0, 0.0), (5, 40.0, 0.0), (3, 1e-3, 0.0), (1, 5.0, 0.3)])
def test_closest_pairs_match_brute_force(monkeypatch, limit, reach, extra):
    monkeypatch.setattr(near_pairs, "SLICE_PAIRS", 500)
    points, places = crowd(1, 120), np.unique(crowd(2, 150), axis=0)
    i, j = near_pairs.closest_pairs(points, places, limit, reach, 1.0, np.full(len(points), extra))
    far = np.sqrt(((points[:, None] - places[None]) ** 2).sum(axis=2))
    kth = np.sort(far, axis=1)[:, limit - 1]
    want = far <= np.minimum(reach, np.where(kth <= reach, kth + extra, reach))[:, None]
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(want))))


def test_pairs_follow_the_answers(spark):
    """Of a thousand places within the radius of each point only those that may be among the closest leave the task."""
    points, places = frame(spark, np.random.default_rng(3).uniform(0, 1, (400, 2))), frame(spark, np.random.default_rng(4).uniform(0, 1, (1000, 2)))
    a, b = points.select("id", F.col("lat").alias("y"), F.col("lon").alias("x")), places.select(F.col("id").alias("pid"), "lat", "lon")
    pairs = near_pairs.near_pairs(a, b, [F.col("y"), F.col("x")], [F.col("lat"), F.col("lon")], 5.0, 5)
    assert pairs.count() == 400 * 5


@pytest.mark.parametrize("rows", [100_000, 40])
def test_places_within_reach_of_crowds(spark, monkeypatch, rows):
    """Blocks of many rows are dealt out in parts."""
    monkeypatch.setattr(near_pairs, "BLOCK_ROWS", rows)
    at, places = crowd(5, 60), crowd(6, 80)
    points = frame(spark, at).unionByName(spark.createDataFrame([(9000, None, 1.0), (9001, float("nan"), 1.0), (9002, 91.0, 1.0)], "id int, lat double, lon double"))
    found = places_within(points, frame(spark, places), ["id"], 500.0, 3, -F.col("id"), [F.col("id").alias("place")]).collect()
    far = np.array([vincenty_np(np.full(len(places), y), np.full(len(places), x), places[:, 0], places[:, 1]) for y, x in at])
    flat = (places[:, 0] - at[:, :1]) ** 2 + (((places[:, 1] - at[:, 1:] + 180) % 360 - 180) * np.cos(np.radians(at[:, :1]))) ** 2
    far[flat > (500 / 111.32 * 1.2) ** 2] = np.inf
    want = {(i, int(p), n + 1) for i in range(len(at)) for n, p in enumerate(np.lexsort((-np.arange(len(places)), far[i]))[:3]) if far[i, p] <= 500_000}
    assert {(r.id, r.place, r.position) for r in found} == want


@pytest.mark.parametrize("rows", [100_000, 40])
def test_nearest_in_degrees_by_pairs_and_by_lists(spark, monkeypatch, rows):
    monkeypatch.setattr(near_pairs, "BLOCK_ROWS", rows)
    at, places = crowd(7, 60), crowd(8, 80)
    points = frame(spark, at).unionByName(spark.createDataFrame([(9000, None, 1.0), (9001, 95.0, 1.0)], "id int, lat double, lon double"))
    gap = at[:, None] - places[None]
    d2 = gap[:, :, 0] * gap[:, :, 0] + gap[:, :, 1] * gap[:, :, 1]
    best = [int(np.lexsort((-np.arange(len(places)), d2[i]))[0]) for i in range(len(at))]
    want = {i: p if d2[i, p] <= 2.5 * 2.5 else None for i, p in enumerate(best)} | {9000: None, 9001: None}
    found = nearest_within_degrees(points, frame(spark, places), ["id"], 2.5, F.col("id"), ["id"], "e")
    assert {r.id: r.e and r.e.id for r in found.collect()} == want
    cell = [F.floor(F.col(c) / 3.0) * 3.0 for c in ("lat", "lon")]
    keyed = points.select("*", *[c.alias(n) for c, n in zip(cell, ("cy", "cx"))])
    boxes = keyed.filter("lat <= 90").select("cy", "cx", F.col("cy").alias("min_lat"), F.col("cx").alias("min_lon"), (F.col("cy") + 3).alias("max_lat"), (F.col("cx") + 3).alias("max_lon")).distinct()
    lists = list_nearest(boxes, frame(spark, places), ["cy", "cx"], 2.5, F.col("id"), ["id"], "near")
    told = keyed.join(lists, ["cy", "cx"], "left").select("id", nearest_listed("near", 2.5).alias("e"))
    assert {r.id: r.e and r.e.id for r in told.collect()} == want


def test_karst_columns_share_the_list_of_their_chunk(spark):
    """Every column used to be shuffled to the entrances; chunks across 180 degrees and by the rim of the grid included."""
    edge = int(np.radians(180.0 - 10.0) * 6378137.0 * np.cos(np.radians(51.0)) / 1000.0) >> 4
    chunks = spark.createDataFrame([(0, 0), (1, 0), (edge, 0), (edge, 3), (edge - 1, 3), (-5, 40)], "cx int, cz int")
    ground = tp.place_columns(tp.columns_by_chunk(chunks).select("bx", "bz", F.lit(70).alias("surface_y"), F.lit("NONE").alias("water_type")), worlds.PARAMS)
    spots = ground.select("lat", "lon").orderBy("bx", "bz").collect()[::37]
    entrances = spark.createDataFrame([(i, r.lat + i % 3 * 0.11, r.lon + 0.03) for i, r in enumerate(spots)] + [(99, 51.0, 179.99), (98, 51.0, -179.99)], "id int, lat double, lon double")
    world = spark.range(1).select("id", F.array(box_ring(F.lit(-90), F.lit(-180), F.lit(90), F.lit(180))).alias("rings"))
    karst = build_shape_index(area_set(world, F.col("id"), ["id"], 45.0))
    near = list_nearest(tp.centre_boxes(chunks, worlds.PARAMS), entrances, ["cx", "cz"], 0.1, F.col("id"), ["lat", "lon"], "near")
    told = tp.place_columns(tp.columns_by_chunk(chunks.join(near, ["cx", "cz"], "left")).select(
        "bx", "bz", F.lit(70).alias("surface_y"), F.lit("NONE").alias("water_type"), "near"), worlds.PARAMS)
    want = {tuple(r) for r in suitability.karst_sites(ground, karst, entrances, -56, 0.1).collect()}
    assert {tuple(r) for r in suitability.karst_sites(told, karst, "near", -56, 0.1).collect()} == want and {r[5] for r in want} == {True, False}
    assert tp.centre_boxes(chunks, worlds.PARAMS).count() > chunks.count()
    plan = worlds.karst_sites(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("ArrowEvalPython"):plan.index("REPARTITION_BY_NUM")].count("Exchange") == 1  # only that of the chunks lies below the hash
