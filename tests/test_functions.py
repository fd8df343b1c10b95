"""Scalar rules against values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import climate, coords, geodesy, noise, vertical, water
from cartolith.functions.coords import Extent, Grid
from cartolith.functions.projections import equirectangular, projection_for, register_projection, web_mercator
from cartolith.functions.text import city_detail, distance_text, iso_code
from cartolith.params import TerrainParams, VerticalProfile, profile_for_bounds


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_geodesic_distances():
    paris = geodesy.vincenty_np([52.520008], [13.404954], [48.856613], [2.352222])[0]
    assert abs(paris - 878_000) < 3_000
    assert geodesy.vincenty_np([10.0], [20.0], [10.0], [20.0])[0] == 0.0
    assert 19_000_000 < geodesy.vincenty_np([0.0], [0.0], [0.0], [180.0])[0] < 21_000_000
    assert np.isnan(geodesy.vincenty_np([np.nan], [0.0], [0.0], [1.0])[0])


def test_haversine_close_to_ellipsoid(spark):
    got = values(spark, [(52.520008, 13.404954, 48.856613, 2.352222)], "a double, b double, c double, d double",
                 geodesy.haversine_m(*[F.col(c) for c in "abcd"]), geodesy.vincenty_m(*[F.col(c) for c in "abcd"]))[0]
    assert abs(got[0] / got[1] - 1) < 0.005


def test_compass(spark):
    got = values(spark, [(b,) for b in (0.0, 90.0, 180.0, 270.0, 359.9)], "b double", geodesy.compass_point(F.col("b")))
    assert [r[0] for r in got] == ["N", "E", "S", "W", "N"]


def test_vertical_scale(spark):
    p = TerrainParams()
    got = values(spark, [(0.0,), (100.0,), (-20.0,)], "m double", vertical.to_y(F.col("m"), p))
    assert [r[0] for r in got] == [63, 163, 43]
    assert values(spark, [(100.0,)], "m double", vertical.to_y(F.col("m"), TerrainParams(vertical_exaggeration=2.0)))[0][0] == 263
    assert values(spark, [(400.0,)], "m double", vertical.to_y(F.col("m"), TerrainParams(meters_per_block=4.0)))[0][0] == 163
    top = values(spark, [(9000.0,), (1e9,)], "m double", vertical.to_y(F.col("m"), p))
    assert top[0][0] < 320 and top[1][0] <= 319
    assert "compressed" in vertical.fit_text(p) and vertical.flattens_real_terrain(p)
    assert "all of Earth fits" in vertical.fit_text(TerrainParams(sea_level=0, min_y=-1024, max_y=1024, meters_per_block=20.0))


def test_biomes(spark):
    cases = [(5.0, 100.0, "NONE", "TREE_COVER", "TROPICAL_RAINFOREST"), (15.0, 100.0, "NONE", "TREE_COVER", "TROPICAL_SEASONAL_FOREST"),
             (48.0, 100.0, "NONE", "TREE_COVER", "TEMPERATE_FOREST"), (62.0, 100.0, "NONE", "TREE_COVER", "BOREAL_FOREST"),
             (70.0, 100.0, "NONE", "TREE_COVER", "TUNDRA"), (46.0, 1200.0, "NONE", "TREE_COVER", "MOUNTAIN_FOREST"),
             (46.0, 2400.0, "NONE", "TREE_COVER", "ALPINE"), (46.0, 4000.0, "NONE", "TREE_COVER", "GLACIER"),
             (10.0, -50.0, "OCEAN", "UNKNOWN", "WARM_OCEAN"), (45.0, -50.0, "OCEAN", "UNKNOWN", "OCEAN"),
             (75.0, -50.0, "OCEAN", "UNKNOWN", "FROZEN_OCEAN"), (45.0, -3000.0, "OCEAN", "UNKNOWN", "DEEP_OCEAN"),
             (-75.0, 100.0, "NONE", "TREE_COVER", "GLACIER")]
    got = values(spark, cases, "lat double, m double, w string, c string, want string",
                 climate.climate_biome(F.col("lat"), F.col("m"), F.col("w"), F.col("c")), "want")
    assert all(a == b for a, b in got)


def test_river_display_width(spark):
    got = values(spark, [(10.0,), (40.0,), (400.0,), (4000.0,)], "q double", water.display_width_blocks(F.col("q"), 3.0))
    assert [round(r[0], 6) for r in got] == [3.0, 3.0, 4.5, 6.0]


def test_planet_extent_and_clamp(spark):
    extent = Grid(TerrainParams(projection="plate_carree", origin_lat=0.0, origin_lon=0.0)).planet_extent()
    assert extent.as_tuple() == (-20037, -10018, 20036, 10017)
    small = Extent(-20, -10, 19, 9)
    assert values(spark, [(500.0, -500.0)], "x double, z double", small.clamp_x(F.col("x"), 0.5), small.clamp_z(F.col("z"), 0.5)) == [(19.5, -9.5)]
    assert small.scaled(0.5).as_tuple() == (-10, -5, 9, 4)


def test_round_trips(spark):
    rows = [(51.0, 10.0), (-33.5, 151.2), (0.0, -179.9)]
    for p in (web_mercator(), equirectangular(51.0)):
        east, north = p.forward(F.col("lat"), F.col("lon"))
        for lat, lon, a, b in values(spark, rows, "lat double, lon double", "lat", "lon", *p.inverse(east, north)):
            assert abs(lat - a) < 1e-9 and abs(lon - b) < 1e-9


def test_projection_registry():
    with pytest.raises(ValueError):
        projection_for(TerrainParams(projection="nowhere"))
    register_projection("Mine", lambda params: equirectangular(0.0, "mine"))
    assert projection_for(TerrainParams(projection="MINE")).id == "mine"


def test_tile_names(spark):
    got = values(spark, [("N50E008.hgt",), ("s01w179",), ("nope",)], "n string", *coords.parse_tile_name(F.col("n")))
    assert got == [(50, 8), (-1, -179), (None, None)]
    assert values(spark, [(90.0, 180.0)], "a double, o double", coords.tile_lat(F.col("a")), coords.tile_lon(F.col("o"))) == [(89, 179)]


def test_spiral(spark):
    x, z = coords.spiral_cell(F.col("id"))
    cells = [tuple(r) for r in spark.range(49).select(x, z).collect()]
    assert cells[0] == (0, 0) and len(set(cells)) == 49 and max(max(abs(a), abs(b)) for a, b in cells) == 3
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(cells, cells[1:]))
    assert coords.spiral_spec(0, 0, 16)["chunks"] == 9


def test_noise_matches_plain_integers(spark):
    def cell_hash(a, b, salt):
        m = (1 << 64) - 1
        h = (a * noise.CELL_MIX_A & m) ^ ((b + noise.CELL_OFFSET_B & m) * noise.CELL_MIX_B & m) ^ salt
        for _ in range(2):
            h = (h ^ h >> 32) * noise.CELL_FINAL & m
        return h ^ h >> 32
    xs, zs = np.array([0, 1, -7, 123456]), np.array([5, -1, 0, -99999])
    want = [cell_hash(int(a), int(b), 42) for a, b in zip(xs, zs)]
    assert noise.cell_hash_np(xs, zs, 42).tolist() == want
    smooth = noise.cell_smooth_np(np.arange(-50, 50), np.zeros(100), 12, 7)
    assert (smooth >= 0).all() and (smooth < 1).all() and np.abs(np.diff(smooth)).max() < 0.3
    draws = noise.geo_noise_np(np.linspace(-80, 80, 500), np.linspace(-170, 170, 500), 0.3, 9)
    assert (np.abs(draws) <= 1).all() and draws.std() > 0.1
    got = values(spark, [(3, -4)], "x int, z int", noise.cell_at(F.col("x"), F.col("z"), 42))[0][0]
    assert got == (cell_hash(3, -4, 42) >> 11) * 2.0 ** -53


def test_noise_in_sql(spark):
    noise.register_noise(spark)
    geodesy.register_geodesy(spark)
    row = spark.sql("SELECT cell_noise(5L, 6L, 12, 7L) AS a, vincenty_m(0D, 0D, 0D, 1D) AS b, geo_noise(1D, 2D, 0.3D, 9L) AS c").first()
    assert abs(row.a - noise.cell_smooth_np([5], [6], 12, 7)[0]) < 1e-12 and abs(row.b - 111_319.49) < 1


def test_text(spark):
    got = values(spark, [("Quadria", True, 1234), (None, True, 0), ("Quadria", False, 0)], "c string, k boolean, p bigint",
                 city_detail(F.col("c"), F.col("k"), F.col("p")))
    assert [r[0] for r in got] == ["Capital of Quadria -- population 1,234", "Capital", "Quadria"]
    assert values(spark, [(999.4,), (1500.0,)], "m double", distance_text(F.col("m"))) == [("999 m",), ("1.5 km",)]
    assert values(spark, [(" de ",), ("-99",)], "c string", iso_code(F.col("c"))) == [("DE",), (None,)]


def test_parameters():
    with pytest.raises(ValueError):
        TerrainParams(sea_level=400)
    with pytest.raises(ValueError):
        VerticalProfile(0, -500, 500, 1.0)
    assert profile_for_bounds(180, 360).meters_per_block == 20.0 and profile_for_bounds(100, 360).min_y == -64
    assert len(profile_for_bounds(1, 1).fingerprint) == 64


def test_lake_placement(spark):
    p = TerrainParams(sea_level=0, min_y=-512, max_y=512, meters_per_block=20.0, min_lake_depth=3)
    rows = [(5440.5, "LAKE", None, 60.0), (5440.5, "LAKE", 0.0, 60.0), (5440.5, "LAKE", 5440.5, 60.0)]
    found = F.struct(F.col("k").alias("water_type"), F.col("s").alias("surface_m"), F.col("b").alias("bed_depth_m"))
    got = values(spark, rows, "m double, k string, s double, b double", water.place_water(F.col("m"), found, p, False))
    assert [r[0].water_type for r in got] == ["NONE", "NONE", "LAKE"]
    assert got[2][0].meters == 5380.5 and got[0][0].meters == 5440.5
