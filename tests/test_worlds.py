"""Terrain, neighbourhood steps, reference data, feeds and file sources."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from cartolith.functions.geodesy import vincenty_np
from cartolith.operators import gazetteer, publish, quality, shaping
from cartolith.operators.shapes import area_set, build_shape_index
from cartolith.params import TerrainParams
from cartolith.plans.terrain import TerrainSources, build_terrain, column_layers, sample_columns
from cartolith.sources import vectors
from cartolith.sources.shapefile import ShapefileSource
from cartolith.streaming import health, ledger, towns

RING = "array<array<struct<lon:double,lat:double>>>"


def box(south, west, north, east):
    south, west, north, east = map(float, (south, west, north, east))
    return [[(west, south), (east, south), (east, north), (west, north), (west, south)]]


def test_fallback_world(spark):
    chunks = spark.createDataFrame([(0, 0), (1, 0)], "cx int, cz int")
    rows = build_terrain(chunks, TerrainSources(wander=False), TerrainParams(fallback_elevation=100.0, detail=0.0)).collect()
    assert len(rows) == 512 and {(r.surface_y, r.water_type, r.from_fallback) for r in rows} == {(163, "NONE", True)}


def test_terrain_does_not_depend_on_what_is_built_with_it(spark):
    params = TerrainParams(fallback_elevation=100.0, detail=1.5)
    alone = build_terrain(spark.createDataFrame([(3, -2)], "cx int, cz int"), TerrainSources(), params)
    block = spark.createDataFrame([(x, z) for x in range(2, 5) for z in range(-3, 0)], "cx int, cz int")
    among = build_terrain(block, TerrainSources(), params).filter("shiftright(bx, 4) = 3 AND shiftright(bz, 4) = -2")
    a, b = ({(r.bx, r.bz): (r.surface_y, r.biome) for r in df.collect()} for df in (alone, among))
    assert len(a) == 256 and a == b and len({v[0] for v in a.values()}) > 3


def test_ice_sheet_and_depth(spark):
    p = TerrainParams(fallback_elevation=1000.0)
    rows = spark.createDataFrame([(0, 0, -75.0, 0.0, 0.0, 0.0)], "bx int, bz int, lat double, lon double, lat_span double, lon_span double")
    row = sample_columns(rows, TerrainSources(wander=False), p).first()
    assert row.elevation_m == 70.0 and row.biome == "GLACIER"


def shore_rows(spark, land):
    rows = [(x, z, 95 if x <= 0 else land(x), 100 if x <= 0 else 63, "LAKE" if x <= 0 else "NONE") for x in range(-10, 12) for z in range(-8, 9)]
    return spark.createDataFrame(rows, "bx int, bz int, surface_y int, water_surface_y int, water_type string")


def test_plateau_falls_to_the_lake(spark):
    shaped = shaping.shape_surface(shore_rows(spark, lambda x: 112), 0.0, 4, -64, 320, patch=8)
    got = {r.bx: r.surface_y for r in shaped.filter("bz = 0").collect()}
    assert [got[x] for x in range(1, 6)] == [101, 104, 106, 109, 112]
    low = shaping.shape_surface(shore_rows(spark, lambda x: 90), 0.0, 4, -64, 320)
    assert {r.bx: r.surface_y for r in low.filter("bz = 0").collect()}[1] == 100


def test_layers_cover_each_column_once(spark):
    rows = spark.createDataFrame([(0, 0, 70, 63, "NONE", "GRASS_BLOCK", "DIRT"), (1, 0, 50, 63, "LAKE", "SAND", "SAND"), (2, 0, 400, 63, "NONE", "STONE", "STONE")],
                                 "bx int, bz int, surface_y int, water_surface_y int, water_type string, top string, filler string")
    layers = {}
    for r in column_layers(rows, TerrainParams()).collect():
        layers.setdefault(r.bx, []).append((r.y_from, r.y_to, r.material))
    for parts in layers.values():
        parts.sort()
        assert parts[0][0] == -64 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    assert layers[1][-1] == (51, 63, "WATER") and layers[2][-1][1] == 319


def test_cities_and_markers(spark):
    cities = spark.createDataFrame([(11, "Harrow Bay", -33.5, 151.25, 6_000, 4, False), (12, "Mellin", 52.0, -3.5, 250_000, 4, False), (13, "Mellin", 12.25, 77.0, 90_000, 4, False),
                                    (21, "Tarn", -4.0, 20.5, 40_000, 4, True), (22, "Vessel", -6.0, 21.5, 40_000, 4, True)],
                                   "id int, name string, lat double, lon double, population bigint, country_id int, capital boolean")
    # one alias of two cities, one that is another city's name, one of something else than a city
    names = spark.createDataFrame([(0, "city", 11, "Saltport"), (1, "city", 13, "Saltport"), (2, "city", 12, "Tarn"), (3, "city", 22, "Old Harbour"), (4, "region", 11, "Nowhere Land")],
                                  "id int, entity_type string, entity_id int, name string")
    want = {"mellin": 12, "SALTPORT": 13, "tarn": 21, " Old Harbour": 22, "Nowhere Land": None, "harrow": None}
    asked = spark.createDataFrame([(q,) for q in want], "query string")
    assert {r["query"]: r.city_id for r in gazetteer.find_city(asked, cities, names).collect()} == want
    for prefix, limit, hits in (("me", 5, [12, 13]), ("s", 5, [13, 11]), ("Tar", 5, [12, 21]), ("tar", 1, [21]), ("old h", 5, [22]), ("nowhere", 5, [])):
        found = gazetteer.search_cities(spark.createDataFrame([(prefix,)], "query string"), cities, names, limit).collect()
        assert [r.city_id for r in sorted(found, key=lambda r: (-r.population, r.name, r.city_id))] == hits, prefix
    countries = spark.createDataFrame([(4, "QH", "Halmere", -10.0, 10.0, 0.0, 30.0)], "id int, iso_code string, name string, min_lat double, min_lon double, max_lat double, max_lon double")
    regions = spark.createDataFrame([(9, 4, "Coast", -10.0, 10.0, -5.0, 30.0)], "id int, country_id int, name string, min_lat double, min_lon double, max_lat double, max_lon double")
    marks = {r.id: r for r in publish.build_markers(countries, regions, cities, "n:", city_limit=1).collect()}
    assert set(marks) == {"n:country/4", "n:region/9", "n:capital/21", "n:capital/22", "n:city/12"}
    assert marks["n:capital/21"].detail == "Capital of Halmere -- population 40,000"
    assert gazetteer.country_anchor(countries, cities).first().lat == -4.0  # of two equally large capitals the first by name
    assert publish.build_markers(countries, regions, cities, "n:").count() == 7  # no limit unless asked for


def test_simplified_ring_keeps_its_corners():
    import numpy as np
    ring = np.array([[x, 0] for x in range(50)] + [[49, z] for z in range(1, 50)] + [[x, 49] for x in range(48, -1, -1)] + [[0, z] for z in range(48, -1, -1)])
    short = publish._fit_ring(ring, 1.0, 10)
    assert len(short) <= 10 and {(0, 0), (49, 0), (49, 49), (0, 49)} <= {tuple(p) for p in short.tolist()}


def test_geojson_files(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    features = [{"type": "Feature", "properties": {"NAME": "A", "ISO_A2": "AA"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
                {"type": "Feature", "properties": {"NAME": "Again", "ISO_A2": "AA"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}},
                {"type": "Feature", "properties": {"NAME": "No", "ISO_A2": "-99"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
                {"type": "Feature", "properties": {"featurecla": "Lake", "Elevation": 372, "Depth_avg": 154.4}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
                {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [5, 95]}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(f) for f in features))
    rows = vectors.read_geojson(spark, str(tmp_path / "a.geojson"))
    assert vectors.read_geojson(spark, str(tmp_path / "b.jsonl"), lines=True).count() == 5
    kept, repeated = vectors.import_countries(vectors.boundary_identity(rows))
    assert [(r.id, r.name) for r in kept.collect()] == [(1, "A")] and repeated.count() == 1
    lake = vectors.split_rejects(vectors.water_features(rows))[0].collect()
    assert [(r.water_type, r.surface_elevation_m, r.bed_depth_m) for r in lake] == [("LAKE", 372.0, 154.4)]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "Topology"}))
    with pytest.raises(Exception, match="feature collection"):
        vectors.read_geojson(spark, str(tmp_path / "c.geojson")).collect()
    strict = rows.withColumn("strict", F.lit(True))
    with pytest.raises(Exception, match="invalid native feature"):
        vectors.split_rejects(strict, fail_fast=True)[0].collect()


def write_shapefile(stem, records):
    """Minimal polygon shapefile with one text attribute."""
    shp, shx = bytearray(100), bytearray(100)
    for number, parts in enumerate(records, 1):
        points = [p for part in parts for p in part]
        starts, at = [], 0
        for part in parts:
            starts.append(at)
            at += len(part)
        body = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts)
        body += b"".join(struct.pack("<dd", *p) for p in points)
        shx += struct.pack(">ii", len(shp) // 2, len(body) // 2)
        shp += struct.pack(">ii", number, len(body) // 2) + body
    stem.with_suffix(".shp").write_bytes(shp)
    stem.with_suffix(".shx").write_bytes(shx)
    field = b"KIND".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15
    head = struct.pack("<BBBBIHH", 3, 24, 1, 1, len(records), 32 + 32 + 1, 9).ljust(32, b"\0")
    table = head + field + b"\r" + b"".join(b" " + f"k{i}".ljust(8).encode() for i in range(len(records)))
    stem.with_suffix(".dbf").write_bytes(table)


def test_shapefile_source(spark, tmp_path):
    shell, hole = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    write_shapefile(tmp_path / "k", [[shell, hole], [shell[:-1]], [shell]])
    spark.dataSource.register(ShapefileSource)
    rows = {r.rec_no: r for r in spark.read.format("shapefile").option("recordsPerTask", "2").load(str(tmp_path / "k.shp")).collect()}
    assert len(rows) == 3 and rows[0].part_roles == ["shell", "hole"] and rows[1].attributes == {"KIND": "k1"}
    assert rows[1].parts[0][0] == rows[1].parts[0][-1]
    write_shapefile(tmp_path / "m", [[shell, hole[:2]]])
    broken = spark.read.format("shapefile").load(str(tmp_path / "m.shp")).first()
    assert broken.status == "malformed parts: 1" and broken.part_roles == ["shell"]
    (tmp_path / "m.dbf").unlink()
    with pytest.raises(Exception, match="m.dbf"):
        spark.read.format("shapefile").load(str(tmp_path / "m.shp")).collect()


def test_overlap_areas_are_exact(spark):
    def square(x, y, size):
        return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]]
    triangle = [[(0.0, 10.0), (4.0, 10.0), (0.0, 14.0), (0.0, 10.0)]]
    holed = square(20.0, 0.0, 4.0) + [[(21.0, 1.0), (21.0, 3.0), (23.0, 3.0), (23.0, 1.0), (21.0, 1.0)]]
    rows = [(1, square(0.0, 0.0, 2.0)), (2, square(1.0, 1.0, 2.0)), (3, square(2.0, 0.0, 1.0)), (4, square(0.01, 0.01, 0.03)), (5, square(0.01, 0.01, 0.03)),
            (6, triangle), (7, square(0.0, 10.0, 4.0)), (8, square(2.0, 12.0, 3.0)), (9, holed), (10, square(20.0, 0.0, 4.0)), (11, square(21.5, 1.5, 1.0))]
    table = spark.createDataFrame(rows, "rank int, rings array<array<struct<lon:double,lat:double>>>").withColumn("radius", F.lit(None).cast("double"))
    got = {(r.a, r.b): round(r.share, 9) for r in quality.overlap_shares(table, 0.7).collect()}
    assert {pair: share for pair, share in got.items() if share > 1e-9} == {
        (1, 2): 0.25, (1, 4): 1.0, (1, 5): 1.0, (4, 5): 1.0, (6, 7): 1.0, (7, 8): round(4 / 9, 9), (9, 10): 1.0, (10, 11): 1.0}
    assert {r.entity for r in quality.overlapping_countries(table).collect()} == {f"{a}/{b}" for (a, b), share in got.items() if share > 0.01}


def test_gazetteer_lines(spark, tmp_path):
    good = "\t".join(["1", "Ostrübingen", "Ostrubing", "a,b", "48.1", "11.6", "P", "PPLC", "DE", "", "", "", "", "", "1500000", "", "", "", ""])
    (tmp_path / "c.txt").write_text(f"{good}\n\n# note\nshort\tline\n")
    rows = vectors.read_geonames(spark, str(tmp_path / "c.txt")).orderBy("ordinal").collect()
    assert [(r.name, r.capital, r.reject_reason) for r in rows][0] == ("Ostrübingen", True, None)
    assert rows[1].reject_reason == "fewer than 15 columns" and len(rows) == 2


def test_upserts_and_tombstones(spark, tmp_path):
    areas = spark.createDataFrame([(1, box(0, 0, 10, 10))], f"id int, rings {RING}")
    index = build_shape_index(area_set(areas, F.col("id"), ["id"]))
    schema = "town_uuid string, town_name string, lat double, lon double, updated_at bigint, deleted boolean"
    source = tmp_path / "in"
    path, offsets = str(tmp_path / "state"), str(tmp_path / "offsets")

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        run = towns.start_upserts(spark.readStream.schema(schema).parquet(str(source)), path, offsets, index, index, None, available_now=True)
        run.awaitTermination()
        return {r.town_uuid: r for r in towns.current(spark, path).collect()}
    state = feed([("a", "A", 1.0, 1.0, 1, False), ("a", "A", 2.0, 2.0, 2, False), ("b", "B", 50.0, 50.0, 1, False)])
    assert state["a"].latitude == 2.0 and state["a"].country_id == 1 and state["a"].elevation is None and state["b"].country_id is None
    assert feed([("a", "A", 9.0, 9.0, 1, False)])["a"].latitude == 2.0
    assert set(feed([("a", "A", 2.0, 2.0, 3, True)])) == {"b"}
    towns.compact(spark, path, str(tmp_path / "compact"))
    assert {r.town_uuid for r in towns.current(spark, str(tmp_path / "compact")).collect()} == {"b"}


def test_distances_between_towns(spark):
    table = spark.createDataFrame([("a", 10.0, 20.0), ("b", -30.0, 179.5), ("c", -30.0, -179.5), ("far", -10.0, -160.0)], "town_uuid string, latitude double, longitude double")
    asked = [("a", "b"), ("b", "a"), ("a", "a"), ("b", "c"), ("a", "gone"), (None, "a"), (None, None), ("a", "b"), ("a", "far")]
    got = towns.distances(spark.createDataFrame([(*p, i) for i, p in enumerate(asked)], "a string, b string, meters int"), table).collect()
    assert sorted((r.a or "", r.b or "") for r in got) == sorted((a or "", b or "") for a, b in asked)
    at = {(r.a, r.b): r.meters for r in got}
    assert at["a", "b"] == at["b", "a"] > 1e7 and at["a", "a"] == 0.0
    assert at["b", "c"] == pytest.approx(float(vincenty_np([-30.0], [179.5], [-30.0], [-179.5])[0])) and at["b", "c"] < 1.1e5
    assert at["a", "far"] == pytest.approx(20_015_100, rel=1e-4)  # antipodes: the sphere's half turn
    assert at["a", "gone"] is None and at[None, "a"] is None and at[None, None] is None
    points = spark.createDataFrame([("a", 10.0, 20.0), ("gone", 1.0, 1.0), (None, 1.0, 1.0), ("b", None, 1.0)], "town string, lat double, lon double")
    to = {(r.town, r.lat): r.meters for r in towns.distances_to(points, table).collect()}
    assert to == {("a", 10.0): 0.0, ("gone", 1.0): None, (None, 1.0): None, ("b", None): None}
    assert towns.distances(spark.createDataFrame([], "a string, b string"), table).count() == 0


def test_health_gate(spark):
    rows = [(0, None), (10, None), (40, None), (50, "low-tps"), (60, None), (80, None), (95, None), (7000, None)]
    frame = spark.createDataFrame([("s", t, r) for t, r in rows], "server string, t bigint, reason string").withColumn("ts", F.timestamp_seconds("t"))
    got = health.health_decisions(frame, health.HealthPolicy(stable_seconds=30), bucket="minute").orderBy("t").collect()
    assert [r.decision for r in got] == ["stabilizing", "stabilizing", "healthy", "low-tps", "stabilizing", "stabilizing", "healthy", "healthy"]


def test_ledger(spark):
    planned = ledger.spiral_chunks(spark, 0, 0, 16)
    assert planned.count() == 9
    done = planned.filter("ordinal < 4")
    assert ledger.remaining(planned, done, ["cx", "cz"]).count() == 5 and ledger.resume_cursor(planned, done).first().cursor == 4


def test_driver_contract(spark):
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    assert entry.entry(spark).count() == 150
