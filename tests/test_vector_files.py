from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from cartolith.operators import tiles
from cartolith.operators.shapes import cut_at_antimeridian
from cartolith.params import VECTOR_SCHEMAS
from cartolith.sources import importers, vectors
from cartolith.sources.shapefile import read_shapefiles

SHELL, HOLE = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
PATH = "array<array<struct<lon:double,lat:double>>>"


def write_files(stem, records, fields=(("KIND", 8),)):
    """Shape, index and table file of (type, parts, attributes) records."""
    shp, shx, rows = bytearray(100), bytearray(100), b""
    for number, (kind, parts, values) in enumerate(records, 1):
        if kind in (3, 5):
            points = [p for part in parts for p in part]
            starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
            body = struct.pack("<i4dii", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts)
            body += b"".join(struct.pack("<dd", *p) for p in points)
        else:
            body = struct.pack("<i", kind) + (struct.pack("<dd", *parts) if parts else b"")
        shx += struct.pack(">ii", len(shp) // 2, len(body) // 2)
        shp += struct.pack(">ii", number, len(body) // 2) + body
        rows += b" " + b"".join(values.get(n, "").encode("latin-1").ljust(w) for n, w in fields)
    head = struct.pack("<BBBBIHH", 3, 24, 1, 1, len(records), 33 + 32 * len(fields), 1 + sum(w for _, w in fields)).ljust(32, b"\0")
    stem.with_suffix(".shp").write_bytes(shp)
    stem.with_suffix(".shx").write_bytes(shx)
    stem.with_suffix(".dbf").write_bytes(head + b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r" + rows)


@pytest.mark.parametrize("per_task", [1, 2, 100])
def test_records_of_a_folder_in_ranges(spark, tmp_path, per_task):
    write_files(tmp_path / "a", [(5, [SHELL, HOLE], {"KIND": "k0"}), (5, [SHELL[:-1]], {}), (0, None, {"KIND": "\xe9"}), (1, (3.0, 4.0), {}), (3, [[(0, 0), (1, 1)]], {"KIND": "k4"})])
    write_files(tmp_path / "b", [(5, [SHELL, HOLE[:2]], {"KIND": "b0"})])
    write_files(tmp_path / "empty", [])
    got = {(r.file.rsplit("/", 1)[1], r.ordinal): r for r in read_shapefiles(spark, f"file:{tmp_path}", per_task).collect()}
    assert sorted(got) == [("a", i) for i in range(5)] + [("b", 0)]
    assert got["a", 0].part_roles == ["shell", "hole"] and got["a", 0].attributes == {"KIND": "k0"} and [(p.lon, p.lat) for p in got["a", 0].parts[1]] == HOLE
    assert got["a", 1].parts[0][0] == got["a", 1].parts[0][-1] and got["a", 1].attributes == {}
    assert [got["a", i].status for i in range(5)] == ["ok", "ok", "empty", "unsupported type", "ok"] and got["a", 2].attributes == {"KIND": "\xe9"}
    assert got["b", 0].status == "malformed parts: 1" and got["b", 0].part_roles == ["shell"]


def test_files_that_do_not_fit_each_other(spark, tmp_path):
    write_files(tmp_path / "a", [(5, [SHELL], {"KIND": "x"})] * 3)
    whole = (tmp_path / "a.dbf").read_bytes()
    (tmp_path / "a.dbf").write_bytes(whole[:4] + struct.pack("<I", 2) + whole[8:])
    with pytest.raises(Exception, match="disagree"):
        read_shapefiles(spark, str(tmp_path)).collect()
    (tmp_path / "a.dbf").unlink()
    with pytest.raises(Exception, match="a.dbf"):
        read_shapefiles(spark, str(tmp_path)).collect()
    (tmp_path / "a.dbf").write_bytes(whole)
    (tmp_path / "a.shp").write_bytes((tmp_path / "a.shp").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends inside a record"):
        read_shapefiles(spark, str(tmp_path)).collect()


def test_paths_are_cut_at_180_degrees(spark):
    paths = [[(170.0, 0.0), (179.0, 1.0), (-179.0, 3.0), (-170.0, 4.0), (179.0, 4.0)], [(1.0, 1.0), (2.0, 2.0)], [(180.0, 5.0), (-180.0, 6.0)], [(-179.0, 0.0), (179.0, 0.0), (-179.0, 1.0)]]
    row = spark.createDataFrame([(paths,)], f"paths {PATH}").select(cut_at_antimeridian(F.col("paths")).alias("cut")).first()
    got = [[(p.lon, round(p.lat, 9)) for p in piece] for piece in row.cut]
    assert got == [[(170.0, 0.0), (179.0, 1.0), (180.0, 2.0)], [(-180.0, 2.0), (-179.0, 3.0), (-170.0, 4.0), (-180.0, 4.0)], [(180.0, 4.0), (179.0, 4.0)], [(1.0, 1.0), (2.0, 2.0)],
                   [(180.0, 5.0), (180.0, 5.0)], [(-180.0, 5.0), (-180.0, 6.0)], [(-179.0, 0.0), (-180.0, 0.0)], [(180.0, 0.0), (179.0, 0.0), (180.0, 0.5)], [(-180.0, 0.5), (-179.0, 1.0)]]
    empty = spark.createDataFrame([([],), ([[]],), ([[(1.0, 1.0)]],)], f"paths {PATH}").select(cut_at_antimeridian(F.col("paths")).alias("cut")).collect()
    assert [len(r.cut) for r in empty] == [0, 1, 1]


def test_rivers_and_their_store(spark, tmp_path):
    fields = (("NAME", 10), ("KIND", 10), ("DIS_AV_CMS", 10))
    line = [[(10.0, 50.0), (11.0, 50.0)]]
    (tmp_path / "in").mkdir()
    write_files(tmp_path / "in" / "r", [(3, line, {"NAME": "Elbe", "DIS_AV_CMS": "40000"}), (3, line, {"KIND": "Canal"}), (3, [[(179.0, 10.0), (-179.0, 12.0)]], {"DIS_AV_CMS": "x"}),
                                       (3, [[(200.0, 10.0), (201.0, 12.0)]], {}), (5, [SHELL], {})], fields)
    records = read_shapefiles(spark, str(tmp_path / "in"))
    read = importers.rivers(records, box=(0.0, 0.0, 60.0, 60.0)).orderBy("ordinal").collect()
    assert [r.reject_reason for r in read] == [None, "made by people", "outside the box", "invalid position", "not a line"] and [r.strict for r in read] == [False, False, False, True, True]
    assert read[0].name == "Elbe" and read[0].discharge_cms == 40000.0 and read[2].discharge_cms == 0.0 and len(read[2].rings) == 2
    with pytest.raises(Exception, match="invalid position|not a line"):
        vectors.split_rejects(importers.rivers(records), fail_fast=True)[0].collect()
    accepted, _ = vectors.split_rejects(importers.rivers(records))
    rows = importers.rows_for("water_bodies", accepted)
    folder = str(tmp_path / "store")
    importers.store(rows, "water_bodies", folder, records)
    stored = spark.read.parquet(f"{folder}/water_bodies")
    assert stored.columns == spark.createDataFrame([], VECTOR_SCHEMAS["water_bodies"]).columns and sorted(r.id for r in stored.collect()) == [1, 2]
    (note,) = spark.read.parquet(f"{folder}/cache_metadata/water_bodies").collect()
    assert note.cache_key.startswith("water_bodies:") and '"records":5' in note.detail and note.prepared_at > 0
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        importers.store(rows, "water_bodies", folder)
    importers.store(rows.where("id = 1"), "water_bodies", folder, replace=True)
    assert spark.read.parquet(f"{folder}/water_bodies").count() == 1


def test_karst_areas(spark, tmp_path):
    write_files(tmp_path / "k", [(5, [HOLE, SHELL, HOLE], {}), (5, [HOLE], {}), (3, [[(0, 0), (1, 1)]], {}), (5, [[(0, 0), (5, 5), (0, 0), (0, 0)]], {}), (5, [SHELL, [(20, 20), (20, 30), (30, 30), (20, 20)]], {})])
    records = read_shapefiles(spark, str(tmp_path))
    read = importers.karst(records).orderBy("ordinal").collect()
    assert [r.reject_reason for r in read][:3] == [None, "no shell", "not an area"] and read[3].reject_reason in ("zero area", "no shell") and read[4].reject_reason is None
    assert [len(r) for r in read[0].rings] == [5, 5] and (read[4].min_lon, read[4].max_lon) == (0.0, 30.0)
    cut = {r.ordinal: r for r in importers.karst(records, (1.0, 2.0, 8.0, 9.0)).collect()}
    assert (cut[0].min_lat, cut[0].min_lon, cut[0].max_lat, cut[0].max_lon) == (1.0, 2.0, 8.0, 9.0) and len(cut) == 5
    far = importers.karst(records, (60.0, 60.0, 70.0, 70.0)).where("reject_reason IS NULL")
    assert far.count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 16, 17, 70])
def test_tree_fingerprint_is_the_same_however_files_arrive(spark, n):
    names = [(f"file:/d/x/{i % 50:03d}.bin", i % 50) for i in range(n)]  # beyond 50 some entries stand twice
    random.Random(n).shuffle(names)
    level = sorted(f"x/{i % 50:03d}.bin={i % 50}\0" for i in range(n)) or [""]
    while True:
        level = [hashlib.sha256("".join(level[i:i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
        if len(level) == 1:
            break
    files = spark.createDataFrame(names, "path string, length long").repartition(3)
    assert tuple(tiles.tree_fingerprint(files, "/d", fan_in=4).first()) == (n, level[0])


def _decoded(spark, features):
    rows = [("f", i, ("Feature", props, None if kind is None else (kind, text))) for i, (props, kind, text) in enumerate(features)]
    schema = "file string, ordinal long, feature struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"
    return vectors.decode_features(spark.createDataFrame(rows, schema))


def test_karst_and_entrances_of_collections(spark, tmp_path):
    cave = {"natural": "cave_entrance"}
    features = _decoded(spark, [
        ({}, "Polygon", "[[[0,0],[4,0],[4,4],[0,4],[0,0]]]"), (None, "Polygon", "[[[9,9],[12,9],[12,12],[9,12],[9,9]]]"), ({}, "Polygon", "[[[0,0],[1,1],[0,0],[0,0]]]"),
        (cave, "Point", "[2,3]"), (cave, "Point", "[9,9]"), (cave, "Point", "[2]"), ({"natural": "peak"}, "Point", "[2,3]"), (cave, None, None), (None, None, None),
        ({**cave, "name": " Deep "}, "Point", "[-1,0]")])
    box = (-1.0, -1.0, 3.0, 3.0)
    areas = {r.ordinal: (r.reject_reason, r.max_lat, r.strict) for r in importers.karst_features(features, box).collect()}
    assert len(areas) == 10 and areas[0] == (None, 3.0, False) and areas[1][0] == "outside the box" and areas[2][0] == "zero area"
    assert all(areas[i][0] == "not an area" for i in range(3, 10))
    assert importers.karst_features(features).where("reject_reason IS NULL").count() == 2
    caves = {r.ordinal: (r.reject_reason, r.name) for r in importers.cave_entrances(features, box).collect()}
    assert [i for i, r in caves.items() if r[0] is None] == [3, 9] and caves[9][1] == " Deep " and caves[3][1] is None
    assert caves[4][0] == "outside the box" and caves[5][0] == "invalid position" and caves[6][0] == "not a cave entrance" and caves[7][0] == "not a point"
    rows = importers.rows_for("cave_entrances", importers.cave_entrances(features).where("reject_reason IS NULL"))
    importers.store(rows, "cave_entrances", str(tmp_path), features)
    assert spark.read.parquet(str(tmp_path / "cave_entrances")).count() == 3
    with pytest.raises(Exception, match="(?i)exist|occupied|already"):
        importers.store(rows, "cave_entrances", str(tmp_path))
    assert importers.karst_features(features.limit(0), box).count() == importers.cave_entrances(features.limit(0)).count() == 0


def test_cities_and_regions_with_their_countries(spark):
    countries = spark.createDataFrame([("AA", 1), ("BB", 2)], "iso_code string, id int")
    lines = ["\t".join(["1", name, plain, alias, lat, "5", "P", code, iso, *[""] * 5, people, "", "", "", ""]) for name, plain, alias, lat, code, iso, people in [
        ("One", "One", "Uno,One, ,Eins", "5", "PPLC", "AA", "7"), ("Two", "", "", "50", "PPL", "aa", "x"), ("Two", "", "", "50", "PPL", "BB", "0"), ("Three", " ", "Trois", "north", "PPL", "CC", "1")]]
    rows = vectors.parse_geonames(spark.createDataFrame([("g", i, v) for i, v in enumerate([*lines, "short\tline", "# note", " "])], "file string, ordinal long, value string"))
    found = importers.cities(rows, countries)
    assert {r.ordinal: (r.reject_reason, r.country_id) for r in found.collect()} == {
        0: (None, 1), 1: ("bad population", None), 2: (None, 2), 3: ("bad latitude", None), 4: ("fewer than 15 columns", None)}
    boxed = {r.ordinal: (r.reject_reason, r.strict) for r in importers.cities(rows, countries, (0.0, 0.0, 10.0, 10.0)).collect()}
    assert boxed == {0: (None, True), 1: ("outside the box", False), 2: ("outside the box", False), 3: ("bad latitude", True), 4: ("fewer than 15 columns", True)}
    cities, names = importers.numbered_cities(found.where("reject_reason IS NULL"))
    assert [(r.id, r.name, r.capital) for r in cities.orderBy("id").collect()] == [(1, "One", True), (2, "Two", False)]
    assert [(r.id, r.entity_id, r.name) for r in names.orderBy("id").collect()] == [(1, 1, "One"), (2, 1, "Uno"), (3, 1, "Eins")]
    ring = "[[[0,0],[4,0],[4,4],[0,4],[0,0]]]"
    native = {"boundary_type": "region", "name": "R", "admin_level": "2"}
    features = vectors.boundary_identity(_decoded(spark, [
        ({**native, "country_iso_code": "AA"}, "Polygon", ring), ({**native, "country_iso_code": "CC"}, "Polygon", ring), ({"admin": "x", "name": "S", "iso_a2": "CC"}, "Polygon", ring),
        ({"NAME": "Country", "ISO_A2": "AA"}, "Polygon", ring), (native, "Polygon", ring)]))
    regions = {r.ordinal: (r.reject_reason, r.strict, r.country_id) for r in importers.regions(features, countries).collect()}
    assert regions == {0: (None, True, 1), 1: ("error: unknown country", True, None), 2: ("skipped: unknown country", False, None)}
    away = importers.regions(features, countries, (10.0, 10.0, 20.0, 20.0)).collect()
    assert len(away) == 3 and {r.reject_reason for r in away} == {"outside the box"}
    with pytest.raises(Exception, match="unknown country"):
        vectors.split_rejects(importers.regions(features, countries), fail_fast=True)[0].count()


def test_files_in_pieces(spark, monkeypatch):
    """A file used to be built as one row of one group; now pieces are, and ranges of records reach over them."""
    import types
    from cartolith.plans import vector_files
    from cartolith.sources import shapefile
    parts = spark.range(400).select(F.col("id").alias("p_partkey"))
    tables = types.SimpleNamespace(base=lambda name: parts)
    want = sorted(vector_files._karst(tables).collect(), key=lambda r: (r.file, r.ordinal))
    assert len(want) == 400 and [r.ordinal for r in want] == [i for _ in range(5) for i in range(80)]
    monkeypatch.setattr(vector_files, "RECORDS_PER_PIECE", 7)
    monkeypatch.setattr(shapefile, "STRETCH", 700)
    seen = []
    decode = vector_files.decode_pieces
    monkeypatch.setattr(vector_files, "decode_pieces", lambda *pieces, per_task: seen.extend(pieces) or decode(*pieces, per_task))
    assert sorted(vector_files._karst(tables).collect(), key=lambda r: (r.file, r.ordinal)) == want
    shapes, index, table = seen
    for pieces in seen:  # without gaps
        rows = sorted(pieces.where("file = '/karst/3'").collect(), key=lambda r: r.at)
        assert len(rows) == 12 and all(a.at + len(a.content) == b.at for a, b in zip(rows, rows[1:])) and rows[0].at == 0
    assert max(len(r.content) for r in shapes.collect()) < 7 * 400 and index.count() == table.count() == 60
