"""Tiles, grids and the files they come from."""

import struct

import numpy as np
import pytest

from cartolith.operators import raster, tiles
from cartolith.operators.raster import build_landcover_index, dem_blocks, landcover_blocks
from cartolith.sources import rasters

TILE = "lat_deg int, lon_deg int, width int, height int, samples array<double>"


def tile(lat, lon, grid):
    grid = np.asarray(grid, dtype=object)
    return lat, lon, grid.shape[1], grid.shape[0], [None if v is None else float(v) for v in grid.ravel()]


def bump():
    grid = np.zeros((5, 5))
    grid[2, 2] = 400
    return grid


@pytest.mark.parametrize("block", [2, 128])
def test_point_and_mean(spark, block):
    dem = dem_blocks(spark.createDataFrame([tile(50, 8, bump())], TILE), block)
    points = spark.createDataFrame([(1, 50.5, 8.5, 0.5, 0.5), (2, 10.0, 10.0, 0.5, 0.5), (3, 50.5, 8.5, 0.01, 0.01)], "id int, lat double, lon double, lat_span double, lon_span double")
    at = {r.id: r.elevation_m for r in raster.elevation_at(points, dem).collect()}
    assert at[1] == 400.0 and at[2] is None
    mean = {r.id: r.elevation_m for r in raster.footprint_mean(points, dem, ["id"]).collect()}
    assert mean[1] == pytest.approx(400 / 9) and mean[2] is None and mean[3] == 400.0


def test_shared_edge_counts_once_and_closing_edges(spark):
    rows = [tile(50, 8, np.full((3, 3), 100)), tile(50, 9, np.full((3, 3), 300)), tile(89, 10, np.full((2, 2), 42)), tile(10, 179, np.full((2, 2), 17))]
    dem = dem_blocks(spark.createDataFrame(rows, TILE))
    points = spark.createDataFrame([(1, 50.5, 8.95, 1.0, 0.9)], "id int, lat double, lon double, lat_span double, lon_span double")
    assert raster.footprint_mean(points, dem, ["id"]).first().elevation_m == 200.0
    edges = spark.createDataFrame([(1, 90.0, 10.5), (2, 10.5, 180.0)], "id int, lat double, lon double")
    assert {r.id: r.elevation_m for r in raster.elevation_at(edges, dem).collect()} == {1: 42.0, 2: 17.0}


def test_blocks_agree_with_whole_tiles(spark):
    rng = np.random.default_rng(1)
    grid = rng.normal(0, 300, (61, 45)).astype(object)
    grid[rng.random(grid.shape) < 0.2] = None
    frame = spark.createDataFrame([tile(0, 0, grid), tile(0, 1, grid[:, ::-1])], TILE)
    spots = [(i, float(rng.uniform(0, 1)), float(rng.uniform(0, 2)), float(rng.uniform(0.02, 1.4)), float(rng.uniform(0.02, 1.4))) for i in range(120)]
    points = spark.createDataFrame(spots, "id int, lat double, lon double, lat_span double, lon_span double")
    results = [{r.id: (r.a, r.elevation_m) for r in raster.footprint_mean(raster.elevation_at(points, dem_blocks(frame, b), "a"), dem_blocks(frame, b), ["id"]).collect()} for b in (7, 128)]
    for k in results[0]:
        for a, b in zip(results[0][k], results[1][k]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-12))


def test_bathymetry_merge(spark):
    land = spark.createDataFrame([tile(0, 0, [[12, 0, None], [8, -1, None]])], TILE)
    sea = spark.createDataFrame([tile(0, 0, [[-10, -20], [-30, -40]])], TILE)
    row = raster.merge_bathymetry(land, sea).first()
    assert row.samples == [12.0, -20.0, -20.0, 8.0, -40.0, -40.0] and row.bathymetry


def test_landcover_lookup(spark):
    texts = spark.createDataFrame([("a.asc", "ncols 2\nnrows 2\nxllcorner 37\nyllcorner 55\ncellsize 0.5\nNODATA_value -9999\n10 50\n90 -9999\n")], "file_name string, value string")
    grids = rasters.parse_ascii_grids(texts)
    points = spark.createDataFrame([(1, 55.9, 37.1), (2, 55.9, 37.9), (3, 55.1, 37.1), (4, 55.1, 37.9), (5, 0.0, 0.0)], "id int, lat double, lon double")
    for block in (1, 64):
        index = build_landcover_index(landcover_blocks(grids, block))
        assert index.single
        got = {r.id: r.landcover for r in raster.landcover_at(points, index, ["id"]).collect()}
        assert got == {1: "TREE_COVER", 2: "BUILT_UP", 3: "HERBACEOUS_WETLAND", 4: "UNKNOWN", 5: "UNKNOWN"}


def test_file_readers(spark, tmp_path):
    np.array([[1, 2], [-32768, 4]], dtype=">i2").tofile(tmp_path / "N50E008.hgt")
    (tmp_path / "N51E008.hgt").write_bytes(b"abc")
    (tmp_path / "what.hgt").write_bytes(b"\0" * 8)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in rasters.read_hgt(spark, str(tmp_path)).collect()}
    assert rows["N50E008.hgt"].samples == [1.0, 2.0, None, 4.0] and rows["N51E008.hgt"].status == "not a square grid"
    assert rows["what.hgt"].status == "unrecognised name"

    def dem(name, south, west, body, version=2, encoding=1, flags=0):
        head = struct.pack(">iHHiiiiiiiB", rasters.DEM_MAGIC, version, encoding, 2, 2, south, west, -32768, 1, 2, flags)
        (tmp_path / name).write_bytes(head.ljust(64, b"\0") + body)
    dem("S01W002.tfdem", -1, -2, np.array([2, 4, -32768, 8], dtype=">i2").tobytes(), flags=1)
    dem("N01E002.tfdem", 1, 3, np.zeros(4, dtype=">i2").tobytes())
    dem("N02E002.tfdem", 2, 2, np.array([1.5, np.nan, 2, 3], dtype=">f4").tobytes(), version=1, encoding=2)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in rasters.read_dem_tiles(spark, str(tmp_path)).collect()}
    assert rows["S01W002.tfdem"].samples == [1.0, 2.0, None, 4.0] and rows["S01W002.tfdem"].bathymetry
    assert rows["N01E002.tfdem"].status == "name and header disagree"
    assert rows["N02E002.tfdem"].samples == [0.75, None, 1.0, 1.5] and rows["N02E002.tfdem"].bathymetry
    summary = tiles.catalogue_summary(rasters.tile_catalogue(spark, str(tmp_path))).first()
    assert (summary.tiles, summary.corrupt, summary.has_bathymetry) == (2, 1, True)
    files = tiles.dataset_fingerprint(rasters.list_files(spark, str(tmp_path)), str(tmp_path)).first()
    assert len(files.fingerprint) == 64


def test_tile_store_keeps_existing(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([tile(0, 0, [[1, 1], [1, 1]])], TILE)
    second = spark.createDataFrame([tile(0, 0, [[9, 9], [9, 9]]), tile(0, 1, [[2, 2], [2, 2]])], TILE)
    tiles.write_tiles(first, path)
    tiles.write_tiles(second, path)
    assert {(r.lon_deg, r.samples[0]) for r in spark.read.parquet(path).collect()} == {(0, 1.0), (1, 2.0)}
    tiles.write_tiles(second.filter("lon_deg = 0"), path, replace=True)
    assert {(r.lon_deg, r.samples[0]) for r in spark.read.parquet(path).collect()} == {(0, 9.0), (1, 2.0)}
    tiles.write_table_if_free(first, str(tmp_path / "free"))
    with pytest.raises(Exception):
        tiles.write_table_if_free(first, str(tmp_path / "free"))


def test_transcode_rejects_out_of_range(spark):
    rows = spark.createDataFrame([(1, False, [1.4, None, 2.5]), (2, False, [40000.0]), (3, True, [1.25])], "id int, fractional boolean, samples array<double>")
    got = {r.id: r for r in tiles.transcode(rows, "int16").collect()}
    assert got[1].samples == [1.0, None, 3.0] and got[1].void_count == 1 and got[1].reject_reason is None
    assert got[2].reject_reason and got[3].encoding == "float32"
