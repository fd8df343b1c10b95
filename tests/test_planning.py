"""Joins and fan-outs are planned from rows that were counted, not from the size of a file."""

import pytest
from pyspark.sql import functions as F

from cartolith.plans import lookups, worlds
from cartolith.plans.derived import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.mark.parametrize("build", [lookups.cities_within, lookups.nearest_entrance, lookups.water_column, worlds.flattest_footprint,
                                   worlds.chunk_fallback])
def test_no_table_is_broadcast_before_it_is_measured(tables, build):
    assert "Broadcast" not in build(tables)._jdf.queryExecution().sparkPlan().toString()


def test_chunks_are_spread_before_they_become_columns(tables):
    chunks = worlds.chunks(tables).coalesce(1)
    columns = worlds.tp.chunk_columns(chunks)
    cores = tables.spark.sparkContext.defaultParallelism
    assert columns.rdd.getNumPartitions() == 2 * cores
    assert columns.count() == 256 * chunks.count() == columns.select("bx", "bz").distinct().count()
    twice = worlds.tp.chunk_columns(chunks.unionByName(chunks))
    assert twice.groupBy("bx", "bz").count().agg(F.max("count")).first()[0] == 1


def test_settings_of_the_caller_are_kept(spark):
    caller = spark.newSession()
    caller.conf.set("spark.sql.shuffle.partitions", "3")
    caller.conf.set("spark.sql.autoBroadcastJoinThreshold", "5MB")
    assert Tables(caller, SMALL).spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert caller.conf.get("spark.sql.autoBroadcastJoinThreshold") == "5MB"


def test_flat_distance_ties_like_sql(spark):
    """The point of customer 77408 lies between two cities at distances that SQL finds equal."""
    from cartolith.functions.geodesy import flat_squared_degrees
    from cartolith.plans.derived import LAT, LON
    place = spark.sql(f"SELECT k, {LAT.format(k='k')} AS lat, {LON.format(k='k')} AS lon FROM VALUES (77408L), (47461L), (107355L) t(k)")
    at = {r.k: r for r in place.collect()}
    here = at[77408]
    d = [spark.range(1).select(flat_squared_degrees(*[F.lit(v) for v in (here.lat, here.lon, at[k].lat, at[k].lon)])).first()[0] for k in (47461, 107355)]
    assert d[0] == d[1] == 0.19378527616468294


def test_places_are_multiplied_after_the_shuffle(tables):
    from cartolith.operators import nearest
    rows = tables.cities.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.struct("id").alias("rank"), F.struct("id").alias("value"))
    plan = nearest._narrowed(rows, 0)._jdf.queryExecution().sparkPlan().toString()
    above = nearest._narrowed(nearest._narrowed(rows, 0), nearest.SPLIT_LEVELS)._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    # the join with the limits sits below the step that lists a place under every part of its cell
    assert above.index("Generate explode(_cells") < above.index("Join Inner")


@pytest.mark.parametrize("table", ["customer", "supplier", "part"])
def test_small_files_are_spread_before_they_fan_out(tables, table):
    assert tables.base(table).rdd.getNumPartitions() == 2 * tables.spark.sparkContext.defaultParallelism


def test_small_and_large_crossing_features(spark):
    """Features of few segments are not listed cell by cell; larger ones still are, with the same verdict."""
    from cartolith.operators import quality
    few = [(0.0, 0.0), (9.0, 9.0), (9.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    many = [(9.0 * i / 40, 9.0 * i / 40) for i in range(41)] + [(9.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    box = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]
    rows = spark.createDataFrame([(1, [few]), (2, [many]), (3, [box])], "id int, rings array<array<struct<lon:double,lat:double>>>")
    found = quality.invalid_geometry(rows)
    assert {r.entity: r.message for r in found.collect()} == {"1": "self-intersection", "2": "self-intersection"}
    assert quality.SMALL_FEATURE < len(many)
