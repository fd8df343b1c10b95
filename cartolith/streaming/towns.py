"""Location feeds: enrich positions, keep the newest per key, forget deleted keys.

State lives in a folder of plain parquet. Every micro-batch writes one directory named by its
batch id, so a repeated batch overwrites itself; the current table is the newest entry per key.
Compaction folds old directories into a base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartolith.functions.coords import Extent, Grid
from cartolith.functions.geodesy import vincenty_m
from cartolith.operators.raster import elevation_at
from cartolith.operators.shapes import ShapeIndex, locate

KEY = "town_uuid"
COLUMNS = ["town_uuid", "town_name", "latitude", "longitude", "elevation", "country_id", "region_id", "updated_at", "deleted"]


def enrich(events: DataFrame, countries: ShapeIndex, regions: ShapeIndex, dem: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows for the town table from events with a position (lat, lon), ``updated_at`` and ``deleted``."""
    found = locate(locate(events, countries, key, "_c"), regions, key, "_r")
    found = elevation_at(found, dem, "elevation") if dem is not None else found.withColumn("elevation", F.lit(None).cast("double"))
    return found.select("town_uuid", "town_name", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "elevation",
                        F.col("_c.id").cast("int").alias("country_id"), F.col("_r.id").cast("int").alias("region_id"),
                        "updated_at", "deleted")


def newest(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """The last operation of each key; a deletion wins over a save of the same moment.

    Partial maxima are taken before the shuffle, so a key with very many updates sends one row
    per task.
    """
    rest = [c for c in rows.columns if c != KEY]
    order = order if order is not None else F.struct("updated_at", "deleted")
    return rows.groupBy(KEY).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(KEY, "_r.*").select(*rows.columns)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as it stands: newest entry per key, deleted keys left out."""
    rows = spark.read.parquet(path).drop("batch")
    return newest(rows).filter("NOT deleted").select(*COLUMNS[:-1])


def save_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write the newest entry per key of one batch; writing the same batch again changes nothing."""
    newest(rows).select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Fold a state folder into a fresh one that holds the newest entries only."""
    newest(spark.read.parquet(path).drop("batch")).write.mode("errorifexists").parquet(f"{target}/batch=-1")


def start_upserts(stream: DataFrame, path: str, checkpoint: str, countries: ShapeIndex, regions: ShapeIndex,
                  dem: DataFrame | None, available_now: bool = False):
    """Run the feed: events need town_uuid, town_name, lat, lon, updated_at and deleted.

    Each batch keeps the newest event per key before the lookups, so repeated updates of a key
    cost one lookup.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        save_batch(enrich(newest(batch), countries, regions, dem, [KEY]), batch_id, path)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def backfill(towns: DataFrame, path: str, batch_id: int, countries: ShapeIndex, regions: ShapeIndex, dem: DataFrame | None,
             name: str | None = None) -> None:
    """Refresh every town, or one by name, through the same rows as the feed."""
    chosen = towns if name is None else towns.filter(F.lower("town_name") == name.lower())
    save_batch(enrich(newest(chosen), countries, regions, dem, [KEY]), batch_id, path)


def distances(pairs: DataFrame, table: DataFrame, a: str = "a", b: str = "b", out: str = "meters") -> DataFrame:
    """pairs of town keys with the ellipsoidal distance in metres; null where a town is not in the table now.

    ``table`` has one row per town, as :func:`current` gives it. Each way of a pair is worked out once, however often it is asked.
    """
    spot = table.select(F.col(KEY).alias("_k"), F.struct("latitude", "longitude").alias("_at"))
    asked = pairs.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    first, second = (spot.select(F.col("_k").alias(k), F.col("_at").alias(at)) for k, at in (("_a", "_p"), ("_b", "_q")))
    known = asked.join(first, "_a").join(second, "_b").select(
        "_a", "_b", vincenty_m(F.col("_p.latitude"), F.col("_p.longitude"), F.col("_q.latitude"), F.col("_q.longitude")).alias(out))
    keyed = pairs.drop(out).withColumns({"_a": F.when(F.col(b).isNotNull(), F.least(a, b)), "_b": F.when(F.col(a).isNotNull(), F.greatest(a, b))})
    return keyed.join(known, ["_a", "_b"], "left").drop("_a", "_b")


def distances_to(points: DataFrame, table: DataFrame, town: str = "town", lat: str = "lat", lon: str = "lon", out: str = "meters") -> DataFrame:
    """points with the ellipsoidal distance in metres from a town to a position; null where the town is not in the table now."""
    spot = table.select(F.col(KEY).alias("_k"), F.struct("latitude", "longitude").alias("_at"))
    met = points.drop(out).join(spot, F.col(town) == F.col("_k"), "left")
    return met.withColumn(out, vincenty_m(F.col("_at.latitude"), F.col("_at.longitude"), F.col(lat), F.col(lon))).drop("_k", "_at")


def edge_guard(positions: DataFrame, extent: Extent, inset: float = 0.5, x: str = "x", z: str = "z") -> DataFrame:
    """Move positions outside the extent just inside it; works on batches and streams alike."""
    outside = ~extent.contains(F.col(x), F.col(z))
    return (positions.withColumn("moved", outside)
            .withColumn("_x", F.when(outside, extent.clamp_x(F.col(x), inset)).otherwise(F.col(x)))
            .withColumn("_z", F.when(outside, extent.clamp_z(F.col(z), inset)).otherwise(F.col(z)))
            .drop(x, z).withColumnsRenamed({"_x": x, "_z": z}))

