"""Registered feeds: replays of the event table as streams and as batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from cartolith.functions.coords import Grid
from cartolith.params import TerrainParams
from cartolith.plans.derived import LAT, LON, Tables, with_tables
from cartolith.plans.geodesic_sql import geodesic_tables, recursive
from cartolith.plans.registry import registered
from cartolith.session import shared_folder
from cartolith.streaming import health, ledger, towns

_OUTCOME = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'skipped' ELSE 'failed' END"


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream(t: Tables) -> DataFrame:
    """The event table as a stream of files."""
    return t.spark.readStream.schema(t.base("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _events(t: Tables) -> DataFrame:
    return t.base("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _town_events(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("town-"), F.col("user_id").cast("string")).alias("town_uuid"),
                         F.concat(F.lit("Town "), F.col("user_id").cast("string")).alias("town_name"),
                         F.expr(LAT.format(k="event_id * 3")).alias("lat"), F.expr(LON.format(k="event_id * 3")).alias("lon"),
                         F.unix_micros("ts").alias("updated_at"), (F.col("event_type") == "error").alias("deleted"))


_TOWNS = with_tables("positions", "regions") + """
, last AS (SELECT user_id, arg_max(struct_pack(lat := lat, lon := lon, t := ts, gone := event_type = 'error'), struct_pack(t := ts, d := event_type = 'error')) AS v FROM positions GROUP BY user_id)
SELECT concat('town-', cast(user_id AS varchar)) AS town_uuid, round(v.lat, 6) + 0e0 AS latitude, round(v.lon, 6) + 0e0 AS longitude, min(r.id)::int AS region_id FROM last l
LEFT JOIN regions r ON v.lat BETWEEN r.min_lat AND r.max_lat AND v.lon BETWEEN r.min_lon AND r.max_lon WHERE NOT v.gone GROUP BY ALL"""


def _town_rows(df: DataFrame) -> DataFrame:
    return df.select("town_uuid", (F.round("latitude", 6) + 0.0).alias("latitude"), (F.round("longitude", 6) + 0.0).alias("longitude"), "region_id")


@registered("town_upserts", _TOWNS)
def town_upserts(t: Tables) -> DataFrame:
    """Every event moves its user's town, errors delete it; run as a stream to its end."""
    path = _folder(t, "towns")
    run = towns.start_upserts(_town_events(_stream(t)), path, _folder(t, "offsets"), t.country_shapes, t.region_shapes, t.dem, available_now=True)
    run.awaitTermination()
    return _town_rows(towns.current(t.spark, path))


@registered("town_backfill", _TOWNS)
def town_backfill(t: Tables) -> DataFrame:
    """The same rows from one batch, compacted."""
    path, target = _folder(t, "towns"), _folder(t, "towns-compact")
    towns.backfill(_town_events(_events(t)), path, 0, t.country_shapes, t.region_shapes, t.dem)
    towns.compact(t.spark, path, target)
    return _town_rows(towns.current(t.spark, target))


_LIVE = with_tables("positions") + """, last AS (SELECT user_id AS k, arg_max(struct_pack(lat := lat, lon := lon, gone := event_type = 'error'), struct_pack(t := ts, d := event_type = 'error')) AS v FROM positions GROUP BY user_id),
live AS (SELECT k, v.lat AS lat, v.lon AS lon FROM last WHERE NOT v.gone)"""


@registered("town_distances", recursive(_LIVE + f""", asked AS (SELECT DISTINCT user_id AS a, event_id * 31 % 1009 AS b FROM events),
{geodesic_tables("SELECT a * 100000 + b AS pid, p.lat AS lat1, p.lon AS lon1, q.lat AS lat2, q.lon AS lon2 FROM asked JOIN live p ON p.k = a JOIN live q ON q.k = b")}
SELECT concat('town-', cast(a AS varchar)) AS a, concat('town-', cast(b AS varchar)) AS b, round(meters, 3) + 0e0 AS meters FROM asked LEFT JOIN geodesic ON pid = a * 100000 + b"""))
def town_distances(t: Tables) -> DataFrame:
    """Distances between towns as they stand; towns that are gone, or never were, have none."""
    path = _folder(t, "towns")
    towns.backfill(_town_events(_events(t)), path, 0, t.country_shapes, t.region_shapes, None)
    named = [F.concat(F.lit("town-"), k.cast("string")).alias(c) for k, c in ((F.col("user_id"), "a"), (F.col("event_id") * 31 % 1009, "b"))]
    found = towns.distances(t.base("events").select(*named).distinct(), towns.current(t.spark, path))
    return found.select("a", "b", (F.round("meters", 3) + 0.0).alias("meters"))


@registered("town_distance_to_point", recursive(_LIVE + f""",
{geodesic_tables("SELECT event_id AS pid, l.lat AS lat1, l.lon AS lon1, p.lon / 2 AS lat2, p.lat * 2 AS lon2 FROM positions p JOIN live l ON l.k = p.user_id")}
SELECT p.event_id, round(meters, 3) + 0e0 AS meters FROM positions p LEFT JOIN geodesic g ON g.pid = p.event_id"""))
def town_distance_to_point(t: Tables) -> DataFrame:
    """Distance of every user's town as it stands to a position of the event."""
    path = _folder(t, "towns")
    towns.backfill(_town_events(_events(t)), path, 0, t.country_shapes, t.region_shapes, None)
    there = _events(t).select("event_id", F.concat(F.lit("town-"), F.col("user_id").cast("string")).alias("town"),
                              F.expr(f"({LON.format(k='event_id * 3')}) / 2").alias("lat"), F.expr(f"({LAT.format(k='event_id * 3')}) * 2").alias("lon"))
    found = towns.distances_to(there, towns.current(t.spark, path))
    return found.select("event_id", (F.round("meters", 3) + 0.0).alias("meters"))


@registered("edge_guard", """
SELECT event_id, CASE WHEN NOT inside THEN greatest(least(x, 20036.5e0), -20036.5e0) ELSE x END AS x, CASE WHEN NOT inside THEN greatest(least(z, 10017.5e0), -10017.5e0) ELSE z END AS z, NOT inside AS moved FROM (
 SELECT *, x >= -20037e0 AND x < 20037e0 AND z >= -10018e0 AND z < 10018e0 AS inside FROM (SELECT event_id, (event_id * 7919 % 60000) - 30000e0 AS x, (event_id * 104729 % 30000) - 15000e0 AS z FROM events))""")
def edge_guard(t: Tables) -> DataFrame:
    extent = Grid(TerrainParams(projection="plate_carree", origin_lat=0.0, origin_lon=0.0)).planet_extent()
    moved = towns.edge_guard(t._sql("SELECT event_id, (event_id * 7919 % 60000) - 30000e0 AS x, (event_id * 104729 % 30000) - 15000e0 AS z FROM {events}", "events"), extent)
    return moved.select("event_id", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"), "moved")


POLICY = health.HealthPolicy(stable_seconds=36_000)
_HEALTH = """
WITH e AS (SELECT user_id AS server, ts, CASE WHEN event_type = 'error' THEN 'low-tps' WHEN value > 400 THEN 'high-mspt' END AS reason FROM events),
m AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY server ORDER BY ts, CASE WHEN reason IS NULL THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS breaks FROM e),
s AS (SELECT *, min(CASE WHEN reason IS NULL THEN ts END) OVER (PARTITION BY server, breaks) AS since FROM m)
SELECT server, ts, reason IS NULL AND ts >= since + INTERVAL 36000 SECOND AS may_dispatch, CASE WHEN reason IS NOT NULL THEN reason WHEN ts >= since + INTERVAL 36000 SECOND THEN 'healthy' ELSE 'stabilizing' END AS decision FROM s"""


def _snapshots(events: DataFrame) -> DataFrame:
    readings = events.select(F.col("user_id").alias("server"), "ts", F.lit(False).alias("shutting_down"), F.lit(False).alias("recent_failure"), F.lit(True).alias("dem_available"),
                             F.lit(100).alias("disk_gb"), F.lit(0).alias("players"), F.when(F.col("event_type") == "error", 10.0).otherwise(20.0).alias("tps"),
                             F.when(F.col("value") > 400, 80.0).otherwise(20.0).alias("mspt"))
    return readings.select("server", "ts", health.health_reason(POLICY).alias("reason"))


@registered("health_decisions", _HEALTH)
def health_decisions(t: Tables) -> DataFrame:
    return health.health_decisions(_snapshots(_events(t)), POLICY, bucket="day").select("server", F.col("ts").cast("timestamp_ntz").alias("ts"), "may_dispatch", "decision")


@registered("health_stream", _HEALTH)
def health_stream(t: Tables) -> DataFrame:
    path = _folder(t, "health")
    run = (health.health_stream(_snapshots(_stream(t)), POLICY).writeStream.format("parquet").option("path", path)
           .option("checkpointLocation", _folder(t, "offsets")).trigger(availableNow=True).start())
    run.awaitTermination()
    return t.spark.read.schema("server bigint, ts timestamp, may_dispatch boolean, decision string").parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_LEDGER = f"""SELECT o_custkey AS job_id, count(*) FILTER ({_OUTCOME} = 'completed') AS completed, count(*) FILTER ({_OUTCOME} = 'skipped') AS skipped, count(*) FILTER ({_OUTCOME} = 'failed') AS failed FROM orders GROUP BY 1"""


@registered("job_ledger", _LEDGER)
def job_ledger(t: Tables) -> DataFrame:
    return ledger.outcome_counts(t.base("orders").select(F.col("o_custkey").alias("job_id"), F.expr(_OUTCOME).alias("outcome")))


@registered("job_ledger_stream", _LEDGER)
def job_ledger_stream(t: Tables) -> DataFrame:
    """Running counts in update mode; the newest row per job stays."""
    path = _folder(t, "ledger")
    stream = t.spark.readStream.schema(t.base("orders").schema).option("pathGlobFilter", "orders.parquet").parquet(t.sf_dir)
    counts = ledger.outcome_counts(stream.select(F.col("o_custkey").alias("job_id"), F.expr(_OUTCOME).alias("outcome")))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    run = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", _folder(t, "offsets")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = t.spark.read.parquet(path)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("completed", "skipped", "failed"), "batch").alias("r")).select("job_id", "r.*")


_STATES = "['PAUSED', 'RUNNING', 'AUTO_PAUSED', 'COMPLETED', 'CANCELLED'][event_id % 5 + 1]"


@registered("illegal_transitions", f"""
WITH s AS (SELECT user_id AS job_id, event_id AS seq, {_STATES} AS state, lag({_STATES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT job_id, seq, previous, state FROM s WHERE previous <> state AND NOT ((previous = 'PAUSED' AND state IN ('RUNNING', 'CANCELLED')) OR (previous = 'RUNNING' AND state <> 'RUNNING') OR (previous = 'AUTO_PAUSED' AND state IN ('RUNNING', 'PAUSED', 'CANCELLED')))""")
def illegal_transitions(t: Tables) -> DataFrame:
    states = F.array(*[F.lit(v) for v in ledger.TRANSITIONS])
    rows = t.base("events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("state"))
    return ledger.illegal_transitions(rows).select("job_id", "seq", "previous", "state")


@registered("remaining_work", """
WITH d AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM d)""")
def remaining_work(t: Tables) -> DataFrame:
    done = t.base("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return ledger.remaining(t.base("customer").select(F.col("c_custkey").alias("k")), done, ["k"])
